"""GIF as a media column: texts stored as timed frames, and any GIF read back.

Reading decodes LZW code streams without a loop over codes.  A code above the literals names
an earlier code of its segment, and its string is a copy of earlier output that is one byte
longer than that code's own string; lengths and bytes follow by pointer doubling.
"""
from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from contactlake.llm.tables import on_workers
from contactlake.llm.textarrays import blocks

WIDTH = 192
# Rows of a frame; longer payloads go on in the next frame.
FRAME_ROWS = 192
DELAY_CS = 10
HISTOGRAM_BINS = 8
_FULL = 4096


class Frame(NamedTuple):
    index: np.ndarray            # palette index of every pixel, (height, width)
    palette: np.ndarray          # (n, 3)
    left: int
    top: int
    delay_cs: int
    disposal: int                # 0, 1: leave, 2: clear to background, 3: put back what was there
    transparent: int             # palette index that shows what is below, or -1


class Gif(NamedTuple):
    width: int
    height: int
    frames: list[Frame]


# --- LZW -------------------------------------------------------------------------------

@lru_cache(maxsize=16)
def _schedule(literal_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Width of each code after a clear, and the bit where it starts; until the table is full."""
    base = (1 << literal_bits) + 2
    ready = base + np.maximum(0, np.arange(_FULL - base + 2) - 1)
    width = np.clip(np.ceil(np.log2(ready + 1)).astype(np.int64), literal_bits + 1, 12)
    return width, np.cumsum(width) - width


def lzw_codes(data: bytes) -> list[int]:
    """Codes of 8-bit data, clear and end codes included."""
    codes = [256]
    put = codes.append
    table: dict[int, int] = {}
    look, free = table.get, 258
    stream = iter(data)
    run = next(stream)
    for b in stream:
        key = run << 8 | b
        code = look(key)
        if code is not None:
            run = code
            continue
        put(run)
        run = b
        if free < 4096:
            table[key] = free
            free += 1
        else:
            put(256)
            table.clear()
            free = 258
    put(run)
    put(257)
    return codes


def pack_codes(codes: np.ndarray, literal_bits: int = 8) -> bytes:
    """Codes as a little-endian bit stream under the width schedule."""
    clear = 1 << literal_bits
    width_after, _ = _schedule(literal_bits)
    at = np.arange(len(codes))
    fresh = np.zeros(len(codes), bool)
    fresh[1:] = codes[:-1] == clear
    begin = np.maximum.accumulate(np.where(fresh, at, 0))
    width = width_after[np.minimum(at - begin, len(width_after) - 1)]
    width[0] = literal_bits + 1
    bit = np.cumsum(width) - width
    spread = codes << (bit & 7)
    size = int(bit[-1] + width[-1] + 7) // 8
    out = np.zeros(size + 2, np.int64)
    for k in range(3):
        out += np.bincount((bit >> 3) + k, (spread >> 8 * k) & 255, minlength=size + 2)[:size + 2].astype(np.int64)
    return out[:size].astype(np.uint8).tobytes()


def _strings(codes: np.ndarray, literal_bits: int) -> np.ndarray:
    """Bytes of the codes between two clears."""
    base, n = (1 << literal_bits) + 2, len(codes)
    at = np.arange(n)
    ref = codes - base
    is_ref = ref >= 0
    if (ref >= at).any() or (~is_ref & (codes >= base - 2)).any():
        raise ValueError("code before its entry")
    jump = np.where(is_ref, ref, at)
    hops = is_ref.astype(np.int64)
    while True:
        further = hops[jump]
        if not further.any():
            break
        hops = hops + further
        jump = jump[jump]
    length = hops + 1
    end = np.cumsum(length)
    start = end - length
    total = int(end[-1])
    shift = np.where(is_ref, start[np.where(is_ref, ref, 0)], start) - start
    source = np.arange(total) + np.repeat(shift, length)
    while True:
        next_source = source[source]
        if np.array_equal(next_source, source):
            break
        source = next_source
    literal = np.zeros(total, np.uint8)
    literal[start[~is_ref]] = codes[~is_ref]
    return literal[source]


def lzw_decode(data: bytes, literal_bits: int) -> np.ndarray:
    """Bytes of a code stream; a missing end code ends with the data."""
    clear, stop = 1 << literal_bits, (1 << literal_bits) + 1
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    width_after, bit_after = _schedule(literal_bits)
    bits, bit, out, kept = 8 * len(data), 0, [], []

    def read(width: np.ndarray, start: np.ndarray) -> np.ndarray:
        i = start >> 3
        return (raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16) >> (start & 7) & ((1 << width) - 1)

    while True:
        if kept:    # the table is full and was not cleared: 12-bit codes follow
            width = np.full(_FULL, 12)
            start = bit + 12 * np.arange(_FULL)
        else:
            width, start = width_after, bit + bit_after
        room = int(np.searchsorted(start + width, bits, "right"))
        codes = read(width[:room], start[:room])
        mark = np.flatnonzero((codes == clear) | (codes == stop))
        n = int(mark[0]) if len(mark) else room
        kept.append(codes[:n])
        ended = not len(mark) and room < len(width) or len(mark) and codes[n] == stop
        if len(mark) or ended:
            segment = np.concatenate(kept)
            if len(segment):
                out.append(_strings(segment, literal_bits))
            kept = []
        if ended:
            break
        bit = int(start[n] + width[n]) if len(mark) else int(start[room - 1] + width[room - 1])
    return np.concatenate(out) if out else np.zeros(0, np.uint8)


# --- files -----------------------------------------------------------------------------

def palette_332() -> np.ndarray:
    """256 colours: three bits of red and green, two of blue; index and colour determine each other."""
    i = np.arange(256)
    return np.stack([(i >> 5) * 255 // 7, (i >> 2 & 7) * 255 // 7, (i & 3) * 85], axis=1).astype(np.uint8)


_PALETTE = palette_332()


def _sub_blocks(data: bytes) -> bytes:
    whole = len(data) // 255 * 255
    full = np.frombuffer(data[:whole], np.uint8).reshape(-1, 255)
    framed = np.insert(full, 0, 255, axis=1).tobytes()
    rest = data[whole:]
    return framed + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def encode(payload: bytes, width: int = WIDTH, frame_rows: int = FRAME_ROWS, delay_cs: int = DELAY_CS) -> bytes:
    """GIF whose frames hold the payload, one byte a pixel; its length is a positive multiple of ``width``."""
    rows = len(payload) // width
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, frame_rows), 0xF7, 0, 0), _PALETTE.tobytes()]
    for lo in range(0, rows, frame_rows):
        part = payload[lo * width:(lo + frame_rows) * width]
        out += [b"\x21\xF9\x04", struct.pack("<BHB", 1 << 2, delay_cs, 0), b"\0",
                b"\x2C", struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0),
                b"\x08", _sub_blocks(pack_codes(np.array(lzw_codes(part))))]
    return b"".join([*out, b"\x3B"])


def decode(data: bytes) -> Gif:
    """Frames of a GIF87a or GIF89a file, interlaced or not; ValueError if it is none."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at, common = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        common = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n

    def blocks_from(at: int) -> tuple[bytes, int]:
        parts = []
        while (n := data[at]):
            parts.append(data[at + 1:at + 1 + n])
            at += n + 1
        return b"".join(parts), at + 1

    frames: list[Frame] = []
    delay, disposal, transparent = 0, 0, -1
    try:
        while data[at] != 0x3B:
            kind = data[at]
            if kind == 0x21:
                label = data[at + 1]
                body, at = blocks_from(at + 2)
                if label == 0xF9:
                    packed, delay, index = struct.unpack("<BHB", body[:4])
                    disposal, transparent = packed >> 2 & 7, index if packed & 1 else -1
            elif kind == 0x2C:
                left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at + 1)
                at += 10
                palette = common
                if packed & 0x80:
                    n = 2 << (packed & 7)
                    palette = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
                    at += 3 * n
                if palette is None:
                    raise ValueError("no palette")
                bits = data[at]
                stream, at = blocks_from(at + 1)
                pixels = lzw_decode(stream, bits)[:w * h]
                if len(pixels) < w * h:
                    raise ValueError("pixels missing")
                index = pixels.reshape(h, w)
                if packed & 0x40:
                    order = [r for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(first, h, step)]
                    index = index[np.argsort(order)]
                frames.append(Frame(index, palette, left, top, delay, disposal, transparent))
                delay, disposal, transparent = 0, 0, -1
            else:
                raise ValueError("unknown block")
    except (IndexError, struct.error) as e:
        raise ValueError("file ends early") from e
    return Gif(width, height, frames)


def canvases(gif: Gif) -> Iterator[tuple[np.ndarray, int]]:
    """What the screen shows at each frame, (height, width, 4) with alpha, and for how many 1/100 s."""
    canvas = np.zeros((gif.height, gif.width, 4), np.uint8)
    for f in gif.frames:
        before = canvas.copy() if f.disposal == 3 else None
        h, w = f.index.shape
        here = canvas[f.top:f.top + h, f.left:f.left + w]
        index = f.index[:here.shape[0], :here.shape[1]]
        full = np.zeros((256, 4), np.uint8)
        full[:len(f.palette), :3] = f.palette
        full[:, 3] = 255
        if f.transparent >= 0:
            show = index != f.transparent
            here[show] = full[index[show]]
        else:
            here[...] = full[index]
        yield canvas, f.delay_cs
        if f.disposal == 2:
            canvas[f.top:f.top + h, f.left:f.left + w] = 0
        elif before is not None:
            canvas = before


def feature(gif: Gif, bins: int = HISTOGRAM_BINS) -> str:
    """Frames, running time and the brightness histogram of all shown pixels, in thousandths."""
    count, time = np.zeros(bins, np.int64), 0
    for canvas, delay in canvases(gif):
        rgb = canvas[canvas[..., 3] > 0].astype(np.int32)
        grey = (299 * rgb[:, 0] + 587 * rgb[:, 1] + 114 * rgb[:, 2]) // 1000
        count += np.bincount(grey * bins >> 8, minlength=bins)
        time += delay
    share = count * 1000 // max(1, int(count.sum()))
    return f"{len(gif.frames)};{time};" + ",".join(map(str, share))


# --- operator --------------------------------------------------------------------------

def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """Every whole text as a GIF, read back: sizes, digests and features of what was stored.

    The payload is the UTF-8 text with spaces appended up to a positive multiple of the width.
    Columns: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature and, with ``keep_media``, media.  The payload columns come from the
    decoded file.  Null and empty texts are one row of spaces.  Ids may be null or repeat; each
    row stands for itself and moves nowhere.  Other columns are ignored.
    """
    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
             "feature", *(["media"] if keep_media else [])]

    def one(text: bytes) -> tuple:
        media = encode(text + b" " * ((-len(text)) % WIDTH if text else WIDTH))
        gif = decode(media)
        payload = b"".join(f.index.tobytes() for f in gif.frames)
        return (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]),
                len(media), hashlib.sha256(media).hexdigest(), feature(gif), media)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def run(batches):
        for batch in batches:
            for b in blocks(batch, text_col):
                rows = [one(t) for t in b.column(text_col).fill_null("").cast(pa.binary()).to_pylist()]
                columns = [pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names) - 1)]
                yield pa.RecordBatch.from_arrays([b.column(id_col), *columns], names=names)

    return on_workers(docs).select(id_col, text_col).mapInArrow(
        run, f"doc_id {id_type}, n_bytes LONG, payload_bytes LONG, payload_sha256 STRING, tail_crc32 LONG, "
             "media_bytes LONG, media_sha256 STRING, feature STRING" + (", media BINARY" if keep_media else ""))
