"""GIF files: round trips, hand-made files and the rules of showing frames."""
import hashlib
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import no_documents, odd_documents, odd_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from contactlake.llm.gif import (WIDTH, canvases, decode, encode, lzw_codes, lzw_decode, pack_codes, text_media)


def slow_lzw(codes):
    """Textbook decoder over whole codes."""
    table, out, last = {}, b"", None
    for c in codes:
        if c == 256:
            table, last = {i: bytes([i]) for i in range(256)} | {256: b"", 257: b""}, None
            continue
        if c == 257:
            break
        entry = table[c] if c in table else last + last[:1]
        out += entry
        if last is not None and len(table) < 4096:
            table[len(table)] = last + entry[:1]
        last = entry
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9000), st.sampled_from([1, 2, 5, 256]), st.integers(0, 9))
def test_lzw_round_trip(n, letters, seed):
    data = np.random.Generator(np.random.PCG64(seed)).integers(0, letters, n).astype(np.uint8).tobytes()
    codes = lzw_codes(data)
    assert slow_lzw(codes) == data
    assert lzw_decode(pack_codes(np.array(codes)), 8).tobytes() == data


def test_a_full_table_that_is_not_cleared():
    data = np.random.Generator(np.random.PCG64(4)).integers(0, 256, 6000).astype(np.uint8).tobytes()
    codes, table, run = [256], {}, data[:1]
    known = {bytes([i]): i for i in range(256)}
    for b in data[1:]:
        longer = run + bytes([b])
        if longer in known:
            run = longer
            continue
        codes.append(known[run])
        if 258 + len(table) < 4096:
            known[longer] = 258 + len(table)
            table[longer] = True
        run = bytes([b])
    codes += [known[run], 257]
    assert lzw_decode(pack_codes(np.array(codes)), 8).tobytes() == data


def test_bad_streams_are_refused():
    with pytest.raises(ValueError):
        lzw_decode(pack_codes(np.array([256, 300, 257])), 8)
    for bad in (b"", b"GIF89a", b"PNG....", encode(b"x" * WIDTH)[:-20]):
        with pytest.raises(ValueError):
            decode(bad)


def gif(frames, size=(4, 4), palette=(0, 0, 0, 255, 255, 255, 255, 0, 0, 0, 0, 255)):
    """Small GIF of frames (left, top, width, height, pixels, disposal, transparent, interlaced)."""
    out = b"GIF89a" + struct.pack("<HHBBB", *size, 0x81, 0, 0) + bytes(palette)
    for left, top, w, h, pixels, disposal, transparent, interlaced in frames:
        codes = [4]
        for p in pixels:    # a clear before each pair keeps all codes at three bits
            codes += [p, 4]
        codes.append(5)
        bits = 0
        for k, c in enumerate(codes):
            bits |= c << 3 * k
        raw = bits.to_bytes(-(-3 * len(codes) // 8), "little")
        out += b"\x21\xF9\x04" + struct.pack("<BHB", disposal << 2 | (transparent >= 0), 5, max(0, transparent)) + b"\0"
        out += b"\x21\xFE\x02hi\0"
        out += b"\x2C" + struct.pack("<HHHHB", left, top, w, h, 0x40 if interlaced else 0)
        out += b"\x02" + bytes([len(raw)]) + raw + b"\0"
    return out + b"\x3B"


def shown(data):
    return [c[..., 0].astype(int).tolist() for c, _ in ((c.copy(), d) for c, d in canvases(decode(data)))]


def test_disposal_and_transparency():
    white = (0, 0, 4, 4, [1] * 16, 1, -1, False)
    spot = (1, 1, 2, 2, [0, 3, 0, 0], 3, 3, False)
    after = (0, 0, 1, 1, [2], 2, -1, False)
    last = (3, 3, 1, 1, [1], 0, -1, False)
    a, b, c, d = shown(gif([white, spot, after, last]))
    assert a == [[255] * 4] * 4
    assert b[1][1:3] == [0, 255] and b[2][1:3] == [0, 0] and b[0] == [255] * 4
    assert c[0][0] == 255 and c[1][1] == 255                 # the spot was put back
    assert d[0][0] == 0 and d[3][3] == 255                   # the corner was cleared


def test_interlaced_rows():
    pixels = [r % 4 for r in (0, 8, 4, 2, 6, 1, 3, 5, 7, 9)]
    f = decode(gif([(0, 0, 1, 10, pixels, 0, -1, True)], size=(1, 10))).frames[0]
    assert f.index.ravel().tolist() == [r % 4 for r in range(10)]


def test_texts_come_back_from_their_files(spark):
    rows = text_media(odd_documents(spark)).collect()
    want = Counter()
    for d in odd_rows():
        raw = (d[1] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        want[(d[0], len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    for r in rows:
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
    same = {}
    for d, r in zip(odd_rows(), rows):
        same.setdefault(r.payload_sha256, set()).add((r.feature, r.media_sha256))
    assert all(len(v) == 1 for v in same.values())
    assert text_media(no_documents(spark)).collect() == []
