"""Documents as token pieces, packed first-fit decreasing into sequences."""
from __future__ import annotations

import re
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlake.llm.tables import on_workers, stage
from contactlake.llm.textarrays import blocks, string_block, word_spans, words
from contactlake.llm.tokens import _SETTLED as settled
from contactlake.llm.tokens import WORD_END, WORD_PATTERN, WordBpe, byte_letters

# Pieces of one group: enough for close packing, small enough for one task.
GROUP_PIECES = 4096
# Known words of one of the two generations that a worker keeps.
REMEMBERED = 300_000


class WordIds:
    """Ids of texts by the tokenizers library, which sees every distinct word once.

    Words are found as in WordBpe; the library's model takes many of them, already split, in one
    call, and the ids are cut behind those that carry the end-of-word mark.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._model = Tokenizer(self._library.model)
        self._words = WordBpe(path)
        self._letter = dict(enumerate(byte_letters()))
        self._pattern = regex.compile(f"{WORD_PATTERN}| ")
        self._special = regex.compile("|".join(map(regex.escape, self._words.special)) or r"(?!)")
        self._special_bytes = re.compile(b"|".join(re.escape(t.lower().encode()) for t in self._words.special) or rb"(?!)")
        vocab = self._library.get_vocab()
        self._ends = np.zeros(max(vocab.values()) + 1, bool)
        self._ends[[i for t, i in vocab.items() if t.endswith(WORD_END)]] = True
        # two generations: the older one goes when the younger is full, so frequent words stay
        self.known: dict[bytes, bytes] = {}
        self._older: dict[bytes, bytes] = {}

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self._library.encode(text, add_special_tokens=False).ids, "<u4")

    def _encode_words(self, given: list[bytes]) -> list[bytes]:
        letters = [w.decode("latin-1").translate(self._letter) for w in given]
        ids = np.array(self._model.encode(letters, is_pretokenized=True, add_special_tokens=False).ids, "<u4")
        cut = np.flatnonzero(self._ends[ids]) + 1
        if len(cut) != len(given):
            return [self._encode(w.decode("utf-8", "replace")).tobytes() for w in given]
        raw, cut = ids.tobytes(), (cut * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *cut], cut)]

    def _learn_plain(self, chunks: list[bytes], text: str) -> None:
        """Chunks of settled letters without special tokens, joined by spaces in ``text``: one pattern pass for all."""
        known, older = self.known, self._older
        flat = self._pattern.findall(text.lower())
        distinct = set(flat)
        distinct.discard(" ")
        ids = {w: known.get(k) or older.get(k) for w, k in zip(distinct, map(str.encode, distinct))}
        new = [w for w, found in ids.items() if found is None]
        for lo in range(0, len(new), 4096):
            part = new[lo:lo + 4096]
            raw = list(map(str.encode, part))
            found = self._encode_words(raw)
            ids.update(zip(part, found))
            known.update(zip(raw, found))
        cuts = [i for i, w in enumerate(flat) if w == " "]
        look = ids.__getitem__
        for c, a, b in zip(chunks, [0, *(i + 1 for i in cuts)], [*cuts, len(flat)]):
            known[c] = ids[flat[a]] if b - a == 1 else b"".join(map(look, flat[a:b]))

    def learn(self, chunks: set[bytes]) -> dict[bytes, bytes]:
        """Ids of all given chunks, and of others met before."""
        known, older = self.known, self._older
        new = chunks.difference(known)
        if older:
            met = new.intersection(older)
            known.update((c, older[c]) for c in met)
            new -= met
        plain, odd = list(new), []
        text = b" ".join(plain).decode("utf-8", "replace")
        if not self._plain(text):
            plain, odd = [], []
            for c in new:
                (plain if self._plain(c.decode("utf-8", "replace")) else odd).append(c)
            text = b" ".join(plain).decode("utf-8", "replace")
        if plain:
            self._learn_plain(plain, text)
        for c in odd:
            ws, specials = self._words.pieces(c)
            known[c] = self._encode(c.decode("utf-8", "replace")).tobytes() if specials else b"".join(self._encode_words(ws))
        if len(known) > REMEMBERED:
            self._older, self.known = known, {}
        return known

    def _plain(self, text: str) -> bool:
        return bool(settled(text)) and not self._special.search(text)

    def ids(self, texts: pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text.

        Words of a block are numbered by their hash, the numbering is checked byte by byte, and the
        ids of a block are gathered from those of its distinct words.  A block that holds a special
        token's string is taken word by word, since case counts there.
        """
        data, at = string_block(texts)
        low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        raw = low.tobytes()
        found = None if self._special_bytes.search(raw) else _numbered(low, at)
        if found is None:
            parts = [(t or b"").split() for t in texts.cast(pa.binary()).to_pylist()]
            look = self.learn(set(chain.from_iterable(parts))).__getitem__
            return [b"".join(map(look, p)) for p in parts]
        start, end, number, first = found
        chunks = [raw[a:b] for a, b in zip(start.tolist(), end.tolist())]
        pieces = list(map(self.learn(set(chunks)).__getitem__, chunks))
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        flat, begin = np.frombuffer(b"".join(pieces), "<u4"), np.cumsum(size) - size
        n = size[number]
        upto = np.r_[0, np.cumsum(n)]
        ids = flat[np.repeat(begin[number] - upto[:-1], n) + np.arange(upto[-1])].tobytes()
        cut = (4 * upto[first]).tolist()
        return [ids[a:b] for a, b in zip(cut, cut[1:])]


def _numbered(low: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Where each distinct word of a block stands, the number of each word and the first word of each text.

    None if two words share a hash.
    """
    w = words(low, at)
    start, end = word_spans(low, at)
    _, place, number = np.unique(w.hash, return_index=True, return_inverse=True)
    size = end - start
    if not np.array_equal(size, size[place][number]):
        return None
    at_byte = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    if not np.array_equal(low[np.repeat(start, size) + at_byte], low[np.repeat(start[place][number], size) + at_byte]):
        return None
    return start[place], end[place], number, w.first


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


class OpenBins:
    """Tournament tree over bins: each node holds the most room left below it."""

    def __init__(self, bins: int):
        self.leaves = 1
        while self.leaves < bins:
            self.leaves *= 2
        self.room = [0] * (2 * self.leaves)

    def set(self, bin_: int, room: int) -> None:
        i, tree = bin_ + self.leaves, self.room
        tree[i] = room
        i >>= 1
        while i:
            best = tree[2 * i] if tree[2 * i] >= tree[2 * i + 1] else tree[2 * i + 1]
            if tree[i] == best:
                break
            tree[i] = best
            i >>= 1

    def first(self, size: int) -> int:
        """First bin with at least this room, or -1."""
        tree, i = self.room, 1
        if tree[1] < size:
            return -1
        while i < self.leaves:
            i *= 2
            if tree[i] < size:
                i += 1
        return i - self.leaves


def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each size, taken in the given (decreasing) order."""
    bins, used, tree = [], 0, OpenBins(len(sizes))
    offsets = []
    for s in sizes:
        b = tree.first(s)
        if b < 0:
            b, used = used, used + 1
            room = capacity
        else:
            room = tree.room[tree.leaves + b]
        bins.append(b)
        offsets.append(capacity - room)
        tree.set(b, room - s)
    return bins, offsets


def document_pieces(docs: DataFrame, path: str, capacity: int, end_id: int,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, start, length, ids_crc32, doc_tokens."""
    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches):
        coder = word_ids(path)
        for batch in batches:
            for b in blocks(batch, text_col):
                row, start, length, crc, whole = [], [], [], [], []
                for i, ids in enumerate(coder.ids(b.column(text_col).fill_null(""))):
                    ids += tail
                    n = len(ids) // 4
                    for lo in range(0, n, capacity):
                        row.append(i)
                        start.append(lo)
                        length.append(min(capacity, n - lo))
                        crc.append(zlib.crc32(ids[4 * lo:4 * (lo + capacity)]))
                        whole.append(n)
                yield pa.RecordBatch.from_arrays(
                    [b.column(id_col).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, whole))],
                    names=names)

    return on_workers(docs).select(id_col, text_col).mapInArrow(
        run, f"doc_id {id_type}, start LONG, length LONG, ids_crc32 LONG, doc_tokens LONG")


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, seed: int = 7,
         id_col: str = "doc_id", text_col: str = "text", group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pieces with sequence_id and offset: each sequence holds at most ``capacity`` ids.

    A document is cut every ``capacity`` ids, so only its last piece leaves room.  Pieces are
    dealt into groups by a seeded hash of id, start and content, about ``group_pieces`` each,
    and every group is packed by itself, longest first, ties by id, start and content.
    ``sequence_id`` is group * 2^32 + number of the sequence in its group.

    Null and empty texts are one piece, the end id.  Rows with null or repeated ids are pieces
    of their own; equal rows may trade places.  An empty table gives no rows; other columns
    are ignored.
    """
    pieces = stage(document_pieces(docs, path, capacity, end_id, id_col, text_col))
    groups = max(1, -(-pieces.count() // group_pieces))
    keyed = pieces.withColumn("_group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32", "doc_tokens"),
                                               F.lit(groups)))

    def run(pdf):
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True],
                              kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(pdf["length"].tolist(), capacity)
        pdf["sequence_id"] = int(pdf["_group"].iloc[0]) * 2**32 + np.array(bins, np.int64)
        pdf["offset"] = np.array(offsets, np.int64)
        return pdf.drop(columns="_group")

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return keyed.groupBy("_group").applyInPandas(run, f"{fields}, sequence_id LONG, offset LONG")
