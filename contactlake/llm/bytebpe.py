"""Byte-level BPE: texts to ids by the tokenizers library, and ids back to bytes and text."""
from __future__ import annotations

import base64
import codecs
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from contactlake.llm.tables import on_workers
from contactlake.llm.textarrays import blocks
from contactlake.llm.tokens import byte_letters

# Pieces of one of the two generations that a worker remembers, and the longest piece kept.
REMEMBERED = 150_000
LONGEST = 64
# Text that is split into pieces at once.
BLOCK_BYTES = 1 << 20
# Ids that are decoded at once.
BLOCK_IDS = 1 << 17

# Letters, digits and space of these characters are the same in every version of Unicode's tables.
_SETTLED = regex.compile(r"[\x00-ɏ]*").fullmatch
# What a character is to the pattern, and a character of that kind that no literal in it names.
_KINDS = ((r"\p{L}", "a"), (r"\p{N}", "0"), (r"\s", "\t"))
_OTHER = "!"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: base64 and a number on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class ByteTable:
    """The byte table of a rank file, reversed: bytes of every id."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self._start = np.cumsum(self.length) - self.length
        self._bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def starts(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """First byte of each id within its own text."""
        size = self.length[ids]
        before = np.cumsum(size) - size
        has = np.diff(first) > 0
        return before - np.repeat(before[first[:-1][has]], np.diff(first)[has])

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Bytes of all id lists, where each list's bytes start, and the number of bytes of each id."""
        known = (ids >= 0) & (ids < len(self.length))
        at = np.where(known, ids, 0)
        size = np.where(known, self.length[at], 0)
        end = np.cumsum(size)
        place = np.repeat(self._start[at] - (end - size), size) + np.arange(end[-1] if len(end) else 0)
        return self._bytes[place].tobytes(), np.r_[0, end][first], size


class RankCoder:
    """A rank file as a BPE model of the tokenizers library, over the printable letters of bytes.

    A rank file merges every neighbouring pair whose joint bytes are a token, lowest rank first.
    The library merges listed pairs, so every way to split a token into two tokens is listed, in
    order of the token's rank.  Pieces of text are the matches of the pattern; each distinct
    piece goes through the library once, as a word of one sequence whose offsets, in letters and
    so in bytes, show where it ends, and is held against the rank file's own library.
    """

    def __init__(self, path: str, pattern: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer, models

        ranks = read_ranks(path)
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary has every single byte")
        self._letter = dict(enumerate(byte_letters()))
        name = {t: t.decode("latin-1").translate(self._letter) for t in ranks}
        merges = []
        for token, rank in sorted(ranks.items(), key=lambda t: t[1]):
            ways = [(ranks[token[:i]], ranks[token[i:]], i) for i in range(1, len(token))
                    if token[:i] in ranks and token[i:] in ranks]
            merges += [(name[token[:i]], name[token[i:]]) for _, _, i in sorted(ways)]
        self._library = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges))
        self._exact = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._tiktoken = tiktoken
        self._pattern = regex.compile(pattern)
        self.table = ByteTable(ranks)
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._stand_in: dict[int, str] | None = None

    def _stand_ins(self) -> dict[int, str]:
        """Characters that the two pattern libraries take for different kinds, and what to split in their place."""
        every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
        single = {bytes([b]): b for b in range(256)}
        kind, mine = dict.fromkeys(every, _OTHER), dict.fromkeys(every, _OTHER)
        for pattern, letter in _KINDS:
            # only what the pattern matches is encoded, here into single bytes
            probe = self._tiktoken.Encoding("kind", pat_str=pattern, mergeable_ranks=single, special_tokens={})
            kind.update(dict.fromkeys(bytes(probe.encode_ordinary(every)).decode(), letter))
            mine.update(dict.fromkeys(regex.findall(pattern, every), letter))
        return {ord(c): k for c, k in kind.items() if k != mine[c]}

    def split(self, text: str) -> list[str]:
        """Matches of the pattern, as the rank file's own library finds them."""
        if _SETTLED(text):
            return self._pattern.findall(text)
        if self._stand_in is None:
            self._stand_in = self._stand_ins()
        plain = text.translate(self._stand_in)
        found = self._pattern.findall(plain)
        if plain == text:
            return found
        out, at = [], 0
        for piece in found:
            out.append(text[at:at + len(piece)])
            at += len(piece)
        return out

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each piece."""
        words = [p.encode().decode("latin-1").translate(self._letter) for p in pieces]
        found = self._library.encode(words, is_pretokenized=True, add_special_tokens=False)
        # a word's first token is the one whose offset is 0
        ids, begin = np.array(found.ids, "<i4"), np.array(found.offsets, np.int64).reshape(-1, 2)[:, 0]
        cut = np.r_[np.flatnonzero(begin == 0), len(ids)]
        exact = list(map(self._exact.encode_ordinary, pieces))
        size = np.fromiter(map(len, exact), np.int64, len(exact))
        checked = np.fromiter(chain.from_iterable(exact), "<i4", int(size.sum()))
        if len(cut) != len(pieces) + 1 or not np.array_equal(ids, checked) or not np.array_equal(np.diff(cut), size):
            ids, cut = checked, np.r_[0, np.cumsum(size)]
        raw, at = ids.tobytes(), (4 * cut).tolist()
        return [raw[a:b] for a, b in zip(at, at[1:])]

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of all given pieces; long ones are not remembered."""
        young, old = self._young, self._old
        new = []
        for p in pieces.difference(young):
            ids = old.get(p)
            if ids is None:
                new.append(p)
            else:
                young[p] = ids
        look = young
        for lo in range(0, len(new), 4096):
            part = new[lo:lo + 4096]
            young.update(zip(part, self.encode_pieces(part)))
        long = [p for p in new if len(p) > LONGEST]
        if len(young) > REMEMBERED or long:
            look = dict(young)
            for p in long:
                del young[p]
        if len(young) > REMEMBERED:
            self._old, self._young = young, {}
        return look

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where those of each text start; one more entry closes the last."""
        parts = list(map(self.split, texts))
        look = self._learn(set(chain.from_iterable(parts))).__getitem__
        raw = [b"".join(map(look, p)) for p in parts]
        first = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) // 4, out=first[1:])
        return np.frombuffer(b"".join(raw), "<i4"), first


def token_texts(raw: bytes, sizes: np.ndarray) -> list[str]:
    """The text of each token; a character over several tokens belongs to the one that ends it.

    Broken bytes give U+FFFD, at the latest with the last token.
    """
    ends = np.cumsum(sizes)
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        reader, out, lo = codecs.getincrementaldecoder("utf-8")("replace"), [], 0
        for hi in ends.tolist():
            out.append(reader.decode(raw[lo:hi], hi == len(raw)))
            lo = hi
        return out
    lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    # characters that end at or before each token's end
    upto = np.r_[0, np.cumsum(lead)]
    closed = np.r_[lead, True]
    done = upto[ends] - ~closed[ends]
    return [text[a:b] for a, b in zip([0, *done.tolist()], done.tolist())]


@lru_cache(maxsize=2)
def byte_table(path: str) -> ByteTable:
    return ByteTable(read_ranks(path))


@lru_cache(maxsize=2)
def rank_coder(path: str, pattern: str) -> RankCoder:
    return RankCoder(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           offsets: bool = False) -> DataFrame:
    """doc_id and ids of every whole text, and starts (first byte of each id in the text) if ``offsets``.

    ``path`` is a rank file, ``pattern`` splits texts before merging; no token crosses a match.
    The strings of special tokens are ordinary text.  Null and empty texts have no ids.  Null
    and repeated ids are kept as they are, an empty table gives no rows and other columns are
    ignored.  No row moves; a worker keeps the ids of the pieces it met last.
    """
    id_type = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        coder = rank_coder(path, pattern)
        for batch in batches:
            for b in blocks(batch, text_col, BLOCK_BYTES):
                ids, first = coder.encode(b.column(text_col).fill_null("").to_pylist())
                columns, names = [b.column(id_col), _lists(ids, first)], ["doc_id", "ids"]
                if offsets:
                    columns, names = [*columns, _lists(coder.table.starts(ids, first), first)], [*names, "starts"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return on_workers(docs).select(id_col, text_col).mapInArrow(
        run, f"doc_id {id_type}, ids ARRAY<INT>" + (", starts ARRAY<INT>" if offsets else ""))


def _lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.astype(np.int32)))


def _ends(lists: pa.Array) -> np.ndarray:
    """Where each list starts; one more entry closes the last.  Null lists are empty."""
    return np.r_[0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))]


def _few_ids(batch: pa.RecordBatch, at: int):
    """The batch in pieces of about BLOCK_IDS ids, whole rows each."""
    first, lo = _ends(batch.column(at)), 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + BLOCK_IDS, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", texts: bool = False) -> DataFrame:
    """All columns, with ``bytes`` (binary) of each id list, and ``pieces`` (text of each id) if ``texts``.

    In ``pieces`` a character whose bytes lie in several ids belongs to the id that ends it, the
    others have an empty share of it; bytes that are no UTF-8 show as U+FFFD.  A null list has no
    bytes; an id that is null or outside the vocabulary stands for no bytes.  Columns of the same
    names are replaced.
    """
    kept = [c for c in encoded.columns if c not in ("bytes", "pieces")]
    at = kept.index(ids_col)
    schema = encoded.select(*kept).schema.add("bytes", "binary")
    if texts:
        schema = schema.add("pieces", T.ArrayType(T.StringType()))

    def run(batches):
        table = byte_table(path)
        for batch in batches:
            for b in _few_ids(batch, at):
                lists = b.column(at)
                first = _ends(lists)
                ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                raw, begin, sizes = table.decode(ids, first)
                rows = [raw[lo:hi] for lo, hi in zip(begin[:-1].tolist(), begin[1:].tolist())]
                columns = [*b.columns, pa.array(rows, pa.binary())]
                if texts:
                    cut = first.tolist()
                    columns.append(pa.array([token_texts(r, sizes[i:j]) for r, i, j in zip(rows, cut, cut[1:])],
                                            pa.list_(pa.string())))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return on_workers(encoded).select(*kept).mapInArrow(run, schema)
