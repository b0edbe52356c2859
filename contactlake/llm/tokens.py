"""Token counts by byte-pair merging of many words at once in ragged arrays."""
from __future__ import annotations

import json
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from contactlake.llm.tables import on_workers
from contactlake.llm.textarrays import blocks

# Fixed values of the tokenizer family: its word pattern and the end-of-word mark.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"

# Letters whose kind, case and composition are the same in every version of Unicode's tables.
_SETTLED = regex.compile(r"[\x00-\u024f]*").fullmatch

# Known words kept by one worker; beyond this the memory starts again.
REMEMBERED = 600_000
_NONE = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class WordBpe:
    """Byte-level BPE with word ends, read from a ``tokenizers`` json file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self._special = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        self._word = regex.compile(WORD_PATTERN)
        self._path, self._library = path, None
        letters = byte_letters()
        self._inner = np.array([vocab[c] for c in letters], np.int32)
        self._last = np.array([vocab[c + WORD_END] for c in letters], np.int32)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.uint32)
        right = np.array([vocab[b] for _, b in merges], np.uint32)
        self._merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self._keys(left << np.uint32(16) | right)
        self.known: dict[bytes, int] = {}

    def _keys(self, keys: np.ndarray) -> None:
        """Two-step table from a pair of symbols to its rank; the first rank of a pair counts."""
        slot = self._slot(keys)
        self._key = np.zeros(1 << 20, np.uint32)
        self._rank = np.full(1 << 20, _NONE, np.int32)
        first = np.unique(slot, return_index=True)[1]
        self._key[slot[first]], self._rank[slot[first]] = keys[first], first
        rest = np.setdiff1d(np.arange(len(keys)), first)
        rest = rest[np.argsort(keys[rest], kind="stable")]
        self._more, self._more_rank = keys[rest], rest.astype(np.int32)
        self._shared = np.zeros(1 << 20, bool)
        self._shared[slot[rest]] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(2654435761)) >> np.uint32(12)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.uint32) << np.uint32(16) | b.astype(np.uint32)
        slot = self._slot(keys)
        out = np.where(self._key[slot] == keys, self._rank[slot], _NONE)
        again = np.flatnonzero((out == _NONE) & self._shared[slot])
        if len(again) and len(self._more):
            at = np.minimum(np.searchsorted(self._more, keys[again]), len(self._more) - 1)
            hit = self._more[at] == keys[again]
            out[again[hit]] = self._more_rank[at[hit]]
        return out

    def pieces(self, chunk: bytes) -> tuple[list[bytes], int]:
        """Words of a chunk without ASCII space, normalised, and how many special tokens it holds."""
        if chunk.isalpha():
            return [chunk.lower()], 0
        text, specials, out = chunk.decode("utf-8", "replace"), 0, []
        parts = [text]
        if self._special.search(text):
            specials, parts = len(self._special.findall(text)), self._special.split(text)
        for part in parts:
            if _SETTLED(part):
                out += [w.encode() for w in self._word.findall(part.lower())]
            else:
                out += self._by_library(part)
        return out, specials

    def _by_library(self, part: str) -> list[bytes]:
        """Words as the library's own tables of letters and digits find them."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
            self._byte = {c: b for b, c in enumerate(byte_letters())}
        plain = self._library.normalizer.normalize_str(part)
        return [bytes(map(self._byte.__getitem__, w)) for w, _ in self._library.pre_tokenizer.pre_tokenize_str(plain)]

    def merge_counts(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each word when its lowest-ranked pair is merged until none is left."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        symbol = self._inner[np.frombuffer(b"".join(words), np.uint8)]
        end = np.cumsum(size)
        symbol[end - 1] = self._last[np.frombuffer(b"".join(w[-1:] for w in words), np.uint8)]
        count = size.copy()
        alive = np.arange(len(words))
        while len(alive):
            size = count[alive]
            start = np.cumsum(size) - size
            rank = np.full(len(symbol), _NONE, np.int32)
            rank[:-1] = self.ranks(symbol[:-1], symbol[1:])
            rank[start + size - 1] = _NONE
            lowest = np.minimum.reduceat(rank, start)
            go = lowest != _NONE
            if not go.all():
                keep = np.repeat(go, size)
                alive, size, lowest = alive[go], size[go], lowest[go]
                symbol, rank = symbol[keep], rank[keep]
                if not len(alive):
                    break
            pick = rank == np.repeat(lowest, size)
            # of overlapping pairs every second one goes, from the left
            run = pick[1:] & pick[:-1]
            if run.any():
                at = np.flatnonzero(pick)
                fresh = np.r_[True, np.diff(at) != 1]
                begin = at[fresh][np.cumsum(fresh) - 1]
                pick[at[(at - begin) % 2 == 1]] = False
            at = np.flatnonzero(pick)
            symbol[at] = self._merged[rank[at]]
            gone = np.zeros(len(symbol), bool)
            gone[at + 1] = True
            owner = np.repeat(np.arange(len(alive)), size)
            count[alive] = size - np.bincount(owner[at], minlength=len(alive))
            symbol = symbol[~gone]
        return count

    def learn(self, chunks: set[bytes]) -> None:
        """Add the counts of chunks not met before."""
        new = chunks.difference(self.known)
        if not new:
            return
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = chunks
        split = {c: self.pieces(c) for c in new}
        words = list({w for ws, _ in split.values() for w in ws}.difference(self.known))
        known = self.known
        if words:
            known.update(zip(words, self.merge_counts(words).tolist()))
        for c, (ws, specials) in split.items():
            if specials or len(ws) != 1 or ws[0] != c:
                known[c] = specials + sum(known[w] for w in ws)

    def counts(self, texts: list[bytes]) -> list[int]:
        """Tokens of each text."""
        parts = [t.split() for t in texts]
        self.learn(set(chain.from_iterable(parts)))
        look = self.known.__getitem__
        return [sum(map(look, p)) for p in parts]


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and n_tokens of every whole text; no row moves.

    Null and empty texts have 0 tokens.  Null ids and repeated rows are kept as they are, an
    empty table gives no rows and other columns are ignored.  Texts are split at ASCII white
    space, which no token crosses, and a distinct chunk is merged once per worker.
    """
    schema = docs.select(id_col).schema
    id_type = schema[0].dataType.simpleString()

    def run(batches):
        bpe = word_bpe(path)
        for batch in batches:
            for b in blocks(batch, text_col):
                texts = b.column(text_col).fill_null("").cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [b.column(id_col), pa.array(list(map(len, texts)), pa.int64()),
                     pa.array(bpe.counts(texts), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return on_workers(docs).select(id_col, text_col).mapInArrow(run, f"doc_id {id_type}, n_bytes LONG, n_tokens LONG")
