"""Words of whole texts as numpy arrays, straight from Arrow buffers.

A word is a run of bytes outside space and 9-13, with A-Z lowered.  Words are known by a
64-bit hash; the hash of every word of a block comes from one running sum over its bytes.
"""
from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

# A block ends with the document that takes it to this many bytes; documents are never cut.
BLOCK_BYTES = 4 << 20
BLOCK_ROWS = 1 << 16
# Bits of a shingle's hash.
SHINGLE_BITS = 47

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit number over all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        out = np.full(size, base, np.uint64)
        out[0] = 1
        out = np.multiply.accumulate(out)
        if size > 4 * BLOCK_BYTES:
            return out
        _powers[name] = have = out
    return have[:n]


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept between calls."""
    return _power(str(base), np.uint64(base), n)


class Words(NamedTuple):
    doc: np.ndarray     # document of each word, by its place in the block
    hash: np.ndarray    # 64-bit hash of each word, in text order
    first: np.ndarray   # first word of each document; one more entry closes the last


def string_block(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and where each row starts; nulls are empty."""
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    if data is None or not len(col):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    start = int(offsets[0])
    return np.frombuffer(data, np.uint8)[start:int(offsets[-1])], offsets.astype(np.int64) - start


def blocks(batch: pa.RecordBatch, text: str, size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``size`` bytes of text, whole rows each."""
    if not batch.num_rows:
        return
    _, at = string_block(batch.column(text))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, min(lo + BLOCK_ROWS, int(np.searchsorted(at, at[lo] + size, "right")) - 1))
        yield batch.slice(lo, hi - lo)
        lo = hi


def words(data: np.ndarray, at: np.ndarray) -> Words:
    """Words of a block given as bytes and row offsets."""
    n, rows = len(data), len(at) - 1
    if not n:
        return Words(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64))
    ink = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = ink[:-1]
    before[edge[:n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = ink[1:]
    after[edge[1:]] = False
    start = np.flatnonzero(ink & ~before)
    end = np.flatnonzero(ink & ~after) + 1
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * _power("base", _BASE, n), out=total[1:])
    hashes = mix((total[end] - total[start]) * _power("inverse", _BASE_INVERSE, n)[start] + (end - start).astype(np.uint64))
    first = np.searchsorted(start, at)
    doc = np.repeat(np.arange(rows), np.diff(first))
    return Words(doc, hashes, first)


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word of a block and the byte behind its last, in the order of words()."""
    ink = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    start = np.flatnonzero(ink & (edge[:-1] | ~np.r_[False, ink[:-1]][:len(data)]))
    end = np.flatnonzero(ink & (edge[1:] | ~np.r_[ink[1:], False][:len(data)])) + 1
    return start, end


def hash_word(word: str) -> int:
    """Hash of one word, as words() gives it."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(words(raw, np.array([0, len(raw)])).hash[0])


_STEP = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)


class Sets(NamedTuple):
    first: np.ndarray   # first member of each document's set; one more entry closes the last
    member: np.ndarray  # distinct shingle hashes, sorted within a document


def shingle_sets(w: Words, width: int = 5) -> Sets:
    """Distinct runs of ``width`` words of each document; a shorter text is one run, an empty one none.

    A block has at most BLOCK_ROWS documents.
    """
    rows = len(w.first) - 1
    count = np.diff(w.first)
    total = len(w.hash)
    if total < width:
        run, doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    else:
        run = np.zeros(total - width + 1, np.uint64)
        for k in range(width):
            run += mix(w.hash[k:total - width + 1 + k]) * np.uint64(_STEP[k % len(_STEP)] + 2 * (k // len(_STEP)))
        whole = w.doc[:total - width + 1] == w.doc[width - 1:]
        run, doc = mix(run[whole]), w.doc[:total - width + 1][whole]
    few = np.flatnonzero((count > 0) & (count < width))
    if len(few):
        short = np.zeros(len(few), np.uint64)
        for k in range(width - 1):
            has = count[few] > k
            short[has] += mix(w.hash[w.first[few[has]] + k]) * np.uint64(_STEP[k % len(_STEP)] + 2 * (k // len(_STEP)))
        short = mix(short + count[few].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        run, doc = np.concatenate([run, short]), np.concatenate([doc, few])
    # the document above the hash in one number, so that one plain sort serves both
    key = doc.astype(np.uint64) << np.uint64(SHINGLE_BITS) | run >> np.uint64(64 - SHINGLE_BITS)
    key.sort()
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    first = np.searchsorted(key, np.arange(rows + 1, dtype=np.uint64) << np.uint64(SHINGLE_BITS))
    return Sets(first, key & np.uint64((1 << SHINGLE_BITS) - 1))
