"""Language-model scores from an n-gram trie in Elias-Fano levels.

The model is a bigram model with a Dirichlet prior: p(w | c) = (n(c, w) + k p(w)) / (n(c) + k),
p(w) = (n(w) + 1) / (N + V + 1).  A context is any word or the start of a text; behind a word that
no training text holds p(w | c) is p(w).  With ``pooled_below`` above 1, words seen less often than
that (and all below the ``CONTEXTS`` most frequent) are one context together.

Words are counted over all tasks first.  Then every token goes, with its context's hash, to the
shard of its word; the shard counts the training tokens, builds its part of the trie, and scores
its tokens, training and held out alike.  A hot word has several shards, by context.  The
logarithm of n(c) + k is a term of its own, so it is added where c is the word: no shard needs
the counts of contexts.
"""
from __future__ import annotations

import os
import tempfile
import zlib
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlake.llm.calibrate import remainder
from contactlake.llm.tables import highest, log_level, on_workers, stage, task_count
from contactlake.llm.textarrays import Words, blocks, mix, string_block, words

# Words that are contexts of their own at most, when rare ones are pooled.
CONTEXTS = 65_534
# A word that may be hot has this many training tokens at least.
_HOT_LEAST = 16
PRIOR = 4_000.0
# Steps of stored log10 probabilities; they are rounded down.
STEPS = 4_096
END = np.uint64(0x5851F42D4C957F2D)
_START, _OTHER = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25)
_SALT = np.uint64(0xD6E8FEB86659FD93)


# --- Elias-Fano ------------------------------------------------------------------------

class EliasFano:
    """A rising sequence as low bits and unary gaps of the high bits."""

    def __init__(self, low_bits: int, low: np.ndarray, upper: np.ndarray, size: int):
        self.low_bits, self.low, self.size = low_bits, low, size
        bits = np.unpackbits(upper, bitorder="little")
        self._one = np.flatnonzero(bits)[:size]
        self._zero = np.flatnonzero(bits == 0)

    @staticmethod
    def encode(values: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """low_bits, low bits of each value, upper bit string."""
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // max(1, n)).bit_length() - 1)
        kind = np.uint8 if low_bits <= 8 else np.uint16 if low_bits <= 16 else np.uint32 if low_bits <= 32 else np.int64
        high = (values >> low_bits).astype(np.int64)
        bits = np.zeros(n + (top >> low_bits) + 2, np.uint8)
        bits[high + np.arange(n)] = 1
        return low_bits, (values & ((1 << low_bits) - 1)).astype(kind), np.packbits(bits, bitorder="little")

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return (self._one[i] - i << self.low_bits) | self.low[i]

    def successor(self, value: np.ndarray) -> np.ndarray:
        """Place of the first element that is not smaller, for each value up to the last one's bucket."""
        high = value >> self.low_bits
        high = np.minimum(high, len(self._zero) - 1)
        at = np.where(high > 0, self._zero[high - 1] - high + 1, 0)
        stop = self._zero[high] - high
        low = value & ((1 << self.low_bits) - 1)
        todo = np.flatnonzero(at < stop)
        while len(todo):
            middle = at[todo] + stop[todo] >> 1
            less = self.low[middle] < low[todo]
            at[todo[less]] = middle[less] + 1
            stop[todo[~less]] = middle[~less]
            todo = todo[at[todo] < stop[todo]]
        return at


class Trie:
    """Words of a shard and the contexts they were seen after, in a memory-mapped file.

    Level one holds the words, their pointers into level two and the log10 of their own
    probability; level two the contexts of all words, each word's shifted behind the last one's
    so that the level rises as a whole, and the log10 of each pair's probability.
    """

    def __init__(self, word: np.ndarray, single: np.ndarray, pair_word: np.ndarray, context: np.ndarray, joint: np.ndarray,
                 bits: int = 16):
        """``word``: sorted hashes; pairs as places of their word, rising, then by context, a number of ``bits`` bits."""
        self._bits = bits
        pointer = np.searchsorted(pair_word, np.arange(len(word) + 1))
        levels = {
            "word": word, "single": _stored(single), "joint": _stored(joint)}
        self._low = {}
        for name, values in (("pointer", pointer.astype(np.int64)), ("pair", pair_word.astype(np.int64) << bits | context)):
            self._low[name], levels[name + "_low"], levels[name + "_upper"] = EliasFano.encode(values)
        fd, path = tempfile.mkstemp(suffix=".trie")
        with os.fdopen(fd, "wb") as f:
            at = {}
            for name, a in levels.items():
                f.write(b"\0" * (-f.tell() % 8))
                at[name] = (f.tell(), a.dtype, len(a))
                a.tofile(f)
        # the file is gone from its folder at once and from the disk with the last map
        maps = {name: np.memmap(path, t, "r", start, n) if n else np.zeros(0, t) for name, (start, t, n) in at.items()}
        os.unlink(path)
        self._word, self._single, self._joint = maps["word"], maps["single"], maps["joint"]
        self._pointer = EliasFano(self._low["pointer"], maps["pointer_low"], maps["pointer_upper"], len(word) + 1)
        self._pair = EliasFano(self._low["pair"], maps["pair_low"], maps["pair_upper"], len(context))

    def single(self, at: np.ndarray) -> np.ndarray:
        return self._single[at].astype(float) / -STEPS

    def joint(self, at: np.ndarray, context: np.ndarray) -> np.ndarray:
        """log10 p(word | context) of pairs that were seen, nan of others."""
        out = np.full(len(at), np.nan)
        if self._pair.size:
            place = self._pair.successor(at << self._bits | context)
            ok = np.flatnonzero(place < self._pointer[at + 1])
            ok = ok[self._pair[place[ok]] == (at[ok] << self._bits | context[ok])]
            out[ok] = self._joint[place[ok]].astype(float) / -STEPS
        return out


def _stored(log10: np.ndarray) -> np.ndarray:
    return np.ceil(-log10 * STEPS).clip(0, 65_535).astype(np.uint16)


# --- counting and scoring --------------------------------------------------------------

def tokens(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Words of each document and one end behind them: hash and document."""
    rows = len(w.first) - 1
    where = w.first[1:]
    return np.insert(w.hash, where, END), np.insert(w.doc, where, np.arange(rows))


def listed(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash stands in a sorted table."""
    if not len(table):
        return np.zeros(len(h), bool)
    return table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h


class Contexts(NamedTuple):
    """What a shard has to know of contexts besides its own words."""

    texts: int                          # training texts: how often the start was seen
    frequent: np.ndarray | None = None  # sorted hashes of the words that are not pooled; None: nothing is
    other: int = 0                      # how often the class of pooled words was seen

    def of(self, h: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Context of each token of a block."""
        out = np.empty(len(h), np.uint64)
        out[1:] = h[:-1] if self.frequent is None else np.where(listed(self.frequent, h[:-1]), h[:-1], _OTHER)
        out[np.r_[True, doc[1:] != doc[:-1]][:len(h)]] = _START
        return out

    def seen(self, word: np.ndarray, count: np.ndarray) -> np.ndarray:
        """How often each word, seen ``count`` times, was a context."""
        return count if self.frequent is None else np.where(listed(self.frequent, word), count, self.other)


def shard_scores(word_count: dict[int, int], parts: list[tuple], contexts: Contexts, total: int, kinds: int,
                 prior: float) -> list[np.ndarray]:
    """Base, model score and known tokens of each document of each part.

    A part: word hashes (one each), tokens of each, place of each token's context in the last entry,
    documents, held-out flags, hashes of contexts.  ``word_count``: counts of words of which this shard
    sees only some tokens.  What a document's contexts take off is added with the words they are, and
    for the start with the end.
    """
    word, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    cut = np.cumsum([0, *(len(p[0]) for p in parts)])
    at = at.astype(np.int32)
    place = [np.repeat(at[a:b], p[1]) for a, b, p in zip(cut, cut[1:], parts)]
    names, number = np.unique(np.concatenate([p[5] for p in parts]), return_inverse=True)
    bits = max(1, len(names).bit_length())
    name_cut = np.cumsum([0, *(len(p[5]) for p in parts)])
    pair = np.concatenate([i.astype(np.int64) << bits | number[a:b][p[2]]
                           for i, a, b, p in zip(place, name_cut, name_cut[1:], parts)])
    del at, number
    asked, back = np.unique(pair, return_inverse=True)
    del pair
    back = back.astype(np.uint32)
    n = np.bincount(back[np.concatenate([~p[4][p[3]] for p in parts])], minlength=len(asked))
    learned, n = asked[n > 0], n[n > 0]
    count = np.bincount(learned >> bits, n, minlength=len(word)).astype(np.int64)
    for h, c in word_count.items():
        i = int(np.searchsorted(word, np.uint64(h)))
        if i < len(word) and word[i] == np.uint64(h):
            count[i] = c
    single = np.log10((count + 1) / (total + kinds + 1))
    pair_word, context = learned >> bits, learned & (1 << bits) - 1
    # over the same number everywhere, so that no logarithm is above zero
    whole = np.log10(total + prior)
    trie = Trie(word, single, pair_word, context, np.log10(n + prior * 10 ** single[pair_word]) - whole, bits)
    a_word = asked >> bits
    score = trie.joint(a_word, asked & (1 << bits) - 1)
    unseen = np.isnan(score)
    score[unseen] = trie.single(a_word[unseen]) + np.log10(prior) - whole
    taken = np.log10(contexts.seen(word, count) + prior) - whole
    taken[word == END] = np.log10(contexts.texts + prior) - whole
    out, lo = [], 0
    for i, p in zip(place, parts):
        rows, these = len(p[4]), back[lo:lo + len(i)]
        lo += len(i)
        out.append(np.stack([np.bincount(p[3], single[i], rows), np.bincount(p[3], score[these] - taken[i], rows),
                             np.bincount(p[3], count[i] > 0, rows)]))
    return out


def language_scores(docs: DataFrame, modulus: int = 7, held_remainder: int = 2, id_col: str = "doc_id",
                    text_col: str = "text", prior: float = PRIOR, pooled_below: int = 16) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Words as in textarrays, then one end.  Rows whose crc32(id as text) has ``held_remainder``
    are scored but not learned from.  Null and empty texts are the end alone.  A null id is not
    held out; repeated rows count each.  Words with fewer than ``pooled_below`` training tokens are one
    context together; with 1 every word is a context of its own.  With nothing to learn from every token is new.  An empty
    table gives no rows; other columns are ignored.
    """
    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    shards = task_count(docs.sparkSession)
    texts = on_workers(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                                    F.coalesce(remainder(id_col, modulus) == held_remainder, F.lit(False)).alias("held_out"))

    def shard_of(h: np.ndarray) -> np.ndarray:
        return ((mix(h) >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)

    # counts of all training words, summed in each task first
    def count(batches):
        have, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def rows():
            order = np.argsort(shard_of(have), kind="stable")
            cut = np.searchsorted(shard_of(have)[order], np.arange(shards + 1, dtype=np.uint64))
            full = np.flatnonzero(np.diff(cut)).tolist()
            return pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int32()),
                 pa.array([have[order[cut[k]:cut[k + 1]]].tobytes() for k in full], pa.binary()),
                 pa.array([times[order[cut[k]:cut[k + 1]]].astype(np.uint32).tobytes() for k in full], pa.binary())],
                names=["shard", "words", "counts"])

        for batch in batches:
            for b in blocks(batch, "text"):
                taught = ~b.column("held_out").to_numpy(zero_copy_only=False)
                h, doc = tokens(words(*string_block(b.column("text"))))
                new, n = np.unique(h[taught[doc]], return_counts=True)
                both, at = np.unique(np.r_[have, new], return_inverse=True)
                times = np.bincount(at, np.r_[times, n], len(both)).astype(np.int64)
                have = both
                if len(have) > 2 << 20:
                    yield rows()
                    have, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        yield rows()

    def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
        h, at = np.unique(np.frombuffer(b"".join(pdf["words"]), np.uint64), return_inverse=True)
        n = np.bincount(at, np.frombuffer(b"".join(pdf["counts"]), np.uint32), len(h)).astype(np.int64)
        often = n >= (pooled_below if pooled_below > 1 else _HOT_LEAST)
        return pd.DataFrame({"word": pd.array([None, *h[often].view(np.int64).tolist()], "Int64"),
                             "n": [int(n.sum()), *n[often].tolist()], "kinds": [len(h), *[0] * int(often.sum())]})

    counted = stage(texts.select("text", "held_out").mapInArrow(count, "shard INT, words BINARY, counts BINARY")
                    .groupBy("shard").applyInPandas(add_up, "word LONG, n LONG, kinds LONG"))
    total, kinds = counted.where("word is null").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    learned_texts = texts.where(~F.col("held_out")).count()
    contexts = Contexts(learned_texts)
    if pooled_below > 1:
        # at most CONTEXTS rows of two numbers
        table = highest(counted.where("word is not null"), log_level(F.col("n")), CONTEXTS).toPandas()
        word, n = table["word"].to_numpy(np.int64).view(np.uint64), table["n"].to_numpy(np.int64)
        contexts = Contexts(learned_texts, np.sort(word[word != END]), int(total - n[word != END].sum() - learned_texts))
    # a word with more than a quarter of a shard's tokens is dealt over shards by context; fewer than 4 * shards words can
    table = counted.where(F.col("word").isNotNull() & (F.col("n") > max(1, total // (4 * shards)))).toPandas()
    hot_word, n = table["word"].to_numpy(np.int64).view(np.uint64), table["n"].to_numpy(np.int64)
    hot_parts = -(-n * 4 * shards // max(1, total))
    hot_count = {int(h): int(c) for h, c in zip(hot_word, n)}
    by_hash = np.argsort(hot_word)
    hot_word, hot_parts = hot_word[by_hash], hot_parts[by_hash]

    def route(batches):
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for b in blocks(batch, "text"):
                h, doc = tokens(words(*string_block(b.column("text"))))
                context = contexts.of(h, doc)
                key = h.copy()
                if len(hot_word):
                    at = np.minimum(np.searchsorted(hot_word, h), len(hot_word) - 1)
                    here = np.flatnonzero(hot_word[at] == h)
                    salt = mix(context[here]) % hot_parts[at[here]].astype(np.uint64)
                    key[here] += salt * _SALT
                shard = shard_of(key)
                order = np.lexsort((doc, h, shard))
                h, doc, context, shard = h[order], doc[order].astype(np.uint16), context[order], shard[order]
                cut = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))
                rows = [zlib.compress(np.packbits(b.column("held_out").to_numpy(zero_copy_only=False)).tobytes(), 1), b.num_rows]
                out: dict[str, list] = {c: [] for c in ("shard", "words", "runs", "contexts", "names", "docs")}
                for k in np.flatnonzero(np.diff(cut)).tolist():
                    these = slice(cut[k], cut[k + 1])
                    start = np.flatnonzero(np.r_[True, h[these][1:] != h[these][:-1]])
                    out["shard"].append(k)
                    out["words"].append(h[these][start].tobytes())
                    out["runs"].append(np.diff(np.r_[start, cut[k + 1] - cut[k]]).astype(np.uint32).tobytes())
                    names, which = np.unique(context[these], return_inverse=True)
                    out["contexts"].append(which.astype(np.uint16 if len(names) <= 65_536 else np.uint32).tobytes())
                    out["names"].append(names.tobytes())
                    out["docs"].append(doc[these].tobytes())
                m = len(out["shard"])
                ids = pa.array([_pack_ids(b.column("doc_id"))] * m, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["shard"], pa.int32()), pa.array([part << 32 | number] * m, pa.int64()), ids,
                     pa.array([rows[0]] * m, pa.binary()), pa.array([rows[1]] * m, pa.int32()),
                     *(pa.array(out[c], pa.binary()) for c in ("words", "runs", "contexts", "names", "docs"))],
                    names=["shard", "block", "ids", "held", "rows", "words", "runs", "contexts", "names", "docs"])
                number += 1

    # in Arrow, so that the bytes of a shard are held once
    def score(shard: pa.Table) -> pa.Table:
        def column(name, kind=None):
            for x in shard.column(name):
                yield np.frombuffer(x.as_buffer(), kind) if kind else x.as_py()

        parts = [(w, r, np.frombuffer(c.as_buffer(), np.uint16 if len(x) <= 65_536 else np.uint32), d,
                  np.unpackbits(np.frombuffer(zlib.decompress(f), np.uint8), count=rows).astype(bool), x)
                 for w, r, c, x, d, f, rows in zip(
                     column("words", np.uint64), column("runs", np.uint32), shard.column("contexts"), column("names", np.uint64),
                     column("docs", np.uint16), column("held"), column("rows"))]
        sums = shard_scores(hot_count, parts, contexts, total, kinds, prior)
        return pa.table({
            **{c: shard.column(c) for c in ("block", "ids", "rows", "held")},
            "sums": pa.array([s[:2].tobytes() for s in sums], pa.binary()),
            "known": pa.array([s[2].astype(np.uint32).tobytes() for s in sums], pa.binary()),
            "tokens": pa.array([np.bincount(p[3], minlength=len(p[4])).astype(np.uint32).tobytes() for p in parts], pa.binary())})

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = int(pdf["rows"].iloc[0])
        sums = sum(np.frombuffer(s).reshape(2, rows) for s in pdf["sums"])
        known, n_tokens = (sum(np.frombuffer(x, np.uint32).astype(np.int64) for x in pdf[c]) for c in ("known", "tokens"))
        held = np.unpackbits(np.frombuffer(zlib.decompress(pdf["held"].iloc[0]), np.uint8), count=rows).astype(bool)
        return pd.DataFrame({"doc_id": _unpack_ids(pdf["ids"].iloc[0]), "held_out": held, "n_tokens": n_tokens, "n_known": known,
                             "train_tokens": np.int64(total), "base_score": sums[0], "score": sums[1]})

    partial = (texts.mapInArrow(route, "shard INT, block LONG, ids BINARY, held BINARY, rows INT, words BINARY, runs BINARY, "
                                       "contexts BINARY, names BINARY, docs BINARY")
               .groupBy("shard").applyInArrow(score, "block LONG, ids BINARY, rows INT, held BINARY, sums BINARY, known BINARY, "
                                                     "tokens BINARY"))
    return partial.groupBy("block").applyInPandas(
        finish, f"doc_id {id_type}, held_out BOOLEAN, n_tokens LONG, n_known LONG, train_tokens LONG, base_score DOUBLE, "
                "score DOUBLE")


def _pack_ids(ids: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("doc_id", ids.type)])) as out:
        out.write_batch(pa.RecordBatch.from_arrays([ids], names=["doc_id"]))
    return zlib.compress(sink.getvalue().to_pybytes(), 6)


def _unpack_ids(raw: bytes) -> pd.Series:
    t = pa.ipc.open_stream(zlib.decompress(raw)).read_all().column(0)
    return t.to_pandas(integer_object_nulls=True)
