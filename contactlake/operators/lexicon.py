"""Which terms of a lexicon table occur in which texts: one automaton, one narrow pass over the texts.

The lexicon is measured first.  Up to a byte limit it is sent to the workers once, as a
broadcast of proven size; each worker builds one automaton of all terms from it and runs every
Arrow batch of texts through it, so the plan is the same for ten terms and for a million, and
no text moves.  A larger lexicon is cut by hash into parts below the limit, each with a pass of
its own over the texts it may concern.
"""
from __future__ import annotations

import uuid
from collections import OrderedDict
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlake.session import stage

# Bytes of terms (and a flat share for each row) that one automaton holds.
LIMIT_BYTES = 16 << 20
ROW_BYTES = 64
# Found rows that a task holds before it hands them on.
FOUND_ROWS = 1 << 16
_machines: OrderedDict[str, Machine] = OrderedDict()


class Machine:
    """Automaton over the distinct terms, and the lexicon's rows in the order of term and ``by`` values."""

    def __init__(self, table: pa.Table, by: tuple, term: str, kept: list[str]):
        import ahocorasick

        self.size = _held(table)
        coded = table.column(term).combine_chunks().dictionary_encode()
        words, term_of = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for lo in range(0, len(words), 4096):
            for at, word in enumerate(words.slice(lo, 4096).to_pylist(), lo):
                self.automaton.add_word(word, at)
        self.automaton.make_automaton()
        self.length = pc.utf8_length(words).to_numpy().astype(np.int64)
        self.keys: dict[tuple, int] = {}
        key_of = np.zeros(table.num_rows, np.int64)
        if by:
            for row, key in enumerate(zip(*(table.column(c).to_pylist() for c in by))):
                key_of[row] = self.keys.setdefault(key, len(self.keys))
        self.n_keys = max(1, len(self.keys))
        code = term_of * self.n_keys + key_of
        self.order = np.argsort(code, kind="stable")
        self.code = code[self.order]
        self.entries = table.select(kept).combine_chunks()

    def find(self, text: str, key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lexicon rows of one key whose term the text holds, with its place and times."""
        met = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64)
        at, first, times = np.unique(met[1::2], return_index=True, return_counts=True)
        place = met[::2][first] - self.length[at] + 2
        code = at * self.n_keys + key
        begin = np.searchsorted(self.code, code)
        size = np.searchsorted(self.code, code, "right") - begin
        upto = np.cumsum(size)
        rows = np.repeat(begin - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)
        return self.order[rows], np.repeat(place, size), np.repeat(times, size)


def _held(table: pa.Table) -> int:
    return table.nbytes + ROW_BYTES * table.num_rows


def _machine(name: str, shared, by: tuple, term: str, kept: list[str]) -> Machine:
    """The machine of a lexicon, kept between tasks; together those kept hold no more terms than one may."""
    if name not in _machines:
        table = shared.value
        # others go before this one takes its memory
        while _machines and sum(m.size for m in _machines.values()) + _held(table) > LIMIT_BYTES:
            _machines.popitem(last=False)
        _machines[name] = Machine(table, by, term, kept)
    _machines.move_to_end(name)
    return _machines[name]


def _size(rows: DataFrame, term: str) -> int:
    return rows.agg(F.sum(F.octet_length(term) + F.lit(ROW_BYTES)).cast("long")).first()[0] or 0


def lexicon_parts(rows: DataFrame, by: tuple, term: str, limit: int, depth: int = 0) -> list[tuple[DataFrame, Column | None]]:
    """Parts of the lexicon, each below the limit, with the test that picks the texts a part may concern.

    The first cut is by ``by``; a key that is too large by itself (or a lexicon without keys) is cut
    by term, and its texts are read once for every such part.
    """
    total = _size(rows, term)
    if total <= limit or depth > 4:
        return [(rows, None)] if total else []
    parts = -(-5 * total // (4 * limit))
    keys = by if by and not depth else (*by, term)
    slot = F.pmod(F.xxhash64(F.lit(depth), *keys), F.lit(parts))
    out = []
    for p in range(parts):
        test = slot == p
        for part, inner in lexicon_parts(rows.where(test), by, term, limit, depth + 1):
            own = test if keys == by else None
            out.append((part, own if inner is None else inner if own is None else own & inner))
    return out


def find_terms(texts: DataFrame, lexicon: DataFrame, keys: list[str], by: tuple = (), text: str = "text",
               term: str = "term", limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """One row for each text and each lexicon row whose term occurs in it.

    Returns ``keys`` (columns of the texts), the lexicon's columns other than ``by``, ``place`` (where the
    term first begins, from 1, in characters) and ``times`` (occurrences, overlapping ones too).
    With ``by``, a lexicon row concerns only texts with equal values in these columns, which both
    sides have and which are not null.  Matching is exact, so lower both sides where case does
    not count.  Null texts hold nothing; null and empty terms occur nowhere; equal lexicon rows
    count once.
    """
    by = tuple(by)
    rows = lexicon.where((F.col(term) != "") & reduce(lambda a, c: a & F.col(c).isNotNull(), by, F.lit(True))).distinct()
    kept = [c for c in rows.columns if c not in by]
    given = texts.select(*dict.fromkeys([*keys, *by, text]))
    types = dict(given.dtypes)
    rows = rows.select(*(F.col(c).cast(types[c]).alias(c) if c in by else F.col(c) for c in rows.columns))
    fields = [f"`{c}` {types[c]}" for c in keys] + [f"`{c}` {t}" for c, t in rows.dtypes if c in kept]
    schema = ", ".join([*fields, "place INT", "times INT"])
    if _size(rows, term) > limit_bytes:
        rows = stage(rows)  # read by every part
    parts = lexicon_parts(rows, by, term, limit_bytes)
    if not parts:
        return texts.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, [
        (given if own is None else given.where(own)).mapInArrow(_pass(part, keys, by, text, term, kept), schema)
        for part, own in parts])


def _pass(part: DataFrame, keys: list[str], by: tuple, text: str, term: str, kept: list[str]):
    shared = part.sparkSession.sparkContext.broadcast(part.toArrow())
    name, names = uuid.uuid4().hex, [*keys, *kept, "place", "times"]

    def run(batches):
        machine = _machine(name, shared, by, term, kept)
        for b in batches:
            own = list(zip(*(b.column(c).to_pylist() for c in by))) if by else None
            found, n = [], 0
            # one text at a time, so that what is held does not grow with the batch
            for i, value in enumerate(b.column(text)):
                t, key = value.as_py(), machine.keys.get(own[i]) if by else 0
                if not t or key is None:
                    continue
                entry, place, times = machine.find(t, key)
                if len(entry):
                    found.append((np.full(len(entry), i), entry, place, times))
                    n += len(entry)
                if n >= FOUND_ROWS:
                    yield from _found(b, keys, machine.entries, found, names)
                    found, n = [], 0
            yield from _found(b, keys, machine.entries, found, names)

    return run


def _found(batch: pa.RecordBatch, keys: list[str], entries: pa.Table, found: list[tuple], names: list[str]):
    if not found:
        return
    row, entry, place, times = (np.concatenate(f) for f in zip(*found))
    for lo in range(0, len(row), FOUND_ROWS):
        part = slice(lo, lo + FOUND_ROWS)
        taken = entries.take(pa.array(entry[part]))
        columns = [batch.column(c).take(pa.array(row[part])) for c in keys] + [c.combine_chunks() for c in taken.columns]
        columns += [pa.array(x[part].astype(np.int32)) for x in (place, times)]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def term_summary(found: DataFrame, by: list[str], term: str = "term") -> DataFrame:
    """What ``find_terms`` found, one row for each value of ``by`` (a text's key and a group).

    n_terms and times; score, 1 and a twentieth of the length for each term; the term that begins
    first (the longer of two at one place) with its place; the longest term (of equally long ones
    the first by code point).  Terms are counted once a group.
    """
    place = F.struct(F.col("place"), -F.length(term))
    return found.groupBy(*by).agg(
        F.count("*").alias("n_terms"), F.sum("times").alias("times"),
        F.sum(1.0 + F.length(term) / 20.0).alias("score"),
        F.min_by(term, place).alias("first_term"), F.min("place").alias("first_place"),
        F.min_by(term, F.struct(-F.length(term), F.col(term))).alias("longest"))


def best_group(found: DataFrame, keys: list[str], group: str, order: dict[str, int], term: str = "term") -> DataFrame:
    """The group with the highest score for each key; of equal scores the first in ``order``.

    Scores are compared in twentieths, so they are whole numbers and equal ones are equal.
    """
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col(group))
    scored = found.groupBy(*keys, group).agg(F.sum(20 + F.length(term)).alias("_score"))
    return scored.groupBy(*keys).agg(F.max_by(group, F.struct("_score", -rank)).alias(group))


def first_groups(found: DataFrame, keys: list[str], group: str, ord_col: str, limit: int) -> DataFrame:
    """The first ``limit`` groups found for each key, in the order of the lexicon."""
    first = found.groupBy(*keys, group).agg(F.min(ord_col).alias("_ord"))
    ranked = F.slice(F.sort_array(F.collect_list(F.struct("_ord", group))), 1, limit)
    return first.groupBy(*keys).agg(F.transform(ranked, lambda g: g[group]).alias("groups"))


def mark_texts(texts: DataFrame, lexicon: DataFrame, key: str, by: tuple = (), text: str = "text", term: str = "term",
               flag: str = "named", limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """The texts with ``flag``: whether any term of the lexicon occurs.  ``key`` identifies a text."""
    hit = find_terms(texts, lexicon.select(*by, term), [key], by, text, term, limit_bytes).select(key).distinct()
    return texts.join(hit.withColumn(flag, F.lit(True)), key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
