"""Quality scores: kernel ridge by random Fourier features over text statistics, calibrated."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlake.llm.calibrate import fit_calibration, labelled, remainder
from contactlake.llm.tables import on_workers, stage
from contactlake.llm.textarrays import Words, blocks, mix, string_block, words

# Rows the model is fitted on at most.
FIT_ROWS = 200_000
FIT_TASKS = 8
FOURIER = 256
# Width of the kernel in standardised statistics, and the ridge a row.
GAMMA = 0.02
RIDGE = 1e-4
STATISTICS = (
    "log_bytes", "log_words", "word_length", "word_length_sd", "upper", "digit", "stop_mark", "symbol", "space",
    "line_rate", "wide", "distinct_words", "top_word", "word_again", "distinct_pairs", "distinct_lines",
    "capital_words", "short_words", "long_words", "symbol_words", "exclaim", "bar", "byte_entropy", "is_empty",
)

_KIND = np.zeros(256, np.int8)      # 1 upper, 2 lower, 3 digit, 4 stop mark, 5 other symbol, 6 space, 7 wide
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 3, 7
for _c in range(33, 127):
    if not _KIND[_c]:
        _KIND[_c] = 4 if chr(_c) in ".,;:?'\"-()" else 5
_KIND[[32, *range(9, 14)]] = 6


def _distinct_share(doc: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the count of the commonest, of each document."""
    key = (doc.astype(np.uint64) << np.uint64(48)) | (value >> np.uint64(16))
    key.sort()
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    owner = (key[at] >> np.uint64(48)).astype(np.int64)
    count = np.diff(np.r_[at, len(key)])
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, owner, count)
    return np.bincount(owner, minlength=rows), most


def statistics(data: np.ndarray, at: np.ndarray, w: Words) -> np.ndarray:
    """The STATISTICS of each document of a block."""
    rows = len(at) - 1
    size = np.diff(at).astype(float)
    safe = np.maximum(size, 1)
    doc = np.repeat(np.arange(rows), np.diff(at))
    per = np.bincount(doc * 8 + _KIND[data], minlength=8 * rows).reshape(rows, 8) if rows else np.zeros((0, 8))
    n = np.diff(w.first).astype(float)
    many = np.maximum(n, 1)

    def per_word(x: np.ndarray) -> np.ndarray:
        return np.bincount(w.doc, x, rows) / many

    ink = _KIND[data] != 6
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    start = np.flatnonzero(ink & ~(np.r_[False, ink[:-1]] & ~edge[:-1])) if len(data) else np.zeros(0, np.int64)
    end = np.flatnonzero(ink & ~(np.r_[ink[1:], False] & ~edge[1:])) if len(data) else np.zeros(0, np.int64)
    length = (end - start + 1).astype(float)
    mean = per_word(length)
    sd = np.sqrt(np.maximum(per_word(length * length) - mean * mean, 0))
    distinct, top = _distinct_share(w.doc, w.hash, rows)
    same = np.zeros(len(w.hash), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    pair_ok = w.doc[1:] == w.doc[:-1] if len(w.doc) else np.zeros(0, bool)
    pairs = mix(w.hash[:-1] * np.uint64(3) + mix(w.hash[1:]))[pair_ok] if len(w.doc) else w.hash
    distinct_pairs, _ = _distinct_share(w.doc[:-1][pair_ok] if len(w.doc) else w.doc, pairs, rows)
    # lines by the sum of their words' hashes
    newline = np.flatnonzero(data == 10)
    cut = np.unique(np.r_[at[:-1], newline + 1]) if len(data) else np.zeros(0, np.int64)
    cut = cut[cut < len(data)]
    total = np.r_[np.uint64(0), np.cumsum(w.hash)] if len(w.hash) else np.zeros(1, np.uint64)
    upto = total[np.searchsorted(start, np.r_[cut, len(data)])]
    line = mix(upto[1:] - upto[:-1]) if len(cut) else np.zeros(0, np.uint64)
    line_doc = doc[cut] if len(cut) else np.zeros(0, np.int64)
    lines = np.bincount(line_doc, minlength=rows)
    distinct_lines, _ = _distinct_share(line_doc, line, rows)
    byte = np.bincount(doc * 256 + data, minlength=256 * rows).reshape(rows, 256) / safe[:, None] if rows else np.zeros((0, 256))
    entropy = -(byte * np.log2(np.where(byte > 0, byte, 1))).sum(axis=1)
    first_kind, last_kind = _KIND[data[start]], _KIND[data[end]]
    return np.stack([
        np.log1p(size), np.log1p(n), mean, sd, per[:, 1] / safe, per[:, 3] / safe, per[:, 4] / safe, per[:, 5] / safe,
        per[:, 6] / safe, np.bincount(doc[newline], minlength=rows) / safe, per[:, 7] / safe,
        np.log1p(distinct) / np.maximum(np.log1p(n), 1e-9), top / many, per_word(same), distinct_pairs / np.maximum(n - 1, 1),
        distinct_lines / np.maximum(lines, 1), per_word(first_kind == 1), per_word(length == 1), per_word(length > 12),
        per_word(last_kind == 5), np.bincount(doc[data == 33], minlength=rows) / many,
        np.bincount(doc[data == 124], minlength=rows) / many, entropy, size == 0,
    ], axis=1).astype(float)


class KernelRidge:
    """Ridge on random Fourier features of standardised statistics."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray, fourier: int, gamma: float, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.mean, self.sd = mean, np.where(sd > 1e-9, sd, 1.0)
        self.wave = rng.normal(0, np.sqrt(2 * gamma), (len(mean), fourier))
        self.phase = rng.uniform(0, 2 * np.pi, fourier)
        self.weight = np.zeros(fourier + 1)

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.sd).clip(-8, 8)
        return np.c_[np.sqrt(2 / len(self.phase)) * np.cos(z @ self.wave + self.phase), np.ones(len(x))]

    def solve(self, gram: np.ndarray, moment: np.ndarray, ridge: float) -> np.ndarray:
        penalty = ridge * (gram[-1, -1] + 1) * np.eye(len(gram))
        penalty[-1, -1] = 1e-9
        return np.linalg.solve(gram + penalty, moment)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the array ``x`` of statistics of every whole text."""
    id_type = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for b in blocks(batch, text_col):
                data, at = string_block(b.column(text_col))
                x = statistics(data, at, words(data, at))
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(STATISTICS))
                yield pa.RecordBatch.from_arrays([b.column(id_col), flat.cast(pa.list_(pa.float64()))], names=["doc_id", "x"])

    return on_workers(docs).select(id_col, text_col).mapInArrow(run, f"doc_id {id_type}, x ARRAY<DOUBLE>")


def quality_scores(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_remainder: int = 0,
                   threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                   fit_rows: int = FIT_ROWS, fourier: int = FOURIER, gamma: float = GAMMA, ridge: float = RIDGE,
                   seed: int = 11) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    Statistics of whole texts are lifted by random Fourier features (a Gaussian kernel); tasks
    add up the normal equations of two folds of the labelled rows, the driver solves them, and
    scores of each fold by the other's model give the monotone calibration.  Only labels whose
    id has another remainder than ``held_remainder`` are seen.

    Null and empty texts are scored alike.  A null id is never held out and has no label; rows
    with the same text get the same score.  Without labels every score is 0.5.  Other columns,
    also ones named like these, are ignored.
    """
    rest = remainder(id_col, modulus)
    known = stage(labelled(labels, label_col, rest == held_remainder, fit_rows, id_col)
                  .withColumn("fold", (F.floor(F.crc32(F.col("doc_id").cast("string")) / modulus) % 2).cast("int")))
    stats = stage(document_statistics(docs, id_col, text_col))
    # the labelled ids are at most fit_rows pairs of numbers
    fit = stage(stats.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
                .join(known, "doc_id").repartition(FIT_TASKS, "doc_id"))
    width = len(STATISTICS)
    m = fit.agg(*[F.avg(F.col("x")[i]) for i in range(width)], *[F.stddev_pop(F.col("x")[i]) for i in range(width)]).first()
    model = KernelRidge(np.array([v or 0.0 for v in m[:width]]), np.array([v or 0.0 for v in m[width:]]), fourier, gamma, seed)

    def matrix(b: pa.RecordBatch) -> np.ndarray:
        return np.array(b.column("x").flatten()).reshape(-1, width)

    def equations(batches):
        size = fourier + 1
        gram, moment = np.zeros((2, size, size)), np.zeros((2, size))
        for b in batches:
            z, y, f = model.lift(matrix(b)), b.column("label").to_numpy(), b.column("fold").to_numpy()
            for k in range(2):
                part = z[f == k]
                gram[k] += part.T @ part
                moment[k] += part.T @ y[f == k]
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()]), pa.array([moment.tobytes()])], names=["gram", "moment"])

    # one row of fixed size from each of FIT_TASKS tasks
    sums = fit.mapInArrow(equations, "gram BINARY, moment BINARY").collect()
    size = fourier + 1
    gram = sum((np.frombuffer(r.gram).reshape(2, size, size) for r in sums), np.zeros((2, size, size)))
    moment = sum((np.frombuffer(r.moment).reshape(2, size) for r in sums), np.zeros((2, size)))
    by_other = np.stack([model.solve(gram[1], moment[1], ridge), model.solve(gram[0], moment[0], ridge)])
    model.weight = model.solve(gram.sum(axis=0), moment.sum(axis=0), ridge)

    def other_fold(batches):
        for b in batches:
            raw = (model.lift(matrix(b)) * by_other[b.column("fold").to_numpy()]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(raw), b.column("label")], names=["raw", "label"])

    curve = fit_calibration(fit.mapInArrow(other_fold, "raw DOUBLE, label INT"), -0.5, 1.5)

    def score(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(curve(model.lift(matrix(b)) @ model.weight))],
                                             names=["doc_id", "score"])

    id_type = stats.schema[0].dataType.simpleString()
    scored = stats.mapInArrow(score, f"doc_id {id_type}, score DOUBLE")
    return scored.select("doc_id", F.coalesce(remainder("doc_id", modulus) == held_remainder, F.lit(False)).alias("held_out"),
                         "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
