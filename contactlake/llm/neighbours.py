"""Approximate nearest neighbours with an inverted multi-index."""
from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactlake.llm.tables import on_workers, stage, task_count

# Vectors the two codebooks are fitted on; every vector is indexed.
FIT_ROWS = 20_000
# Centroids of each half; the index has their square of cells.
CENTROIDS = 64
# A query goes on until its cells hold this share of all vectors, and this many at least.
VISIT_SHARE = 0.6
VISIT_ROWS = 2_000
# Vectors of a block and queries of a chunk that meet in one task.
BLOCK_ROWS = 4_096
CHUNK_QUERIES = 1_024


def sound(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vec of the rows that take part: finite, not zero, of the most frequent length."""
    v = F.col(vector_col).cast("array<double>")
    good = (F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0)
            & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists(v, lambda x: x != 0))
    rows = vectors.where(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vec"))
    size = (rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect())
    return rows.where(F.size("vec") == (size[0].n if size else 0))


def centroids(sample: np.ndarray, k: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """Lloyd's means of a bounded sample; empty means stay where they began."""
    pick = np.random.Generator(np.random.PCG64(seed)).permutation(len(sample))[:k]
    means = sample[pick].copy()
    for _ in range(rounds):
        near = nearest(sample, means)
        count = np.bincount(near, minlength=len(means))
        total = np.zeros_like(means)
        np.add.at(total, near, sample)
        has = count > 0
        means[has] = total[has] / count[has, None]
    return means


def nearest(rows: np.ndarray, means: np.ndarray) -> np.ndarray:
    return np.argmin((means * means).sum(axis=1) - 2 * rows @ means.T, axis=1)


def cell_order(first: np.ndarray, second: np.ndarray, held: np.ndarray, wanted: int) -> list[int]:
    """Cells (i * len(second) + j) by falling first[i] + second[j] until they hold ``wanted`` rows."""
    a, b = np.argsort(-first, kind="stable").tolist(), np.argsort(-second, kind="stable").tolist()
    x, y = first[a].tolist(), second[b].tolist()
    n, m = len(a), len(b)
    heap = [(-(x[0] + y[0]), 0, 0)]
    # how far each row of the grid of pairs has been taken
    taken = [0] * n
    out, rows = [], 0
    while heap and rows < wanted:
        _, i, j = heapq.heappop(heap)
        cell = a[i] * m + b[j]
        taken[i] = j + 1
        if held[cell]:
            out.append(cell)
            rows += held[cell]
        if j + 1 < m and (i == 0 or taken[i - 1] > j + 1):
            heapq.heappush(heap, (-(x[i] + y[j + 1]), i, j + 1))
        if i + 1 < n and taken[i + 1] == j:
            heapq.heappush(heap, (-(x[i + 1] + y[j]), i + 1, j))
    return out


def rank_block(ids: np.ndarray, vecs: np.ndarray, cells: np.ndarray, query_ids: np.ndarray, queries: np.ndarray,
               visits: list[np.ndarray], k: int) -> list[tuple]:
    """The k best rows of one block for each query, among the cells it visits."""
    order = np.argsort(ids, kind="stable")
    ids, vecs, cells = ids[order], vecs[order], cells[order]
    names, at = np.unique(cells, return_inverse=True)
    seen = np.zeros((len(queries), len(names)), bool)
    for q, v in enumerate(visits):
        seen[q, np.searchsorted(names, v)[np.isin(v, names)]] = True
    rough = queries @ vecs.T
    rough[~seen[:, at]] = -np.inf
    rough[query_ids[:, None] == ids[None, :]] = -np.inf
    out = []
    for q in range(len(queries)):
        row = rough[q]
        floor = np.partition(row, -k)[-k] if len(row) > k else -np.inf
        # the product of a matrix may differ in the last bits from that of two vectors
        near = np.flatnonzero((row > -np.inf) & (row >= floor - 1e-9 * max(1.0, abs(floor)) if np.isfinite(floor) else row > -np.inf))
        exact = (vecs[near] * queries[q]).sum(axis=1)
        best = np.lexsort((ids[near], -exact))[:k]
        out += [(int(query_ids[q]), int(ids[near[b]]), float(exact[b])) for b in best]
    return out


def nearest_neighbours(vectors: DataFrame, query_every: int, k: int = 20, id_col: str = "vec_id",
                       vector_col: str = "embedding", share: float = VISIT_SHARE, fit_rows: int = FIT_ROWS,
                       centroids_a_half: int = CENTROIDS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query among the cells it visits.

    Queries are the rows whose id is divisible by ``query_every``, candidates all other rows.
    The two halves of a vector are quantised apart; a query takes pairs of centroids by falling
    sum of their inner products, from a heap, until the cells hold ``share`` of all vectors
    (``VISIT_ROWS`` at least), and the rows of these cells are ranked by their exact product.
    A cell larger than a block is spread over several blocks, so a vector held by a third of
    all rows does not meet in one task.

    Vectors that are null, empty, zero, of another length than most or with null or non-finite
    components take no part, nor do null ids.  Ties go to the smaller id; rows with repeated ids
    are candidates each, but never of a query with their own id, which the smallest vector asks.  An empty table gives no rows;
    other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = stage(sound(on_workers(vectors), id_col, vector_col))
    total = rows.count()
    schema = "query_id LONG, rank INT, vec_id LONG, score DOUBLE"
    if not total:
        return spark.createDataFrame([], schema)
    slots = 1 << 30
    fit = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(slots)) < int(min(1.0, 1.2 * fit_rows / total) * slots))
    sample = np.array([r.vec for r in fit.select("vec").limit(fit_rows).toLocalIterator()])
    if not len(sample):
        sample = np.array([r.vec for r in rows.select("vec").limit(fit_rows).toLocalIterator()])
    half = sample.shape[1] // 2
    one, two = centroids(sample[:, :half], centroids_a_half), centroids(sample[:, half:], centroids_a_half)

    def index(batches):
        for b in batches:
            v = np.array(b.column("vec").to_pylist(), np.float64)
            if len(v):
                cell = nearest(v[:, :half], one) * len(two) + nearest(v[:, half:], two)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), b.column("vec_id"), b.column("vec")],
                                                 names=["cell", "vec_id", "vec"])

    indexed = stage(rows.mapInArrow(index, "cell INT, vec_id LONG, vec ARRAY<DOUBLE>"))
    # at most one row per pair of centroids
    counts = dict(indexed.groupBy("cell").count().collect())
    held = np.zeros(len(one) * len(two), np.int64)
    held[list(counts)] = list(counts.values())
    # cells one after the other fill blocks; a large cell has several blocks of its own
    first, parts, block, room = {}, {}, 0, block_rows
    for cell in sorted(counts):
        n = counts[cell]
        if n > room:
            block, room = block + (room < block_rows), block_rows
        first[cell], parts[cell] = block, -(-n // block_rows)
        if n > block_rows:
            block, room = block + parts[cell], block_rows
        else:
            room -= n
    places = spark.createDataFrame([(c, first[c], parts[c]) for c in first], "cell INT, _first INT, _parts INT")
    placed = indexed.join(F.broadcast(places), "cell").withColumn(
        "block", (F.col("_first") + F.pmod(F.xxhash64("vec_id"), F.col("_parts"))).cast("int"))

    wanted = max(VISIT_ROWS, int(share * total))
    # of rows that share a query's id the smallest vector asks; few small rows, but dear ones
    queries = indexed.where(F.col("vec_id") % query_every == 0).groupBy("vec_id").agg(F.min("vec").alias("vec")).repartition(
        task_count(spark), "vec_id")
    chunks = max(1, -(-queries.count() // CHUNK_QUERIES))

    def visit(batches):
        for b in batches:
            ids, vecs = b.column("vec_id").to_numpy(), np.array(b.column("vec").to_pylist(), np.float64)
            names = ("block", "chunk", "query_id", "query", "cells")
            out: dict[str, list] = {n: [] for n in names}
            for i, v in zip(ids.tolist(), vecs):
                by_block: dict[int, list[int]] = {}
                for cell in cell_order(one @ v[:half], two @ v[half:], held, wanted):
                    for p in range(parts[cell]):
                        by_block.setdefault(first[cell] + p, []).append(cell)
                for block, cells in by_block.items():
                    for n, x in zip(names, (block, i // query_every % chunks, i, v, cells)):
                        out[n].append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["block"], pa.int32()), pa.array(out["chunk"], pa.int32()), pa.array(out["query_id"], pa.int64()),
                 pa.array(out["query"], pa.list_(pa.float64())), pa.array(out["cells"], pa.list_(pa.int32()))], names=names)

    asked = stage(queries.mapInArrow(visit, "block INT, chunk INT, query_id LONG, query ARRAY<DOUBLE>, cells ARRAY<INT>"))
    met = asked.select(F.col("block").alias("_block"), F.col("chunk").alias("_chunk")).distinct()
    given = (placed.join(met, F.col("block") == F.col("_block"))
             .select("_block", "_chunk", "cell", "vec_id", "vec"))

    def rank(asked_pdf, given_pdf):
        found = [] if not len(asked_pdf) or not len(given_pdf) else rank_block(
            given_pdf["vec_id"].to_numpy(), np.array(given_pdf["vec"].tolist(), np.float64), given_pdf["cell"].to_numpy(),
            asked_pdf["query_id"].to_numpy(), np.array(asked_pdf["query"].tolist(), np.float64),
            [np.asarray(c) for c in asked_pdf["cells"]], k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"})

    best = (asked.groupBy("block", "chunk").cogroup(given.groupBy("_block", "_chunk"))
            .applyInPandas(rank, "query_id LONG, vec_id LONG, score DOUBLE"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
