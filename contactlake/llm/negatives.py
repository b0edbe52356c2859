"""Hard negatives by the threshold algorithm over per-dimension sorted candidate lists.

A block of candidates keeps one list per dimension, sorted by that component.  An anchor reads all
lists side by side, from the end that its own sign makes the better one, scores every row it
meets by random access, and stops when no row it has not met can matter: the threshold, the
score of a row that stands at the current place of every list, bounds all of them.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactlake.llm.tables import on_workers, stage

# Candidates of a block and anchors of a chunk that meet in one task.
BLOCK_ROWS = 2_048
CHUNK_ANCHORS = 2_048
# Places read from every list in the first round; each round doubles what has been read.
FIRST_PLACES = 8
_LONG = 2**63 - 1


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of integer components, zeros behind shorter ones."""
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy()
    return out


def width_of(*columns: pa.Array) -> int:
    return max((int(c.value_lengths().to_numpy(zero_copy_only=False).max(initial=0)) for c in columns), default=0)


class SortedLists:
    """A block of candidates with one sorted list per dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, labels: np.ndarray, largest: int):
        # smaller ids stand first, so equal scores come in the order of ids
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels = ids[order], labels[order]
        vectors = vectors[order]
        top = max(_size(vectors), 1) * max(largest, 1) * max(vectors.shape[1], 1)
        # whole numbers stay exact in floats up to 2^53; beyond longs Python's own numbers count
        self.kind = np.float64 if top < 2**53 else np.int64 if top < 2**62 else object
        self.vectors = vectors.astype(self.kind)
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.vectors, self.order, axis=0)

    def search(self, query: np.ndarray, windows: list[tuple[int, int]], k: int, wanted: np.ndarray) -> list[list[tuple[int, int]]]:
        """The first k (score, row) of each window (least, most), among the ``wanted`` rows.

        Higher scores first, ties by smaller id.  A row that has not been met scores at most the
        threshold, so a window is whole once the threshold is strictly below its kth score, or
        below all it admits.
        """
        n = len(self.ids)
        used = np.flatnonzero(query)
        q = query.astype(self.kind)
        falling = query[used] > 0
        met = np.zeros(n, bool)
        scores = np.zeros(n, self.kind)
        found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(windows)
        upto, step = 0, FIRST_PLACES
        while True:
            to = min(n, step)
            if len(used):
                place = np.arange(upto, to)
                at = np.where(falling[None, :], n - 1 - place[:, None], place[:, None])
                rows = self.order[at, used[None, :]].ravel()
                fresh = np.zeros(n, bool)
                fresh[rows] = True
                fresh &= ~met
                last = np.where(falling, n - to, to - 1)
                threshold = max(-_LONG - 1, int((self.sorted[last, used] * q[used]).sum())) if to < n else None
            else:
                fresh, threshold = ~met, None
            met |= fresh
            new = np.flatnonzero(fresh & wanted)
            scores[new] = self.vectors[new] @ q
            if self.kind is object:
                scores[new] = np.clip(scores[new], -_LONG - 1, _LONG)
            done = True
            for w, (least, most) in enumerate(windows):
                inside = new[(scores[new] >= least) & (scores[new] <= most)]
                both = np.concatenate([found[w], inside])
                found[w] = both[np.lexsort((both, -scores[both]))[:k]]
                if threshold is None or threshold < least:
                    continue
                done &= len(found[w]) == k and threshold < int(scores[found[w][-1]])
            if done or threshold is None:
                return [[(int(scores[r]), int(r)) for r in f] for f in found]
            upto, step = to, 2 * step


def _size(values: np.ndarray) -> int:
    """Largest absolute component."""
    return max(int(values.max()), -int(values.min())) if values.size else 0


def whole_rows(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int,
               relabel: Column | None) -> DataFrame:
    """vec_id, label, vec of the rows that take part, components as floor(scale * x)."""
    v = F.col(vector_col).cast("array<double>")
    good = (F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull()
            & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    label = F.col(label_col) if relabel is None else relabel
    return vectors.where(F.coalesce(good, F.lit(False))).select(
        F.col(id_col).cast("long").alias("vec_id"), label.alias("label"),
        F.transform(v, lambda x: F.floor(x * scale)).alias("vec"))


def _best(rows: DataFrame, keys: list[str], score: str, row_id: str, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), row_id))
    return rows.withColumn("rank", place).where(F.col("rank") <= k)


def _search_group(k: int, same_label: bool):
    """The search of a chunk of anchors in a block: rows (anchor_id, window, other_id, score)."""

    def run(anchors, block):
        ids, at, other, score = [], [], [], []
        if anchors.num_rows and block.num_rows:
            queries, own = anchors.column("vec").combine_chunks(), block.column("vec").combine_chunks()
            width = width_of(queries, own)
            queries = matrix(queries, width)
            lists = SortedLists(block.column("vec_id").to_numpy(), matrix(own, width), block.column("label").to_numpy(), _size(queries))
            windows = anchors.column("windows").to_pylist()
            for q, i, label, wins in zip(queries, anchors.column("anchor_id").to_pylist(), anchors.column("label").to_pylist(), windows):
                wanted = (lists.labels == label) & (lists.ids != i) if same_label else lists.labels != label
                for w, rows in enumerate(lists.search(q, [(x["least"], x["most"]) for x in wins], k, wanted)):
                    for s, r in rows:
                        ids.append(i)
                        at.append(w)
                        other.append(int(lists.ids[r]))
                        score.append(s)
        return pa.table({"anchor_id": pa.array(ids, pa.int64()), "window": pa.array(at, pa.int32()),
                         "other_id": pa.array(other, pa.int64()), "score": pa.array(score, pa.int64())})

    return run


_FOUND = "anchor_id LONG, window INT, other_id LONG, score LONG"
_WINDOWS = "array<struct<least: bigint, most: bigint>>"


def hard_negatives(vectors: DataFrame, anchor_every: int, positives: int = 5, negatives: int = 5,
                   least_percent: int = 80, scale: int = 256, relabel: Column | None = None, id_col: str = "vec_id",
                   vector_col: str = "embedding", label_col: str = "label", block_rows: int = BLOCK_ROWS,
                   chunk_anchors: int = CHUNK_ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x), scores are integer inner products; higher scores come
    first, ties by smaller id.  Anchors are the rows whose id is divisible by ``anchor_every``.
    Each takes its first ``positives`` other rows of the same label, and for each of them the
    first ``negatives`` rows of another label that score no more than it and at least
    ``least_percent`` hundredths of it.  Exact: every row stands in one block, every anchor
    reads every block that may hold its rows.

    Positives are looked for in blocks of one label, negatives in blocks of all rows; a label with
    a third of all rows has as many blocks as it needs.  Blocks and chunks of anchors meet in
    one task each.

    Rows with a null id, label or vector, or with a null or non-finite component take no part.
    Shorter vectors count as if zeros followed; a score beyond a long stands at its end.  Of rows
    that share an id divisible by ``anchor_every`` the one with the smallest label and vector is the
    anchor, which takes no row of its own id as a positive; otherwise each row counts, repeated
    ones too.  An empty table gives no rows; other columns are ignored.
    """
    rows = stage(whole_rows(on_workers(vectors), id_col, vector_col, label_col, scale, relabel))
    anchors = stage(rows.where(F.col("vec_id") % anchor_every == 0).groupBy("vec_id")
                    .agg(F.min(F.struct("label", "vec")).alias("r")).select(F.col("vec_id").alias("anchor_id"), "r.*"))
    total, asked = rows.count(), anchors.count()
    # rows and anchors of each label: one small row a label
    sizes = rows.groupBy("label").agg(F.ceil(F.count("*") / block_rows).alias("_blocks"))
    chunks = anchors.groupBy("label").agg(F.ceil(F.count("*") / chunk_anchors).alias("_chunks"))
    counts = stage(sizes.join(chunks, "label"))

    everything = F.array(F.struct(F.lit(-_LONG - 1).alias("least"), F.lit(_LONG).alias("most"))).cast(_WINDOWS)
    deal = lambda column, n: F.pmod(F.xxhash64(column), n)
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))
    near = (anchors.join(counts, "label").withColumn("windows", everything)
            .withColumn("_chunk", deal("anchor_id", F.col("_chunks"))).withColumn("_block", numbers(F.col("_blocks"))))
    same = (rows.join(counts, "label").withColumn("_block", deal("vec_id", F.col("_blocks")))
            .withColumn("_chunk", numbers(F.col("_chunks"))))
    keys = ["label", "_block", "_chunk"]
    met = (near.select("anchor_id", "label", "vec", "windows", "_block", "_chunk").groupBy(*keys)
           .cogroup(same.select("vec_id", "label", "vec", "_block", "_chunk").groupBy(*keys))
           .applyInArrow(_search_group(positives, True), _FOUND))
    chosen = stage(_best(met, ["anchor_id"], "score", "other_id", positives))

    # at most ``positives`` windows an anchor; the least whole score that is high enough
    share = f"(cast(score AS DECIMAL(19, 0)) * {least_percent})"
    least = F.expr(f"({share} + pmod(-{share}, 100)) div 100")
    windows = (chosen.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct(
        "rank", F.col("other_id").alias("positive_id"), "score", least.alias("least")))).alias("_chosen")))
    asking = stage(windows.join(anchors, "anchor_id").withColumn("windows", F.transform(
        "_chosen", lambda c: F.struct(c["least"].alias("least"), c["score"].alias("most")))))
    blocks, groups = max(1, -(-total // block_rows)), max(1, -(-asked // chunk_anchors))
    far = (asking.select("anchor_id", "label", "vec", "windows", deal("anchor_id", F.lit(groups)).alias("_chunk"))
           .withColumn("_block", numbers(F.lit(blocks))))
    others = rows.withColumn("_block", deal("vec_id", F.lit(blocks))).withColumn("_chunk", numbers(F.lit(groups)))
    hit = (far.groupBy("_block", "_chunk").cogroup(others.groupBy("_block", "_chunk"))
           .applyInArrow(_search_group(negatives, False), _FOUND))
    ranked = _best(hit, ["anchor_id", "window"], "score", "other_id", negatives)
    named = asking.select("anchor_id", F.posexplode("_chosen").alias("window", "_c"))
    return (ranked.join(named, ["anchor_id", "window"])
            .select("anchor_id", F.col("_c.positive_id").alias("positive_id"), "rank", F.col("other_id").alias("negative_id"),
                    F.col("_c.score").alias("positive_score"), F.col("score").alias("negative_score")))
