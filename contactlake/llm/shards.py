"""Contiguous shards of nearly equal bytes, cut from global prefix sums."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlake.llm.tables import prefix_sums, stage

# A cut moves to the edge of a group of equal texts when that is at most this share of a shard away.
SNAP = 0.02


def balanced_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text",
                    overhead: int = 8, snap: float = SNAP) -> DataFrame:
    """Shard and slot of every row, under the law ``bytes``: doc_id, size, text_crc32, shard, slot.

    Rows stand in the order of their text's md5, then id, so equal texts are neighbours.  The
    order is cut at multiples of total / shards; a cut inside a group of equal texts moves to
    the nearer edge of the group if that is within ``snap`` of a shard, otherwise the group is
    split, since it is too large to stay whole with shards of near equal size.  A row belongs
    to the side on which its middle byte lies.

    Null text: empty, size is the overhead.  Null ids stand first among equal texts.  Repeated
    rows each get a slot.  An empty table gives no rows; with fewer rows than shards some
    shards stay empty.  Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = stage(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.md5(text).alias("_key")))
    rows, total, _ = prefix_sums(narrow, ["_key", "doc_id"], "size")
    cuts = []
    if total:
        ends = F.col("before") + F.col("size")
        nth = lambda c: F.expr(f"({c}) * {shards} div {total}")
        # at most one row per cut lies across it
        across = rows.where(nth("before") != nth("before + size")).select("_key").distinct()
        keys = [r[0] for r in across.collect()]
        groups = (rows.where(F.col("_key").isin(keys)).groupBy("_key")
                  .agg(F.min("before").alias("lo"), F.max(ends).alias("hi")).collect()) if keys else []
        for k in range(1, shards):
            ideal = k * total / shards
            edge = min((e for g in groups if g.lo < ideal < g.hi for e in (g.lo, g.hi)),
                       key=lambda e: abs(e - ideal), default=ideal)
            cuts.append(2 * edge if abs(edge - ideal) <= snap * total / shards else int(2 * ideal))
    middle = F.col("before") * 2 + F.col("size")
    listed = F.array(*[F.lit(int(c)).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    rows = rows.withColumn("shard", F.size(F.filter(listed, lambda c: c <= middle)).cast("int"))
    firsts = dict(rows.groupBy("shard").agg(F.min("place")).collect())
    start = F.element_at(F.array(*[F.lit(int(firsts.get(s) or 0)).cast("long") for s in range(shards)]),
                         F.col("shard") + 1)
    return rows.select("doc_id", "size", "text_crc32", "shard", (F.col("place") - start).alias("slot"))
