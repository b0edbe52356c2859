"""Mixing sources to target weights by entropy balancing."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlake.llm.tables import on_workers, prefix_sums, stage
from contactlake.llm.textarrays import blocks

# Rows that round their rates together.
CELL_ROWS = 4096
NEWTON_STEPS = 60
WEIGHTS = (1, 2, 3)
MOST = 3


def word_sizes(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """Words of every whole text beside its id and source."""
    ids, sources = (docs.select(c).schema[0].dataType.simpleString() for c in (id_col, source_col))

    def run(batches):
        for batch in batches:
            for b in blocks(batch, text_col):
                texts = b.column(text_col).fill_null("").cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [b.column(id_col), b.column(source_col), pa.array([len(t.split()) for t in texts], pa.int64())],
                    names=["doc_id", "source", "size"])

    return on_workers(docs).select(id_col, source_col, text_col).mapInArrow(run, f"doc_id {ids}, source {sources}, size LONG")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size, source_rows, target: shares by weight, held at ``most`` times a source's size.

    Weights repeat over the sources in code-point order, null last.  What a held source leaves
    is shared again by weight among the others until none is above its bound.
    """
    totals = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
              .withColumn("_last", F.col("source").isNull()))
    ranked, total, _ = prefix_sums(totals, ["_last", "source"], "source_size")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double")
    table = stage(ranked.select("source", "source_size", "source_rows", weight.alias("weight"),
                                (F.col("source_size") * F.lit(float(most))).alias("bound")))
    level, held = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > F.col("bound")
        r = table.agg(F.sum(above.cast("int")).alias("held"), F.sum(F.when(above, F.col("bound"))).alias("used"),
                      F.sum(F.when(~above, F.col("weight"))).alias("free")).first()
        if level and r.held == held or not r.free:
            break
        held = r.held if level else -1
        level = (total - (r.used or 0.0)) / r.free
        if not level:
            break
    return table.withColumn("target", F.least(F.col("weight") * F.lit(level), F.col("bound"))).drop("weight")


def balance(targets: DataFrame, most: float = MOST, steps: int = NEWTON_STEPS) -> DataFrame:
    """Add ``rate``: the tilt of each source that meets its token target with least change.

    Least change is the relative entropy of taken against given tokens; under the constraint
    tokens(source) * exp(dual) = target its dual is convex in one variable for each source, so
    all sources take their Newton steps side by side, on sums that are one row a source.  A
    source without tokens or target gets rate 0; rates stop at ``most``.
    """
    ratio = F.col("target") / F.col("source_size")
    start = stage(targets.withColumn("_ratio", F.when(F.col("source_size") > 0, ratio).otherwise(F.lit(0.0)))
                  .withColumn("_dual", F.lit(0.0)))
    # gradient: size * exp(dual) - target, curvature: size * exp(dual)
    dual = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col("_dual"),
                       lambda d, _: d + F.col("_ratio") * F.exp(-d) - F.lit(1.0))
    return (start.withColumn("rate", F.when(F.col("_ratio") > 0, F.least(F.exp(dual), F.lit(float(most)))).otherwise(0.0))
            .drop("_ratio", "_dual"))


def round_rates(sizes: np.ndarray, rates: np.ndarray, most: int) -> np.ndarray:
    """Whole copies of rows in the given order (largest first); what one row misses the next make up."""
    low = np.floor(rates + 1e-9).astype(np.int64)
    part = (rates - low).clip(0)
    out, owed = low.tolist(), 0.0
    for i, (s, p, c) in enumerate(zip(sizes.tolist(), part.tolist(), out)):
        owed += s * p
        if s and c < most and owed >= s / 2:
            out[i] = c + 1
            owed -= s
    return np.array(out, np.int64)


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, id_col: str = "doc_id",
                source_col: str = "source", text_col: str = "text", cell_rows: int = CELL_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies and taken of every row.

    The rows of a source are dealt into cells of about ``cell_rows`` by a hash of their id, so a
    hot source is rounded by many tasks.  In a cell rows go from the largest down and pass on
    what rounding left over, so a cell misses its share by half a small document; runs agree.

    Null text: size 0, never taken.  Null source: a source of its own, the last.  Null and
    repeated ids: each row counts.  An empty table gives no rows; other columns are ignored.
    """
    sizes = stage(word_sizes(docs, id_col, source_col, text_col))
    table = balance(source_targets(sizes, weights, most), most)
    cell = F.pmod(F.xxhash64("doc_id", "size"), F.ceil(F.col("source_rows") / cell_rows))
    rows = (sizes.withColumnRenamed("source", "_source")
            .join(table, F.col("_source").eqNullSafe(F.col("source"))).drop("_source")
            .withColumn("_cell", cell))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    names = ["doc_id", "source", "size", "source_size", "target", "rate"]

    def run(pdf):
        pdf = pdf.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable", ignore_index=True)
        pdf["copies"] = round_rates(pdf["size"].to_numpy(), pdf["rate"].to_numpy(), most)
        pdf["taken"] = pdf["copies"] * pdf["size"]
        return pdf[[*names, "copies", "taken"]]

    return rows.groupBy("source", "_cell").applyInPandas(
        run, ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", copies LONG, taken LONG")
