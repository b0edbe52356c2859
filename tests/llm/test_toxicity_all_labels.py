"""Toxicity learns from every label: words that only few labelled rows of many hold, and small blocks."""
import inspect

import numpy as np
import pytest
from helpers import labels
from pyspark.sql import functions as F

from contactlake.llm import toxicity
from contactlake.llm.calibrate import labelled


def test_no_label_is_left_out(spark):
    marks = spark.range(250_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    assert labelled(marks, "toxic", F.lit(False)).count() == 250_000
    assert "fit_rows" not in inspect.signature(toxicity.toxicity_scores).parameters


def test_every_labelled_text_is_counted(spark, monkeypatch):
    staged = []

    def stage(df):
        staged.append(df)
        if len(staged) > 3:
            raise StopIteration("only the texts learned from are of interest")
        return own(df)

    own = toxicity.stage
    monkeypatch.setattr(toxicity, "stage", stage)
    docs = spark.range(130_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word n"), F.col("id").cast("string")).alias("text"))
    marks = docs.select("doc_id", (F.col("doc_id") % 9 == 0).cast("int").alias("toxic"))
    with pytest.raises(StopIteration):
        toxicity.toxicity_scores(docs, marks, modulus=50)
    learned = docs.where(F.crc32(F.col("doc_id").cast("string")) % 50 != 1).count()
    assert learned > 120_000 and [df.count() for df in staged[:3]] == [learned] * 3
    # the labels grow with the texts: they meet by a shuffle, not by a copy in every task
    assert not any("BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString() for df in staged[1:3])


def test_small_blocks_give_the_same_scores(spark, monkeypatch):
    rng = np.random.Generator(np.random.PCG64(3))
    plain = ["".join(rng.choice(list("abcdefghilmnop"), 6)) for _ in range(90)]
    rows = [(i, " ".join([*rng.choice(plain, 7), "m0r0n" if i % 12 == 0 else "moron"] if i % 6 == 0 else rng.choice(plain, 8))) for i in range(1_500)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(2)
    marks = labels(spark, [(i, 1, int(i % 6 == 0)) for i in range(1_500)])
    score = lambda: sorted((r.doc_id, r.score) for r in toxicity.toxicity_scores(docs, marks).collect())
    whole = score()
    monkeypatch.setattr(toxicity, "BLOCK_BYTES", 900)
    assert score() == whole and {s > 0.5 for _, s in whole} == {True, False}
