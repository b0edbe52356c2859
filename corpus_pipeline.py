"""The corpus pipeline: quality, toxicity, near copies, source mix, packed sequences.

Each stage takes the documents its predecessor kept, is written as Parquet and read again.
All but the last return the columns of ``documents``.  Every stage learns and decides on its
own input; labels are those of ``labels``.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactlake.llm import jaccard, mixing, packing, quality, toxicity
from contactlake.llm.queries import QUALITY_FROM, TOKEN_LIMIT, TOKENIZER, TOXIC_FROM
from contactlake.llm.tables import read
from contactlake.session import shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _kept(docs: DataFrame, verdicts: DataFrame, keep) -> DataFrame:
    """The documents whose id has a verdict that is kept; a row without an id goes."""
    ids = verdicts.where(keep).select("doc_id")
    return docs.join(ids, "doc_id", "left_semi").select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return _kept(docs, quality.quality_scores(docs, read(spark, sf_dir, "labels"), threshold=QUALITY_FROM),
                 F.col("predicted") == 1)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    return _kept(docs, toxicity.toxicity_scores(docs, read(spark, sf_dir, "labels"), threshold=TOXIC_FROM),
                 F.col("predicted") == 0)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    kept = _kept(docs, jaccard.jaccard_components(docs), F.col("component_id") == F.col("doc_id"))
    return kept.dropDuplicates(["doc_id"])


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, 0 to 3 times."""
    copies = mixing.mix_sources(docs).where("copies > 0").select("doc_id", F.col("copies").cast("int").alias("_copies"))
    return (docs.join(copies.groupBy("doc_id").agg(F.max("_copies").alias("_copies")), "doc_id")
            .withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_copies")))).select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), TOKEN_LIMIT, end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", near_copy_stage),
    ("mixing sources", mix_stage),
    ("packing", packing_stage),
]

# Models, tokens and the packing order cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written in the shared folder and read again."""
    out = read(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        result = stage(spark, out, sf_dir)
        result.write.parquet(f"{folder}/{k}")
        out = spark.read.schema(result.schema).parquet(f"{folder}/{k}")
    return out


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
