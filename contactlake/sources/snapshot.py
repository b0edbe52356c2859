"""Page snapshots kept in buckets of their url, so that looking pages up moves urls and never html.

A snapshot is a table bucketed and sorted by url.  A join on url then shuffles the other side, a
narrow list of urls, to the buckets, and reads html in place; a list that is small enough to be
broadcast is not shuffled either.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A bucket of a hundred thousand pages and more is fine; choose the number by the snapshot's size.
BUCKETS = 64


def write_snapshot(pages: DataFrame, name: str, path: str | None = None, buckets: int = BUCKETS) -> None:
    """Store the pages as table ``name`` (in ``path``, else in the warehouse), one file a bucket."""
    # repartition and bucketBy hash alike, so every task holds one bucket
    writer = pages.repartition(buckets, "url").write.bucketBy(buckets, "url").sortBy("url").mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def read_snapshot(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def pages_at(pages: DataFrame, urls: DataFrame, columns: tuple = ("html",)) -> DataFrame:
    """``urls`` (url and any columns) with these columns of the pages; urls without a page are left out."""
    return urls.join(pages.select("url", *columns), "url")


def has_page(pages: DataFrame, urls: DataFrame) -> DataFrame:
    """The pages of these urls, each once."""
    return pages.join(urls.select("url").where(F.col("url").isNotNull()).distinct(), "url", "left_semi")
