"""Small JSON notes in a shared folder, replaced in one step."""
from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_note(spark: SparkSession, path: str, default=None):
    """The note, or ``default`` where there is none."""
    place, fs = _place(spark, path)
    if not fs.exists(place):
        return default
    stream = fs.open(place)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def write_note(spark: SparkSession, path: str, value) -> None:
    """Replace the note: written beside it and renamed over it, so a reader sees the old or the new one."""
    jvm = spark.sparkContext._jvm
    fresh, fs = _place(spark, f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(fresh, True)
    try:
        stream.write(json.dumps(value).encode())
    finally:
        stream.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    place = jvm.org.apache.hadoop.fs.Path(path)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fresh, place, options)


def drop_folder(spark: SparkSession, path: str) -> None:
    place, fs = _place(spark, path)
    fs.delete(place, True)
