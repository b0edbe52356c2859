"""A keyed table that takes batches as sorted runs and merges them level by level.

Every batch becomes a run of level 0.  When a level holds ``fan_in`` runs they are merged into one
run of the next level, so a row is rewritten once a level (a logarithm of the number of batches)
and a reader meets fewer than ``fan_in`` runs a level.  A note lists the runs of the current
version and is replaced in one step: readers see one version, and a batch that is repeated after
a failure changes nothing.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactlake.sources.notes import drop_folder, read_note, write_note

FAN_IN = 4


class MergedTable:
    """Latest row of each key; ``order`` is the column (or struct) whose greatest value wins."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: tuple, order: str, fan_in: int = FAN_IN):
        self.spark, self.path, self.schema = spark, path, schema
        self.keys, self.order, self.fan_in = list(keys), order, fan_in
        self._note = f"{path}/_runs.json"

    def _version(self) -> dict:
        return read_note(self.spark, self._note, {"runs": [], "old": []})

    def runs(self) -> list[dict]:
        """Runs of the current version: folder, level, first and last batch."""
        return self._version()["runs"]

    def _latest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.keys]
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), self.order).alias("_r")).select(*self.keys, "_r.*")

    def _rows(self, runs: list[dict]) -> DataFrame:
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*[f"{self.path}/{r['folder']}" for r in runs]) if runs else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The current version, one row a key."""
        return self._latest(self._rows(self.runs()))

    def _write(self, rows: DataFrame, level: int, first: int, last: int) -> dict:
        folder = f"level={level}/run-{first}-{last}-{uuid.uuid4().hex[:8]}"
        self._latest(rows).write.parquet(f"{self.path}/{folder}")
        return {"folder": folder, "level": level, "first": first, "last": last}

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Take a batch, numbered upwards; one that is in already is passed over.

        Runs that a merge replaced stay until the next version, for readers that still list them.
        """
        version = self._version()
        runs = version["runs"]
        if any(r["last"] >= batch_id for r in runs):
            return
        runs = [*runs, self._write(rows.select(*self._rows([]).columns), 0, batch_id, batch_id)]
        replaced, level = [], 0
        while len(same := [r for r in runs if r["level"] == level]) >= self.fan_in:
            merged = self._write(self._rows(same), level + 1, same[0]["first"], same[-1]["last"])
            runs = [*[r for r in runs if r["level"] > level], merged]
            replaced += [r["folder"] for r in same]
            level += 1
        write_note(self.spark, self._note, {"runs": runs, "old": replaced})
        for folder in version["old"]:
            drop_folder(self.spark, f"{self.path}/{folder}")
