"""Stored runs -> history list, comparison and export."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlake.functions.phone import RU, NumberingPlan
from contactlake.operators.runs import compare_runs, latest_runs, of_operator, summarize_runs
from contactlake.sources.readers import run_results
from contactlake.sources.writers import export_table, export_width, exportable, write_csv


def history(runs: DataFrame, operator: str | None = None, limit: int = 100) -> DataFrame:
    rows = summarize_runs(runs)
    return latest_runs(of_operator(rows, operator) if operator is not None else rows, limit)


def compare(runs: DataFrame, a: str, b: str) -> DataFrame:
    rows = run_results(runs.where(F.col("id").isin(a, b))).select("run_id", "site").distinct()
    return compare_runs(rows.where(F.col("run_id") == a), rows.where(F.col("run_id") == b))


def export_run(runs: DataFrame, run_id: str, path: str, marked_only: bool = False,
               plan: NumberingPlan = RU) -> None:
    run = runs.where(F.col("id") == run_id)
    reviewed = run.agg(F.bool_and(F.coalesce("pipeline.sources_reviewed", F.lit(False)))).first()[0]
    rows = exportable(run_results(run), bool(reviewed), marked_only)
    write_csv(export_table(rows, export_width(rows, plan), plan), path)
