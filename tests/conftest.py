import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from contactlake.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("8", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture
def ev(spark):
    """Evaluate one column expression over rows of values: ev(fn, [(a, b), ...]) -> list."""
    from pyspark.sql import functions as F

    def run(fn, rows, schema=None):
        rows = [r if isinstance(r, tuple) else (r,) for r in rows]
        names = [f"c{i}" for i in range(len(rows[0]))]
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                                   schema and f"i INT, {schema}" or ["i", *names])
        cols = [F.col(c) for c in df.columns[1:]]
        return [r.v for r in df.select("i", fn(*cols).alias("v")).orderBy("i").collect()]
    return run
