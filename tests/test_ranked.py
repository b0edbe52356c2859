"""Global ranks and pages of a stored order."""
import random
import re

import pytest
from pyspark.sql import functions as F

from contactlake.operators import ranked as R


def explained(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def rows(spark, n, seed=1):
    r = random.Random(seed)
    return spark.createDataFrame([(i, r.choice([None, "b", "a", "c"])) for i in range(n)], "i INT, t STRING").repartition(5)


def plain(df):
    return [x.i for x in sorted(df.collect(), key=lambda x: (x.t is not None, [-ord(c) for c in x.t or ""], x.i))]


def order():
    return [F.col("t").desc_nulls_first(), F.col("i").asc()]


@pytest.mark.parametrize("n", [0, 1, 7, 300])
def test_ranks(spark, n):
    df = rows(spark, n)
    got = R.ranked(df, *order(), parts=6)
    assert got.columns == ["i", "t", "rank"]
    assert [x.i for x in sorted(got.collect(), key=lambda x: x.rank)] == plain(df)
    assert sorted(x.rank for x in got.collect()) == list(range(1, n + 1))


def test_pages_read_their_range_only(spark, tmp_path):
    df, path = rows(spark, 1000), str(tmp_path / "grid")
    R.write_ranked(df, path, *order(), parts=8)
    want = plain(df)
    for page in (1, 7, 20, 99, -3):
        at = max(1, min(page, 20))
        got = R.ranked_page(spark, path, page, 50)
        assert [x.i for x in sorted(got.collect(), key=lambda x: x.rank)] == want[(at - 1) * 50:at * 50]
        assert got.select(F.input_file_name()).distinct().count() <= 2
        assert re.search(r"PartitionFilters: \[.*_part", explained(got))
    assert sorted((x.rank, x.i) for x in R.ranked_after(spark, path, 990, 50).collect()) == list(enumerate(want, 1))[990:]


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "grid")
    R.write_ranked(rows(spark, 0), path, *order())
    assert R.ranked_page(spark, path, 3).collect() == []
