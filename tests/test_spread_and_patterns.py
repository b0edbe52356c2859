"""Tasks of fair size whatever the row groups, and tests of phrases and briefs that match each text a fixed number of times."""
import pytest
from pyspark.sql import functions as F

from contactlake.functions.text import has_service_sense, looks_like_query, mostly_caps
from contactlake.session import TASK_ROWS, spread
from contactlake.sources.readers import parse_briefs


def rows_of(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_one_row_group_cut_into_empty_splits_is_spread(spark, tmp_path):
    path, key = str(tmp_path / "t"), "spark.sql.files.maxPartitionBytes"
    spark.range(40_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x")).coalesce(1).write.parquet(path)
    before = spark.conf.get(key)
    spark.conf.set(key, "64k")
    try:
        df = spark.read.parquet(path)
        assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and len(rows_of(df)) == 1
        got = rows_of(spread(df))
    finally:
        spark.conf.set(key, before)
    assert sum(got) == 40_000 and max(got) < 10_000


def test_tasks_of_a_long_table_stay_short(spark):
    many = spark.range(0, 80 * TASK_ROWS, 1, spark.sparkContext.defaultParallelism)
    got = rows_of(spread(many))
    assert sum(got) == 80 * TASK_ROWS and max(got) <= 2 * TASK_ROWS
    fair = spark.range(0, 1000, 1, 20)
    assert spread(fair) is fair


@pytest.mark.parametrize("text, caps, sense, query", [
    ("ABCD ef", True, False, False), ("ABC def", False, False, False), ("home menu", False, False, False),
    ("home menus, blogs", False, True, True), ("опт", False, True, False), ("завод слово опалубка дом", False, True, False),
    ("заводы слово опалубка", False, True, True), (" купить\tслово ", False, True, True), ("a1 b2 c3", False, False, False),
    ("", False, False, False), ("ÄÖÜÉ 12 ÀÈ", True, False, False), ("read moreover", False, False, False)])
def test_phrases(spark, text, caps, sense, query):
    p = F.col("p")
    df = spark.createDataFrame([(text,)], "p STRING").select(mostly_caps(p), has_service_sense(p), looks_like_query(p))
    assert tuple(df.first()) == (caps, sense, query)


def test_no_list_of_letters_or_words_is_made(spark):
    p = F.col("p")
    df = spark.createDataFrame([("x",)], "p STRING").select(mostly_caps(p), has_service_sense(p), looks_like_query(p))
    plan = plan_of(df)
    assert not any(x in plan for x in ("regexp_extract_all", "regexp_count", "filter(", "split("))


def test_briefs_are_matched_as_a_whole(spark):
    text = "Клиент: A\nклиент: B\nclientName:\n---\nC\nD: x\n---\nКлиент\nНеизвестно: z\nСайт клиента:  c.ru \nМакс. сайтов: 7"
    df = parse_briefs(spark.createDataFrame([(1, text), (2, None), (3, "")], "i INT, value STRING"))
    a, b, c = (r.brief for r in df.orderBy("i").collect())
    assert (a.clientName, a.clientSite, a.maxSites, a.checkAlive) == ("C\nD: x", "https://c.ru/", 7, True)
    assert (b.clientName, c.clientName, c.clientSite, c.maxSites) == ("", "", None, 50)
    # one search for entries and for each form of value, one filter (of sources)
    plan = plan_of(df)
    assert plan.count("regexp_extract_all") == 3 and plan.count("filter(") == 1
