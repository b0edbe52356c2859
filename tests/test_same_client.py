"""The latest run of a client is found however many newer runs other clients have."""
from contactlake.operators import runs as O


def test_same_client_over_all_runs(spark):
    rows = [("old", "stopped", "https://a.ru/", "2020-01-01")] + [(f"r{i:02}", "done", f"https://b{i}.ru", f"2021-01-{i + 1:02}")
                                                                  for i in range(31)] + [("x", "running", "c.ru", "2019-01-01")]
    runs = spark.createDataFrame(rows, "id STRING, status STRING, client_site STRING, created_at STRING")
    assert sorted(r.id for r in O.same_client(runs, ("stopped", "running")).collect()) == ["old", "x"]
    assert O.same_client(runs, ("stopped", "running"), newest=30).collect() == []
