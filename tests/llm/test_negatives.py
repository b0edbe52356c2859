"""Hard negatives against plain loops over all rows."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactlake.llm import negatives

SCHEMA = "vec_id LONG, embedding ARRAY<FLOAT>, label INT"
COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def plain(rows, every, k=5, percent=80):
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows
             if i is not None and v is not None and lab is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for anchor, q, label in sorted({r[0]: r for r in sorted(whole, key=lambda r: (r[0], r[2], r[1]), reverse=True)}.values()):
        if anchor % every:
            continue
        scored = sorted((-max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(q, v)))), i, lab) for i, v, lab in whole)
        for s, i, _ in [x for x in scored if x[2] == label and x[1] != anchor][:k]:
            kept = [x for x in scored if x[2] != label and percent * -s <= 100 * -x[0] <= 100 * -s]
            out += [(anchor, i, r + 1, x[1], -s, -x[0]) for r, x in enumerate(kept[:k])]
    return sorted(out)


def mined(spark, rows, every, **more):
    out = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3), every, **more)
    assert tuple(out.columns) == COLUMNS
    return sorted(tuple(r) for r in out.collect())


def make(n, dim, labels, seed, step=0.0):
    g = np.random.Generator(np.random.PCG64(seed))
    v = g.normal(size=(n, dim)) / math.sqrt(dim)
    if step:
        v = np.round(v / step) * step
    return [(int(i), [float(x) for x in v[i]], int(g.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("dim,labels,step,block", [(8, 3, 0.0, 40), (3, 2, 0.25, 30), (2, 4, 0.5, 1000), (16, 2, 0.0, 64)])
def test_random_rows(spark, dim, labels, step, block):
    rows = make(260, dim, labels, dim, step)
    assert mined(spark, rows, 20, block_rows=block, chunk_anchors=5) == plain(rows, 20)


def test_hot_label_and_negative_scores(spark):
    rows = [(i, v, 0 if i % 3 else lab) for i, v, lab in make(300, 4, 5, 9)]
    rows += [(1000, [-9.0, 0.0, 0.0, 0.0], 77), (1001, [9.0, 0.0, 0.0, 0.0], 77)]
    assert mined(spark, rows, 25, block_rows=32) == plain(rows, 25)


def test_odd_rows(spark):
    rows = [*make(60, 3, 2, 1), (None, [1.0, 1.0, 1.0], 1), (70, None, 1), (71, [1.0, None, 1.0], 1), (72, [float("nan"), 1.0, 1.0], 0),
            (73, [float("inf")] * 3, 0), (74, [1.0, 1.0, 1.0], None), (80, [], 1), (90, [0.0, 0.0, 0.0], 1), (91, [0.5], 0),
            (92, [0.5, 0.5, 0.5, 0.5], 0), (100, [1.0, 0.5, 0.25], 5), (5, [0.1, 0.2, 0.3], 1), (5, [0.1, 0.2, 0.3], 1),
            (10, [2.0, 2.0, 2.0], 1), (10, [2.0, 2.0, 2.0], 0)]
    assert mined(spark, rows, 10, block_rows=16) == plain(rows, 10)


def test_empty_and_extra_columns(spark):
    assert mined(spark, [], 10) == []
    rows = make(40, 3, 2, 4)
    named = spark.createDataFrame([(*r, 1, 2, [3], 4, 5) for r in rows],
                                  SCHEMA + ", anchor_id INT, _block INT, vec ARRAY<INT>, score INT, rank INT")
    assert sorted(map(tuple, negatives.hard_negatives(named, 10).collect())) == plain(rows, 10)


@pytest.mark.parametrize("factor", [1e4, 1e9, 1e14])
def test_huge_components(spark, factor):
    rows = [(i, [float(np.float32(x * factor)) for x in v], lab) for i, v, lab in make(60, 3, 2, 6)]
    assert mined(spark, rows, 10, block_rows=16) == plain(rows, 10)


def test_stops_before_all_rows_are_met():
    g = np.random.Generator(np.random.PCG64(3))
    v = np.floor(256 * g.normal(size=(4000, 2))).astype(np.int64)
    lists = negatives.SortedLists(np.arange(4000), v, np.zeros(4000, np.int64), 1000)
    seen = []
    own = lists.vectors

    class Watch:
        def __getitem__(self, at):
            seen.extend(np.atleast_1d(at).tolist())
            return own[at]

    lists.vectors = Watch()
    q = np.array([300, -200])
    (found,) = lists.search(q, [(-2**63, 2**63 - 1)], 5, np.ones(4000, bool))
    scores = v @ q
    assert [r for _, r in found] == np.lexsort((np.arange(4000), -scores))[:5].tolist()
    assert len(seen) == len(set(seen)) < 1000


def test_query_with_sql(spark):
    import oracle

    from contactlake.llm.queries import QUERIES, SQL

    con = oracle.connect("/root/testdata/sf0.01")
    assert oracle.compare(spark, con, "/root/testdata/sf0.01", QUERIES["op12_negatives"], SQL["op12_negatives"]) == []
