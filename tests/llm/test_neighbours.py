"""Inverted multi-index against all pairs."""
import numpy as np
import pytest

from contactlake.llm.neighbours import cell_order, nearest_neighbours

SCHEMA = "vec_id LONG, embedding ARRAY<FLOAT>, label INT, cell INT, block INT, score DOUBLE, rank INT"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 0.5, 4) for i, v in rows], SCHEMA)


def plain(rows, every, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    return {i: sorted(((-float((q * v).sum()), j) for j, v in good if j != i))[:k] for i, q in good if i % every == 0}


def test_cells_come_by_falling_sum():
    rng = np.random.Generator(np.random.PCG64(1))
    a, b, held = rng.normal(size=7), rng.normal(size=5), rng.integers(0, 4, 35)
    got = cell_order(a, b, held, int(held.sum()))
    sums = (a[:, None] + b[None]).ravel()
    want = [c for c in np.argsort(-sums, kind="stable") if held[c]]
    assert got == want[:len(got)] and sum(held[got]) == held.sum()
    assert cell_order(a, b, held, 1) == want[:1]


def test_all_cells_visited_is_exact_with_ties_and_hot_vectors(spark):
    rng = np.random.Generator(np.random.PCG64(2))
    rows = [(i, rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(400)]
    rows += [(i, [1.0, 2.0, 0.0, 0.0, 1.0, -1.0]) for i in range(400, 650)]
    rows += [(660, None), (680, [0.0] * 6), (700, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (720, [float("nan")] * 6), (740, [float("inf")] + [0.0] * 5),
             (760, [])]
    df = nearest_neighbours(table(spark, rows).repartition(3), 20, share=1.0, centroids_a_half=8, block_rows=50)
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert got == {q: v for q, v in plain(rows, 20, 20).items()}


def test_recall_of_the_production_share(spark):
    rng = np.random.Generator(np.random.PCG64(3))
    v = rng.normal(size=(4000, 32))
    rows = [(i, x.tolist()) for i, x in enumerate(v / np.linalg.norm(v, axis=1, keepdims=True))]
    got = {}
    for r in nearest_neighbours(table(spark, rows), 20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = plain(rows, 20, 20)
    assert np.mean([len(got[q] & {j for _, j in w}) / 20 for q, w in want.items()]) >= 0.9


@pytest.mark.parametrize("rows", [[], [(20, None)], [(20, [1.0, 2.0])], [(20, [1.0, 2.0]), (21, [3.0, 4.0]), (22, [1.0])]])
def test_few_rows(spark, rows):
    got = [tuple(r) for r in nearest_neighbours(table(spark, rows), 20).collect()]
    assert got == ([(20, 1, 21, 11.0)] if len(rows) == 3 else [])
