"""Shards and source mix against plain models."""
import zlib

import numpy as np
import pytest
from helpers import no_documents, odd_documents, odd_rows
from pyspark.sql import functions as F

from contactlake.llm.mixing import balance, mix_sources, round_rates, source_targets
from contactlake.llm.shards import balanced_shards
from contactlake.llm.tables import highest, log_level, prefix_sums


def test_prefix_sums_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"), (F.col("id") % 7).alias("v")).repartition(5)
    out, total, count = prefix_sums(df, ["k"], "v")
    rows = sorted((r.k, r.v, r.before, r.place) for r in out.collect())
    at = 0
    for i, (k, v, before, place) in enumerate(rows):
        assert (before, place) == (at, i)
        at += v
    assert (total, count) == (at, 1000)


def test_highest_levels_fit(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([1, 1, 1, 5, 5, 9, 100, 100_000])], "i INT, n INT")
    for most, want in ((8, 8), (7, 5), (5, 5), (4, 3), (2, 2), (0, 0)):
        assert highest(df, log_level(F.col("n")), most).count() == want
    assert highest(df.limit(0), log_level(F.col("n")), 3).count() == 0


def test_shards_are_even_gapless_and_keep_groups(spark):
    rng = np.random.Generator(np.random.PCG64(1))
    texts = ["x" * int(n) for n in rng.integers(0, 900, 3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING").repartition(4)
    rows = balanced_shards(docs, 7).collect()
    assert sorted(r.doc_id for r in rows) == list(range(3000))
    assert all(r.size == len(texts[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
    sizes = np.bincount([r.shard for r in rows], [r.size for r in rows], 7)
    assert sizes.max() / sizes.mean() < 1.05 and sizes.min() / sizes.mean() > 0.95
    for s in range(7):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert [tuple(r) for r in sorted(rows)] == [tuple(r) for r in sorted(balanced_shards(docs.repartition(3), 7).collect())]


def test_a_group_larger_than_a_shard_is_split(spark):
    docs = spark.createDataFrame([(i, "same text" if i < 800 else f"t{i}") for i in range(1000)], "doc_id LONG, text STRING")
    rows = balanced_shards(docs, 5).collect()
    sizes = np.bincount([r.shard for r in rows], [r.size for r in rows], 5)
    assert sizes.max() / sizes.mean() < 1.05


def test_shards_of_odd_rows(spark):
    rows = balanced_shards(odd_documents(spark), 24).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in rows) == sorted(
        (d[0] is None, d[0] or 0, len((d[1] or "").encode()) + 8) for d in odd_rows())
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert balanced_shards(no_documents(spark), 24).collect() == []


def plain_targets(sizes, weights, most):
    total, free, target = sum(sizes), set(range(len(sizes))), {}
    while free:
        left = total - sum(target.values())
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        above = {i for i in free if share[i] > most * sizes[i]}
        if not above:
            return [target.get(i, share.get(i)) for i in range(len(sizes))]
        target |= {i: most * sizes[i] for i in above}
        free -= above
    return [target[i] for i in range(len(sizes))]


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 1000, 1, 5, 800], [0, 5, 7], [3], [0, 0], [1, 2, 3, 4, 5, 6, 700]])
def test_targets_and_rates(spark, sizes):
    df = spark.createDataFrame([(f"s{i:02d}", n) for i, n in enumerate(sizes)] + [(None, 4)], "source STRING, size LONG")
    got = {r.source: r for r in balance(source_targets(df)).collect()}
    want = plain_targets([*sizes, 4], [i % 3 + 1 for i in range(len(sizes) + 1)], 3)
    for i, name in enumerate([*(f"s{i:02d}" for i in range(len(sizes))), None]):
        r = got[name]
        assert r.target == pytest.approx(want[i]) and r.rate * r.source_size == pytest.approx(want[i])


def test_rounding_keeps_bounds_and_sum():
    rng = np.random.Generator(np.random.PCG64(3))
    sizes = np.sort(rng.integers(0, 500, 400))[::-1]
    for rate in (0.0, 0.2, 1.0, 1.7, 2.99, 3.0):
        copies = round_rates(sizes, np.full(400, rate), 3)
        assert copies.min() >= 0 and copies.max() <= 3
        assert abs((copies * sizes).sum() - rate * sizes.sum()) <= 0.0005 * 3 * sizes.sum()


def test_mix_of_odd_rows_and_many_cells(spark):
    rows = mix_sources(odd_documents(spark)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in rows) == sorted(
        (d[0] is None, d[0] or 0, len((d[1] or "").encode().split())) for d in odd_rows())
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    assert mix_sources(no_documents(spark)).collect() == []
    docs = spark.createDataFrame([(i, "w " * (i % 50 + 1), "hot" if i % 3 else f"s{i % 5}") for i in range(3000)],
                                 "doc_id LONG, text STRING, source STRING")
    one, two = (sorted(tuple(r) for r in mix_sources(d, cell_rows=100).collect()) for d in (docs, docs.repartition(7)))
    assert one == two
    taken, target = {}, {}
    for doc, source, size, whole, goal, rate, copies, words in one:
        taken[source] = taken.get(source, 0) + words
        target[source] = goal
    assert all(abs(taken[s] / target[s] - 1) < 0.01 for s in target)
