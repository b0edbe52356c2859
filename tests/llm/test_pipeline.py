"""Registered queries of the subpackage and the stages of the pipeline."""
import os

import pytest
from test_jaccard import plain_components

import __spark_entry__ as entry
import corpus_pipeline

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_all_eleven_are_registered():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, out[-1], SF).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def test_stages_keep_the_columns_and_only_given_rows(stages):
    given = {r.doc_id: r for r in stages[0].collect()}
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns
        assert all(given[r.doc_id] == r for r in df.collect())


def test_one_of_each_group_of_near_copies_stays(stages):
    before = {r.doc_id: r.text for r in stages[2].collect()}
    want = {c for _, c in plain_components(sorted(before.items())).values()}
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(want)


def test_clean_documents_stay(stages):
    marks = {r.doc_id: r for r in stages[0].sparkSession.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = {i for i, r in marks.items() if r.quality == 1 and r.toxic == 0}
    kept = {r.doc_id for r in stages[2].collect()}
    assert len(clean & kept) >= 0.85 * len(clean)      # the smallest tables teach from 70 rows


def test_mix_repeats_and_packing_holds_every_copy(stages):
    copies = {}
    for r in stages[4].collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert max(copies.values()) <= 3
    starts = {}
    for r in stages[5].where("start = 0").collect():
        starts[r.doc_id] = starts.get(r.doc_id, 0) + 1
    assert starts == copies
