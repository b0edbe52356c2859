"""Every training word is a context of its own, however rare and however many there are."""
import math
from collections import Counter

import numpy as np
import pytest
from test_language import held
from test_textarrays import plain_words

from contactlake.llm import language
from contactlake.llm.language import EliasFano, language_scores
from contactlake.llm.queries import op2_language


def every_context(rows, prior):
    """rows: (id, text) -> id: score, each word its own context."""
    texts = [(i, plain_words(t) + [None]) for i, t in rows]
    one, context, pair = Counter(), Counter(), Counter()
    for i, w in texts:
        if not held(i):
            one.update(w)
            context.update(["<s>", *w[:-1]])
            pair.update(zip(["<s>", *w], w))
    total, kinds = sum(one.values()), len(one)
    p = lambda w: (one[w] + 1) / (total + kinds + 1)
    return {i: (len(w), sum(math.log10((pair[c, x] + prior * p(x)) / (context[c] + prior)) for c, x in zip(["<s>", *w], w)))
            for i, w in texts}


def rare_rows():
    rng = np.random.Generator(np.random.PCG64(8))
    # every word but "the" fewer than 16 times, each with a follower of its own
    return [(i, " ".join(f"a{int(x)} b{int(x)} the" for x in rng.integers(0, 400, int(rng.integers(0, 12))))) for i in range(300)]


@pytest.mark.parametrize("prior", [2.0, 4_000.0])
def test_rare_words_are_contexts(spark, prior):
    rows = rare_rows()
    want = every_context(rows, prior)
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(3)
    got = {r.doc_id: r.score for r in language_scores(docs, prior=prior, pooled_below=1).collect()}
    assert got.keys() == want.keys()
    assert all(-n / 4096 - 1e-6 <= got[i] - x <= 1e-6 for i, (n, x) in want.items())


def test_the_query_has_no_bound_on_contexts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(language, "CONTEXTS", 3)
    rows = rare_rows()
    spark.createDataFrame(rows, "doc_id LONG, text STRING").write.parquet(str(tmp_path / "documents.parquet"))
    want = every_context(rows, language.PRIOR)
    got = {r.doc_id: r.score for r in op2_language(spark, str(tmp_path)).collect()}
    assert all(-n / 4096 - 1e-6 <= got[i] - x <= 1e-6 for i, (n, x) in want.items()) and got.keys() == want.keys()


def test_successor_in_full_buckets_and_wide_levels():
    v = np.r_[np.arange(0, 20_000, 2), (1 << 50) + np.arange(0, 9, 3)].astype(np.int64)
    for values in (v, np.array([5, 1 << 55], np.int64)):
        ef = EliasFano(*EliasFano.encode(values), len(values))
        assert ef[np.arange(len(values))].tolist() == values.tolist()
        asked = np.r_[values, np.maximum(values - 1, 0)]
        assert ef.successor(asked).tolist() == np.searchsorted(values, asked).tolist()
