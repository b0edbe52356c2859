"""Elias-Fano levels and language-model scores against plain counts."""
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import no_documents, odd_documents, odd_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from test_textarrays import plain_words

from contactlake.llm.language import EliasFano, Trie, language_scores


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=60), st.integers(0, 6000))
def test_elias_fano_access_and_successor(values, probe):
    v = np.sort(np.array(values, np.int64))
    ef = EliasFano(*EliasFano.encode(v), len(v))
    assert ef[np.arange(len(v))].tolist() == v.tolist()
    if len(v) and probe <= v[-1]:
        assert ef.successor(np.array([probe]))[0] == np.searchsorted(v, probe)


def test_trie_gives_stored_pairs_only():
    word = np.array([3, 9, 12], np.uint64)
    pair_word, context = np.array([0, 0, 2, 2, 2]), np.array([1, 65_535, 0, 7, 8])
    t = Trie(word, np.array([-1.0, -2.0, -3.5]), pair_word, context, np.array([-0.5, -0.25, -1.0, -2.0, -3.0]))
    at, asked = np.array([0, 0, 0, 1, 1, 2, 2, 2, 2]), np.array([1, 2, 65_535, 0, 65_535, 0, 7, 8, 9])
    got = t.joint(at, asked)
    want = [-0.5, None, -0.25, None, None, -1.0, -2.0, -3.0, None]
    assert [None if math.isnan(x) else x for x in got] == want
    assert t.single(np.arange(3)).tolist() == [-1.0, -2.0, -3.5]


def plain_scores(rows, prior):
    """rows: (id, text, held out) -> id: (n, known, N, base, score)."""
    texts = [(i, plain_words(t) + [None], h) for i, t, h in rows]
    one, context, pair = Counter(), Counter(), Counter()
    for _, w, held in texts:
        if not held:
            one.update(w)
            for c, x in zip(["<s>", *w], w):
                context[c] += 1
                pair[c, x] += 1
    total, kinds = sum(one.values()), len(one)
    often = {w for w, n in one.items() if n >= 16 and w is not None}
    merged_c, merged_p = Counter(), Counter()
    name = lambda c: c if c in often or c == "<s>" else "<other>"
    for c, n in context.items():
        merged_c[name(c)] += n
    for (c, x), n in pair.items():
        merged_p[name(c), x] += n
    p = lambda w: (one[w] + 1) / (total + kinds + 1)
    out = []
    for i, w, held in texts:
        base = sum(math.log10(p(x)) for x in w)
        score = sum(math.log10((merged_p[name(c), x] + prior * p(x)) / (merged_c[name(c)] + prior)) for c, x in zip(["<s>", *w], w))
        out.append((i, held, len(w), sum(one[x] > 0 for x in w), total, base, score))
    return out


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


@pytest.mark.parametrize("prior", [2.0, 4_000.0])
def test_scores_of_odd_rows(spark, prior):
    rows = [(r[0], r[1], held(r[0])) for r in odd_rows()]
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    got = sorted((tuple(r) for r in language_scores(odd_documents(spark), prior=prior).collect()), key=key)
    want = sorted(plain_scores(rows, prior), key=key)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9)
        assert abs(g[6] - w[6]) <= w[2] / 4096 + 1e-6       # stored probabilities are rounded down
        assert g[6] <= w[6] + 1e-6
    assert language_scores(no_documents(spark)).collect() == []


def test_probabilities_of_next_words_sum_to_at_most_one(spark):
    rng = np.random.Generator(np.random.PCG64(2))
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.5, 30) % 40) for _ in range(200)]
    rows = [(i, t, held(i)) for i, t in enumerate(texts)]
    vocabulary = {w for _, t, h in rows if not h for w in t.split()}
    # score(w0 x) - score(w0): what follows w0, and one word never seen
    probes = [(10_000 + k, f"w0 {x}".strip(), False) for k, x in enumerate(["", *sorted(vocabulary), "never-seen"])]
    ids = [i for i in range(20_000, 40_000) if held(i)][:len(probes)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(i, p[1]) for i, p in zip(ids, probes)], "doc_id LONG, text STRING")
    plain = {r[0]: r[6] for r in plain_scores(rows + [(i, p[1], True) for i, p in zip(ids, probes)], 20.0)}
    got = {r.doc_id: r.score for r in language_scores(docs, prior=20.0).collect()}
    assert all(abs(got[i] - plain[i]) < 0.02 for i in ids)


def test_nothing_to_learn_from(spark):
    i = next(i for i in range(100) if held(i))
    r = language_scores(spark.createDataFrame([(i, "a b")], "doc_id LONG, text STRING")).collect()[0]
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)
