"""Near copies against all pairs."""
import random

import numpy as np
import pytest
from helpers import no_documents, odd_documents, odd_rows
from test_textarrays import plain_words

from contactlake.llm.components import components
from contactlake.llm.jaccard import CountTree, count_vector, fold, jaccard_components, list_pairs


def plain_set(text):
    w = plain_words(text)
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain_components(texts):
    """texts: list of (id, text); smallest id reachable."""
    sets = [(i, plain_set(t)) for i, t in texts]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, s) in enumerate(sets):
        for j, u in sets[:k]:
            both = len(s & u)
            if s and u and 100 * both >= 80 * (len(s) + len(u) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(seed, groups, copies, words=60):
    """Groups of copies with 0 to many changed words, unrelated texts and a passage that many share."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [f"p{i}" for i in range(55)]
    texts = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(5, words))]
        for c in range(rng.randint(1, copies)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                t += [rng.choice(vocabulary) for _ in range(rng.randint(1, 6))]
            texts.append(" ".join(t))
    texts += [" ".join([*passage, *(rng.choice(vocabulary) for _ in range(rng.randint(10, 60)))]) for _ in range(60)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed, groups, copies, list_sets", [(1, 60, 6, 8192), (2, 4, 90, 8192), (3, 3, 120, 25)])
def test_components_are_those_of_all_pairs(spark, seed, groups, copies, list_sets):
    texts = corpus(seed, groups, copies)
    docs = spark.createDataFrame(texts, "doc_id LONG, text STRING").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, list_sets=list_sets).collect()}
    assert got == plain_components(texts)


def test_odd_rows(spark):
    rows = sorted(tuple(r)[:3] for r in jaccard_components(odd_documents(spark)).collect())
    given = [(r[0], r[1]) for r in odd_rows() if r[0] is not None]
    distinct = dict(given[:-3] + given[-1:])
    want = plain_components([x for x in distinct.items() if x[0] != 3] + [(3, "a")])
    assert rows == sorted((i, *want[i]) for i, _ in given)
    assert jaccard_components(no_documents(spark)).collect() == []


def test_tree_finds_all_pairs_that_the_bound_allows():
    rng = np.random.Generator(np.random.PCG64(8))
    base = rng.integers(0, 1 << 40, 90).astype(np.uint64)
    sets = [np.unique(np.r_[base[rng.random(90) < 0.97], rng.integers(0, 1 << 40, rng.integers(0, 12)).astype(np.uint64)])
            for _ in range(300)]
    vectors = [count_vector(s) for s in sets]
    groups = min(map(len, vectors))
    v = np.stack([fold(x, groups) for x in vectors])
    sizes = np.array(list(map(len, sets)))
    component = rng.integers(0, 6, 300)
    want = set()
    for i in range(300):
        for j in range(i):
            bound = int(np.minimum(v[i], v[j]).sum())
            n, m = int(sizes[i]), int(sizes[j])
            if component[i] != component[j] and 9 * bound >= 4 * (n + m) and 100 * min(n, m) >= 80 * max(n, m):
                want.add((j, i))
            assert bound >= len(np.intersect1d(sets[i], sets[j]))
    got = list_pairs(np.arange(300), sizes, component, vectors, 80, 100)
    assert want and {tuple(p) for p in got.tolist()} == want
    assert len(CountTree(v, sizes, component).levels) > 1


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, j) for j in range(200, 260)] + [(3, 3), (300, 299), (299, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a LONG, b LONG")).collect()}
    want = {i: 100 for i in range(100, 161)} | {j: 7 for j in [7, *range(200, 260)]} | {299: 299, 300: 299}
    assert got == want
    assert components(spark.createDataFrame([], "a LONG, b LONG")).collect() == []
