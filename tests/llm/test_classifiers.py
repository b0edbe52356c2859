"""Quality, toxicity and calibration: held-out accuracy, restored words, odd rows."""
import zlib

import numpy as np
from helpers import labels, no_documents, odd_documents, odd_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from contactlake.llm.calibrate import Calibration, isotonic
from contactlake.llm.quality import KernelRidge, quality_scores, statistics
from contactlake.llm.textarrays import string_block, words
from contactlake.llm.toxicity import (ALPHABET, CharModel, Restorer, disguised, restore_word, toxicity_scores, word_features)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 9)), min_size=1, max_size=12))
def test_isotonic_is_rising_and_beats_its_neighbours(pairs):
    n = np.array([a for a, _ in pairs], float)
    k = np.minimum(n, [b for _, b in pairs])
    start, share = isotonic(np.arange(len(n), dtype=float), n, k)
    fit = share[np.searchsorted(start, np.arange(len(n)), "right") - 1]
    assert (np.diff(fit) >= -1e-12).all()
    assert np.isclose((fit * n).sum(), k.sum())
    # means of upper and lower sets, the closed form of the rising fit
    best = [max(min(k[i:j + 1].sum() / n[i:j + 1].sum() for j in range(m, len(n))) for i in range(m + 1)) for m in range(len(n))]
    assert np.allclose(fit, best)


def test_calibration_without_rows():
    assert Calibration([])(np.array([-1.0, 3.0])).tolist() == [0.5, 0.5]


def test_fourier_features_approach_the_kernel():
    rng = np.random.Generator(np.random.PCG64(1))
    x = rng.normal(size=(30, 5))
    m = KernelRidge(np.zeros(5), np.ones(5), 20_000, 0.1, 3)
    z = m.lift(x)[:, :-1]
    want = np.exp(-0.1 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - want).max() < 0.05


def test_statistics_of_a_text_do_not_depend_on_its_block():
    import pyarrow as pa
    texts = ["", "One two.\nOne two.", "a|b | c", None, "É è 12 !!", "x " * 500]
    def run(t):
        data, at = string_block(pa.array(t, pa.string()))
        return statistics(data, at, words(data, at))
    assert np.allclose(run(texts), np.concatenate([run([t]) for t in texts]))
    assert np.isfinite(run(texts)).all() and run([]).shape[0] == 0


def model_of(text):
    counts = np.zeros(ALPHABET ** 3, np.int64)
    for w in text.split():
        code = [0, 0, *(ord(c) - 96 for c in w), 0]
        for a, b, c in zip(code, code[1:], code[2:]):
            counts[(a * ALPHABET + b) * ALPHABET + c] += 1
    return CharModel(counts)


MODEL = model_of("idiot stupid loser trash clown the and of moron hello sweet little letter " * 50)


def test_disguised_words_are_restored():
    for seen, meant in (("1d10t", "idiot"), ("st.u.p.i.d", "stupid"), ("l0$er", "loser"), ("iiiidiooot", "idiot"), ("m0r0n", "moron"),
                        ("tra5h", "trash"), ("hello", "hello"), ("c|own", "clown"), ("s-t-u-p-1-d", "stupid")):
        assert restore_word(seen, MODEL) == meant, seen


def test_spans_and_blocks_are_restored_in_place():
    import pyarrow as pa
    texts = ["you i d i o t you", "", "plain words stay", "the 1d10t", None, "m 0 r 0 n"]
    data, at = Restorer(MODEL)(*string_block(pa.array(texts, pa.string())))
    raw = data.tobytes().decode()
    assert [raw[a:b] for a, b in zip(at, at[1:])] == ["you idiot you", "", "plain words stay", "the idiot", "", "moron"]
    assert disguised(*string_block(pa.array(["ab", "c", "d", "e"], pa.string()))) == []


def test_features_of_words_do_not_depend_on_place():
    import pyarrow as pa
    h, doc = word_features(*string_block(pa.array(["Word other", "xx word!", "wordy"], pa.string())))
    assert doc.tolist() == [0, 0, 1, 1, 2]
    assert h[0, 0] == h[0, 3] != h[0, 4] and h[1, 0] == h[1, 3] == h[1, 4] and h[2, 4] and not h[2, 0]


def corpus(spark, toxic_words):
    rng = np.random.Generator(np.random.PCG64(5))
    rows, marks = [], []
    for i in range(900):
        w = [f"{'abcdefgh'[int(x) % 8]}{'lmnop'[int(x) % 5]}o" for x in rng.integers(0, 400, int(rng.integers(5, 60)))]
        good, toxic = int(i % 5 > 0), int(i % 7 == 0)
        if toxic:
            w[int(rng.integers(0, len(w)))] = toxic_words[int(rng.integers(0, len(toxic_words)))]
        if not good:
            w = [x.upper() + "!!" for x in w] if i % 2 else [x for x in w for _ in range(6)]
        rows.append((i, " ".join(w)))
        if i % 10 < 7:
            marks.append((i, good, toxic))
    return spark.createDataFrame(rows, "doc_id LONG, text STRING"), labels(spark, marks), rows


def test_quality_on_held_out_rows(spark):
    docs, marks, rows = corpus(spark, ["zzz"])
    got = quality_scores(docs.repartition(3), marks, fit_rows=400).collect()
    assert sorted(r.doc_id for r in got) == list(range(900))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 5 > 0) for r in held]) > 0.95


def test_toxicity_on_held_out_rows_and_disguises(spark):
    docs, marks, rows = corpus(spark, ["idiot", "moron", "loser"])
    more = spark.createDataFrame([(5000, "bmo clo 1d10t dno"), (5001, "bmo i d i o t clo"), (5002, "bmo clo dno")], docs.schema)
    got = toxicity_scores(docs.union(more), marks).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == 903
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 900 and r.doc_id % 5]
    assert np.mean([r.predicted == (r.doc_id % 7 == 0) for r in held]) > 0.95
    assert (by_id[5000].predicted, by_id[5001].predicted, by_id[5002].predicted) == (1, 1, 0)


def test_odd_rows_and_no_labels(spark):
    marks = labels(spark, [(i, i % 2, (i + 1) % 2) for i in range(13)] + [(3, 0, 1), (None, 1, 1), (4, None, None)])
    none = labels(spark, [])
    for f in (quality_scores, toxicity_scores):
        rows = f(odd_documents(spark), marks).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((d[0] is None, d[0] or 0) for d in odd_rows())
        assert all(0 <= r.score <= 1 for r in rows)
        assert all(r.score == 0.5 for r in f(odd_documents(spark), none).collect())
        assert f(no_documents(spark), marks).collect() == []
