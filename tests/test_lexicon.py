"""Terms of a lexicon table in texts, against plain loops."""
import random

import pytest
from pyspark.sql import functions as F

from contactlake.operators import lexicon as L
from contactlake.operators.containment import first_containing


def plain(texts, terms, with_by=False):
    out = []
    for key, by, text in texts:
        for t_by, group, term in set(terms):
            if not text or not term or (with_by and (by is None or by != t_by)):
                continue
            times = sum(text.startswith(term, i) for i in range(len(text)))
            if times:
                out.append((key, group, term, text.index(term) + 1, times))
    return sorted(out, key=repr)


def made(seed, n_texts=60, n_terms=80, letters="abc é"):
    r = random.Random(seed)
    word = lambda most: "".join(r.choice(letters) for _ in range(r.randint(1, most)))
    texts = [(i, r.choice(["x", "y", "z", None]), r.choice([None, "", word(40), word(200)])) for i in range(n_texts)]
    return texts, [(r.choice(["x", "y", "x", None]), r.choice([1, 2, None]), r.choice([None, "", word(3), word(7)])) for _ in range(n_terms)]


def frames(spark, texts, terms):
    return (spark.createDataFrame(texts, "k INT, who STRING, text STRING").repartition(3),
            spark.createDataFrame(terms, "who STRING, grp INT, term STRING"))


@pytest.mark.parametrize("seed", [1, 2])
def test_all_terms(spark, seed):
    texts, terms = made(seed)
    t, x = frames(spark, texts, terms)
    out = L.find_terms(t, x.drop("who"), ["k"])
    assert sorted(map(tuple, out.collect()), key=repr) == plain(texts, terms and [(None, g, w) for _, g, w in terms])


@pytest.mark.parametrize("limit", [1 << 20, 700, 150])
def test_terms_of_the_same_owner_in_parts(spark, limit):
    texts, terms = made(3)
    t, x = frames(spark, texts, terms)
    out = L.find_terms(t, x, ["k"], by=("who",), limit_bytes=limit)
    assert out.columns == ["k", "grp", "term", "place", "times"]
    assert sorted(map(tuple, out.collect()), key=repr) == plain(texts, terms, True)


def test_parts_hold_less_than_the_limit(spark):
    _, x = frames(spark, *made(4, n_terms=300))
    rows = x.where("who IS NOT NULL AND term <> ''").distinct()
    parts = L.lexicon_parts(rows, ("who",), "term", 500)
    sizes = [L._size(p, "term") for p, _ in parts]
    assert max(sizes) <= 500 and sum(sizes) == L._size(rows, "term") and len(parts) > 10


def test_plan_does_not_grow_with_the_lexicon(spark):
    plans = []
    for n in (3, 3000):
        t = spark.range(5).select("id", F.lit("t12 t7").alias("text"))
        x = spark.range(n).select(F.concat(F.lit("t"), "id").alias("term"))
        out = L.find_terms(t, x, ["id"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        plans.append(len(plan))
        assert "Exchange" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert abs(plans[0] - plans[1]) < 10


def test_empty_sides(spark):
    t, x = frames(spark, [(1, "x", "abc")], [("x", 1, "b")])
    assert L.find_terms(t.limit(0), x, ["k"], by=("who",)).count() == 0
    assert L.find_terms(t, x.limit(0), ["k"], by=("who",)).count() == 0


def test_first_text_that_names_a_needle(spark):
    texts, terms = made(6)
    t, x = frames(spark, texts, terms)
    got = first_containing(t, x.select("who", F.col("term").alias("needle")), ["who"], "k")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "text" not in plan.split("Exchange")[1].split("MapInArrow")[0]
    want = {}
    for k, who, text in sorted(texts, key=lambda r: r[0]):
        for w, _, term in terms:
            if who is not None and who == w and term and text and term in text:
                want.setdefault((who, term), k)
    assert {(r.who, r.needle): r.k for r in got.collect()} == want


def test_summary_of_terms(spark):
    t = spark.createDataFrame([(1, "red fox, red hen"), (2, "nothing"), (3, None)], "k INT, text STRING")
    x = spark.createDataFrame([("a", "red"), ("a", "fox"), ("a", "hen"), ("b", "red"), ("b", "red fox"), ("c", "owl")], "grp STRING, term STRING")
    got = {(r.k, r.grp): (r.n_terms, r.times, r.first_term, r.first_place, r.longest, round(r.score, 6))
           for r in L.term_summary(L.find_terms(t, x, ["k"]), ["k", "grp"]).collect()}
    assert got == {(1, "a"): (3, 4, "red", 1, "fox", 3.45), (1, "b"): (2, 3, "red fox", 1, "red fox", 2.5)}


def test_best_group(spark):
    t = spark.createDataFrame([(1, "red fox"), (2, "owl")], "k INT, text STRING")
    x = spark.createDataFrame([("m1", "red", 0), ("m1", "fox", 1), ("m2", "fox", 0), ("m3", "red", 0), ("m3", "fox", 1)],
                              "grp STRING, term STRING, ord INT")
    best = L.best_group(L.find_terms(t, x, ["k"]), ["k"], "grp", order={"m3": 0, "m1": 1, "m2": 2})
    assert [tuple(r) for r in best.collect()] == [(1, "m3")]


def test_packaged_lexicon_gives_the_same_scores(spark):
    from contactlake.operators.profile import model_scores
    from contactlake.sources.readers import term_lexicon

    texts = ["аренда опалубки и продажа стройматериалов", "производство и завод, аренда", "crm сервис интеграция для бизнеса", ""]
    t = spark.createDataFrame(list(enumerate(texts)), "k INT, text STRING")
    x = term_lexicon(spark).where("kind = 'model'").select("group", "term")
    rows = L.term_summary(L.find_terms(t, x, ["k"]), ["k", "group"]).select("k", "group", F.round("score", 6).alias("s")).collect()
    want = [(r.k, c[6:], round(v, 6)) for r in t.select("k", *model_scores(F.col("text"))).collect()
            for c, v in r.asDict().items() if c != "k" and v]
    assert {(r.k, r.group): r.s for r in rows} == {(k, g): s for k, g, s in want} and len(want) > 3


def test_marked_texts_and_first_groups(spark):
    t = spark.createDataFrame([(1, "in kazan and omsk"), (2, "nowhere"), (3, None)], "k INT, text STRING")
    x = spark.createDataFrame([("Omsk", "omsk", 2), ("Kazan", "kazan", 5), ("And", "and", 9)], "label STRING, term STRING, ord INT")
    assert {r.k: r.named for r in L.mark_texts(t, x, "k").collect()} == {1: True, 2: False, 3: False}
    rows = L.first_groups(L.find_terms(t, x, ["k"]), ["k"], "label", "ord", 2).collect()
    assert [(r.k, r.groups) for r in rows] == [(1, ["Omsk", "Kazan"])]
