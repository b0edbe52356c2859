"""Set-oriented jobs against direct sequential models on random tables."""
import random

from pyspark.sql import functions as F

from contactlake.operators import contacts as C
from contactlake.operators import hits as H
from contactlake.operators import leads as L
from contactlake.operators import profile as P
from contactlake.operators import runs as R
from contactlake.operators.containment import first_containing
from contactlake.operators.html import source_rank
from contactlake import schemas as S
from contactlake import fixed_values as V


def test_first_hits_and_grouping(spark):
    rng = random.Random(1)
    rows, first_want, group_want = [], [], {}
    for b in range(40):
        hits = [dict(brief_id=f"b{b}", pos=i, query=rng.choice("qrs"), domain=rng.choice("abcdef"),
                     title="t" * rng.randint(0, 3) + str(i % 2), snippet="s" * rng.randint(0, 2), engine=rng.choice("xy"))
                for i in range(rng.randint(0, 30))]
        for h in hits:
            h["url"] = f"u{h['pos']}"
            rows.append(h)
        kept = []
        for query in "qrs":
            seen = set()
            for h in hits:
                if h["query"] == query and h["domain"] not in seen and len(seen) < 4:
                    seen.add(h["domain"])
                    kept.append(h)
        first_want += [(h["brief_id"], h["query"], h["pos"]) for h in kept]
        for h in sorted(kept, key=lambda h: h["pos"]):
            g = group_want.setdefault((h["brief_id"], h["domain"]), dict(
                title=h["title"], snippet=h["snippet"], urls=[], queries=set()))
            g["urls"].append(h["url"])
            g["queries"].add(h["query"])
            for c in ("title", "snippet"):
                if len(h[c]) > len(g[c]):
                    g[c] = h[c]
    df = spark.createDataFrame(rows, "brief_id STRING, pos INT, query STRING, domain STRING, title STRING, "
                                     "snippet STRING, engine STRING, url STRING")
    first = H.first_hits(df, 4)
    assert sorted((r.brief_id, r["query"], r.pos) for r in first.collect()) == sorted(first_want)
    got = {(r.brief_id, r.domain): dict(title=r.title, snippet=r.snippet, urls=r.urls, queries=set(r.queries))
           for r in H.group_by_domain(first).collect()}
    assert got == group_want


def test_candidate_cut(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for b in range(120):
        n, max_sites, check = rng.randint(0, 90), rng.choice([10, 12, 60]), rng.random() < 0.8
        cands = [dict(brief_id=f"b{b}", domain=f"d{i:03d}", queries=["q"] * rng.randint(1, 3), alive=rng.random() < 0.4,
                      max_sites=max_sites, check_alive=check) for i in range(n)]
        rows += cands
        order = sorted(cands, key=lambda c: (-len(c["queries"]), c["domain"]))
        window = max(max_sites + 20, int(max_sites * 1.4))
        if check:
            out = [c for c in order[:window] if c["alive"]][:max_sites]
            out += order[window:][: max_sites - len(out)]
        else:
            out = order[:max_sites]
        if out:
            want[f"b{b}"] = [c["domain"] for c in out]
    df = spark.createDataFrame(rows, "brief_id STRING, domain STRING, queries ARRAY<STRING>, alive BOOLEAN, "
                                     "max_sites INT, check_alive BOOLEAN")
    got = {}
    for r in H.cut_candidates(df, F.col("max_sites"), F.col("check_alive")).orderBy("brief_id", "pick").collect():
        got.setdefault(r.brief_id, []).append(r.domain)
    assert got == want


def _pick(contacts, policy, threshold=10, limit=10):
    kind = lambda p: "mobile" if p[1] == "9" else "city"
    rank = lambda s: 2 if s.endswith("-tel") else V.SOURCE_RANK.get(s, 9)
    if len(contacts) > threshold:
        return [p for p, s in sorted([c for c in contacts if kind(c[0]) == "mobile"], key=lambda c: rank(c[1]))][:limit]
    keep = {"mobile": ["mobile"], "city": ["city"]}.get(policy, ["mobile", "city"])
    out = [p for p, _ in contacts if kind(p) in keep]
    return [p for p, _ in contacts] if not out and policy == "mobile" else out


def test_pick_phones(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for i in range(200):
        phones = rng.sample([f"7{rng.choice('94')}{k:09d}" for k in range(30)], rng.choice([0, 1, 3, 10, 11, 14]))
        pairs = [(p, rng.choice(["header", "nav-tel", "text", "footer", "json-ld"])) for p in phones]
        policy = rng.choice(C.POLICIES)
        rows.append((i, policy, [(k, p, "mobile" if p[1] == "9" else "city", s) for k, (p, s) in enumerate(pairs)]))
        want[i] = _pick(pairs, policy)
    df = spark.createDataFrame(rows, f"i INT, policy STRING, contacts ARRAY<{S.CONTACT}>")
    got = {r.i: r.p for r in df.select("i", C.pick_phones(F.col("contacts"), F.col("policy")).alias("p")).collect()}
    assert got == want
    flat = df.select(F.col("i").alias("site"), "policy", F.inline("contacts"))
    for policy in ("mobile", "business"):
        mine = flat.where(F.col("policy") == policy).withColumn("source_rank", source_rank(F.col("source")))
        got = {r.site: r.phones for r in C.pick_by_site(mine, "site", policy=policy).collect()}
        assert got == {i: want[i] for i, p, c in rows if p == policy and c}


def test_first_per_site(spark):
    rows = [("s", 3, "7900", "mobile", "text"), ("s", 1, "7900", "mobile", "nav"), ("s", 2, "7495", "city", "text")]
    df = spark.createDataFrame(rows, "site STRING, ord INT, phone STRING, type STRING, source STRING")
    got = sorted((r.phone, r.ord, r.source) for r in C.first_per_site(df, "site").collect())
    assert got == [("7495", 2, "text"), ("7900", 1, "nav")]


def test_dedupe(spark):
    rng = random.Random(4)
    rows, want = [], set()
    for b in range(150):
        seen_sites, seen = set(), set()
        for i in range(rng.randint(0, 25)):
            site = rng.choice(["a", "A", "b", "c", "d", "e", "f"])
            p1 = rng.choice(["", None, "1", "2", "3", "4"])
            p2 = rng.choice(["", None, "1", "2", "5"]) if p1 else None
            rows.append((f"b{b}", i, site, p1, p2))
            if site.lower() in seen_sites:
                continue
            seen_sites.add(site.lower())
            if p1 and p1 in seen and not p2:
                continue
            seen |= {p for p in (p1, p2) if p}
            want.add((f"b{b}", i))
    df = spark.createDataFrame(rows, "brief_id STRING, ord INT, site STRING, p1 STRING, p2 STRING")
    assert {(r.brief_id, r.ord) for r in L.dedupe_leads(df).collect()} == want


def test_containment(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    texts = [("b", f"u{i:02d}", word(rng.randint(0, 60))) for i in range(40)] + [("c", "u00", "abcabcabc")]
    needles = [("b", word(rng.randint(1, 8))) for _ in range(150)] + [("c", "bcabc"), ("c", "zz"), ("c", "bcabca")]
    want = {}
    for brief, n in needles:
        urls = [u for b, u, t in texts if b == brief and n in t]
        if urls:
            want[brief, n] = min(urls)
    got = first_containing(
        spark.createDataFrame(texts, "brief_id STRING, url STRING, text STRING"),
        spark.createDataFrame(needles, "brief_id STRING, needle STRING"), ["brief_id"], "url")
    assert {(r.brief_id, r.needle): r.url for r in got.collect()} == want


def test_keywords(spark):
    import re
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["опалубка", "аренда", "монтаж", "под", "сайт", "каркас-дом", "bricks", "stone"])
                      for _ in range(rng.randint(0, 40))) for _ in range(60)]

    def model(text):
        counts = {}
        for w in re.findall(r"[а-яёa-z][а-яёa-z\-]{3,}", text):
            if len(w) >= 5 and w not in V.KEYWORD_STOP_WORDS:
                counts[w] = counts.get(w, 0) + 1
        return [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], -len(x[0])))[:4]]

    df = spark.createDataFrame(list(enumerate(texts)), "i INT, body STRING")
    got = {r.i: r.keywords for r in P.with_keywords(df, "body", limit=4).collect()}
    assert got == {i: model(t) for i, t in enumerate(texts)}


def test_progress(spark):
    rng = random.Random(7)
    runs, steps, sites, probes, want = [], [], [], [], {}
    for i in range(150):
        status = rng.choice(["running", "pending", "stopped", "error", "done"])
        state = {s: rng.choice(["done", "running", "pending", "done"]) for s in V.STEPS}
        checked, total = rng.randint(0, 30), rng.choice([0, 30, 70])
        done, n = rng.randint(0, 5), 5 if rng.random() < 0.8 else 0
        done = min(done, n)
        runs.append((i, status))
        steps += [(i, s, v) for s, v in state.items()]
        sites += [(i, f"s{k}", rng.choice(["success", "error", "skip"]) if k < done else "pending") for k in range(n)]
        probes.append((i, checked, total))
        if status == "done":
            want[i] = (100, "")
            continue
        p, current = 0, ""
        for s in V.STEPS:
            if state[s] == "done":
                p += 16
            elif state[s] == "running":
                current = s
                p += 8
                if s == "filter" and total > 0:
                    p += int(16 * 0.75 * checked / total)
                if s == "crawl":
                    p += int(16 * 0.5 * done / max(1, n))
        want[i] = (min(p, 99 if status in ("running", "pending") else 100), current)
    got = R.progress(
        spark.createDataFrame(runs, "run_id INT, status STRING"),
        spark.createDataFrame(steps, "run_id INT, step STRING, status STRING"),
        spark.createDataFrame(sites, "run_id INT, site STRING, status STRING"),
        spark.createDataFrame(probes, "run_id INT, checked INT, total INT"))
    assert {r.run_id: (r.progress, r.current_step) for r in got.collect()} == want


def test_crawl_results(spark):
    """Stop at the first page with a number; the title is the first filled one up to there."""
    c = [(0, "74951112233", "city", "text")]
    rows = [
        ("home", 0, "Home", "b0", c), ("home", 1, "Two", "b1", c),
        ("later", 0, "", "b0", []), ("later", 1, "T1", "b1", []), ("later", 2, "T2", "b2", c), ("later", 3, "T3", "b3", c),
        ("never", 0, "", "b0", []), ("never", 5, "T5", "b5", []),
    ]
    df = spark.createDataFrame(rows, f"site STRING, visit INT, title STRING, body STRING, contacts ARRAY<{S.CONTACT}>")
    got = {r.site: (r.found_at, r.title, r.text, r.pages, len(r.contacts)) for r in C.crawl_results(df).collect()}
    assert got == {"home": (0, "Home", "b0", 1, 1), "later": (2, "T1", "b0\nb1\nb2", 3, 1),
                   "never": (None, "T5", "b0\nb5", 2, 0)}
    limited = C.limit_visits(df, 2, "visit")
    assert limited.where("site = 'later'").count() == 2
