import json

import pytest
from pyspark.sql import functions as F

from contactlake import schemas as S
from contactlake.operators import results as R
from contactlake.operators import runs as O
from contactlake.plans import history as H
from contactlake.sources import readers as I
from contactlake.sources import writers as W


def test_search_responses(spark):
    group = "<group><doc><url>{}</url><title>{}</title>{}</doc></group>"
    texts = {
        1: "<r><response><results><grouping>" + group.format("https://www.A.ru/x", "T &amp; <b>x</b>", "<snippet>s</snippet>")
           + group.format("", "no url", "") + group.format("https://b.ru", "B", "<passage>p</passage>") + "</grouping></results></response></r>",
        2: '<r><error code="15">нет</error></r>', 3: "<r><error>сбой</error></r>", 4: '<r><error code="7"/></r>',
        5: "<r><group><doc><url>https://x.ru</url>", 6: "", 7: "<r><error></error>" + group.format("c.ru/y", "C", "") + "</r>",
    }
    df = spark.createDataFrame(list(texts.items()), "id INT, xml STRING")
    hits, errors = I.read_hits(df)
    got = [(r.id, r.url, r.domain, r.snippet) for r in hits.orderBy("id", "pos").collect()]
    assert got == [(1, "https://www.A.ru/x", "a.ru", "s"), (1, "https://b.ru", "b.ru", "p"), (7, "c.ru/y", "c.ru", "")]
    assert {r.id: r.error for r in errors.collect()} == {
        2: "[15] нет", 3: "сбой", 4: "[7]", 5: "malformed xml"}


BRIEF = """Бриф
Экспорт: 01.01.2026
# заметка: нет
Кто запускает: Иван
Клиент: ООО Ромашка
Сайт клиента: romashka.ru/catalog
Регионы: Москва, Тверская область
Поисковые запросы:
---
аренда опалубки
купить: опалубку
---
Исключить домены:
Неизвестно: x
Проверка живого сайта: нет
Прокси: YES
Макс. сайтов: 70
crawlDepth: три
Источники: serp; site
"""


def test_briefs(spark, tmp_path):
    files = {
        "a.txt": "﻿" + BRIEF.replace("\n", "\r\n"),
        "b.txt": json.dumps({"brief": {"clientSite": "https://b.ru", "maxSites": 20, "checkAlive": False, "apiKey": "k"}}),
        "c.txt": json.dumps({"clientSite": "c.ru", "clientName": "C", "sources": ["site"]}),
    }
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    got = {r.file: r.brief for r in I.read_briefs(spark, str(tmp_path)).collect()}
    a, b, c = got["a.txt"], got["b.txt"], got["c.txt"]
    assert (a.operatorName, a.clientName, a.clientSite) == ("Иван", "ООО Ромашка", "https://romashka.ru/catalog")
    assert a.queries == "аренда опалубки\nкупить: опалубку" and a.regions == "Москва, Тверская область"
    assert (a.checkAlive, a.useProxy, a.maxSites, a.crawlDepth, a.sources) == (False, True, 70, 2, ["serp", "site"])
    assert a.excludeDomains == "" and a.regionMode == "include" and a.phoneFilter == "business"
    assert (b.clientSite, b.maxSites, b.checkAlive, b.crawlDepth) == ("https://b.ru/", 20, False, 2)
    assert (c.clientSite, c.clientName, c.sources, c.checkAlive) == ("https://c.ru/", "C", ["site"], True)
    assert "apiKey" not in b.asDict()


def stored(spark):
    lead = lambda site, p1, mark=None: {"site": site, "name": site, "status": "найден", "p1": p1, "for_definition": mark}
    rows = [
        ("r1", "done", {"operatorName": "Иван", "clientName": "A", "clientSite": "https://www.a.ru/", "queries": "x\ny,x",
                        "regions": "Москва, "}, {"sources_reviewed": True},
         [lead("good.ru", "79001234567", True), lead("bad.ru", "79007654321", False)], "2026-01-02T00:00:00+00:00"),
        ("r2", "stopped", {"operatorName": " ИВАН ", "clientSite": "a.ru"}, {"analyze": "done"},
         [lead("good.ru", None), lead("new.ru", None)], "2026-01-03T00:00:00+00:00"),
        ("r3", "error", {"clientSite": "b.ru"}, None, None, "2026-01-01T00:00:00+00:00"),
        ("r4", "running", {"operatorName": "Пётр", "clientSite": "https://a.ru"}, {"logs": [{"ts": "1"}, {"ts": "2"}]}, [],
         "2026-01-04T00:00:00+00:00"),
    ]
    dump = lambda x: None if x is None else json.dumps(x, ensure_ascii=False)
    raw = spark.createDataFrame(
        [(i, s, dump(b), dump(p), dump(r), None, 0, at, at) for i, s, b, p, r, at in rows], S.RUNS_RAW)
    return raw


def test_run_store(spark, tmp_path):
    raw = stored(spark)
    raw.write.parquet(str(tmp_path / "runs"))
    runs = I.read_runs(spark, str(tmp_path / "runs"))
    items = {r.id: r for r in O.summarize_runs(runs).collect()}
    assert (items["r1"].queries, items["r1"].regions, items["r1"].phones_count) == (["x", "y"], ["Москва"], 2)
    assert (items["r3"].operator_name, items["r3"].sites_count, items["r3"].status_label) == ("не указан", 0, "ошибка")
    assert [r.id for r in H.history(runs, "иван").collect()] == ["r2", "r1"]
    assert [r.id for r in H.history(runs, limit=2).collect()] == ["r4", "r2"]
    assert O.count_runs(O.of_operator(O.summarize_runs(runs), "")).first().total == 1
    assert {r.id: r.v for r in runs.select("id", O.can_resume().alias("v")).collect()} == {
        "r1": False, "r2": True, "r3": False, "r4": True}
    assert {r.id: r.v for r in runs.select("id", O.can_resume(F.lit(True)).alias("v")).collect()}["r4"] is False
    changes = {r.site: r.change for r in H.compare(runs, "r1", "r2").collect()}
    assert changes == {"good.ru": "common", "bad.ru": "removed", "new.ru": "new"}
    same = O.same_client(O.summarize_runs(runs), ("stopped", "running"))
    assert {r.client_key: r.id for r in same.collect()} == {"a.ru": "r4"}
    exact = O.same_client(O.summarize_runs(runs), ("done", "stopped"), exact_site=True)
    assert {r.client_key: r.id for r in exact.collect()} == {"https://www.a.ru": "r1", "a.ru": "r2"}


def test_export(spark, tmp_path):
    runs = I.decode_runs(stored(spark))
    with pytest.raises(W.ExportRefused):
        H.export_run(runs, "r2", str(tmp_path / "x"))
    H.export_run(runs, "r1", str(tmp_path / "all"))
    H.export_run(runs, "r1", str(tmp_path / "marked"), marked_only=True)
    with pytest.raises(W.ExportRefused):
        W.exportable(I.run_results(runs.where("id = 'r2'")), True, marked_only=True)

    def text(name):
        return [p.read_bytes().decode() for p in sorted((tmp_path / name).glob("*.csv"))]

    lines = [t.splitlines() for t in text("marked")]
    assert lines[0][0] == "﻿Сайт;Компания;Регион;Телефон 1;Источник;Статус;К определению"
    assert [x for t in lines for x in t[1:]] == ["good.ru;good.ru;;79001234567;;найден;да"]
    assert sum(len(t.splitlines()) - 1 for t in text("all")) == 2


def test_export_phones(spark):
    rows = [([f"7900123456{i}" for i in range(10)], "79000000000", None), ([], "8 495 111 22 33", "bad"), (None, None, None)]
    df = spark.createDataFrame(rows, "phones ARRAY<STRING>, p1 STRING, p2 STRING")
    got = [r.v for r in df.select(W.export_phones().alias("v")).collect()]
    assert [len(v) for v in got] == [6, 1, 0] and got[1] == ["74951112233"]
    assert W.export_width(df) == 6 and W.export_width(df.where("p1 is null")) == 1


def test_upsert(spark):
    runs = stored(spark)
    up = "id STRING, seq INT, status STRING, brief_json STRING, pipeline_json STRING, results_json STRING, error STRING, is_demo INT"
    updates = spark.createDataFrame([
        ("r1", 1, "running", None, None, None, None, None), ("r1", 2, None, None, None, None, "boom", None),
        ("r1", 3, "error", None, None, None, None, None), ("new", 1, None, "{}", None, None, None, None)], up)
    got = {r.id: r for r in W.upsert_runs(runs, updates, F.lit("2026-02-01")).collect()}
    assert len(got) == 5
    assert (got["r1"].status, got["r1"].error, got["r1"].updated_at) == ("error", "boom", "2026-02-01")
    assert got["r1"].created_at.startswith("2026-01-02") and json.loads(got["r1"].results_json)[0]["site"] == "good.ru"
    assert got["r2"].updated_at.startswith("2026-01-03")
    assert (got["new"].status, got["new"].pipeline_json, got["new"].is_demo) == ("pending", "{}", 0)


def test_legacy_sheet(spark, tmp_path):
    def row(*cells):
        return "<Row>" + "".join(f'<Cell><Data ss:Type="String">{c}</Data></Cell>' for c in cells) + "</Row>"

    sheet = ('<?xml version="1.0"?><Workbook xmlns:ss="urn:schemas-microsoft-com:office:spreadsheet"><Worksheet><Table>'
             + row("Сайт", "Компания", "Регион", "Контакты", "Источник", "Статус")
             + row("a.ru", "A", "", "89001234567, 79001234567; 84951112233", "сайт", "найден")
             + row("b.ru", "B", "R", "8 (495) 111-22-33") + row("c.ru", "C", "", "нет", "x", "y")
             + "</Table></Worksheet></Workbook>")
    (tmp_path / "old.xls").write_text(sheet, encoding="utf-8")
    got = {r.site: (r.phones, r.source, r.status) for r in I.read_legacy_sheet(spark, str(tmp_path / "old.xls")).collect()}
    assert got == {"a.ru": (["79001234567", "74951112233"], "сайт", "найден"), "b.ru": (["74951112233"], "", ""),
                   "c.ru": ([], "x", "y")}


def test_pages_source(spark, tmp_path):
    rows = [(1, "u1", "<html>" + "x" * 300, 200), (2, "u2", "<html>" + "x" * 300, 404), (3, "u3", "short", 200)]
    spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING, status_code INT").write.parquet(str(tmp_path / "p"))
    assert [r.page_id for r in I.read_pages(spark, str(tmp_path / "p")).collect()] == [1]


def grid(spark):
    rows = [
        (0, "Good.ru", "Good", "дом", "Москва", "7900", None, "mobile", None, "найден", True),
        (1, "bad.ru", "Bad", "опт", "", "7495", "7900", "city", "mobile", "агрегатор", False),
        (2, "no.ru", None, "", None, None, None, None, None, "без телефона", None)]
    return spark.createDataFrame(
        [r[:7] + ("сайт",) + r[7:] for r in rows],
        "ord INT, site STRING, name STRING, offer STRING, region STRING, p1 STRING, p2 STRING, source STRING, "
        "p1_type STRING, p2_type STRING, status STRING, for_definition BOOLEAN")


def test_grid(spark):
    g = grid(spark)

    def sites(**f):
        return [r.site for r in g.where(R.matches(**f)).orderBy("ord").collect()]

    assert sites() == ["Good.ru", "bad.ru", "no.ru"]
    assert sites(phone_type="mobile") == ["Good.ru", "bad.ru"] and sites(region="Москва") == ["Good.ru"]
    assert sites(marked=True) == ["Good.ru"] and sites(marked=False) == ["bad.ru", "no.ru"]
    assert sites(search="GOOD") == ["Good.ru"] and sites(status="агрегатор", search="опт") == ["bad.ru"]
    assert [r.site for r in g.orderBy(*R.grid_order("site")).collect()] == ["bad.ru", "Good.ru", "no.ru"]
    assert tuple(R.result_stats(g).first()) == (3, 2, 1, 1)
    assert {r.region: r.n for r in R.region_groups(g).collect()} == {"Москва": 1, "Без региона": 2}
    marked = R.mark_visible(g, R.matches(phone_type="mobile"))
    assert {r.site: r.for_definition for r in marked.collect()} == {"Good.ru": True, "bad.ru": False, "no.ru": False}
    assert R.clear_marks(marked).where("for_definition").count() == 0
    assert [r.site for r in O.page_of(g, 9, F.col("ord"), size=2).collect()] == ["no.ru"]
    assert [r.site for r in O.page_of(g, 0, F.col("ord"), size=2).collect()] == ["Good.ru", "bad.ru"]


def test_annotate(spark):
    updates = spark.createDataFrame(
        [("GOOD.ru ", 1, False, None), ("bad.ru", 2, None, "найден"), ("bad.ru", 3, True, None), ("x.ru", 4, True, "y")],
        "site STRING, seq INT, for_definition BOOLEAN, status STRING")
    done = R.annotate(grid(spark), updates)
    got = {r.site: (r.for_definition, r.status) for r in done.collect()}
    assert got == {"Good.ru": (False, "найден"), "bad.ru": (True, "найден"), "no.ru": (None, "без телефона")}
    assert tuple(R.annotate_counts(done).first()) == (3, 1, 3)


def test_district_totals(spark):
    dim = I.regions(spark)
    chosen = spark.createDataFrame([("Москва",), ("Республика Коми",), ("Москва",)], "name STRING")
    got = {r.district: (r.selected, r.total, r.state) for r in R.district_totals(
        dim.select("name", F.col("district_id").alias("district")), chosen).collect()}
    assert got["cfo"] == (1, 18, "partial") and got["sfo"] == (0, 10, "none") and got[None] == (2, 89, "partial")
