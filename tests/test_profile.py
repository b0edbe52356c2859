from pyspark.sql import functions as F

from contactlake.operators import profile as P
from contactlake.plans.profile import profile_job, survey_pages

SURVEY = (
    "site STRING, title STRING, meta_description STRING, headings ARRAY<STRUCT<level: STRING, text: STRING>>, "
    "nav_labels ARRAY<STRING>, footer_text STRING, brand_hints ARRAY<STRING>, org_names ARRAY<STRING>, "
    "body_text STRING, list_items ARRAY<STRING>, schema_offerings ARRAY<STRING>, pages_surveyed INT"
)


def row(site, title, meta, headings, body, nav=(), footer="", brands=(), orgs=(), items=(), schema=()):
    return (site, title, meta, headings, list(nav), footer, list(brands), list(orgs), body, list(items), list(schema), 1)


SITES = [
    row("http://houseclub.ru/", "Главная | Houseclub", "Дом с полной готовностью к проживанию за 2 месяца",
        [("h1", "Дом с полной готовностью к проживанию за 2 месяца"), ("h2", "Собираем дома на собственном производстве"),
         ("h3", "Каркасные дома под ключ")],
        "Философия каркасного дома House club производство каркасные дома под ключ внешняя отделка "
        "ИНН 332807583351 ИП Иванов Пётр Сергеевич", nav=("Каталог", "Портфолио")),
    row("https://www.opalubka-stroyka.ru/", "Продажа строительной опалубки в Москве | Купить новую или БУ",
        "Аренда, продажа опалубки и комплектующих в Москве",
        [("h2", "Аренда, продажа опалубки"), ("h3", "Крупнощитовая опалубка")],
        "Аренда и продажа опалубки крупнощитовая мелкощитовая Щелково Москва", nav=("Аренда оборудования",),
        footer="© 2020-2026, ООО «Опалубка‑Стройка»", brands=("Опалубка Стройка",)),
    row("https://profitsys.ru/", "Профитсис — архитектура прибыли",
        "Система управляемой прибыли для бизнеса от 50 млн выручки",
        [("h1", "ПРОФИТСИС (PROFITSYS)"), ("h2", "Для кого"), ("h2", "КТО ЗА ЭТИМ СТОИТ"), ("h2", "4 проблемы — 4 решения"),
         ("h3", "Решение: Система привлечения горячего спроса"), ("h3", "Решение: Система возврата упущенных сделок"),
         ("h3", "Решение: Система управления прибылью"), ("h2", "РЕЗУЛЬТАТЫ ПИЛОТОВ")],
        "Система управляемой прибыли для бизнеса B2B лидогенерация горячий спрос отдел продаж воронка сигналы спроса "
        "пилот 30 дней", nav=("Для кого", "Команда", "FAQ"), brands=("Profitsys", "Профитсис")),
]


def test_golden_sites(spark):
    got = {r.site: r for r in P.profile_sites(spark.createDataFrame(SITES, SURVEY)).collect()}
    house, forms, profit = (got[s[0]] for s in SITES)

    queries = "\n".join(house.queries).lower()
    assert "каркас" in house.summary.lower() and "каркас" in queries and "углеволок" not in queries
    assert house.client_name == "ИП Иванов Пётр Сергеевич"

    queries = "\n".join(forms.queries).lower()
    assert forms.business_model == "goods_rental" and "опалуб" in forms.summary.lower()
    assert forms.client_name == "ООО «Опалубка-Стройка»"
    assert "аренда аренда" not in queries and forms.geo_cities == ["Москва", "Щелково"]
    assert forms.exclude_domains[0] == "opalubka-stroyka.ru" and len(forms.exclude_domains) == 10

    queries = "\n".join(profit.queries).lower()
    for junk in ("для кого", "продажа профитсис", "купить профитсис", "кто за этим", "4 проблемы", "результаты пилотов",
                 "завод ", "решение:"):
        assert junk not in queries
    assert any(x in queries for x in ("спрос", "прибыл", "лидоген", "b2b", "аутсорсинг"))
    assert (profit.business_model, profit.audience) == ("b2b_services", "b2b")
    assert all(len(r.queries) <= 14 and len(r.offerings) <= 10 and len(r.industry_keywords) <= 12 for r in got.values())


def test_models(spark):
    bodies = ["аренда и прокат ", "производство: аренда ", "каталог и завод ", "ничего", "монтаж под ключ", "вывод"]
    df = spark.createDataFrame(list(enumerate(bodies)), "i INT, body STRING").select("*", *P.model_scores(F.col("body")))
    got = {r.i: (r.m, r.a) for r in df.withColumn("m", P.model_pick()).select(
        "i", "m", P.audience(F.col("body"), F.col("m")).alias("a")).collect()}
    assert [got[i][0] for i in range(6)] == [
        "goods_rental", "manufacturing", "goods_sales", "unknown", "construction_services", "unknown"]
    rows = spark.createDataFrame([("b2b для дома", "x"), ("для дома", "x"), ("для дома семьи b2b", "x"), ("", "b2b_services")],
                                 "b STRING, m STRING")
    assert [r.a for r in rows.select(P.audience(F.col("b"), F.col("m")).alias("a")).collect()] == ["mixed", "b2c", "b2c", "b2b"]


def test_company_name(ev):
    none = F.array().cast("array<string>")
    texts = [("ООО «Рога и Копыта» политика", ""), ("Компания ООО Ромашка Плюс", ""), ("", "ИНН 123 ИП Петров Иван"), ("", "")]
    assert ev(lambda t, f: P.company_name(t, F.lit(""), f, none, none), texts) == [
        "ООО «Рога и Копыта»", "ООО Ромашка Плюс", "ИП Петров Иван", ""]
    hints = F.array(F.lit("logo дом"), F.lit("Мой Дом"), F.lit("АО Завод"))
    assert ev(lambda t: P.company_name(t, t, t, hints, none), ["x"]) == ["Мой Дом"]
    assert ev(lambda t: P.company_name(t, t, t, hints, F.array(F.lit("АО Завод"))), ["x"]) == ["АО Завод"]


def test_brand_tokens(ev):
    got = ev(lambda s: P.brand_tokens(s, F.lit("Окна Плюс"), F.array(F.lit("Brand X")), F.array().cast("array<string>")),
             ["https://www.houseclub.ru/", "ab.ru"])
    assert [sorted(g) for g in got] == [sorted(["houseclub", "houseclu"[:7], "окна", "плюс", "brand"]), sorted(["окна", "плюс", "brand"])]


def test_survey_plan(spark):
    home = '<title>Окна Сити</title><div><h2>Монтаж окон недорого</h2></div><a href="/uslugi">Услуги</a><a href="/blog">Блог</a>'
    pages = spark.createDataFrame([
        (1, "https://okna.ru/", home), (2, "https://okna.ru/uslugi", "<h2>Ремонт пластиковых окон</h2>"),
        (3, "https://okna.ru/blog", "<h2>Ремонт балконов</h2>")], "page_id BIGINT, url STRING, html STRING")
    r = profile_job(survey_pages(pages)).first()
    assert (r.site, r.pages_surveyed, r.title) == ("okna.ru", 2, "Окна Сити")
    assert r.offerings[:2] == ["Монтаж окон недорого", "Ремонт пластиковых окон"]
