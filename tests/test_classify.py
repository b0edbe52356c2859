from pyspark.sql import functions as F

from contactlake import fixed_values as V
from contactlake.operators import classify as C
from contactlake.sources.readers import dimension, domain_lexicon, regions, term_lexicon


def test_domain_rules(ev):
    hosts = ["avito.ru", "m.avito.ru", "www.avito.ru", "notavito.ru", "maps.google.kz", "docs.google.com", "site.ru"]
    assert ev(C.is_aggregator, hosts) == [True, True, True, False, True, True, False]
    assert ev(C.is_catalog, ["spb.2gis.ru", "2gis.ru", "a2gis.ru", "kudagid.ru"]) == [True, True, False, True]
    exclude, client = F.array(F.lit("web.ru")), F.lit("client.ru")
    hosts = ["client.ru", "shop.client.ru", "xclient.ru", "web.ru", "a.web.ru", "eb.ru", "avito.ru"]
    assert ev(lambda h: C.domain_class(h, exclude, client), hosts) == [
        V.STATUS_EXCLUDED, V.STATUS_EXCLUDED, V.STATUS_CANDIDATE, V.STATUS_EXCLUDED, V.STATUS_EXCLUDED,
        V.STATUS_CANDIDATE, V.STATUS_AGGREGATOR]
    assert ev(lambda h: C.is_excluded(h, exclude, F.lit("")), ["a.ru"]) == [False]


def test_flag_domains_matches_expression(spark):
    hosts = spark.createDataFrame([(h,) for h in ("a.b.c", "b.c", "x.c", "c", "b.cc")], "host STRING")
    listed = dimension(spark, [("b.c",)], "domain STRING")
    got = {r.host: r.f for r in C.flag_domains(hosts, "host", listed, "f").collect()}
    assert got == {"a.b.c": True, "b.c": True, "x.c": False, "c": False, "b.cc": False}


def test_junk(ev):
    rows = [("vc.ru", "стартапы", ""), ("salecraft.ru", "Отдел продаж под ключ", ""), ("tver.mk.ru", "x", ""),
            ("law.univer.ru", "x", ""), ("my-habr.com.ru", "x", ""), ("a.ru", "Что такое лизинг", ""), ("e1.ru", "", "")]
    assert ev(C.is_junk, rows) == [True, False, True, True, True, True, True]


def relevant(host, title, snippet, own, queries, niche):
    return C.is_relevant(host, title, snippet, own, queries, niche)


def test_relevance(ev):
    schema = "h STRING, t STRING, s STRING, o ARRAY<STRING>, q ARRAY<STRING>, n STRING"
    b2b = ["лидогенерация B2B", "аутсорсинг отдела продаж"]
    rows = [
        ("salecraft.ru", "Построение отдела продаж под ключ в Москве", "Аутсорсинг продаж для B2B",
         ["аутсорсинг отдела продаж"], b2b, "B2B услуги"),
        ("tver.mk.ru", "Новости Твери", "Городские новости", ["лидогенерация B2B"], b2b, ""),
        ("opennet.ru", "Форум", "обсуждение Linux", ["аренда опалубки"], ["аренда опалубки Москва"], "опалубка"),
        ("klerk.ru", "Что такое упущенная выгода", "", ["упущенная выгода"], ["упущенная выгода"], ""),
        ("salecraft.ru", "Отдел продаж под ключ Москва", "аутсорсинг", ["отдел продаж под ключ"],
         ["отдел продаж под ключ"], ""),
        ("a.ru", "кофе", "зёрна", ["чай"], ["окна пвх"], ""),     # no word of four letters in the own query
        ("a.ru", "кофе", "зёрна", ["чайник"], ["окна пвх"], ""),
        ("a.ru", "контакт-центр", "", ["колл"], ["колл"], ""),     # synonym
        ("a.ru", "металлы", "", ["чайник"], ["чайник"], "металлургия"),  # niche stem
        ("a.ru", "заказать кофе", "", ["чайник"], ["чайник"], ""),       # commercial word
    ]
    assert ev(relevant, rows, schema) == [True, False, False, False, True, True, False, True, True, True]


def test_regions(ev):
    oblast = F.array(F.lit("московская область"))

    def match(mode, regions=oblast):
        return lambda t: C.regions_match(t, regions, F.lit(mode))

    assert ev(match("exclude"), ["компания в казани", "компания в московской области"]) == [True, False]
    assert ev(match("include"), ["склад в московской области", "казань"]) == [True, False]
    assert ev(match("include", F.array().cast("array<string>")), ["x"]) == [True]
    for region, texts in {
        "москва": ["в Москве", "тверь"], "санкт-петербург": ["СПб", "тверь"],
        "ханты-мансийский автономный округ — югра": ["г. Сургут", "тверь"],
        "чеченская республика": ["чечен", "тверь"], "камчатский край": ["камчат", "тверь"],
    }.items():
        assert ev(match("include", F.array(F.lit(region))), texts) == [True, False], region
    assert ev(lambda t: C.hit_region_ok(t, oblast, F.lit("include")), ["нет региона"]) == [True]
    assert ev(lambda t: C.hit_region_ok(t, oblast, F.lit("exclude")),
              ["Компания в Казани", "Склад в Московской области"]) == [True, False]
    assert ev(lambda r: F.size(C.region_needles(r)), ["омская область", "томская область"]) == [1, 1]


def test_detect_region(ev):
    texts = ["Тула, Тульская область", "кемеровская область — кузбасс", "Новгородская и Нижегородская область", "нигде",
             "Республика Алтай и Алтайский край"]
    assert ev(C.detect_region, texts) == [
        "Тульская область", "Кемеровская область — Кузбасс", "Нижегородская область", None, "Республика Алтай"]


def test_alive_and_usable(ev):
    page = "<html>" + "x" * 300
    rows = [(200, page), (404, page), (None, "<html>"), (200, "Domain is for sale " + page),
            (200, "y" * 3000 + "coming soon"), (200, None)]
    assert ev(C.is_alive, rows, "s INT, h STRING") == [True, False, False, False, True, False]
    rows = [(200, page), (500, page), (200, "<HTML>"), (200, "z" * 300), (200, "z" * 401), (200, "ж" * 150)]
    assert ev(C.body_usable, rows, "s INT, h STRING") == [True, False, True, False, True, False]


def test_dimensions(spark):
    r = regions(spark)
    assert r.count() == 89 and r.select("name").distinct().count() == 89
    assert r.select("district_id").distinct().count() == 8
    labels = {x.name: x.label for x in r.collect()}
    assert labels["Тульская область"] == "Тульская обл." and labels["Москва"] == "г. Москва"
    assert labels["Кемеровская область — Кузбасс"] == "Кемеровская обл. — Кузбасс"
    assert labels["Республика Алтай"] == "Республика Алтай" and labels["Еврейская автономная область"] == "Еврейская АО"
    assert domain_lexicon(spark).where("kind = 'junk'").count() == len(V.JUNK_DOMAINS)
    assert term_lexicon(spark).where("kind = 'model'").select("group").distinct().count() == 7
