import datetime

from pyspark.sql import functions as F

from contactlake.functions import lists as L
from contactlake.functions import phone as P
from contactlake.functions import text as T
from contactlake.functions import url as U


def test_normalize_and_type(ev):
    raws = ["+7 (900) 123-45-67", "8 495 111 22 33", "9161112233", "8 800 100 20 30", "712345", "", "6 495 111 22 33"]
    assert ev(P.normalize_digits, raws) == [
        "79001234567", "74951112233", "79161112233", "78001002030", None, None, None]
    assert ev(P.normalize_phone, raws) == [
        "79001234567", "74951112233", "79161112233", None, None, None, None]
    digits = ["79001234567", "78001234567", "74951112233", "72001112233", "70001112233", "7900", None]
    assert ev(P.phone_type, [(d,) for d in digits], "d STRING") == [
        "mobile", "excluded", "city", "invalid", "invalid", "invalid", "invalid"]
    assert ev(P.is_valid, [(d,) for d in digits[:3]], "d STRING") == [True, False, True]
    assert ev(P.invalid_reason, [("79001234567",), ("78001234567",), ("",), ("72001112233",)], "d STRING") == [
        "", "toll-free", "empty", "format"]


def test_display(ev):
    assert ev(P.format_display, ["89001234567", "abc", ""]) == ["+7 (900) 123-45-67", "abc", ""]


def test_text_runs(ev):
    texts = ["тел +7 900 123-45-67 и 8(495)1112233", "9161112233", "19161112233", "карта 4111 1888 1234 5678 90",
             "8 800 100 20 30", "none"]
    assert ev(P.phones_in_text, texts) == [
        ["79001234567", "74951112233"], ["79161112233"], [], ["78812345678"], [], []]
    assert ev(lambda t: P.phones_in_text(t, strict=True), ["4111 1888 1234 5678 90", "x8 888 123 45 67"]) == [
        [], ["78881234567"]]
    assert ev(P.phones_after_words, ["Телефон: 343 111 22 33", "phone 343-111-22-33", "343 111 22 33"]) == [
        ["73431112233"], ["73431112233"], []]


def test_hint(ev):
    assert ev(P.phone_hint, ["a +7 900 123 45 67", "tel:+7", "none", "x" * 80_000 + "tel:+7"]) == [
        True, True, False, False]


def test_policy(ev):
    phones = ["79001234567", "74951112233", "78001112233"]
    rows = [(phones,)]
    for policy, want in (("mobile", phones[:1]), ("city", phones[1:2]), ("business", phones[:2]),
                         ("all", phones[:2]), ("no-800", phones[:2]), ("odd", [])):
        assert ev(lambda p: P.filter_by_policy(p, policy), rows, "p ARRAY<STRING>") == [want]
    city = [(["74951112233"],)]
    assert ev(lambda p: P.filter_by_policy(p, "mobile", fallback=True), city, "p ARRAY<STRING>") == [["74951112233"]]
    assert ev(lambda p: P.filter_by_policy(p, "mobile"), city, "p ARRAY<STRING>") == [[]]


def test_host(ev):
    urls = ["https://WWW.Example.ru:8080/x", "example.ru/path", "пример.рф", "//no.scheme/x", "mailto:a@b.ru",
            "http://www.web.ru", "a.ru/?u=http://b.ru", ""]
    assert ev(U.host, urls) == ["example.ru:8080", "example.ru", "пример.рф", "", "mailto:a@b.ru", "web.ru", "", ""]
    assert ev(U.host_without_port, urls[:1]) == ["example.ru"]
    assert ev(U.host_suffixes, ["a.b.c"]) == [["a.b.c", "b.c", "c"]]


def test_normalize_url(ev):
    base = "https://Site.ru/a/b/c.html?x=1#f"
    cases = {
        "d.html": "https://site.ru/a/b/d.html", "/d": "https://site.ru/d", "//o.ru": "https://o.ru/",
        "?q=2": "https://site.ru/a/b/c.html?q=2", "#top": "https://site.ru/a/b/c.html?x=1",
        "../d": "https://site.ru/a/d", "../../../d": "https://site.ru/d", "./": "https://site.ru/a/b/",
        "http://X.ru/p;v=1?q#f": "http://x.ru/p?q", "ftp://x.ru/y": "https://x.ru/y", "": None,
    }
    got = ev(lambda u: U.normalize_url(u, F.lit(base)), list(cases))
    assert dict(zip(cases, got)) == cases
    assert ev(U.normalize_url, ["site.ru", "HTTP://Site.ru/A"]) == ["https://site.ru/", "http://site.ru/A"]


def test_clean_site_input(ev):
    cases = [
        ("https://angary-stroy.ru/service/angary/", "https://angary-stroy.ru/service/angary/"),
        ("angary-stroy.ru/service/angary/", "https://angary-stroy.ru/service/angary/"),
        ("https://opalubka-domstroy.ru", "https://opalubka-domstroy.ru/"),
        ("opalubka-domstroy.ru", "https://opalubka-domstroy.ru/"),
        ("наш сайт (https://a.ru/x), звоните", "https://a.ru/x"), ("localhost", None), ("", None), ("пример.рф", "https://пример.рф/"), ("site.rux", "https://site.rux/"),
    ]
    assert ev(U.clean_site_input, [c for c, _ in cases]) == [w for _, w in cases]


def test_lists(ev):
    assert ev(lambda t: L.query_list(t, distinct=True), ["а\nб, в, а"]) == [["а", "б", "в"]]
    assert ev(L.domain_list, [" WWW.A.ru,b.ru\na.ru"]) == [["a.ru", "b.ru"]]
    assert ev(L.region_list, ["Москва, Тверская область\n"]) == [["москва", "тверская область"]]
    assert len(ev(L.query_list, [""])[0]) == 8
    assert ev(lambda t: L.query_list(t, quick=F.lit(True)), [""]) == [[]]
    assert ev(lambda t: L.seed_domains(t, F.lit(True)), ["www.A.ru, b.ru"]) == [["a.ru", "b.ru"]]
    assert len(ev(lambda t: L.seed_domains(t, F.lit(True)), [""])[0]) == 12
    assert ev(lambda t: L.seed_domains(t, F.lit(False)), ["a.ru"]) == [[]]
    assert ev(L.exclude_list, ["x.ru", "avito.ru", ""])[0][:2] == ["x.ru", "avito.ru"]
    assert [len(x) for x in ev(L.exclude_list, ["x.ru", "avito.ru", ""])] == [10, 9, 9]


def test_labels(ev):
    assert ev(L.status_label, ["done", "ERROR", "odd", ""]) == ["готово", "ошибка", "odd", "—"]
    assert ev(L.operator_name, ["", " Иван "]) == ["не указан", "Иван"]
    errors = ["error:empty", "unreachable", "error:HTTP 403", "HTTP 401", "HTTP 404", "HTTP 503", "HTTP 418",
              "Read timed out", "ReadTimeout", "certificate has expired", "boom"]
    assert ev(L.error_class, errors) == [
        "empty", "empty", "forbidden", "forbidden", "not_found", "server_error", "http_error", "timeout", "timeout",
        "tls", "other"]
    rows = [("аренда Москва", "спб"), ("аренда", "Ярославль"), ("аренда", "")]
    assert ev(L.locale_code, rows) == [213, 16, None]


def test_export_name(ev):
    at = datetime.datetime(2026, 1, 31, 22, 0)
    rows = [('ООО "Рога/Копыта".', "abcdef123456", at), (" . ", "abcdef123456", at)]
    assert ev(lambda n, i, t: L.export_name(n, i, t, "csv"), rows) == [
        "ООО РогаКопыта 01-02-2026.csv", "run-abcdef12 01-02-2026.csv"]


def test_phrases(ev):
    raws = ["  Аренда   опалубки. ", "Решение: Система привлечения спроса", "Главная", "Каталог", "4 проблемы — 4 решения",
            "Скидка 10%", "123-45", "abc", "х" * 91, "РЕЗУЛЬТАТЫ ПИЛОТОВ"]
    assert ev(T.clean_phrase, raws) == [
        "Аренда   опалубки".replace("   ", " "), "Система привлечения спроса", None, None, None, None, None, None, None, None]
    assert ev(T.mostly_caps, ["КТО ЗА ЭТИМ", "Кто за этим", "АБВ"]) == [True, False, False]
    brand = F.array(F.lit("houseclub"))
    assert ev(lambda p: T.contains_brand(p, brand), ["Houseclub", "дом house", "большой дом"]) == [True, True, False]
    assert ev(T.has_service_sense, ["аренда", "мы вам", "красивые окна"]) == [True, False, True]
    assert ev(T.looks_like_query, ["аренда опалубки", "аренда", "завод окон стали", "новые красивые окна"]) == [
        True, False, False, True]
    assert ev(T.section_junk, ["кто за этим стоит", "этап работ", "этап продаж b2b", "Каркасные дома"]) == [
        True, True, False, False]
    assert ev(lambda t: T.has_year(t, 2026), ["© 2026 г", "x2026", "20261"]) == [True, False, False]
    assert ev(T.normalize_dashes, ["a‑b−c"]) == ["a-b-c"]


def test_sql_functions(spark):
    from contactlake.functions.sql import register

    register(spark)
    row = spark.sql(
        "SELECT site_host('https://www.A.ru/x') h, normalize_phone('8 (495) 111-22-33') p, "
        "phone_type('79001234567') t, format_phone('89001234567') f").first()
    assert tuple(row) == ("a.ru", "74951112233", "mobile", "+7 (900) 123-45-67")
    flat = spark.sql("SELECT strings, size(links) n FROM flatten_page('<p>a<a href=\"/x\">b</a>')").first()
    assert (flat.strings, flat.n) == (["a", "b"], 1)
