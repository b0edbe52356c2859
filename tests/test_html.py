
from contactlake.operators import html as H
from contactlake.operators import links as K
from contactlake.operators.flatten import flatten_pages

CHANNELS = {
    "header": ("<header>8 495 111 22 33</header>", "header"),
    "header link": ('<header><a href="tel:84951112233">call</a></header>', "header-tel"),
    "nav": ("<nav>8 495 111 22 33</nav>", "nav"),
    "class": ('<span class="my-phone">8 495 111 22 33</span>', "header-class"),
    "itemprop": ('<span itemprop="telephone">8 495 111 22 33</span>', "header-class"),
    "data": ('<i class="tel" data-tel="84951112233"></i>', "data-attr"),
    "footer tag": ("<footer>8 495 111 22 33</footer>", "footer"),
    "footer role": ('<div role="contentinfo">8 495 111 22 33</div>', "footer"),
    "footer class": ('<div class="site-bottom">8 495 111 22 33</div>', "footer"),
    "footer id": ('<section id="Podval">8 495 111 22 33</section>', "footer"),
    "footer link": ('<footer><a href="callto:84951112233">call</a></footer>', "footer-tel"),
    "ld text": ('<script type="application/ld+json">{"telephone": "84951112233"}</script>', "json-ld"),
    "ld list": ('<script type="application/ld+json">[{"phone": ["84951112233"]}]</script>', "json-ld"),
    "ld nested": ('<script type="application/ld+json">{"a":{"contactPoint":{"telephone":84951112233}}}</script>', "json-ld"),
    "ld number": ('<script type="application/ld+json">{"phone":[{"telephone":84951112233}]}</script>', "json-ld"),
    "meta": ('<meta property="business:phone_number" content="84951112233">', "meta"),
    "tel": ('<a href="TEL:84951112233">call</a>', "tel"),
    "callto": ('<a href="callto:84951112233">call</a>', "callto"),
    "text": ("<p>8 495 111 22 33</p>", "text"),
    "no-break": ("<p>8&nbsp;495&nbsp;111 22 33</p>", "text"),
    "context": ("<p>Тел.: 495 111 22 33</p>", "context"),
    "split by tag": ("<p>8 495 <b>111</b> 22 33</p>", "text"),
}


def contacts(spark, *htmls):
    df = spark.createDataFrame([(i, h) for i, h in enumerate(htmls)], "page_id INT, html STRING")
    rows = H.contact_rows(H.page_contacts(df), "page_id").orderBy("page_id", "ord").collect()
    out = {i: [] for i in range(len(htmls))}
    for r in rows:
        out[r.page_id].append((r.phone, r.type, r.source, r.source_rank))
    return list(out.values())


def test_channels(spark):
    got = contacts(spark, *[h for h, _ in CHANNELS.values()])
    ranks = dict(header=0, nav=1, tel=2, callto=2, footer=3, meta=7, context=8, text=9)
    ranks |= {"header-tel": 2, "footer-tel": 2, "header-class": 4, "data-attr": 5, "json-ld": 6}
    for (name, (_, source)), found in zip(CHANNELS.items(), got):
        assert found == [("74951112233", "city", source, ranks[source])], name


def test_order_and_first_source(spark):
    html = ('<p>8 903 000 00 01</p><footer>8 903 000 00 02, 8 495 111 22 33</footer>'
            '<header><a href="tel:+79001234567">+7 (900) 123-45-67</a></header><p>+7 495 111-22-33</p>')
    got = contacts(spark, html)[0]
    assert [(p, s) for p, _, s, _ in got] == [
        ("79001234567", "header"), ("79030000002", "footer"), ("74951112233", "footer"), ("79030000001", "text")]


def test_skipped_and_odd_input(spark):
    got = contacts(
        spark, '<a href="https://wa.me/79001234567">x</a>', "<script>8 495 111 22 33</script>",
        "<!-- 8 495 111 22 33 -->", "8 800 100 20 30", "", "<p>4111 8888 1234 5678 9</p>")
    assert [len(g) for g in got] == [0, 0, 0, 0, 0, 1]


SITE = """<html><head><title>Окна &amp; двери</title><meta name="description" content="">
<meta property="og:description" content=" Делаем окна. Монтаж! "><meta property="og:site_name" content="Окна+">
<script type="application/ld+json">{"@graph":[{"@type":"Service","name":"Монтаж окон"}],"@type":"Organization",
 "name":"ОкнаСтрой","legalName":"ООО «Окна»"}</script>
<script type="application/ld+json">{broken</script></head>
<body><header><a class="logo" href="/">Логотип</a><nav><ul><li>пункт меню первый</li></ul><a href="/about">О компании</a></nav></header>
<div class="content"><h1>Окна</h1><h2>Монтаж <b>окон</b></h2><h3></h3><ul><li>Установка окон<li>мал</ul>
<img src=x alt="Фото офиса"><noscript>нет скриптов</noscript></div><div class="menu"><li>пункт бокового меню</li></div>
<p>Текст<p>ещё<footer>ООО Окна<br>2026</footer></body></html>"""


def test_content_and_identity(spark):
    df = spark.createDataFrame([(1, SITE)], "page_id INT, html STRING")
    r = H.page_content(flatten_pages(df), "page_id").first()
    assert r.title == "Окна & двери"
    assert [(h.level, h.text) for h in r.headings] == [("h1", "Окна"), ("h2", "Монтаж окон")]
    # an unclosed <li> nests, so the first item spans the second
    assert r.list_items == ["Установка окон мал"]
    assert r.meta_description == "Делаем окна. Монтаж!"
    assert r.schema_offerings == ["Монтаж окон"]
    # header and nav both list the link in the nav
    assert r.nav_labels == ["Логотип", "О компании", "О компании"]
    assert r.footer_text == "ООО Окна\n2026"
    assert r.brand_hints == ["Окна+", "Фото офиса", "Логотип"]
    assert r.org_names == ["ОкнаСтрой", "ООО «Окна»"]
    assert "нет скриптов" not in r.text and "Текст\nещё" in r.text and "@graph" not in r.text


def test_title_falls_back_to_h1(spark):
    df = spark.createDataFrame([(1, "<h1>A <b>b</b></h1>"), (2, "<p>x"), (3, "<title> </title><h1>c</h1>")],
                               "page_id INT, html STRING")
    rows = flatten_pages(df).select("page_id", H.page_title().alias("t")).collect()
    assert {r.page_id: r.t for r in rows} == {1: "Ab", 2: "", 3: "c"}


LINKS = """<a href="/b">Б</a><a href="/contacts">к</a><a href="c?x=1#y">в</a><a href="https://other.ru/">o</a>
<a href="https://sub.site.ru/about">s</a><a href="/b">дубль</a><a href="mailto:a@site.ru">m</a><a href="/uslugi/x">Наши услуги</a>
<a name="n">no</a><a href="/z">Каталог</a>"""


def test_links(spark):
    df = spark.createDataFrame([("site.ru", "https://www.site.ru/d/", LINKS)], "site STRING, url STRING, html STRING")
    flat = flatten_pages(df)
    rows = K.page_links(flat).orderBy("pos").collect()
    assert [r.target for r in rows if r.same_host] == [
        "https://www.site.ru/b", "https://www.site.ru/contacts", "https://www.site.ru/d/c?x=1",
        "https://sub.site.ru/about", "https://www.site.ru/uslugi/x", "https://www.site.ru/z"]
    top = [(r.target, r.score) for r in K.top_links(flat, k=3).orderBy("rank").collect()]
    assert top == [("https://www.site.ru/contacts", 15), ("https://sub.site.ru/about", 15), ("https://www.site.ru/b", 0)]
    sections = [r.target for r in K.section_links(flat).orderBy("rank").collect()]
    assert sections == ["https://sub.site.ru/about", "https://www.site.ru/uslugi/x", "https://www.site.ru/z"]


def test_frontier(spark):
    links = spark.createDataFrame(
        [("s", "a", "b"), ("s", "a", "c"), ("s", "b", "d"), ("s", "d", "a"), ("s", "d", "e"), ("t", "a", "z")],
        "site STRING, url STRING, target STRING")
    seeds = spark.createDataFrame([("s", "a")], "site STRING, url STRING")
    got = {r.url: r.level for r in K.expand_frontier(links, seeds, 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert K.expand_frontier(links, seeds, 9).count() == 5


def test_visit_order(ev):
    assert ev(K.visit_order, ["", "/", "/contacts", "/kontakt", "/about-us", "/x"]) == [0, 0, 1, 4, 8, None]
    assert [K.page_budget(d) for d in (1, 2, 3)] == [4, 6, 9]


def test_wide_page_stays_whole(spark):
    """Numbers far behind any prefix are found, and a page with many numbers keeps them all."""
    many = "".join(f"<p>8 903 {i:03d} 00 00</p>" for i in range(300))
    got = contacts(spark, "<p>" + "x " * 200_000 + "8 495 111 22 33</p>", many)
    assert [len(g) for g in got] == [1, 300]
    assert [p for p, *_ in got[1]] == [f"7903{i:03d}0000" for i in range(300)]


def test_source_rank(ev):
    assert ev(H.source_rank, ["header", "FOOTER", "nav-tel", "snippet", "html"]) == [0, 3, 2, 9, 10]


def test_phone_flag(spark):
    rows = [(1, "tel:+79001234567"), (2, "<p>495 <b>x</b></p>"), (3, "<span class=phone>9161112233</span>"),
            (4, "x" * 90_000 + "<p>8 495 111 22 33"), (5, None)]
    df = spark.createDataFrame(rows, "page_id INT, html STRING")
    got = {r.page_id: r.has_phone for r in H.with_phone_flag(df).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: False}


def test_no_page_stops_the_job(spark):
    deep = '<script type="application/ld+json">' + "[" * 5000 + "]" * 5000 + "</script>тел 8 495 111 22 33"
    half = '<script type="application/ld+json">{"telephone": "\\ud800 8 495 000 00 07", "name": "\\udfff x", "@type": "Service"}</script>'
    chain = '<script type="application/ld+json">' + '{"a":' * 900 + '{"telephone": "8 495 000 00 08"}' + "}" * 900 + "</script>"
    pages = spark.createDataFrame(list(enumerate([deep, half, chain, "<![if", "<!DOCTYPE [<", "<a" * 3000, None])), "page_id LONG, html STRING")
    rows = {r.page_id: [c.phone for c in r.contacts] for r in H.page_contacts(pages).collect()}
    assert rows[0] == ["74951112233"] and rows[1] == ["74950000007"] and rows[2] == ["74950000008"] and len(rows) == 7
