"""Words of whole sites and structured data as VARIANT values."""
from pyspark.sql import functions as F

from contactlake.operators.sitewords import site_keywords, site_words
from contactlake.operators.structured import item_columns, structured_items


def test_words_of_all_pages_of_a_site(spark):
    texts = [("a.ru", i, "окна общие слова") for i in range(9)] + [("a.ru", 9, "двери " * 11 + "общие"), ("a.ru", 10, None), (None, 1, "ничья страница"),
                                                                 ("b.ru", 1, ""), ("c.ru", 2, "beta-x alpha alpha beta-x gamma")]
    df = spark.createDataFrame(texts, "site STRING, page_id INT, text STRING").repartition(5)
    words = site_words(df, F.col("text"), "page_id")
    got = {(r.site, r.rank): (r.word, r.n) for r in site_keywords(words, 3).collect()}
    # the word that leads the site stands on its last page only; of equal counts the longer word, then the earlier
    assert got == {("a.ru", 1): ("двери", 11), ("a.ru", 2): ("общие", 10), ("a.ru", 3): ("слова", 9),
                   ("c.ru", 1): ("beta-x", 2), ("c.ru", 2): ("alpha", 2), ("c.ru", 3): ("gamma", 1)}
    assert site_keywords(site_words(df.limit(0), F.col("text"), "page_id")).collect() == []


def test_a_large_site_is_cut_in_each_task_before_it_is_ranked(spark):
    df = spark.createDataFrame([("a.ru", 1, "слово")], "site STRING, page_id INT, text STRING")
    plan = site_keywords(site_words(df, F.col("text"), "page_id"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "partial_count" in plan and "collect_list" not in plan


def ld(*blocks):
    return "<html>" + "".join(f"<script type='application/ld+json' id=x>{b}</script>" for b in blocks) + "<p>text</p></html>"


def test_items_of_structured_data(spark):
    pages = spark.createDataFrame([
        (1, ld('{"@type":"Organization","name":" Дом ","legalName":"ООО Дом","telephone":["8 495 1", "8 495 2"],"phone":84953}')),
        (2, ld('[{"@type":"Product","name":"Окно","legalName":"x"}, 5, null]', "not json", '{"name":{"a":1},"telephone":{"b":2}}')),
        (3, ld('{"@graph":[{"@type":"LocalBusiness","contactPoint":{"telephone":"1"}},{"@type":["A","B"],"contactPoint":[{"telephone":"2"},"3",{}]}]}')),
        (4, "<p>none</p>"), (5, None), (6, ""), (7, ld("")), (8, ld("[]"))], "page_id INT, html STRING")
    got = {(r.page_id, r.pos): (r.type, r.name, r.legal_name, r.phones) for r in item_columns(structured_items(pages)).collect()}
    assert got == {
        (1, 0): ("Organization", "Дом", "ООО Дом", ["8 495 1", "8 495 2", "84953"]),
        (2, 0): ("Product", "Окно", None, []), (2, 1): (None, None, None, []), (2, 2): (None, None, None, []), (2, 3): (None, None, None, []),
        (3, 0): (None, None, None, []), (3, 1): ("LocalBusiness", None, None, ["1"]), (3, 2): (None, None, None, ["2", "3"])}
