"""What a site sells and to whom: a profile per site.

Pages are merged once per site (one shuffle, at most five pages each).  Everything
after that is per row: a site's text and lists are bounded, so counting words and
judging phrases inside the row needs no further exchange.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlake import fixed_values as V
from contactlake.functions import let
from contactlake.functions import text as T
from contactlake.functions.lists import contains_any, count_contained, exclude_list, one_of
from contactlake.functions.url import host
from contactlake.session import fence


def merge_pages(content: DataFrame) -> DataFrame:
    """Pages of a site in visiting order -> one survey row.

    ``content``: site, visit and the columns of ``page_content``; home is visit 0.  The
    identity columns come from the home page.
    """
    parts = ("text", "headings", "list_items", "schema_offerings", "meta_description")
    home = ("title", "nav_labels", "footer_text", "brand_hints", "org_names")
    site = content.groupBy("site").agg(
        F.array_sort(F.collect_list(F.struct("visit", F.struct(*parts).alias("p")))).alias("pages"),
        F.min_by(F.struct(*home), "visit").alias("home"),
    )

    def all_of(name: str) -> Column:
        return F.flatten(F.transform("pages", lambda x: x["p"][name]))

    described = F.filter(F.transform("pages", lambda x: x["p"]["meta_description"]), lambda d: d != "")
    body = F.array_join(F.transform("pages", lambda x: x["p"]["text"]), "\n")
    return site.select(
        "site", "home.*",
        F.substring(F.substring(body, 1, 12_000), 1, 8_000).alias("body_text"),
        F.substring(F.coalesce(F.get(described, F.lit(0)), F.lit("")), 1, 500).alias("meta_description"),
        F.slice(all_of("headings"), 1, 60).alias("headings"),
        F.slice(all_of("list_items"), 1, 60).alias("list_items"),
        F.slice(all_of("schema_offerings"), 1, 20).alias("schema_offerings"),
        F.size("pages").alias("pages_surveyed"),
    )


def search_body() -> Column:
    """Lower-cased text all signals are looked up in."""
    parts = [F.col("title"), F.col("meta_description"), F.col("body_text"),
             F.array_join("list_items", " "), F.array_join("schema_offerings", " ")]
    return F.lower(F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts]))


def _holds(body):
    """Test of a term: ``body`` is the lower-cased text, or the test itself."""
    return body if callable(body) else lambda t: F.contains(body, F.lit(t))


def model_score(body, terms) -> Column:
    """Sum of 1 + length/20 over the contained terms."""
    return reduce(
        lambda a, t: a + F.when(_holds(body)(t), 1.0 + len(t) / 20.0).otherwise(0.0),
        terms, F.lit(0.0),
    )


def model_scores(body, signals=V.MODEL_SIGNALS) -> list[Column]:
    return [model_score(body, terms).alias(f"score_{model}") for model, terms in signals]


def model_pick(signals=V.MODEL_SIGNALS) -> Column:
    """Best model over the score columns; listing order breaks ties, below 1 is unknown.

    Rental, then sales, win over manufacturing of no higher score.
    """
    score = {m: F.col(f"score_{m}") for m, _ in signals}
    best = F.greatest(*score.values())
    pick = reduce(lambda c, m: c.when(score[m] == best, m), list(score)[1:],
                  F.when(score[next(iter(score))] == best, next(iter(score))))
    made = score["manufacturing"]

    def beats(m: str) -> Column:
        return (score[m] >= made) & (score[m] >= 1)

    return (
        F.when(best < 1.0, "unknown").when(beats("goods_rental"), "goods_rental")
        .when(beats("goods_sales"), "goods_sales").otherwise(pick)
    )


def audience(body, model: Column, b2b=V.B2B_SIGNALS, b2c=V.B2C_SIGNALS) -> Column:
    business, private = (
        reduce(lambda a, t: a + _holds(body)(t).cast("int"), terms, F.lit(0)) if callable(body) else count_contained(body, terms)
        for terms in (b2b, b2c))
    return (
        F.when((model == "b2b_services") | (business > private), "b2b")
        .when(private > business, "b2c").otherwise("mixed")
    )


def with_keywords(df: DataFrame, body: str, out: str = "keywords", limit: int = 12,
                  stop=V.KEYWORD_STOP_WORDS) -> DataFrame:
    """Most frequent words of five letters and more: count, then length, then first occurrence.

    Sort the words of the row, measure the runs, sort the runs.  No explode, no shuffle.
    """
    found = F.filter(
        F.regexp_extract_all(F.col(body), F.lit(r"([а-яёa-z][а-яёa-z\-]{3,})"), F.lit(1)),
        lambda w: (F.length(w) >= 5) & ~one_of(w, stop))
    w, h = F.col("_words"), F.col("_heads")
    numbered = F.transform(found, lambda x, i: F.struct(x.alias("w"), i.alias("pos")))
    heads = F.filter(
        F.transform(w, lambda x, i: F.struct(x["w"].alias("w"), x["pos"].alias("pos"), i.alias("i"))),
        lambda x: (x["i"] == 0) | (F.get(w, x["i"] - 1)["w"] != x["w"]))
    runs = F.transform(h, lambda x, j: F.struct(
        (x["i"] - F.coalesce(F.get(h, j + 1)["i"], F.size(w))).alias("minus_n"),
        (-F.length(x["w"])).alias("minus_len"), x["pos"].alias("pos"), x["w"].alias("w")))
    return (
        df.withColumn("_words", F.array_sort(numbered)).withColumn("_heads", heads)
        .withColumn(out, F.transform(F.slice(F.array_sort(runs), 1, limit), lambda r: r["w"]))
        .drop("_words", "_heads")
    )


def brand_tokens(site: Column, title: Column, hints: Column, orgs: Column) -> Column:
    base = F.split_part(host(site), F.lit("."), F.lit(1))
    short = F.when(F.length(base) > 4, F.left(base, F.greatest(F.lit(4), F.length(base) - 2)))
    named = F.flatten(F.transform(
        F.concat(F.array(title), hints, orgs),
        lambda t: F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit("([a-zа-яё]{4,})"), F.lit(1))))
    return F.array_distinct(F.filter(
        F.concat(F.array(base, short), named), lambda t: F.length(t) >= 4))


def worthy(brand: Column):
    """Test whether the cleaned form of a phrase may serve as a query."""
    return lambda p: let(T.tidy(p), lambda c: F.when(T.phrase_ok(c), T.query_worthy(c, brand)).otherwise(False))


def short_offering(clean: Column) -> Column:
    return F.substring(T.strip(F.regexp_replace(clean, r"(?iu)^(?:услуги|сервис)\s+", "")), 1, 80)


def normalize_offerings(phrases: Column) -> Column:
    return F.filter(F.transform(T.clean_phrases(phrases), short_offering), lambda p: p != "")


_BODY_PHRASE = r"([а-яёa-z][а-яёa-z\-]{3,}(?:\s+[а-яёa-z][а-яёa-z\-]{3,}){1,4})"


# Whether a cleaned phrase may be an offering, by the place it stands in; a body phrase is asked as found, too.

def heading_fits(p: Column) -> Column:
    return ~T.section_junk(p) & T.has_service_sense(p)


def item_fits(p: Column) -> Column:
    return F.length(p).between(10, 70) & ~T.section_junk(p) & (T.looks_like_query(p) | T.has_service_sense(p))


def sentence_fits(p: Column) -> Column:
    return T.has_service_sense(p) & ~T.section_junk(p)


BODY_PHRASE_CHARS = 18, 65


def body_phrase_fits(raw: Column) -> Column:
    return F.length(raw).between(*BODY_PHRASE_CHARS) & T.looks_like_query(raw)


def off_brand(p: Column, brand: Column) -> Column:
    return ~T.has_service_sense(p) & T.contains_brand(p, brand)


def offerings(brand: Column, limit: int = 10) -> Column:
    """Headings, list items, schema names, description sentences, body phrases, in that order."""
    heads = F.filter(
        T.clean_phrases(F.transform(F.filter("headings", lambda x: x["level"] != "h1"), lambda x: x["text"])), heading_fits)
    listed = F.filter(
        T.clean_phrases(F.concat("list_items", "schema_offerings")), lambda p: item_fits(p) & ~off_brand(p, brand))
    described = F.filter(T.clean_phrases(F.split("meta_description", r"[.!?]\s+")), sentence_fits)
    phrases = F.filter(
        F.regexp_extract_all(F.lower("body_text"), F.lit(_BODY_PHRASE), F.lit(1)), body_phrase_fits)
    body = F.filter(T.clean_phrases(phrases), lambda p: ~T.section_junk(p))
    return T.first_by_lower(
        normalize_offerings(F.concat(heads, listed, described, body)), limit, worthy(brand))


def with_queries(df: DataFrame, brand: str = "brand", limit: int = 14) -> DataFrame:
    """Adds ``queries``: offerings, templates of the model, city variants of the first query.

    Needs business_model, offerings, keywords, geo_cities.  One column per step, so no step
    is evaluated twice.
    """
    model = F.col("business_model")
    none = F.array().cast("array<string>")
    cores = F.col("_cores")
    base = F.when(F.size("offerings") > 0, F.slice("offerings", 1, 3)).when(
        F.size("keywords") > 0, F.array(F.array_join(F.slice("keywords", 1, 2), " "))).otherwise(none)

    def filled(m: str) -> Column:
        usable = F.filter(cores, lambda c: ~F.lower(c).rlike(V.GOODS_SKIP[m])) if m in V.GOODS_SKIP else cores
        return F.flatten(F.transform(usable, lambda c: F.array(
            *[F.replace(F.lit(t), F.lit("{}"), c) for t in V.GOODS_TEMPLATES[m]])))

    b2b = F.concat(*[
        F.when(contains_any(F.col("_blob"), words), F.array(*[F.lit(x) for x in qs])).otherwise(none)
        for words, qs in V.B2B_TRIGGERS])
    served = F.transform(F.slice("offerings", 1, 4), lambda o: F.when(
        F.lower(o).startswith("услуг"), o).otherwise(F.concat(F.lit(V.SERVICE_PREFIX), o)))
    extra = F.when(model == "b2b_services", b2b)
    for m in V.GOODS_TEMPLATES:
        extra = extra.when(model == m, filled(m))
    cities = F.when(
        model.isin(*V.LOCAL_MODELS) & (F.size("_plain") > 0),
        F.transform(F.slice("geo_cities", 1, 2), lambda c: F.concat_ws(" ", F.get("_plain", F.lit(0)), c)),
    ).otherwise(none)
    return (
        df.withColumn("_blob", F.concat_ws(" ", F.array_join("keywords", " "), F.lower(F.array_join("offerings", " "))))
        .withColumn("_cores", F.filter(normalize_offerings(base), lambda c: F.length(c) <= 45))
        .withColumn("_direct", F.transform(
            F.concat(F.slice("offerings", 1, 8), extra.otherwise(served)), T.squeeze))
        .withColumn("_plain", T.first_by_lower(F.col("_direct"), None, worthy(F.col(brand))))
        .withColumn("_cities", cities)
        .withColumn("queries", T.first_by_lower(
            F.concat("_plain", F.filter("_cities", worthy(F.col(brand)))), limit))
        .drop("_blob", "_cores", "_direct", "_plain", "_cities")
    )


def geo_cities(text, cities=V.GEO_CITIES, limit: int = 3) -> Column:
    """Cities named in the text, or by a test of a name (see ``_holds``)."""
    holds = _holds(text if callable(text) else F.lower(text))
    named = F.array(*[F.when(holds(n), F.lit(label)) for n, label in cities])
    return F.slice(F.array_distinct(F.filter(named, lambda c: c.isNotNull())), 1, limit)


def company_matches(blob: Column) -> list[Column]:
    """What each legal form's pattern finds first, or empty text."""
    return [F.regexp_extract(blob, p, 1) for p in V.COMPANY_PATTERNS]


def company_of(matches: list[Column], has_form: Column, hints: Column, orgs: Column) -> Column:
    """First legal form found, else a fitting organisation or brand name."""
    def entity(found: Column) -> Column:
        name = T.clean_entity(found)
        return F.when(F.length(name) >= 4, name)

    quoted = F.nullif(T.clean_entity(matches[0]), F.lit(""))
    names = F.transform(F.concat(orgs, hints), lambda r: T.clean_entity(T.normalize_dashes(r)))
    chosen = F.transform(names, lambda v: (
        F.when(v.rlike(V.COMPANY_FORMS), v)
        .when(v.rlike(V.BRAND_OF_COMPANY) & has_form & quoted.isNotNull(), quoted)
        .when(F.length(v).between(5, 60) & v.rlike("(?iu)[а-яёa-z]") & ~v.rlike(V.BRAND_IMAGE_WORDS)
              & v.rlike(V.BRAND_NAME_WORDS), v)))
    fallback = F.get(F.filter(chosen, lambda v: v.isNotNull()), F.lit(0))
    return F.coalesce(*[entity(m) for m in matches], fallback, F.lit(""))


def company_name(title: Column, text: Column, footer: Column, hints: Column, orgs: Column) -> Column:
    """``company_of`` over title, footer and the first 6000 characters of the text."""
    blob = T.normalize_dashes(F.concat_ws("\n", title, footer, F.substring(text, 1, 6000)))
    return company_of(company_matches(blob), F.contains(F.lower(blob), F.lit(V.COMPANY_FORM_WORD)), hints, orgs)


def summary() -> Column:
    label = F.create_map(*[F.lit(x) for kv in V.MODEL_LABELS.items() for x in kv])
    parts = F.concat(F.array(F.element_at(label, F.col("business_model"))), F.slice("offerings", 1, 2))
    return F.substring(F.array_join(parts, ". "), 1, 300)


def profile_sites(survey: DataFrame) -> DataFrame:
    """Profile record per survey row (``merge_pages`` output or the same columns)."""
    c = F.col
    scored = (
        survey.withColumn("body_low", search_body())
        .withColumn("brand", brand_tokens(c("site"), c("title"), c("brand_hints"), c("org_names")))
        .select("*", *model_scores(c("body_low")))
        .withColumn("business_model", model_pick())
        .withColumn("audience", audience(c("body_low"), c("business_model")))
        .withColumn("offerings", offerings(c("brand")))
    )
    described = with_keywords(scored, "body_low").withColumn(
        "geo_cities", geo_cities(F.concat_ws(" ", "body_text", "footer_text")))
    named = company_name(c("title"), c("body_text"), c("footer_text"), c("brand_hints"), c("org_names"))
    return profile_rows(described.drop("body_low", *[f"score_{m}" for m, _ in V.MODEL_SIGNALS]), named)


def profile_rows(described: DataFrame, client_name: Column) -> DataFrame:
    """Profile record per site whose model, audience, offerings, keywords and cities are known."""
    c = F.col
    return fence(
        with_queries(fence(described, "site"))
        .select(
            "site", "business_model", "audience", summary().alias("summary"), "offerings",
            c("keywords").alias("industry_keywords"), "geo_cities", "queries", client_name.alias("client_name"),
            exclude_list(host(c("site"))).alias("exclude_domains"),
            "title", "pages_surveyed",
        ),
        "site",
    )
