"""Profiles of whole sites: every page and every text of a site, however many it has.

Pages are dealt by range of (site, order) and parsed once, in order.  A page becomes a staged record: which terms it holds,
what the name patterns find, and the phrases that can be among the first offerings of its site; the words of a site
are counted over the pages a task holds of it.  A site is then put together from records by aggregates that combine in the
map tasks; a site with a third of all pages is spread over the ranges, and no task holds the pages of a site.

Offerings are the first phrases of a site that pass every test, so of a page only the first ``limit`` that pass for
sure can be among them, and those before them that hang on the site's brand: this loses nothing, whatever the other
pages hold.  Body phrases are cut from the site's joined text, so a phrase may run over an edge of pages (``_Edges``).
Signal words, cities and legal names are looked for page by page.
"""
from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactlake import fixed_values as V
from contactlake.functions import let
from contactlake.functions import text as T
from contactlake.operators import html as H
from contactlake.operators import profile as P
from contactlake.operators.flatten import _ARROW, FLAT_SCHEMA, _flatten
from contactlake.operators.sitewords import site_keywords, site_words
from contactlake.session import stage

# Workers get this module inside the task, so nothing has to be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TERMS = tuple(dict.fromkeys(
    [t for _, terms in V.MODEL_SIGNALS for t in terms] + list(V.B2B_SIGNALS) + list(V.B2C_SIGNALS)))
NAMES = tuple(n for n, _ in V.GEO_CITIES)
_BITS = 60
_WS = " \t\n\x0b\f\r"
_WORD = r"[а-яёa-z][а-яёa-z\-]{3,}+"
# Up to five words with white space between; where a sixth follows, the white space before it too.
_GROUP = re.compile(rf"{_WORD}(?:[{_WS}]++{_WORD}){{0,4}}+(?:[{_WS}]++(?={_WORD}))?")
_NAMES = "ООО", "ИП"  # one of them stands in every legal name
# What a task needs of other modules, as values.
_STOP, _FORM, _CHARS = frozenset(V.KEYWORD_STOP_WORDS), V.COMPANY_FORM_WORD, P.BODY_PHRASE_CHARS
_NEAR = 200     # characters at the ends of a text that are kept beside it; more than the longest term
_HELD = 65_536  # words of a site a task counts before it hands them on
_PACK = 8_192   # words in one row
_PAGE_ROWS = 2_048  # pages of a range
HEADING, ITEM, SCHEMA, SENTENCE, BODY = range(5)
_FOUND = "array<struct<pos: int, clean: string, phrase: string, sure: boolean>>"


# --- terms -----------------------------------------------------------------------------

def term_masks(text: Column, terms) -> list[Column]:
    """Which terms the lower-cased text contains, as bits of whole numbers."""
    out = []
    for k in range(0, len(terms), _BITS):
        mask = F.lit(0).cast("bigint")
        for b, t in enumerate(terms[k:k + _BITS]):
            mask = mask.bitwiseOR(F.when(F.contains(text, F.lit(t)), F.lit(1 << b)).otherwise(F.lit(0)).cast("bigint"))
        out.append(mask)
    return out


def term_test(terms, name: str, also: Column):
    """Test of a term against the masks, and against a short text beside them."""
    def holds(t: str) -> Column:
        k, b = divmod(terms.index(t), _BITS)
        return (F.col(f"{name}{k}").bitwiseAND(F.lit(1 << b)) != 0) | F.contains(also, F.lit(t))
    return holds


def _bits(text: str, terms) -> list[int]:
    return [sum(1 << b for b, t in enumerate(terms[k:k + _BITS]) if t in text) for k in range(0, len(terms), _BITS)]


# --- phrases of a page -----------------------------------------------------------------

def _judged(clean_fits, raw_fits=None):
    """Test of one phrase: struct<clean, phrase, sure>, or NULL for what is no offering under any brand.

    ``sure`` phrases are offerings under every brand.
    """
    def shortened(clean: Column) -> Column:
        return let(T.tidy(clean), lambda c: F.when((c == clean) | T.phrase_ok(c), P.short_offering(c)))

    def record(clean: Column) -> Column:
        # what has passed as it stands is no junk and not in capitals; it is then worthy unless it is short and without sense
        def judged(p: Column, c: Column, sense: Column) -> Column:
            fair = F.when(c == clean, sense | (F.length(c) >= 14)).otherwise(P.worthy(F.array().cast("array<string>"))(p))
            sure = sense & ((c == clean) | T.has_service_sense(c))
            return F.when((p != "") & fair, F.struct(clean.alias("clean"), p.alias("phrase"), sure.alias("sure")))

        return let(T.has_service_sense(clean), lambda sense: let(
            shortened(clean), lambda p: let(T.tidy(p), lambda c: judged(p, c, sense))))

    def judge(raw: Column) -> Column:
        judged = let(T.tidy(raw), lambda c: F.when(T.phrase_ok(c) & clean_fits(c), record(c)))
        return judged if raw_fits is None else F.when(raw_fits(raw), judged)

    return judge


judge_heading, judge_item = _judged(P.heading_fits), _judged(P.item_fits)
judge_sentence = _judged(P.sentence_fits)
judge_body = _judged(lambda c: ~T.section_junk(c), P.body_phrase_fits)


def numbered(raws: Column) -> Column:
    return F.transform(raws, lambda x, i: F.struct(i.alias("pos"), x.alias("raw")))


def first_phrases(raws: Column, judge, limit: int) -> Column:
    """Phrases of one row (array<struct<pos, raw>>) in order until ``limit`` different sure ones are found, unsure ones among
    them."""
    def step(acc: Column, x: Column) -> Column:
        def added(j: Column) -> Column:
            known = F.exists(acc, lambda a: (F.lower(a["phrase"]) == F.lower(j["phrase"])) & (
                a["sure"] | ((a["phrase"] == j["phrase"]) & (a["clean"] == j["clean"]))))
            new = F.array(F.struct(x["pos"].alias("pos"), j["clean"].alias("clean"), j["phrase"].alias("phrase"),
                                   j["sure"].alias("sure")))
            return F.when(j.isNull() | known, acc).otherwise(F.concat(acc, new))

        full = F.size(F.filter(acc, lambda a: a["sure"])) >= limit
        return F.when(full, acc).otherwise(let(judge(x["raw"]), added))

    return F.aggregate(raws, F.array().cast(_FOUND), step)


def placed(kind: int, found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(
        F.lit(kind).alias("kind"), x["pos"].alias("pos"), x["clean"].alias("clean"), x["phrase"].alias("phrase"), x["sure"].alias("sure")))


# --- phrases over the edges of pages ----------------------------------------------------

_INK = re.compile(rf"[^{_WS}]+")


def _groups(run: str) -> Iterator[tuple[int, str, int]]:
    """Start, text and number of words of each five words of a run."""
    words = list(_INK.finditer(run))
    for k in range(0, len(words), 5):
        some = words[k:k + 5]
        yield some[0].start(), run[some[0].start():some[-1].end()], len(some)


def _cut(low: str) -> dict:
    """Phrases of a lower-cased text: ``inner`` ones that no other page can change, the words it begins with (``lead``, all
    of it if ``full``), and a phrase it ends with that may go on (``tail``).  With all its words."""
    found = _GROUP.findall(low)
    n = 0
    if found and low.startswith(found[0]):
        n = 1
        while found[n - 1][-1] in _WS:
            n += 1
    lead = "".join(found[:n]) if n else None
    last = found[-1] if len(found) > n else ""
    tail = last if last and low.endswith(last) and len(last.split()) < 5 else None
    least, most = _CHARS
    inner = [(i, text) for i, text in enumerate((g.rstrip(_WS) for g in found[n:len(found) - (tail is not None)]), n)
             if least <= len(text) <= most and len(text.split()) > 1]
    return {"blank": low == "", "lead": lead, "full": n > 0 and len(lead) == len(low), "tail": tail, "tail_pos": len(found) - 1,
            "inner": [text for _, text in inner], "at": [i for i, _ in inner], "words": " ".join(found).split()}


class _Edges:
    """Cuts the words at the edges of pages in page order; ``out`` takes (site, ord, pos, phrase)."""

    def __init__(self, out) -> None:
        self.out, self.open = out, None  # open: site, ord, pos, text of a phrase that may go on on the next page

    def emit(self, site, at: int, pos: int, text: str) -> None:
        if len(_INK.findall(text)) > 1:
            self.out(site, at, pos, text.rstrip(_WS))

    def close(self) -> None:
        if self.open:
            self.emit(*self.open)
        self.open = None

    def page(self, r: dict) -> None:
        site, at = r["site"], r["ord"]
        if self.open and self.open[0] != site:
            self.close()
        if r["blank"]:
            if self.open:
                self.open = (*self.open[:3], self.open[3] + "\n")
            return
        if r["lead"] is None:
            self.close()
        else:
            before, self.open = self.open, None
            begun = before[3] + "\n" if before else ""
            own, last = 0, None
            for start, text, n in _groups(begun + r["lead"]):
                if last:
                    self.emit(*last)
                if start < len(begun):
                    last = (*before[:3], text)
                else:
                    last, own = (site, at, own, text), own + 1
                size = n
            if r["full"] and size < 5:
                self.open = last
            else:
                self.emit(*last)
        if r["tail"] is not None:
            self.open = (site, at, r["tail_pos"], r["tail"])


# --- records of pages -------------------------------------------------------------------

_PAGE, _EDGE, _HEAD, _EXIT, _COUNTED = range(5)
_MASKS = [f"term{k // _BITS}" for k in range(0, len(TERMS), _BITS)], [f"city{k // _BITS}" for k in range(0, len(NAMES), _BITS)]
_MADE = pa.struct([
    ("kind", pa.int32()), ("row", pa.int64()), ("site", pa.string()), ("ord", pa.int64()), ("pos", pa.int32()), ("phrase", pa.string()),
    ("blank", pa.bool_()), ("lead", pa.string()), ("full", pa.bool_()), ("known", pa.bool_()),
    ("head", pa.string()), ("end", pa.string()), ("has_name", pa.bool_()), ("has_form", pa.bool_()),
    *[(m, pa.int64()) for ms in _MASKS for m in ms],
    ("inner", pa.list_(pa.string())), ("inner_at", pa.list_(pa.int32())),
    ("word", pa.list_(pa.string())), ("n", pa.list_(pa.int64())), ("word_ord", pa.list_(pa.int64())), ("word_pos", pa.list_(pa.int32())),
    *_ARROW])
_SCHEMA = f"""
    kind INT, row BIGINT, site STRING, ord BIGINT, pos INT, phrase STRING, blank BOOLEAN, lead STRING, full BOOLEAN, known BOOLEAN,
    head STRING, end STRING, has_name BOOLEAN, has_form BOOLEAN, {", ".join(f"{m} BIGINT" for ms in _MASKS for m in ms)},
    inner ARRAY<STRING>, inner_at ARRAY<INT>, word ARRAY<STRING>, n ARRAY<BIGINT>, word_ord ARRAY<BIGINT>, word_pos ARRAY<INT>,
    {FLAT_SCHEMA}"""


class _Reader:
    """Reads the pages of a range in order; ``rows`` takes what it makes of them.

    The kinds of rows: pages, phrases over an edge of pages, first pages of the range (what they begin with depends on the
    range before), the phrase the range leaves open, and words with their counts and first places.
    """

    def __init__(self, part: int) -> None:
        self.rows: list[dict] = []
        self.next, self.first, self.known = part << 33, None, False
        self.edges = _Edges(lambda site, at, pos, phrase: self.put(_EDGE, site=site, ord=at, pos=pos, phrase=phrase))
        self.site, self.counts, self.places = None, Counter(), {}

    def put(self, kind: int, **row) -> None:
        self.rows.append({"kind": kind, "row": self.next, **row})
        self.next += 1

    def page(self, site, html) -> None:
        flat = _flatten(html, True)
        strings, at = flat["strings"], self.next
        for n in flat["nodes"]:
            if n["tag"] == "noscript":
                if strings is flat["strings"]:
                    strings = list(strings)
                strings[n["s"]:n["e"]] = [None] * (n["e"] - n["s"])
        text = "\n".join(s for s in strings if s is not None)
        low, upper = text.lower(), "\n".join(flat["strings"]).upper()
        cut = _cut(low)
        self.put(_PAGE, site=site, ord=at, head=text[:_NEAR], end=low[-_NEAR:], inner=cut["inner"], inner_at=cut["at"],
                 has_name=any(n in upper for n in _NAMES), has_form=_FORM in low,
                 **dict(zip(_MASKS[0], _bits(low, TERMS), strict=True)), **dict(zip(_MASKS[1], _bits(low, NAMES), strict=True)), **flat)
        self.edge({"site": site, "ord": at, **cut})
        self.count(site, at, cut["words"])

    def edge(self, r: dict) -> None:
        if not self.known:
            self.first = self.first or (r["site"],)
            if self.first == (r["site"],):
                self.put(_HEAD, site=r["site"], ord=r["ord"], blank=r["blank"], lead=r["lead"], full=r["full"])
                self.known = not (r["blank"] or r["full"])
                if self.known:
                    self.edges.page({**r, "lead": None})
                return
            self.known = True
        self.edges.page(r)

    def count(self, site, at: int, words: list[str]) -> None:
        if site != self.site or len(self.counts) > _HELD:
            self.hand_on()
            self.site = site
        self.counts.update(words)
        places = self.places
        for pos, w in enumerate(words):
            if w not in places:
                places[w] = at, pos

    def hand_on(self) -> None:
        kept = [w for w in self.counts if len(w) >= 5 and w not in _STOP]
        for k in range(0, len(kept), _PACK):
            some = kept[k:k + _PACK]
            places = [self.places[w] for w in some]
            self.put(_COUNTED, site=self.site, word=some, n=[self.counts[w] for w in some],
                     word_ord=[at for at, _ in places], word_pos=[pos for _, pos in places])
        self.counts.clear()
        self.places.clear()

    def end(self) -> None:
        self.hand_on()
        site, at, pos, phrase = self.edges.open or (None, None, None, None)
        self.put(_EXIT, site=site, ord=at, pos=pos, phrase=phrase, known=self.known)

    def take(self) -> pa.RecordBatch:
        rows = pa.array(self.rows, type=_MADE)
        self.rows.clear()
        return pa.RecordBatch.from_arrays(rows.flatten(), names=[f.name for f in _MADE])


def _read(pages: DataFrame) -> DataFrame:
    """``pages`` (site, o, html) read in order; see ``_Reader``."""
    def run(batches):
        reader = _Reader(TaskContext.get().partitionId())
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # bounds the parsed pages held at once
                b = batch.slice(at, 256)
                for site, html in zip(b.column("site").to_pylist(), b.column("html").to_pylist(), strict=True):
                    reader.page(site, html)
                yield reader.take()
        reader.end()
        yield reader.take()

    parts = max(2 * pages.sparkSession.sparkContext.defaultParallelism, -(-pages.count() // _PAGE_ROWS))
    ranged = pages.select("site", "o", "html").repartitionByRange(parts, "site", "o").sortWithinPartitions("site", "o")
    return ranged.select("site", "html").mapInArrow(run, _SCHEMA)


def _filled(c) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def page_records(pages: DataFrame, limit: int = 10) -> DataFrame:
    """``pages`` (site, o, html; ``o`` orders the pages of a site) -> staged records of pages and what lies between them.

    ``ord`` is the place of a page in the order of (site, o).
    """
    def names(*texts) -> Column:
        blob = T.normalize_dashes(F.concat_ws("\n", *texts))
        nothing = F.array(*[F.lit("") for _ in V.COMPANY_PATTERNS])
        return F.when(F.col("has_name"), let(blob, lambda t: F.array(*P.company_matches(t)))).otherwise(nothing)

    inner = F.transform("inner", lambda x, i: F.struct(F.get("inner_at", i).alias("pos"), x.alias("raw")))
    heads = F.transform(F.filter(H.headings(None), lambda x: x["level"] != "h1"), lambda x: x["text"])
    between = ["kind", "row", "site", "ord", "pos", "phrase", "blank", "lead", "full", "known", "word", "n", "word_ord", "word_pos"]
    page = ["head", "has_form", "title", "footer", "hints", "orgs", "meta", "items", "schema"]
    masks = [F.col(m).bitwiseOR(F.when(F.col("listed") != "", more).otherwise(F.lit(0).cast("bigint"))).alias(m)
             for m, more in zip(_MASKS[0], term_masks(F.col("listed"), TERMS), strict=True)]
    listed = F.lower(F.concat_ws(" ", _filled("end"), _filled("items"), _filled("schema")))
    return stage(
        _read(pages)
        .withColumn("title", H.page_title()).withColumn("meta", H.meta_description(None))
        .withColumn("footer", H.footer_text(None)).withColumn("hints", H.brand_hints(None, None)).withColumn("orgs", H.ld_values("org", None))
        .withColumn("list_items", H.list_items(None)).withColumn("offered", H.ld_values("offering", None))
        .withColumn("items", F.array_join("list_items", " ")).withColumn("schema", F.array_join("offered", " "))
        .withColumn("listed", F.when((F.col("items") == "") & (F.col("schema") == ""), "").otherwise(listed))
        .select(
            *between, *page, *masks, *_MASKS[1],
            names("title", "footer", H.visible_text()).alias("home_names"), names(H.visible_text()).alias("names"),
            F.concat(
                placed(HEADING, first_phrases(numbered(heads), judge_heading, limit)),
                placed(ITEM, first_phrases(numbered(F.col("list_items")), judge_item, limit)),
                placed(SCHEMA, first_phrases(numbered(F.col("offered")), judge_item, limit)),
                placed(BODY, first_phrases(inner, judge_body, limit))).alias("found")))


def _of(records: DataFrame, kind: int) -> DataFrame:
    return records.where(F.col("kind") == kind)


def _close_ranges(rows: list[dict], out) -> None:
    """Cuts what the ranges left open: their first pages and the phrase each ends in, in order."""
    edges = _Edges(out)
    for r in rows:
        if r["kind"] == _HEAD:
            edges.page({**r, "tail": None})
        elif r["known"]:
            edges.close()
            edges.open = (r["site"], r["ord"], r["pos"], r["phrase"]) if r["phrase"] is not None else None
    edges.close()


def edge_phrases(records: DataFrame) -> DataFrame:
    """site, ord, pos, phrase: body phrases that begin at the start of a page, or end at its end.

    What a range cannot know (the words its first site begins with) and the phrase it leaves open, a few rows a range, are cut
    here.
    """
    late: list[tuple] = []
    open_ends = records.where(F.col("kind").isin(_HEAD, _EXIT)).select(
        "kind", "row", "site", "ord", "pos", "phrase", "blank", "lead", "full", "known")
    _close_ranges(sorted((r.asDict() for r in open_ends.collect()), key=lambda r: r["row"]), lambda *row: late.append(row))
    cut = _of(records, _EDGE).select("site", "ord", "pos", "phrase")
    return cut.unionByName(records.sparkSession.createDataFrame(late, cut.schema)) if late else cut


# --- sites ------------------------------------------------------------------------------

def site_rows(records: DataFrame, limit: int = 10) -> DataFrame:
    """One staged row a site: what its first page says of it, and what is known of all pages.  ``site`` is a struct here,
    so that pages without one are a group like any other."""
    names = [F.min_by(F.get("names", F.lit(i)), F.when(F.get("names", F.lit(i)) != "", F.col("ord"))).alias(f"name{i}")
             for i in range(len(V.COMPANY_PATTERNS))]
    home = F.struct("title", "footer", "hints", "orgs", "head", "home_names")
    site = _of(records, _PAGE).groupBy(F.struct("site").alias("site")).agg(
        F.min_by(home, "ord").alias("home"), F.min_by("meta", F.when(F.col("meta") != "", F.col("ord"))).alias("meta"),
        *names, F.max("has_form").alias("has_form"), *[F.bit_or(m).alias(m) for ms in _MASKS for m in ms],
        F.count("*").cast("int").alias("pages_surveyed"))
    matches = [F.coalesce(F.nullif(F.get("home_names", F.lit(i)), F.lit("")), f"name{i}", F.lit("")) for i in range(len(V.COMPANY_PATTERNS))]
    has_form = F.col("has_form") | F.contains(F.lower(F.concat_ws("\n", "title", "footer")), F.lit(V.COMPANY_FORM_WORD))
    return stage(
        site.select("*", "home.*").withColumn("meta", F.coalesce("meta", F.lit("")))
        .withColumn("beside", F.lower(F.concat_ws(" ", _filled("title"), _filled("meta"), _filled("head"))))
        .select("*", *P.model_scores(term_test(TERMS, "term", F.col("beside"))))
        .withColumn("business_model", P.model_pick())
        .select(
            "site", "title", "meta", "business_model",
            P.audience(term_test(TERMS, "term", F.col("beside")), F.col("business_model")).alias("audience"),
            P.geo_cities(term_test(NAMES, "city", F.lower("footer"))).alias("geo_cities"),
            P.brand_tokens(F.col("site.site"), F.col("title"), F.col("hints"), F.col("orgs")).alias("brand"),
            P.company_of(matches, has_form, F.col("hints"), F.col("orgs")).alias("client_name"),
            placed(SENTENCE, first_phrases(numbered(F.split("meta", r"[.!?]\s+")), judge_sentence, limit)).alias("found"),
            "pages_surveyed"))


def site_offerings(records: DataFrame, sites: DataFrame, limit: int = 10) -> DataFrame:
    """site, offerings: the first ``limit`` offerings of each site.

    Sure phrases are ranked without the brand, which leaves ``limit`` of a site in each task.  The others, few, are judged
    with it first.
    """
    key = F.struct("site").alias("site")

    edges = edge_phrases(records).withColumn("j", judge_body(F.col("phrase"))).where(F.col("j").isNotNull()).select(
        key, "ord", F.lit(BODY).alias("kind"), "pos", "j.*")
    found = edges.unionByName(sites.select("site", F.lit(0).cast("bigint").alias("ord"), F.inline("found"))).unionByName(
        _of(records, _PAGE).select(key, "ord", F.inline("found")))
    found = found.withColumn("at", F.struct("kind", "ord", "pos"))

    def first(df: DataFrame) -> DataFrame:
        return df.groupBy("site", F.lower("phrase").alias("low")).agg(
            F.min("at").alias("at"), F.min_by("phrase", "at").alias("phrase"))

    def top(df: DataFrame) -> DataFrame:
        order = Window.partitionBy("site").orderBy("at")
        return df.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit)

    sure = top(first(found.where("sure"))).select("site", "phrase", "at")
    unsure = found.where("NOT sure").groupBy("site", "clean", "phrase", F.col("kind").isin(ITEM, SCHEMA).alias("listed")).agg(
        F.min("at").alias("at"))
    branded = unsure.join(sites.select("site", "brand"), "site").where(
        P.worthy(F.col("brand"))(F.col("phrase")) & ~(F.col("listed") & P.off_brand(F.col("clean"), F.col("brand"))))
    best = top(first(sure.unionByName(branded.select("site", "phrase", "at"))))
    return best.groupBy("site").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("n", "phrase"))), lambda x: x["phrase"]).alias("offerings"))


def site_keyword_lists(records: DataFrame, sites: DataFrame, limit: int = 12) -> DataFrame:
    """site, keywords: the most frequent words of the home page's title, the description, texts, list items and structured
    data."""
    def parts(first: int, *columns: str) -> Column:
        each = F.array(*[F.struct(F.lit(first + i).alias("part"), F.col(c).alias("said")) for i, c in enumerate(columns)])
        return F.inline(F.filter(each, lambda x: x["said"] != ""))

    key = F.struct("site").alias("site")
    few = _of(records, _PAGE).select(key, "ord", parts(3, "items", "schema")).unionByName(
        sites.select("site", F.lit(0).cast("bigint").alias("ord"), parts(0, "title", "meta")))
    def place(part: Column, at: Column) -> Column:  # one number, so that words are counted in a hash table
        return F.shiftleft(part.cast("bigint"), 60).bitwiseOR(at)

    body = _of(records, _COUNTED).select(key, F.inline(F.arrays_zip("word", "n", "word_ord", "word_pos"))).select(
        "site", "word", "n", place(F.lit(2), F.col("word_ord")).alias("ord"), F.col("word_pos").alias("pos"))
    beside = site_words(few, F.col("said"), "part", "ord").select(
        "site", "word", "n", place(F.col("at.part"), F.col("at.ord")).alias("ord"), "at.pos")
    words = body.unionByName(beside).groupBy("site", "word").agg(
        F.sum("n").alias("n"), F.min("ord").alias("ord"), F.min_by("pos", "ord").alias("pos")).select(
        "site", "word", "n", F.struct("ord", "pos").alias("at"))
    return site_keywords(words, limit).groupBy("site").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("keywords"))


def site_profiles(pages: DataFrame) -> DataFrame:
    """Profile record of each site of ``pages`` (site, o, html), over all its pages and their whole texts."""
    records = page_records(pages)
    sites = site_rows(records)
    none = F.array().cast("array<string>")
    described = (
        sites.select("site", "title", "business_model", "audience", "geo_cities", "brand", "client_name", "pages_surveyed")
        .join(site_offerings(records, sites), "site", "left").join(site_keyword_lists(records, sites), "site", "left")
        .withColumn("offerings", F.coalesce("offerings", none)).withColumn("keywords", F.coalesce("keywords", none))
        .withColumn("site", F.col("site.site")))
    return P.profile_rows(described, F.col("client_name"))
