"""Phrase cleaning and judging, and other text expressions."""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactlake import fixed_values as V
from contactlake.functions import let
from contactlake.functions.lists import one_of, phrase_contains

_WS, _INK = f"[{V.WHITE_SPACE}]", f"[^{V.WHITE_SPACE}]"
_LETTER = "[а-яёa-z]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{_WS}+|{_WS}+$", "")


def squeeze(text: Column) -> Column:
    """Trim and turn every run of white space into one blank."""
    return F.regexp_replace(strip(F.coalesce(text, F.lit(""))), rf"{_WS}+", " ")


def words(text: Column) -> Column:
    """White-space separated words, none for blank text."""
    return F.filter(F.split(text, rf"{_WS}+"), lambda w: w != "")


def has_year(text: Column, year: int) -> Column:
    """The year occurs as a word of its own."""
    return F.coalesce(text.rlike(rf"(?U)\b{year:d}\b"), F.lit(False))


def hit_blob(*parts: Column, queries: Column | None = None) -> Column:
    """Title, snippet and the like joined for matching, missing parts as empty text."""
    cols = [F.coalesce(p, F.lit("")) for p in parts]
    if queries is not None:
        cols.append(F.array_join(queries, " "))
    return F.concat_ws(" ", *cols)


def normalize_dashes(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x{2010}-\x{2014}\x{2212}]", "-")


_MARKS = r"[·|\-—–:;,.]+"


# words of letters with one blank or hyphen between: nothing to tidy
_TIDY = rf"\A{_LETTER}++(?:[ \-]{_LETTER}++)*+\z"


def tidy(raw: Column) -> Column:
    """White space squeezed, a label prefix and outer punctuation removed."""
    s = F.regexp_replace(squeeze(raw), V.LABEL_PREFIX, "")
    return F.when(raw.rlike(_TIDY), raw).otherwise(F.regexp_replace(s, f"^{_MARKS}|{_MARKS}$", ""))


def phrase_ok(s: Column) -> Column:
    """Tidied phrase of fair length that is no interface text, promotion or bare number."""
    bad = (
        s.rlike(V.SKIP_PHRASE) | s.rlike(V.SECTION_JUNK) | s.rlike(V.PROMO)
        | one_of(F.lower(s), V.PHRASE_STOP_WORDS) | s.rlike(r"^[0-9\s+().\-]+$")
    )
    return F.length(s).between(4, 90) & ~bad


def clean_phrase(raw: Column) -> Column:
    s = tidy(raw)
    return F.when(phrase_ok(s), s)


def clean_phrases(raws: Column) -> Column:
    """``clean_phrase`` over an array, rejects dropped; each phrase is tidied once."""
    return F.filter(F.transform(raws, tidy), phrase_ok)


def clean_entity(name: Column) -> Column:
    s = F.regexp_replace(strip(F.coalesce(name, F.lit(""))), r"^,+|,+$", "")
    s = strip(F.regexp_replace(s, "(?s)" + V.FOOTER_STOP, ""))
    s = strip(F.regexp_replace(s, r"(?iu)(политика|инн|оферт).*$", ""))
    return F.substring(s, 1, 120)


def mostly_caps(s: Column) -> Column:
    # runs of anything else are dropped, which makes no value for each letter; four capitals are the fewest that can do
    letters, upper = (F.length(F.regexp_replace(s, rf"\P{{{kind}}}+", "")) for kind in ("L", "Lu"))
    return (upper >= 4) & (letters >= 6) & (upper > letters * 0.65)


def contains_brand(phrase: Column, brand: Column) -> Column:
    """At least half of the words are brand tokens, or contain or lie in one."""
    found = F.regexp_extract_all(F.lower(phrase), F.lit("([a-zа-яё0-9]+)"), F.lit(1))
    return let(found, lambda ws: (F.size(ws) > 0) & (
        F.size(F.filter(ws, lambda w: F.exists(brand, lambda b: F.contains(b, w) | F.contains(w, b))))
        >= F.greatest(F.lit(1), F.floor(F.size(ws) / 2))))


def has_service_sense(phrase: Column) -> Column:
    # two words suffice, so one pattern that stops at the second serves better than a list of all
    word = rf"(?<!{_LETTER})(?!(?:{'|'.join(map(re.escape, V.PHRASE_STOP_WORDS))})(?!{_LETTER})){_LETTER}{{4,}}+"
    return let(F.lower(phrase), lambda low: low.rlike(f"{word}(?s:.*?){word}") | phrase_contains(low, V.SERVICE_HINTS))


def looks_like_query(phrase: Column) -> Column:
    starter = f"^(?:{'|'.join(V.QUERY_STARTERS)})"
    bad_start = rf"^(?:{'|'.join(map(re.escape, V.BAD_QUERY_START))})(?:{_WS}|\z)"

    def judged(low: Column) -> Column:
        # white space stands only between words here: one run is two words, two are three
        return low.rlike(_WS) & ~low.rlike(bad_start) & (
            low.rlike(starter) | (low.rlike(f"{_WS}{_INK}++{_WS}") & has_service_sense(low)))

    return let(strip(F.lower(phrase)), judged)


def section_junk(phrase: Column) -> Column:
    def junk(low: Column) -> Column:
        short = (
            phrase_contains(low, V.SECTION_WORDS) & ~phrase_contains(low, V.SECTION_EXCUSES)
            & (F.size(words(low)) <= 4)
        )
        return low.rlike(V.SECTION_JUNK) | short

    return let(strip(F.lower(phrase)), junk) | ((F.length(phrase) >= 10) & mostly_caps(phrase))


def query_worthy(p: Column, brand: Column) -> Column:
    """Whether a cleaned phrase may serve as a search query."""
    good = let(has_service_sense(p), lambda sense: F.when(~sense & (F.length(p) < 14), False).otherwise(
        ~section_junk(p) & ~((F.length(p) > 18) & mostly_caps(p)) & (sense | ~contains_brand(p, brand))))
    return F.coalesce(good, F.lit(False))


def first_by_lower(phrases: Column, limit: int | None, keep=None) -> Column:
    """First of each phrase regardless of case, in order, at most ``limit`` if there is one.

    ``keep`` is the costly test: it is asked only for new phrases while there is room.
    """
    def step(acc: Column, p: Column) -> Column:
        full = F.exists(acc, lambda a: F.lower(a) == F.lower(p))
        full = full if limit is None else (F.size(acc) >= limit) | full
        stay = F.when(full, acc)
        more = F.concat(acc, F.array(p))
        return stay.otherwise(more) if keep is None else stay.when(keep(p), more).otherwise(acc)

    return F.aggregate(phrases, F.array().cast("array<string>"), step)
