"""Words of whole sites: exact counts over all pages of a site, however many it has."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactlake import fixed_values as V
from contactlake.functions.lists import one_of

_WORD = r"([а-яёa-z][а-яёa-z\-]{3,})"


def site_words(pages: DataFrame, text: Column, *order: str, site: str = "site", stop=V.KEYWORD_STOP_WORDS) -> DataFrame:
    """site, word, n, at: how often a word of five letters and more stands on the pages of a site, and where first.

    Words are counted in each map task before the shuffle, which deals (site, word): a site with a third of
    all pages is spread over its words, and no task holds the pages of a site.  ``order`` columns tell which
    page comes first.  Pages without a site or a text have no words.
    """
    found = F.filter(F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(1)),
                     lambda w: (F.length(w) >= 5) & ~one_of(w, stop))
    each = pages.where(F.col(site).isNotNull()).select(F.col(site).alias("site"), *order, F.posexplode_outer(found).alias("pos", "word"))
    return each.where(F.col("word").isNotNull()).groupBy("site", "word").agg(
        F.count("*").alias("n"), F.min(F.struct(*order, "pos")).alias("at"))


def site_keywords(words: DataFrame, limit: int = 12) -> DataFrame:
    """site, word, n, rank: the most frequent words of each site; then the longer, then the earlier one.

    The counts are exact, so no candidate is lost to an estimate.  The rank ends in a group limit, which
    leaves at most ``limit`` words of a site in each task before they are shuffled by site.
    """
    order = Window.partitionBy("site").orderBy(F.desc("n"), F.desc(F.length("word")), "at")
    ranked = words.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return ranked.select("site", "word", "n", "rank")
