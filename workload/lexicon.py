"""A lexicon table against page texts."""
from __future__ import annotations

from pyspark.sql import functions as F

from contactlake.operators.lexicon import best_group, find_terms, term_summary
from workload.common import pages, table

# Words of a turn, by the turn's role; letters as the text has them in lower case.
_LETTERS = "[^a-zà-ÿ]+"
LONG_WORD = 6


def word_lexicon(spark, sf_dir):
    """role, term: every long word of the conversations; some ten thousand on the middle tables."""
    words = F.explode(F.split(F.lower("text"), _LETTERS))
    return table(spark, sf_dir, "conversations").select("role", words.alias("term")).where(
        F.length("term") >= LONG_WORD).distinct()


def _found(spark, sf_dir):
    texts = pages(spark, sf_dir).select("page_id", F.lower("html").alias("text"))
    return find_terms(texts, word_lexicon(spark, sf_dir), ["page_id"])


def q_lexicon(spark, sf_dir):
    return term_summary(_found(spark, sf_dir), ["page_id", "role"]).drop("times")


def q_lexicon_best(spark, sf_dir):
    return best_group(_found(spark, sf_dir), ["page_id"], "role", {"system": 0, "user": 1, "assistant": 2})


QUERIES = {f.__name__: f for f in (q_lexicon, q_lexicon_best)}

_FOUND = f"""WITH lex AS (SELECT DISTINCT role, term FROM (
    SELECT role, unnest(string_split_regex(lower(text), '{_LETTERS}')) AS term FROM conversations) WHERE length(term) >= {LONG_WORD}),
  terms AS (SELECT DISTINCT term FROM lex),
  hit AS (SELECT page_id, term, strpos(lower(html), term) AS place FROM pages JOIN terms ON contains(lower(html), term)),
  found AS (SELECT page_id, role, term, place FROM hit JOIN lex USING (term))"""
SQL = {
    "q_lexicon": f"""{_FOUND}
      SELECT page_id, role, count(*) AS n_terms, sum(1.0::DOUBLE + length(term) / 20.0::DOUBLE) AS score,
        arg_min(term, struct_pack(a := place, b := -length(term))) AS first_term, CAST(min(place) AS INTEGER) AS first_place,
        arg_min(term, struct_pack(a := -length(term), b := term)) AS longest FROM found GROUP BY ALL""",
    "q_lexicon_best": f"""{_FOUND}, s AS (SELECT page_id, role, sum(20 + length(term)) AS score FROM found GROUP BY ALL)
      SELECT page_id, arg_max(role, struct_pack(a := score, b := CASE role WHEN 'system' THEN 0 WHEN 'user' THEN -1 ELSE -2 END)) AS role
      FROM s GROUP BY page_id""",
}
