"""Which needle occurs in which text first, without comparing every text with every needle.

All needles stand in one automaton (``lexicon``); each text goes through it once, in place.
Only pairs of a needle and a text's key leave that pass, and they are reduced to the first key
of each needle before they are shuffled, so no text moves and a common needle is no hot key.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlake.operators.lexicon import LIMIT_BYTES, find_terms


def first_containing(texts: DataFrame, needles: DataFrame, by: list[str], key: str,
                     text: str = "text", needle: str = "needle", limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """Smallest ``key`` of the texts that contain each needle, within equal ``by`` columns.

    Returns ``by``, ``needle``, ``key``; needles that occur nowhere are absent.
    """
    found = find_terms(texts, needles.select(*by, needle), [*by, key], tuple(by), text, needle, limit_bytes)
    return found.groupBy(*by, needle).agg(F.min(key).alias(key))
