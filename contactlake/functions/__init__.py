"""Column functions: URL, phone, text, list and label expressions (no UDFs)."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with the value computed once.

    For values used several times inside lambdas, where the optimizer does not share
    repeated parts.
    """
    return F.get(F.transform(F.array(value), fn), F.lit(0))
