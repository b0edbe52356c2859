"""Monotone calibration of raw scores, and the labelled rows that models are fitted on."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlake.llm.tables import highest

# Bins that raw scores are counted in before the monotone fit; at most so many rows reach the driver.
BINS = 2_000


def remainder(id_col: str, modulus: int):
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % modulus


def labelled(labels: DataFrame, label_col: str, held_out, rows: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """doc_id and label (0, 1) of the rows to learn from; with ``rows`` at most so many, chosen by a hash of the id.

    Null ids or labels are left out; of repeated ids the larger label counts.
    """
    known = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out)
             .groupBy(F.col(id_col).alias("doc_id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("label")))
    return known if rows is None else highest(known, F.pmod(F.xxhash64("doc_id"), F.lit(65_536)).cast("int"), rows)


def isotonic(low: np.ndarray, total: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps that fit the share of ones best: where each starts, and its share."""
    blocks: list[list[float]] = []
    for x, n, k in zip(low.tolist(), total.tolist(), ones.tolist()):
        blocks.append([x, n, k])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            _, n2, k2 = blocks.pop()
            blocks[-1][1] += n2
            blocks[-1][2] += k2
    return np.array([b[0] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


class Calibration:
    """Share of label 1 among rows of a raw score, never falling; straight lines between the steps' middles."""

    def __init__(self, counted: list[tuple[float, int, int]]):
        """``counted``: raw score, rows and rows of label 1, in rising order."""
        if counted:
            x, n, k = (np.array(c, float) for c in zip(*sorted(counted)))
            starts, share = isotonic(x, n, k)
            ends = x[np.r_[np.searchsorted(x, starts[1:]) - 1, len(x) - 1].astype(int)]
            self.x = np.stack([starts, ends], axis=1).ravel()
            self.y = np.repeat(share, 2)
        else:
            self.x, self.y = np.zeros(1), np.full(1, 0.5)

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.x, self.y).clip(0.0, 1.0)


def fit_calibration(scored: DataFrame, low: float, high: float, bins: int = BINS) -> Calibration:
    """Calibration from rows with ``raw`` and ``label``, counted in equal bins of the range."""
    step = (high - low) / bins
    bin_ = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("raw") - low) / step)))
    counted = scored.groupBy(bin_.alias("bin")).agg(F.count("*"), F.sum("label")).collect()
    return Calibration([(low + (b + 0.5) * step, n, k) for b, n, k in counted])
