"""Joins of intervals that look at neighbours only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bins(df: DataFrame, lo: Column, hi: Column, width: int, name: str) -> DataFrame:
    rows = df.where(lo < hi)
    return rows.withColumn(name, F.explode(F.sequence(F.floor(lo / width), F.floor((hi - 1) / width))))


def meeting(left: DataFrame, right: DataFrame, keys: list[str], l: tuple[str, str], r: tuple[str, str], width: int) -> DataFrame:  # noqa: E741
    """The pairs of left and right rows of equal keys whose whole-number intervals [lo, hi) meet, each pair once.

    Each row is copied to the bins of `width` that its interval touches, and rows of one bin are held against each
    other; a pair counts in the first bin that both touch. But for the keys, columns have different names. Empty
    intervals meet nothing. `width` should be about as long as the shorter intervals."""
    a, b = (_bins(df, F.col(lo), F.col(hi), width, "_bin") for df, (lo, hi) in ((left, l), (right, r)))
    first = F.floor(F.greatest(F.col(l[0]), F.col(r[0])) / width)
    return a.join(b, [*keys, "_bin"]).where((F.col(l[0]) < F.col(r[1])) & (F.col(r[0]) < F.col(l[1])) & (F.col("_bin") == first)).drop("_bin")
