"""Mergeable quantiles: one sketch a group, kept in a table and merged for any range.

A KLL sketch of size k answers a quantile with a value whose rank is off by at most
about ``rank_error(k)`` of the rows, whatever their number; up to k values it is
exact. Sketches of months are merged, not recomputed, for a quarter, a year or all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a sketch: a few kilobytes each.
SIZE = 400


def rank_error(size: int = SIZE) -> float:
    """The share of rows by which a quantile's rank is off, with 99 % confidence: the fit that the sketch's authors publish."""
    return 2.446 / size**0.9433


def sketched(rows: DataFrame, keys: list[str], value: str, size: int = SIZE) -> DataFrame:
    """(keys, sketch, n): one sketch of the values of each group; nulls and NaN do not count.

    Tasks sketch what they read and only sketches are shuffled.
    """
    held = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return held.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(size)).alias("sketch"), F.count(F.lit(1)).alias("n"))


def merged(sketches: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    """Sketches of coarser groups from those of finer ones."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"), F.sum("n").alias("n"))


def quantiles(shares: list[float], sketch: str = "sketch") -> Column:
    """The smallest values that at least the shares of rows do not exceed, an array."""
    return F.kll_sketch_get_quantile_double(sketch, F.array(*map(F.lit, shares)))


def rank_of(value: Column, sketch: str = "sketch") -> Column:
    """The share of rows that do not exceed the value."""
    return F.kll_sketch_get_rank_double(sketch, value)
