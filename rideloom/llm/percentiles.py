"""Percentiles of very large columns from cumulative frequencies.

Values are reduced to counts per group and value (partially aggregated before the shuffle, so a group of any
size leaves at most one row per distinct value), range-sorted into bands, summed within bands, shifted by the
totals of the bands before, and the first value that reaches the target rank is picked.

The counts are the mergeable state: counts of days, files or partitions add up to those of the whole, so the
percentiles of a union are computed from the sum of states with the same bound. With no resolution the result
is exact (rank error 0, value error 0); with a resolution values are rounded to multiples of it first, so each
percentile is off by at most half of it, and the state is bounded by the value range over the resolution.

Percentile p of n values is the value of rank ceil(p n), at least 1. Null and NaN values and null groups:
values that are null or NaN are no values; a null group is a group. Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rideloom.common import BANDS, cumulated, value_counts, written


def merge_counts(*states: DataFrame) -> DataFrame:
    """One state from several, whatever their order."""
    whole = states[0]
    for s in states[1:]:
        whole = whole.unionByName(s)
    keys = [c for c in whole.columns if c != "n"]
    return whole.groupBy(*keys).agg(F.sum("n").alias("n"))


def roll_up(state: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The state of coarser groups, e.g. of zones from that of zones and days."""
    return state.groupBy(*groups, "value").agg(F.sum("n").alias("n"))


def percentiles_of(state: DataFrame, groups: Sequence[str], quantiles: Sequence[float], bands: int = BANDS) -> DataFrame:
    """(groups..., n, quantile, percentile) of a state: the first value whose running count reaches the rank.

    The state is read three times (bounds, offsets, running counts), so it is best a stored one.
    """
    s = cumulated(state, groups, bands).withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
    rank = F.greatest(F.lit(1), F.ceil(F.round(F.col("q") * F.col("total"), 6)))
    hit = s.where((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank))
    return hit.select(*groups, F.col("total").alias("n"), F.col("q").alias("quantile"), F.col("value").alias("percentile"))


def percentiles(df: DataFrame, groups: Sequence[str], value: str, quantiles: Sequence[float], resolution: float | None = None) -> DataFrame:
    """The same of rows; their state is written once to the shared folder."""
    return percentiles_of(written(value_counts(df, groups, value, resolution), "counts"), groups, quantiles)
