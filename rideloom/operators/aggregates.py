"""Aggregates: metric summaries, mergeable states, percentiles by rank, histograms, profiles.

Partial states (sum, count, max) are kept instead of averages, so results of parts can be added up.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rideloom.common import cumulated, value_counts

FUNCS = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}


def measure(df: DataFrame, group: Sequence[str], metric: str, func: str) -> DataFrame:
    """One measure by group, rounded to 4; metric * counts rows."""
    if func not in FUNCS or metric != "*" and metric not in df.columns:
        raise ValueError(f"no measure {func}({metric})")
    value = F.count(F.lit(1)) if metric == "*" else FUNCS[func](F.col(metric))
    return df.groupBy(*group).agg((value if func == "count" else F.round(value, 4)).alias("value"))


def gold(df: DataFrame, group: Sequence[str], metrics: Mapping[str, tuple[str, str]]) -> DataFrame:
    """name -> (column, func); nulls are skipped, a group without values has 0.0; adds record_count."""
    aggs = [F.coalesce(FUNCS[f](F.col(c)).cast("double"), F.lit(0.0)).alias(n) for n, (c, f) in metrics.items()]
    return df.groupBy(*group).agg(*aggs, F.count(F.lit(1)).alias("record_count"))


def states(df: DataFrame, group: Sequence[str], metric: str) -> DataFrame:
    """Mergeable states of a metric by group; rows counts null metrics too."""
    return df.groupBy(*group).agg(F.sum(metric).alias("sum"), F.count(metric).alias("count"), F.min(metric).alias("min"), F.max(metric).alias("max"), F.count(F.lit(1)).alias("rows"))


def merged_states(*parts: DataFrame) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    group = [c for c in whole.columns if c not in ("sum", "count", "min", "max", "rows")]
    return whole.groupBy(*group).agg(F.sum("sum").alias("sum"), F.sum("count").alias("count"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("rows").alias("rows"))


def ranked_value(df: DataFrame, group: Sequence[str], value: str, p: float) -> DataFrame:
    """The value at sorted index int(n p), from counts by value: no group is sorted as rows."""
    s = cumulated(value_counts(df, group, value), group)
    at = F.least(F.floor(F.col("total") * p), F.col("total") - 1)
    return s.where((F.col("upto") > at) & (F.col("upto") - F.col("n") <= at)).select(*group, "value")


def interpolated(df: DataFrame, group: Sequence[str], value: str, quantiles: Mapping[str, float]) -> DataFrame:
    """(group..., name...): exact percentiles, linear between ranks, from counts by value: no buffer holds a group's values.

    Null and NaN are no values; a group without values has no row.
    """
    s = cumulated(value_counts(df, group, value), group)
    aggs, picks = [], []
    for name, q in quantiles.items():
        at = F.lit(float(q)) * (F.col("total") - 1)
        for part, rank in (("lo", F.floor(at) + 1), ("hi", F.ceil(at) + 1)):
            aggs.append(F.max(F.when((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank), F.col("value"))).alias(f"{name}_{part}"))
        picks.append((F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * (at - F.floor(at))).alias(name))
    return s.groupBy(*group).agg(*aggs, F.max("total").alias("total")).select(*group, *picks)


def equal_width(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, lo, hi, n): equal-width bins, the top edge in the last, empty bins listed."""
    edges = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    x = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(edges))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    counts = x.groupBy(F.when(width == 0, 0).otherwise(F.least(F.floor((F.col(value) - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    all_bins = edges.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", "hi")
    return all_bins.join(counts, "bin", "left").select("bin", F.round(F.col("lo") + F.col("bin") * width, 4).alias("lo"), F.round(F.col("lo") + (F.col("bin") + 1) * width, 4).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A line a numeric column: rows, nulls, min, max, mean, population deviation in one pass, the median from counts by value."""
    aggs = []
    for c in columns:
        v = F.col(c).cast("double")
        aggs.append(F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"), F.count_if(v.isNull()).alias("nulls"), F.min(v).alias("min"), F.max(v).alias("max"), F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_pop(v), 4).alias("std")).alias(c))
    lines = df.agg(*aggs).select(F.explode(F.array(*columns)).alias("x")).select("x.*")  # as many rows as columns
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    medians = interpolated(long, ["column"], "v", {"median": 0.5}).withColumn("median", F.round("median", 4))
    return lines.join(F.broadcast(medians), "column", "left")


def apdex(latency: Column, satisfied: float) -> Column:
    """Satisfied below the threshold, tolerating below four times it; no calls count as 1."""
    ok, meh = F.count_if(latency < satisfied), F.count_if((latency >= satisfied) & (latency < 4 * satisfied))
    return F.coalesce(F.try_divide(ok + 0.5 * meh, F.count(latency)), F.lit(1.0))


def skewness(v: Column) -> Column:
    return F.skewness(v)
