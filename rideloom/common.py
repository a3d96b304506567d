"""Helpers every operator may use: table reading, hot keys, materialised steps."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rideloom.session import shared_dir

#: A key is hot if it holds more than this part of all rows, or more than HOT_MOST rows whatever the total.
HOT_PART = 1 / 256
#: Below this many rows a key is never worth splitting; from HOT_MOST on it always is.
HOT_ROWS, HOT_MOST = 100_000, 4_000_000
#: Hot keys up to this number are a list of literals; more go to every executor as a table, more still are joined by a shuffle.
MOST_LISTED, MOST_SHIPPED = 512, 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def need(df: DataFrame, *columns: str) -> DataFrame:
    """Just the named columns. Extra columns of the input, clashing names included, can then do no harm."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*columns)


def mark_hot(df: DataFrame, key: str, mark: str, part: float = HOT_PART, least: int = HOT_ROWS, most: int = HOT_MOST) -> tuple[DataFrame, bool]:
    """The rows with a column that tells whether their key is hot, and whether any is.

    Hot is a key with more than `part` of all rows and more than `least`, or with more than `most`. Counts are partially
    aggregated before the shuffle; at most MOST_LISTED + 1 of them reach the driver.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col(key).isNotNull() & (F.col("n") > least))
    top = counts.orderBy(F.desc("n"), key).limit(MOST_LISTED + 1).collect()
    bound = min(df.count() * part, most) if top else most
    few = [r[0] for r in top if r["n"] > bound]
    if len(few) <= MOST_LISTED:
        return df.withColumn(mark, F.coalesce(is_any(F.col(key), few), F.lit(False))), bool(few)
    hot = written(counts.where(F.col("n") > bound).select(F.col(key).alias("_hot_key")), "hot")
    hot = F.broadcast(hot) if hot.count() <= MOST_SHIPPED else hot
    return df.join(hot, df[key] == F.col("_hot_key"), "left").withColumn(mark, F.col("_hot_key").isNotNull()).drop("_hot_key"), True


def tasks_for(df: DataFrame, rows_a_task: int = 100_000, most: int = 20_000) -> int:
    """Tasks for work that costs much a row: partitions of equal bytes would be too few. Not fewer than the session's."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(most, -(-df.count() // rows_a_task)))


def is_any(column: Column, values: Sequence[str]) -> Column:
    return column.isin(*values) if values else F.lit(False)


def time_slice(ts: Column, hours: int) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(hours * 3_600_000_000)).cast("long")


def epoch(ts: Column) -> Column:
    """Whole seconds since 1970, rounded down (unix_timestamp truncates a negative time towards zero)."""
    return F.floor(F.unix_micros(ts) / 1_000_000).cast("long")


def as_timestamp(df: DataFrame, *columns: str) -> DataFrame:
    """Columns without a time zone are read as UTC."""
    kinds = dict(df.dtypes)
    for c in columns:
        if kinds[c] != "timestamp":
            df = df.withColumn(c, F.col(c).cast("timestamp"))
    return df


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rideloom-{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bands of values over which the running sums of a group are spread.
BANDS = 64


def value_counts(df: DataFrame, groups: Sequence[str], value: str, resolution: float | None = None) -> DataFrame:
    """(groups..., value, n): null and NaN are no values; counts of parts can be added up. Partially aggregated before the shuffle."""
    v = F.col(value).cast("double")
    d = need(df, *groups, value).where(v.isNotNull() & ~F.isnan(v))
    if resolution is not None:
        v = F.round(v / F.lit(resolution)) * F.lit(resolution)
    return d.select(*groups, (v + F.lit(0.0)).alias("value")).groupBy(*groups, "value").agg(F.count(F.lit(1)).alias("n"))


def cumulated(counts: DataFrame, groups: Sequence[str], bands: int = BANDS) -> DataFrame:
    """(groups..., value, n, upto, total) of value_counts: upto counts the values of the group up to this one.

    The range sort is by bands of values whose bounds come from one small sketch of the distinct values; the
    running sum of a group is then spread over as many tasks as there are bands, whatever the group's size.
    """
    groups = list(groups)
    bounds = counts.agg(F.percentile_approx("value", F.array(*[F.lit(i / bands) for i in range(1, bands)]), F.lit(10_000)).alias("b"))
    s = counts.crossJoin(F.broadcast(bounds))  # one row
    # The band is the number of bounds below the value: the same for equal values, and growing with them.
    s = s.withColumn("band", F.size(F.filter("b", lambda x: x < F.col("value")))).drop("b")
    totals = s.groupBy(*groups, "band").agg(F.sum("n").alias("band_n"))
    by_group = Window.partitionBy(*groups)
    totals = totals.withColumn("offset", F.sum("band_n").over(by_group.orderBy("band")) - F.col("band_n")).withColumn("total", F.sum("band_n").over(by_group)).drop("band_n")
    on = F.col("s.band") == F.col("t.band")
    for g in groups:
        on = on & F.col(f"s.{g}").eqNullSafe(F.col(f"t.{g}"))
    s = s.alias("s").join(totals.alias("t"), on).select(*[F.col(f"s.{g}") for g in groups], "s.band", "s.value", "s.n", "t.offset", "t.total")
    running = F.sum("n").over(Window.partitionBy(*groups, "band").orderBy("value"))
    return s.select(*groups, "value", "n", (F.col("offset") + running).alias("upto"), "total")


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
