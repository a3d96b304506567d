"""Distribution drift, tests and scores. Approximations of erfc are polynomial, since Spark SQL has none."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rideloom.common import BANDS


def normal_cdf(z: Column) -> Column:
    """Abramowitz and Stegun 26.2.17, error below 1e-7. Its coefficients."""
    k = 1 / (1 + 0.2316419 * F.abs(z))
    poly = k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def two_sided(z: Column) -> Column:
    return 2 * (1 - normal_cdf(F.abs(z)))


def ks(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """(ks, n_a, n_b, p): largest distance of the two empirical distributions at distinct values.

    Counts by value are range-summed in bands as in the percentile operator, so no task sees all values.
    """
    u = a.select(F.col(value).cast("double").alias("v"), F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(F.col(value).cast("double").alias("v"), F.lit(0).alias("x"), F.lit(1).alias("y")))
    g = u.where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("v").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    bounds = g.agg(F.percentile_approx("v", F.array(*[F.lit(i / BANDS) for i in range(1, BANDS)]), F.lit(1000)).alias("b"))
    g = g.crossJoin(F.broadcast(bounds)).withColumn("band", F.size(F.filter("b", lambda x: x < F.col("v")))).drop("b")  # one row
    totals = g.groupBy("band").agg(F.sum("x").alias("bx"), F.sum("y").alias("by"))  # at most as many rows as bands
    w = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    totals = totals.select("band", F.coalesce(F.sum("bx").over(w), F.lit(0)).alias("ox"), F.coalesce(F.sum("by").over(w), F.lit(0)).alias("oy"), F.sum("bx").over(every).alias("n_a"), F.sum("by").over(every).alias("n_b"))
    r = Window.partitionBy("band").orderBy("v")
    g = g.join(F.broadcast(totals), "band")
    gap = F.abs((F.col("ox") + F.sum("x").over(r)) / F.col("n_a") - (F.col("oy") + F.sum("y").over(r)) / F.col("n_b"))
    d = g.withColumn("gap", gap).agg(F.max("gap").alias("ks"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"))
    lam = F.sqrt(F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b"))) * F.col("ks")
    return d.withColumn("p", F.least(F.lit(1.0), 2 * F.exp(-2 * lam * lam)))


def holm(df: DataFrame, key: str, p: str, alpha: float) -> DataFrame:
    """(key, rejected, bonferroni) of a family of tests (a row a test)."""
    order = Window.orderBy(p, key)
    m = df.agg(F.count(F.lit(1)).alias("m"))
    x = df.crossJoin(F.broadcast(m)).withColumn("i", F.row_number().over(order))  # one row
    ok = (F.col(p) <= alpha / (F.col("m") - F.col("i") + 1)).cast("int")
    return x.select(key, (F.min(ok).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1).alias("rejected"), (F.col(p) <= alpha / F.col("m")).alias("bonferroni"))


def shares(df: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """(bin, share): part of the values in each bin between edges; first and last are open."""
    inner = F.array(*[F.lit(float(e)) for e in edges])
    b = F.size(F.filter(inner, lambda e: e <= F.col(value)))
    n = df.where(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    bins = df.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("bin"))
    return bins.join(F.broadcast(n), "bin", "left").crossJoin(F.broadcast(total)).select("bin", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("share"))


def psi(p: Column, q: Column, eps: float = 1e-6, floor: bool = False) -> Column:
    """One bin's part of the population stability index; eps is added, or a floor."""
    a, b = (F.greatest(p, F.lit(eps)), F.greatest(q, F.lit(eps))) if floor else (p + eps, q + eps)
    return (b - a) * F.ln(b / a)


def jensen_shannon(p: Column, q: Column) -> Column:
    m = (p + q) / 2
    part = lambda a: F.when(a > 0, a * F.ln(a / m)).otherwise(0.0)
    return (part(p) + part(q)) / 2


def against(reference: DataFrame, current: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """(bin, p, q) of both over the same bins."""
    return shares(reference, value, edges).withColumnRenamed("share", "p").join(shares(current, value, edges).withColumnRenamed("share", "q"), "bin")
