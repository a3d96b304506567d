"""Ordered and time-series operators on (group, order, value) rows; position never depends on row order."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moving_anomalies(df: DataFrame, group: Sequence[str], order: str, value: str, n: int, threshold: float) -> DataFrame:
    """Rows far from the mean of the n before; with no spread there any other value is far. The first n rows never are."""
    w = Window.partitionBy(*group).orderBy(order)
    before = w.rowsBetween(-n, -1)
    x = df.withColumns({"_m": F.avg(value).over(before), "_s": F.stddev_pop(value).over(before), "_i": F.row_number().over(w)})
    score = F.when(F.col("_s") == 0, F.when(F.col(value) != F.col("_m"), float("inf")).otherwise(0.0)).otherwise(F.abs(F.col(value) - F.col("_m")) / F.nullif("_s", F.lit(0.0)))
    return x.withColumn("score", score).where((F.col("_i") > n) & (F.col("score") > threshold)).drop("_m", "_s", "_i")


def centred_average(df: DataFrame, group: Sequence[str], order: str, value: str, period: int) -> DataFrame:
    """Moving average around each row, null at the edges; an even period is averaged twice."""
    w = Window.partitionBy(*group).orderBy(order)
    h = period // 2
    if period % 2:
        around = w.rowsBetween(-h, h)
        return df.withColumn("trend", F.when(F.count(value).over(around) == period, F.avg(value).over(around)))
    left, whole = w.rowsBetween(-h, h - 1), w.rowsBetween(-h, h)
    x = df.withColumns({"_a": F.avg(value).over(left), "_n": F.count(value).over(whole)})
    x = x.withColumn("_b", F.lead("_a").over(w))
    return x.withColumn("trend", F.when(F.col("_n") == period + 1, (F.col("_a") + F.col("_b")) / 2)).drop("_a", "_b", "_n")


def difference(df: DataFrame, group: Sequence[str], order: str, value: str, times: int = 1) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(order)
    df = df.withColumn("diff", F.col(value))
    for _ in range(times):
        df = df.withColumn("diff", F.col("diff") - F.lag("diff").over(w))
    return df


def undifference(df: DataFrame, group: Sequence[str], order: str, diff: str, first: Column) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("restored", first + F.sum(F.coalesce(F.col(diff), F.lit(0.0))).over(w))


def autocorrelation(df: DataFrame, group: Sequence[str], order: str, value: str, lags: Sequence[int]) -> DataFrame:
    """(group, lag, acf), population form."""
    all_rows = Window.partitionBy(*group)
    w = all_rows.orderBy(order)
    x = df.withColumn("_x", F.col(value) - F.avg(value).over(all_rows))
    x = x.withColumns({f"_l{k}": F.col("_x") * F.lag("_x", k).over(w) for k in lags})
    a = x.groupBy(*group).agg(F.array(*[F.struct(F.lit(k).alias("lag"), (F.sum(f"_l{k}") / F.sum(F.col("_x") * F.col("_x"))).alias("acf")) for k in lags]).alias("a"))
    return a.select(*group, F.explode("a").alias("a")).select(*group, "a.lag", "a.acf")


def page_hinkley(df: DataFrame, group: Sequence[str], order: Sequence[Column], value: str, delta: float) -> DataFrame:
    """Adds ph: how far the running sum of deviations from the running mean is over its lowest point."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = df.withColumn("_x", F.col(value) - F.avg(value).over(w) - delta)
    x = x.withColumn("_c", F.sum("_x").over(w))
    return x.withColumn("ph", F.col("_c") - F.min("_c").over(w)).drop("_x", "_c")


def adwin(df: DataFrame, group: str, order: str, value: str, delta: float) -> DataFrame:
    """(group, order, kept): size of the adaptive window after each value; it drops its older half while the halves differ.

    Sequential by nature: one group is one Python task, so the groups should be pre-aggregated series.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        window, out = [], []
        for r in pdf.sort_values(order).itertuples(index=False):
            window.append(float(getattr(r, value)))
            while len(window) >= 4:
                h = len(window) // 2
                a, b = np.array(window[:h]), np.array(window[h:])
                m = 1 / (1 / len(a) + 1 / len(b))
                var = np.var(window)
                cut = np.sqrt(2 / m * var * np.log(2 / delta)) + 2 / (3 * m) * np.log(2 / delta)
                if abs(a.mean() - b.mean()) <= cut:
                    break
                window = window[h:]
            out.append(len(window))
        s = pdf.sort_values(order)
        return pd.DataFrame({group: s[group].to_numpy(), order: s[order].to_numpy(), "kept": out})

    kinds = dict(df.dtypes)
    return df.groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {order} {kinds[order]}, kept long")


def decompose(df: DataFrame, group: Sequence[str], order: str, value: str, period: int, multiplicative: bool = False) -> DataFrame:
    """Adds trend, seasonal and residual; the seasonal part is centred (sum 0, or mean 1)."""
    w = Window.partitionBy(*group).orderBy(order)
    x = centred_average(df, group, order, value, period).withColumn("_p", (F.row_number().over(w) - 1) % period)
    off = F.try_divide(F.col(value), F.nullif("trend", F.lit(0.0))) if multiplicative else F.col(value) - F.col("trend")
    x = x.withColumn("_d", off)
    s = x.groupBy(*group, "_p").agg(F.avg("_d").alias("_s"))
    whole = Window.partitionBy(*group)
    s = s.withColumn("seasonal", F.col("_s") / F.avg("_s").over(whole) if multiplicative else F.col("_s") - F.avg("_s").over(whole)).drop("_s")
    x = x.join(s, [*group, "_p"])
    left = F.try_divide(F.col(value), F.col("trend") * F.col("seasonal")) if multiplicative else F.col(value) - F.col("trend") - F.col("seasonal")
    return x.withColumn("residual", left).drop("_p", "_d")


def splits(df: DataFrame, order: Sequence[Column], folds: int, test: int, kind: str = "expanding", window: int | None = None) -> DataFrame:
    """(fold, first, last of training and test positions): walk-forward folds over a series of n rows."""
    n = df.agg(F.count(F.lit(1)).alias("n"))
    f = n.select(F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"), "n")
    start = F.col("n") - (folds - F.col("fold")) * test
    first = F.lit(0) if kind == "expanding" else F.greatest(F.lit(0), start - F.lit(window or test))
    return f.where(start > 0).select("fold", first.cast("long").alias("train_first"), (start - 1).cast("long").alias("train_last"), start.cast("long").alias("test_first"), (start + test - 1).cast("long").alias("test_last"))


def yule_walker(df: DataFrame, group: str, order: str, value: str, p: int, steps: int) -> DataFrame:
    """(group, step, forecast) by an autoregression of order p fitted to the autocorrelations of each series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(order)[value].to_numpy(float)
        m = v.mean() if len(v) else 0.0
        x = v - m
        if len(x) <= p or not np.any(x):
            path = [m] * steps
        else:
            r = np.array([np.dot(x[: len(x) - k], x[k:]) / np.dot(x, x) for k in range(p + 1)])
            phi = np.linalg.solve(np.array([[r[abs(i - j)] for j in range(p)] for i in range(p)]) + 1e-12 * np.eye(p), r[1:])
            hist = list(x)
            for _ in range(steps):
                hist.append(float(np.dot(phi, hist[: -p - 1 : -1])))
            path = [h + m for h in hist[-steps:]]
        return pd.DataFrame({group: pdf[group].iloc[0], "step": range(1, steps + 1), "forecast": path})

    return df.groupBy(group).applyInPandas(run, f"{group} {dict(df.dtypes)[group]}, step int, forecast double")
