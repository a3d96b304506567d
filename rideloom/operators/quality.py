"""Rules on data quality, outliers, risk scores and privacy of structured columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rideloom.operators.aggregates import interpolated


def percent(ok: Column, of: Column | None = None) -> Column:
    """Share of rows (of those meant) that pass, in percent; 100 if none are meant."""
    meant = F.lit(True) if of is None else of
    return F.coalesce(F.try_divide(100.0 * F.count_if(meant & F.coalesce(ok, F.lit(False))), F.count_if(meant)), F.lit(100.0))


def complete(c: str) -> Column:
    return percent(F.col(c).isNotNull() & (F.col(c).cast("string") != ""))


def in_range(c: str, lo: float, hi: float) -> Column:
    """A value that is no number fails; null is not judged."""
    return percent(F.expr(f"try_cast(`{c}` AS DOUBLE)").between(lo, hi), F.col(c).isNotNull())


def unique(c: str) -> Column:
    return F.coalesce(F.try_divide(100.0 * F.count_distinct(c), F.count(c)), F.lit(100.0))


def formatted(c: str, pattern: str) -> Column:
    """The pattern is anchored at the start only."""
    return percent(F.col(c).rlike(f"^(?:{pattern})"), F.col(c).isNotNull())


def check_rules(df: DataFrame, rules: Mapping[str, tuple[Column, float]]) -> DataFrame:
    """(rule, score, passed): rule -> (aggregate in percent, least score); one pass over the data."""
    one = df.agg(*[s.alias(n) for n, (s, _) in rules.items()])
    lines = F.array(*[F.struct(F.lit(n).alias("rule"), F.round(F.col(n), 4).alias("score"), (F.col(n) >= least).alias("passed")) for n, (_, least) in rules.items()])
    return one.select(F.explode(lines).alias("x")).select("x.*")


def zscores(df: DataFrame, value: str, threshold: float, group: Sequence[str] = ()) -> DataFrame:
    """Rows beyond the threshold with z and severity (at 1.5 and 2 times it); population deviation."""
    stats = df.groupBy(*group).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    x = df.join(stats, list(group)) if group else df.crossJoin(F.broadcast(stats))  # one row
    z = F.try_divide(F.col(value) - F.col("_m"), F.nullif("_s", F.lit(0.0)))
    x = x.withColumn("z", z).where(F.abs("z") > threshold)
    a = F.abs("z")
    return x.withColumn("severity", F.when(a > 2 * threshold, "high").when(a > 1.5 * threshold, "medium").otherwise("low")).drop("_m", "_s")


def iqr_outliers(df: DataFrame, value: str, k: float = 1.5, group: Sequence[str] = ()) -> DataFrame:
    """Rows outside the fences k interquartile ranges beyond the quartiles; groups under four rows have none."""
    v = F.col(value)
    known = df.where(v.isNotNull())
    stats = interpolated(known, group, value, {"_q1": 0.25, "_q3": 0.75})
    count = known.groupBy(*group).agg(F.count(v).alias("_n"))
    stats = stats.join(count, list(group)) if group else stats.crossJoin(count)  # one row each
    x = df.join(stats, list(group)) if group else df.crossJoin(F.broadcast(stats))  # one row
    iqr = F.col("_q3") - F.col("_q1")
    over = F.greatest(F.col("_q1") - k * iqr - v, v - F.col("_q3") - k * iqr)
    x = x.where((F.col("_n") >= 4) & (over > 0))
    return x.withColumn("severity", F.when(over > 3 * iqr, "high").when(over > iqr, "medium").otherwise("low")).drop("_q1", "_q3", "_n")


def weighted_rules(rules: Mapping[str, tuple[Column, float]]) -> Column:
    """Share of the weights whose rule holds; a rule without a result does not hold."""
    total = sum(w for _, w in rules.values())
    score = F.lit(0.0)
    for c, w in rules.values():
        score = score + F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0)
    return score / total


# ---- isolation forest and local outliers -------------------------------------------------------------------------

SAMPLE, TREES = 256, 60


def _c(n: int) -> float:
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def _tree(x: np.ndarray, rng: np.random.Generator, depth: int, most: int):
    if depth >= most or len(x) <= 1:
        return len(x)
    f = int(rng.integers(x.shape[1]))
    lo, hi = x[:, f].min(), x[:, f].max()
    if lo == hi:
        return len(x)
    cut = rng.uniform(lo, hi)
    left = x[:, f] < cut
    return f, cut, _tree(x[left], rng, depth + 1, most), _tree(x[~left], rng, depth + 1, most)


def _depth(node, x: np.ndarray, at: int = 0) -> np.ndarray:
    if not isinstance(node, tuple):
        return np.full(len(x), at + _c(node))
    f, cut, a, b = node
    out, left = np.empty(len(x)), x[:, f] < cut
    out[left], out[~left] = _depth(a, x[left], at + 1), _depth(b, x[~left], at + 1)
    return out


def isolation_scores(df: DataFrame, features: Sequence[str], trees: int = TREES, sample: int = SAMPLE, seed: int = 5) -> DataFrame:
    """Adds score in (0, 1), near 1 for isolated rows. Trees are grown on the rows with the least seeded hashes
    (a bounded sample: trees x sample rows), every row is scored by Arrow batches."""
    ready = df.dropna(subset=list(features))
    pool = ready.select(*[F.col(f).cast("double").alias(f) for f in features]).orderBy(F.xxhash64(F.lit(seed), *features), *features).limit(trees * sample).toPandas().to_numpy()
    rng = np.random.default_rng(seed)
    n = min(sample, len(pool))
    forest = [_tree(pool[rng.choice(len(pool), n, replace=False)], rng, 0, int(np.ceil(np.log2(max(2, n))))) for _ in range(trees)] if n else []

    @F.pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in cols])
        if not forest:
            return pd.Series(np.zeros(len(x)))
        return pd.Series(2.0 ** (-np.mean([_depth(t, x) for t in forest], axis=0) / max(_c(n), 1e-9)))

    return ready.withColumn("score", score(*[F.col(f).cast("double") for f in features]))


def lof_scores(df: DataFrame, features: Sequence[str], k: int = 5, sample: int = 20_000, seed: int = 5) -> DataFrame:
    """Adds lof: a row's distance to its k-th nearest over the mean of that of its k nearest, features standardised.

    Neighbours are sought among the rows with the least seeded hashes (a bounded sample; up to its size all rows, and
    the result is exact); every row is scored. A row does not count as its own neighbour once. Rows with nulls are left
    out; with k rows or fewer the score is null. Equal points: a ratio of 0 to 0 is 1.
    """
    ready = df.dropna(subset=list(features))
    cols = [F.col(f).cast("double").alias(f) for f in features]
    pool = ready.select(*cols).orderBy(F.xxhash64(F.lit(seed), *features), *features).limit(sample).toPandas().to_numpy(float)
    n = len(pool)
    mean, scale = (pool.mean(0), pool.std(0)) if n else (np.zeros(len(features)), np.ones(len(features)))
    scale[scale == 0] = 1.0
    z = (pool - mean) / scale

    def nearest(x: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray]:
        """Distances to the k-th nearest and the k nearest sampled rows; own: a sampled row at distance 0 is left out once."""
        far, who = np.empty(len(x)), np.empty((len(x), k), int)
        for at in range(0, len(x), 256):
            d = np.sqrt(np.maximum(((x[at : at + 256, None, :] - z[None]) ** 2).sum(2), 0.0))
            order = np.argsort(d, axis=1, kind="stable")[:, : k + 1]
            dist = np.take_along_axis(d, order, 1)
            skip = (own & (dist[:, :1] == 0)).astype(int)
            pick = np.arange(k)[None] + skip
            far[at : at + 256] = np.take_along_axis(dist, pick, 1)[:, -1]
            who[at : at + 256] = np.take_along_axis(order, pick, 1)
        return far, who

    inner = nearest(z, True)[0] if n > k else None

    @F.pandas_udf("double")
    def score(*c: pd.Series) -> pd.Series:
        x = (np.column_stack([s.to_numpy(float) for s in c]) - mean) / scale
        if inner is None:
            return pd.Series([None] * len(x), dtype="float64")
        far, who = nearest(x, True)
        around = inner[who].mean(1)
        return pd.Series(np.where(around > 0, far / np.where(around > 0, around, 1), np.where(far > 0, np.inf, 1.0)))

    return ready.withColumn("lof", score(*[F.col(f).cast("double") for f in features]))


# ---- privacy -----------------------------------------------------------------------------------------------------


def mask(c: Column, how: str) -> Column:
    if how == "redact":
        return F.when(c.isNotNull(), F.lit("[REDACTED]"))
    if how == "last4":
        return F.when(F.length(c) > 4, F.concat(F.repeat(F.lit("*"), F.length(c) - 4), F.right(c, F.lit(4)))).otherwise(F.repeat(F.lit("*"), F.length(c)))
    if how == "hash":
        return F.substring(F.sha2(c, 256), 1, 8)
    raise ValueError(how)
