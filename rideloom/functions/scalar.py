"""Scalar functions: buckets, scaling, hashing to buckets, vectors, formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucketise(v: Column, bounds: Sequence[float], labels: Sequence[str] | None = None) -> Column:
    """Bucket i holds values under bound i and not under the one before; null stays null."""
    names = list(labels) if labels else [f"bucket_{i}" for i in range(len(bounds) + 1)]
    out = F
    for i, b in enumerate(bounds):
        out = out.when(v < b, names[i])
    return F.when(v.isNotNull(), out.otherwise(names[-1]))


def interact(a: Column, b: Column, how: str) -> Column:
    """Two features combined; ratio guards zero with 0, divide raises on it."""
    forms = {"multiply": lambda: a * b, "add": lambda: a + b, "subtract": lambda: a - b, "divide": lambda: a / b, "ratio": lambda: F.coalesce(F.try_divide(a, b), F.lit(0.0))}
    return forms[how]()


def standard(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds <c>_z with the population deviation, 1 for none."""
    s = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"{c}_m"), F.stddev_pop(c).alias(f"{c}_s"))])
    x = df.crossJoin(F.broadcast(s))  # one row
    z = {f"{c}_z": (F.col(c) - F.col(f"{c}_m")) / F.when(F.col(f"{c}_s") == 0, 1.0).otherwise(F.col(f"{c}_s")) for c in columns}
    return x.withColumns(z).drop(*[f"{c}_{k}" for c in columns for k in "ms"])


def min_max(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds <c>_u in 0 .. 1; a range of zero counts as 1."""
    s = df.agg(*[x for c in columns for x in (F.min(c).alias(f"{c}_lo"), F.max(c).alias(f"{c}_hi"))])
    x = df.crossJoin(F.broadcast(s))  # one row
    width = lambda c: F.col(f"{c}_hi") - F.col(f"{c}_lo")
    u = {f"{c}_u": (F.col(c) - F.col(f"{c}_lo")) / F.when(width(c) == 0, 1.0).otherwise(width(c)) for c in columns}
    return x.withColumns(u).drop(*[f"{c}_{k}" for c in columns for k in ("lo", "hi")])


def category_index(df: DataFrame, c: str, order: str) -> DataFrame:
    """(value, index) by first appearance in order."""
    first = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.min(order).alias("_o"))
    return first.select("value", (F.row_number().over(Window.orderBy("_o", "value")) - 1).alias("index"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cut to -1 .. 1; a zero vector is similar to nothing."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.when(n == 0, x.cast("double")).otherwise(x / n))


def fitted(a: Column, size: int) -> Column:
    """Cut or padded with zeros to a size."""
    return F.slice(F.concat(F.transform(a, lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), size)), 1, size)


def md5_bucket(text: Column, buckets: int = 10_000) -> Column:
    """The md5 as a number modulo buckets, from its four 32-bit parts."""
    h = F.md5(text)
    total = F.lit(0).cast("long")
    for i in range(4):
        part = F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long")
        total = total + F.pmod(part, F.lit(buckets)) * (2 ** (32 * (3 - i)) % buckets)
    return F.pmod(total, F.lit(buckets))


def topic_pattern(pattern: str) -> str:
    """A wildcard topic as a regular expression: * is one level, # one or more."""
    import re

    return "^" + r"\.".join({"*": r"[^.]+", "#": r".+"}.get(p, re.escape(p)) for p in pattern.split(".")) + "$"


def trace_parts(header: Column) -> Column:
    """struct(trace_id, span_id, sampled) of a well-formed version 00 header, else null."""
    p = F.split(header, "-")
    ok = (F.size(p) == 4) & (F.length(p[1]) == 32) & (F.length(p[2]) == 16)
    return F.when(ok, F.struct(p[1].alias("trace_id"), p[2].alias("span_id"), (p[3] == "01").alias("sampled")))


def duration_text(seconds: Column) -> Column:
    s = seconds.cast("long")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(h > 0, F.format_string("%dh %dm", h, m)).when(m > 0, F.format_string("%dm %ds", m, s % 60)).otherwise(F.format_string("%ds", s))
