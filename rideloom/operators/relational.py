"""Filters, projections, sorts and set operations with the semantics of the query surface.

Equality with null is unknown and filters the row out; sorts carry a full key so that results are deterministic.
"""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of comparisons as they appear in predicates.
COMPARE = {"eq": operator.eq, "ne": operator.ne, "gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}


def conjunction(conditions: Sequence[Column]) -> Column:
    return reduce(operator.and_, conditions, F.lit(True))


def where_equal(df: DataFrame, conditions: Mapping[str, object]) -> DataFrame:
    """Rows equal to all given values; a column the table lacks counts as null, so nothing matches it."""
    missing = [c for c in conditions if c not in df.columns and conditions[c] is not None]
    if missing:
        return df.limit(0)
    return df.where(conjunction([F.col(c).isNull() if v is None else F.col(c) == F.lit(v) for c, v in conditions.items() if c in df.columns]))


def where_in(df: DataFrame, conditions: Mapping[str, object]) -> DataFrame:
    """A two-tuple is an inclusive range, anything else an equal value."""
    return df.where(conjunction([F.col(c).between(*v) if isinstance(v, tuple) else F.col(c) == F.lit(v) for c, v in conditions.items()]))


def where_compare(df: DataFrame, predicates: Sequence[tuple[str, str, object]]) -> DataFrame:
    return df.where(conjunction([COMPARE[op](F.col(c), F.lit(v)) for c, op, v in predicates]))


def project(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Columns of the given types; absent ones come back null."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])


def in_days(df: DataFrame, column: str, first: str, last: str) -> DataFrame:
    """From the first day's start to the last day's end."""
    return df.where((F.col(column) >= F.to_timestamp(F.lit(first))) & (F.col(column) < F.to_timestamp(F.lit(last)) + F.expr("interval 1 day")))


def search(df: DataFrame, text_columns: Sequence[str], wanted: str) -> DataFrame:
    """Case-insensitive substring in any of the columns."""
    return df.where(reduce(operator.or_, [F.contains(F.lower(F.col(c)), F.lit(wanted.lower())) for c in text_columns]))


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """A page with the total before paging; the order must be total."""
    return df.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("total")))).orderBy(*order).offset(offset).limit(limit)


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def ranked(df: DataFrame, order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of the whole table with their rank; only k rows reach the one task that numbers them."""
    return df.orderBy(*order).limit(k).withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, as sets of values: nulls are equal, repeated rows stay."""
    on = lambda a, b: conjunction([a[c].eqNullSafe(b[c]) for c in old.columns])
    added = new.join(old, on(new, old), "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(old.join(new, on(old, new), "left_anti").withColumn("change", F.lit("removed")))


def fingerprint(columns: Sequence[str]) -> Column:
    """A hash of the row's content; types count, null is its own value."""
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]))


def first_by_content(df: DataFrame, content: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each content, the first in order."""
    w = Window.partitionBy("_content").orderBy(*order)
    return df.withColumn("_content", fingerprint(content)).withColumn("_no", F.row_number().over(w)).where(F.col("_no") == 1).drop("_content", "_no")


def schema_change(old: T.StructType, new: T.StructType) -> dict[str, list[str]]:
    a, b = {f.name: f for f in old}, {f.name: f for f in new}
    return {"added": sorted(b.keys() - a.keys()), "removed": sorted(a.keys() - b.keys()), "changed": sorted(c for c in a.keys() & b.keys() if a[c].dataType != b[c].dataType)}


#: Type changes that keep every value readable.
WIDER = {("int", "bigint"), ("int", "double"), ("int", "string"), ("bigint", "double"), ("bigint", "string"), ("float", "double"), ("float", "string"), ("double", "string"), ("boolean", "string"), ("boolean", "int"), ("boolean", "bigint")}


def forward_compatible(old: T.StructType, new: T.StructType) -> list[str]:
    """Reasons why data of the new schema can't be read with the old one."""
    return backward_compatible(new, old, removed_ok=True)


def fully_compatible(old: T.StructType, new: T.StructType) -> list[str]:
    return [f"backward: {x}" for x in backward_compatible(old, new)] + [f"forward: {x}" for x in forward_compatible(old, new)]


def backward_compatible(old: T.StructType, new: T.StructType, removed_ok: bool = False) -> list[str]:
    """Reasons why data of the old schema can't be read with the new one; none: compatible."""
    a, b = {f.name: f for f in old}, {f.name: f for f in new}
    found = [] if removed_ok else [f"{c} removed" for c in a if c not in b]
    found += [f"{c} {a[c].dataType.simpleString()} to {b[c].dataType.simpleString()}" for c in a if c in b and a[c].dataType != b[c].dataType and (a[c].dataType.simpleString(), b[c].dataType.simpleString()) not in WIDER]
    return found + [f"{c} required" for c in b if c not in a and not b[c].nullable]
