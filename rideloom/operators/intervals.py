"""Merging of overlapping intervals and listing of gaps, with an ordered disjoint-interval map per entity.

Each insertion finds the overlapped intervals by binary search, merges them and adjusts the gaps. The map is
keyed state: rows of an entity arrive in any order and only the disjoint intervals are held, not the rows.
An entity that holds a large part of all rows is split into slices of start time: a first, pre-aggregated pass
carries the furthest end of earlier slices into each slice, so slices are worked on by independent tasks.

Defined results: intervals are half open; an interval whose end is not after its start covers nothing; a null
start or entity covers nothing; a null end is no end; touching intervals leave no gap; repeated rows change
nothing; empty input gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rideloom.common import mark_hot, need

FOREVER = 2**62
SLICE_S = 30 * 86_400


class IntervalMap:
    """Disjoint half-open intervals in order, none touching another."""

    __slots__ = ("ends", "starts")

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def insert(self, start: int, end: int) -> None:
        if end <= start:
            return
        lo = bisect_left(self.ends, start)  # the first that ends at or after start: touching ones merge
        hi = bisect_right(self.starts, end)  # after the last that starts at or before end
        if lo < hi:
            start, end = min(start, self.starts[lo]), max(end, self.ends[hi - 1])
        self.starts[lo:hi] = [start]
        self.ends[lo:hi] = [end]

    def periods(self) -> Iterator[tuple[int, int]]:
        return zip(self.starts, self.ends)

    def gaps(self) -> Iterator[tuple[int, int]]:
        return zip(self.ends[:-1], self.starts[1:])


def _fold(batches: Iterator[pa.RecordBatch], slice_s: int) -> Iterator[pa.RecordBatch]:
    """Rows grouped by (entity, slice) to the periods of each; state of one group at a time."""
    out_schema = pa.schema([("entity", pa.string()), ("slice", pa.int64()), ("period_start", pa.int64()), ("period_end", pa.int64()), ("carried", pa.bool_())])
    now, state, carry = None, IntervalMap(), None
    rows: list[tuple] = []

    def close() -> None:
        for s, e in state.periods():
            rows.append((now[0], now[1], s, e, carry is not None and s < carry))

    def flush() -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[]] * 5
        rows_batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, out_schema.types)], schema=out_schema)
        rows.clear()
        return rows_batch

    for b in batches:
        for entity, piece, start, end, before in zip(*[b.column(i).to_pylist() for i in range(5)]):
            if (entity, piece) != now:
                if now is not None:
                    close()
                now, state, carry = (entity, piece), IntervalMap(), before
                if before is not None:  # earlier slices cover from this slice's start, or from before it, up to here
                    state.insert(min(before - 1, piece * slice_s), before)
            state.insert(start, end)
            if len(rows) >= 50_000:
                yield flush()
        if rows:
            yield flush()
    if now is not None:
        close()
    if rows:
        yield flush()


def merged_periods(df: DataFrame, *, entity: str, start: str, ends: list[str], slice_s: int = SLICE_S, hot_part: float | None = None, hot_least: int | None = None) -> DataFrame:
    """(entity, slice, period_start, period_end, carried): disjoint periods in seconds.

    carried marks the period that continues one of an earlier slice (only for split entities); its true start is
    the end of that coverage. The end of an interval is the earliest of its non-null ends, FOREVER without any.
    """
    sec = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000).cast("long")
    d = need(df, entity, start, *ends)
    end = F.least(*[sec(e) for e in ends]) if len(ends) > 1 else sec(ends[0])
    d = d.select(F.col(entity).cast("string").alias("entity"), sec(start).alias("s"), F.coalesce(end, F.lit(FOREVER)).alias("e"))
    d = d.where(F.col("entity").isNotNull() & F.col("s").isNotNull() & (F.col("e") > F.col("s")))
    limits = {k: v for k, v in (("part", hot_part), ("least", hot_least)) if v is not None}
    d, hot = mark_hot(d, "entity", "hot", **limits)
    d = d.withColumn("slice", F.when(F.col("hot"), F.floor(F.col("s") / slice_s).cast("long")).otherwise(F.lit(0).cast("long")))
    if hot:
        ends_by = d.where("hot").groupBy("entity", "slice").agg(F.max("e").alias("last"))
        before = Window.partitionBy("entity").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        ends_by = ends_by.select("entity", "slice", F.max("last").over(before).alias("before"))
        d = d.join(ends_by, ["entity", "slice"], "left")
    else:
        d = d.withColumn("before", F.lit(None).cast("long"))
    d = d.select("entity", "slice", "s", "e", "before").repartition("entity", "slice").sortWithinPartitions("entity", "slice")
    return d.mapInArrow(lambda batches: _fold(batches, slice_s), "entity string, slice long, period_start long, period_end long, carried boolean")


def gaps(periods: DataFrame) -> DataFrame:
    """(entity, gap_start, gap_end): spans between an entity's first and last covered moment that nothing covers."""
    after = Window.partitionBy("entity", "slice").orderBy("period_start")
    p = periods.withColumn("next", F.lead("period_start").over(after)).where(F.col("next").isNotNull())
    return p.select("entity", F.col("period_end").alias("gap_start"), F.col("next").alias("gap_end"))


def periods_of(periods: DataFrame) -> DataFrame:
    """(entity, period_start, period_end) with slices joined; no end is null."""
    order = Window.partitionBy("entity").orderBy("slice", "period_start")
    p = periods.withColumn("no", F.sum((~F.col("carried")).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    p = p.groupBy("entity", "no").agg(F.min(F.when(~F.col("carried"), F.col("period_start"))).alias("period_start"), F.max("period_end").alias("period_end"))
    return p.select("entity", "period_start", F.when(F.col("period_end") < FOREVER, F.col("period_end")).alias("period_end"))


def subscription_periods(subscriptions: DataFrame, **options) -> DataFrame:
    return merged_periods(subscriptions, entity="user_id", start="started_at", ends=["expires_at", "cancelled_at"], **options)
