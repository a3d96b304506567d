"""Event-time aggregates that late records correct: stream slicing with panes.

Events are kept in non-overlapping panes as wide as the distance of window boundaries. A late event changes one
pane; only the windows over that pane are composed again and emitted again. Every event counts at its first
processing; repeated deliveries change nothing.

A window is published `publish_s` after its end and closed `close_s` after it. What is processed before
publication makes the first emission, what comes from then until closing a correction each `every_s` (the step at
which corrections are emitted), what comes at or after closing is too late and only counted as such.

Defined results: events without key, time or processing time are ignored; times before 1970 fall into panes like
any other; an event processed before it happened counts as known at publication; empty input gives no rows;
other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rideloom.common import need

HOUR_S, PUBLISH_S, CLOSE_S = 3600, 300, 6 * 3600


def first_processed(events: DataFrame, *, id_col: str, key: str, event_ts: str, processed_ts: str) -> DataFrame:
    """One row per event: (key, event_us, processed_us). Rows of one id are pre-aggregated before the shuffle."""
    e = need(events, id_col, key, event_ts, processed_ts)
    e = e.select(F.col(id_col).alias("id"), F.col(key).alias("key"), F.unix_micros(F.col(event_ts).cast("timestamp")).alias("event_us"), F.unix_micros(F.col(processed_ts).cast("timestamp")).alias("processed_us")).dropna()
    return e.groupBy("id").agg(F.min(F.struct("processed_us", "event_us", "key")).alias("x")).select("x.key", "x.event_us", "x.processed_us")


def panes(events: DataFrame, pane_s: int = HOUR_S, size_s: int | None = None, publish_s: int = PUBLISH_S, close_s: int = CLOSE_S, every_s: int = HOUR_S) -> DataFrame:
    """(key, pane_start, batch_s, n): events of a pane by the moment their effect can first be emitted.

    batch_s is the end of the emission step since the epoch in which the event came. What a window makes of it
    (first emission, correction, too late) depends on the window, so the pane only keeps when it came; a hot key
    is spread by pane and step and arrives pre-aggregated.
    """
    start = F.floor(F.col("event_us") / F.lit(pane_s * 1_000_000)).cast("long") * pane_s
    p = events.select("key", start.alias("pane_start"), F.col("processed_us"))
    # Steps are aligned to publication moments: pane ends plus publish_s, then every every_s.
    step = F.lit(every_s * 1_000_000)
    batch = F.floor((F.col("processed_us") - F.lit(publish_s * 1_000_000)) / step).cast("long") * every_s + every_s + publish_s
    return p.withColumn("batch_s", batch).groupBy("key", "pane_start", "batch_s").agg(F.count(F.lit(1)).alias("n"))


def emissions(pane_rows: DataFrame, size_s: int = HOUR_S, slide_s: int = HOUR_S, publish_s: int = PUBLISH_S, close_s: int = CLOSE_S, every_s: int = HOUR_S) -> DataFrame:
    """(key, window_start, emitted_s, n, delta, revision) of each emission; too-late counts in rows with revision null.

    size_s and close_s are multiples of slide_s and every_s, slide_s a multiple of the pane width. A pane belongs
    to size_s / slide_s windows, to which its changes are added; nothing else is composed again.
    """
    if size_s % slide_s or close_s < publish_s or slide_s % every_s or (close_s - publish_s) % every_s:
        raise ValueError("size_s must be a multiple of slide_s, and emission steps must fit the slide")
    k = size_s // slide_s
    first = F.floor(F.col("pane_start") / slide_s).cast("long") * slide_s
    w = pane_rows.withColumn("window_start", F.explode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: first - i * slide_s)))
    published, closed = F.col("window_start") + size_s + publish_s, F.col("window_start") + size_s + close_s
    emitted = F.when(F.col("batch_s") - every_s >= closed, F.lit(None).cast("long")).otherwise(F.greatest("batch_s", published))
    w = w.withColumn("emitted_s", F.when(F.col("batch_s") <= published, published).otherwise(emitted))
    w = w.groupBy("key", "window_start", "emitted_s").agg(F.sum("n").alias("delta"))
    order = Window.partitionBy("key", "window_start").orderBy(F.col("emitted_s").asc_nulls_last())
    w = w.withColumn("n", F.sum("delta").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first_there = F.max((F.col("emitted_s") == published).cast("int")).over(Window.partitionBy("key", "window_start"))
    number = F.row_number().over(order) - F.coalesce(first_there, F.lit(0))
    return w.select("key", "window_start", "emitted_s", F.when(F.col("emitted_s").isNotNull(), F.col("n")).alias("n"), "delta", F.when(F.col("emitted_s").isNotNull(), number.cast("int")).alias("revision"))


def driver_hours(processed: DataFrame, size_s: int = HOUR_S, slide_s: int = HOUR_S, publish_s: int = PUBLISH_S, close_s: int = CLOSE_S) -> DataFrame:
    """(driver_id, period_start, n_published, n_corrected, n_too_late, revisions) of each driver's periods.

    Closing falls between steps that are aligned to publication, so emissions use steps of publish_s, which
    divides both offsets; corrections of an hour are therefore up to publish_s old when emitted.
    """
    every = publish_s
    ev = first_processed(processed, id_col="event_id", key="driver_id", event_ts="recorded_at", processed_ts="processed_at")
    em = emissions(panes(ev, slide_s, size_s, publish_s, close_s, every), size_s, slide_s, publish_s, close_s, every)
    return em.groupBy(F.col("key").alias("driver_id"), F.col("window_start").alias("period_start")).agg(
        F.coalesce(F.sum(F.when(F.col("revision") == 0, F.col("delta"))), F.lit(0)).alias("n_published"),
        F.coalesce(F.sum(F.when(F.col("revision").isNotNull(), F.col("delta"))), F.lit(0)).alias("n_corrected"),
        F.coalesce(F.sum(F.when(F.col("revision").isNull(), F.col("delta"))), F.lit(0)).alias("n_too_late"),
        F.count(F.when(F.col("revision") > 0, 1)).alias("revisions"),
    )


def corrected_hours(processed: DataFrame, **options) -> DataFrame:
    """(driver_id, period_start): periods changed after publication and before closing."""
    return driver_hours(processed, **options).where(F.col("revisions") > 0).select("driver_id", "period_start")


def stream_driver_hours(stream: DataFrame, state_dir: str, size_s: int = HOUR_S, slide_s: int = HOUR_S, publish_s: int = PUBLISH_S, close_s: int = CLOSE_S):
    """A streaming query that publishes and corrects drivers' periods; returns the DataStreamWriter.

    Each micro-batch adds its changes of panes under state_dir/panes, then composes again only the windows over the panes it
    changed and writes their emissions of its steps to state_dir/emissions. Both folders are named by the batch and
    overwritten if it is run again, so results are exactly once.

    Of copies within one micro-batch the first one read counts. The clock is processed_at, the server's: a device's clock that runs ahead moves nothing. Copies of an event are dropped
    while a window it can change is open; a copy that comes later than all of that changes no emission, but counts as
    too late once more.
    """
    every = publish_s
    marked = stream.select("event_id", "driver_id", F.col("recorded_at").cast("timestamp").alias("recorded_at"), F.col("processed_at").cast("timestamp").alias("processed_at")).dropna()
    marked = marked.withWatermark("processed_at", f"{size_s + close_s + publish_s} seconds").dropDuplicatesWithinWatermark(["event_id"])

    def keep(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        ev = batch.select(F.col("driver_id").alias("key"), F.unix_micros("recorded_at").alias("event_us"), F.unix_micros("processed_at").alias("processed_us"))
        panes(ev, slide_s, size_s, publish_s, close_s, every).write.mode("overwrite").parquet(f"{state_dir}/panes/batch={batch_id}")
        own = spark.read.parquet(f"{state_dir}/panes/batch={batch_id}")
        span = own.agg(F.min("pane_start"), F.max("pane_start")).first()
        if span[0] is None:
            return
        # Panes that share a window with a changed one; periods of time first, so that old folders are skipped by their statistics.
        reach = size_s - slide_s
        around = read_panes(spark, state_dir, keep_steps=True).where(F.col("pane_start").between(span[0] - reach, span[1] + reach))
        changed = own.select("key", F.explode(F.sequence(F.col("pane_start") - reach, F.col("pane_start") + reach, F.lit(slide_s).cast("long"))).alias("pane_start")).distinct()
        em = emissions(around.join(changed, ["key", "pane_start"], "left_semi"), size_s, slide_s, publish_s, close_s, every)
        steps = emissions(own, size_s, slide_s, publish_s, close_s, every).select("key", "window_start", "emitted_s")
        same = em["emitted_s"].eqNullSafe(steps["emitted_s"]) & (em["key"] == steps["key"]) & (em["window_start"] == steps["window_start"])
        em.join(steps, same, "left_semi").write.mode("overwrite").parquet(f"{state_dir}/emissions/batch={batch_id}")

    return marked.writeStream.foreachBatch(keep)


def read_panes(spark: SparkSession, state_dir: str, keep_steps: bool = False) -> DataFrame:
    """(key, pane_start, batch_s if steps are kept, n) as of now."""
    kept = spark.read.parquet(f"{state_dir}/panes")
    return kept.groupBy("key", "pane_start", *(["batch_s"] if keep_steps else [])).agg(F.sum("n").alias("n"))


def read_emissions(spark: SparkSession, state_dir: str) -> DataFrame:
    """(key, window_start, emitted_s, n, delta, revision): of several versions of an emission the last batch's."""
    e = spark.read.parquet(f"{state_dir}/emissions")
    values = ["n", "delta", "revision"]
    return e.groupBy("key", "window_start", "emitted_s").agg(F.max_by(F.struct(*values), "batch").alias("x")).select("key", "window_start", "emitted_s", *[f"x.{v}" for v in values])


def compacted(spark: SparkSession, state_dir: str, to_dir: str) -> None:
    """The state of a stopped stream in few files, under a new folder; batch numbers go on above the one it gets."""
    last = spark.read.parquet(f"{state_dir}/panes").agg(F.max("batch")).first()[0]
    read_panes(spark, state_dir, keep_steps=True).write.parquet(f"{to_dir}/panes/batch={last}")
    read_emissions(spark, state_dir).write.parquet(f"{to_dir}/emissions/batch={last}")
