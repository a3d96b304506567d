"""Structured Streaming: windowed aggregates, sessions, deduplication and idempotent sinks.

Every sink writes one folder per micro-batch, named by the batch id and overwritten when a batch is run again, so a
restart after a failure gives the same table. State is bounded by watermarks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rideloom.session import shared_dir


def staged(df: DataFrame, ts: str, parts: int = 4, close: str | None = None) -> str:
    """A folder of files to stream one at a time: the rows in order of time, cut into parts.

    With close, a last file of one row, null but for the time `close` after all others, moves the watermark past every
    window, so that what is open at the end is closed too.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    at = F.unix_micros(ts)
    bounds = df.agg(F.percentile_approx(at, F.array(*[F.lit(i / parts) for i in range(1, parts)])).alias("b"), F.max(ts).alias("last")).first()
    part = F.size(F.filter(F.array(*[F.lit(x) for x in bounds["b"] or []]), lambda b: b < at)) if parts > 1 and bounds["b"] else F.lit(0)
    for i in range(parts):
        df.where(part == i if i else (part == 0) | F.col(ts).isNull()).coalesce(1).sortWithinPartitions(ts).write.mode("append").parquet(path)
    if close and bounds["last"] is not None:
        end = df.limit(1).select(*[(F.lit(bounds["last"]) + F.expr(f"INTERVAL {close}")).alias(c) if c == ts else F.lit(None).cast(t).alias(c) for c, t in df.dtypes])
        end.coalesce(1).write.mode("append").parquet(path)
    return path


def stream_of_files(spark: SparkSession, path: str, at_once: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, oldest first, so many a micro-batch."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", at_once).parquet(path)


def stream_of(spark: SparkSession, path: str, ts: str | None = None) -> DataFrame:
    """A Parquet table as a stream; event times without a zone become UTC timestamps, as watermarks need them."""
    # As a pattern the path may be one file too, which the file source refuses by name.
    s = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")
    return s.withColumn(ts, F.col(ts).cast("timestamp")) if ts else s


def drain(stream: DataFrame, mode: str, each: Callable[[DataFrame, int, str], None] | None = None) -> str:
    """Runs a stream over what is there now; the folder of its batches."""
    spark = stream.sparkSession
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, batch_id: int) -> None:
        if each:
            each(batch, batch_id, out)
        else:
            batch.write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")

    q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return out


def latest_updates(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    """The last state of each key over all batches of an update stream."""
    x = spark.read.parquet(f"{out}/data")
    w = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return x.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "batch")


def windowed(stream: DataFrame, ts: str, size: str, aggs: Sequence[Column], keys: Sequence[str] = (), slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(window start in seconds, keys..., aggregates...) by event time; later than the watermark is dropped."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    a = stream.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(*aggs)
    return a.select(F.unix_seconds("w.start").alias("start"), *keys, *[c for c in a.columns if c not in ("w", *keys)])


def run_windowed(stream: DataFrame, ts: str, size: str, aggs: Sequence[Column], keys: Sequence[str] = (), slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    out = drain(windowed(stream, ts, size, aggs, keys, slide, late), "update")
    return latest_updates(stream.sparkSession, out, ["start", *keys])


def run_sessions(stream: DataFrame, ts: str, gap: str, key: str, late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n) of sessions: a pause longer than the gap ends one; end is the last event's second.

    A session comes out once, when the watermark has passed its end, and leaves the state then; what is open at the
    end of the stream is not among them (see staged). Rows without a key are left out.
    """
    s = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("last"))
    s = s.select(key, F.unix_seconds("w.start").alias("start"), F.unix_seconds("last").alias("end"), "n")
    out = drain(s, "append")
    return stream.sparkSession.read.schema(s.schema).parquet(f"{out}/data").select(*s.columns).where(F.col(key).isNotNull())


def run_deduplicated(stream: DataFrame, ts: str, key: str, within: str) -> DataFrame:
    """Rows once per key within the watermark; rows without a key always pass."""
    marked = stream.withWatermark(ts, within)
    keyed = marked.where(F.col(key).isNotNull()).dropDuplicatesWithinWatermark([key])
    out = drain(keyed, "append")
    rest = drain(marked.where(F.col(key).isNull()), "append")
    return _read(stream, out).unionByName(_read(stream, rest))


def _read(stream: DataFrame, out: str) -> DataFrame:
    spark = stream.sparkSession
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/data")
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{out}/data").select(*stream.columns)


def run_dual(stream: DataFrame, fact: Callable[[DataFrame], DataFrame]) -> str:
    """Curated rows and the raw archive from the same batch, computed once."""

    def both(batch: DataFrame, batch_id: int, out: str) -> None:
        batch.persist()
        fact(batch).write.mode("overwrite").parquet(f"{out}/fact/batch={batch_id}")
        batch.write.mode("overwrite").option("compression", "gzip").json(f"{out}/raw/batch={batch_id}")
        batch.unpersist()

    return drain(stream, "append", both)


def run_with_dead_letters(stream: DataFrame, body: str, schema: str, needed: str) -> str:
    """Parsed rows to data, unreadable ones as they came to dlq."""

    def split(batch: DataFrame, batch_id: int, out: str) -> None:
        x = batch.withColumn("parsed", F.from_json(body, schema))
        x.where(F.col(f"parsed.{needed}").isNotNull()).write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")
        x.where(F.col(f"parsed.{needed}").isNull()).drop("parsed").write.mode("overwrite").parquet(f"{out}/dlq/batch={batch_id}")

    return drain(stream, "append", split)


def run_incremental_view(stream: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """A view of sums and counts kept by deltas: each batch adds its own states, a read adds them up."""
    def delta(batch: DataFrame, batch_id: int, out: str) -> None:
        batch.groupBy(*keys).agg(F.sum(value).alias("sum"), F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")

    out = drain(stream, "append", delta)
    return stream.sparkSession.read.parquet(f"{out}/data").groupBy(*keys).agg(F.sum("sum").alias("sum"), F.sum("rows").alias("rows"))


def backpressure(arrivals: DataFrame, capacity: int, most_buffer: int) -> DataFrame:
    """(tick, handled, buffered, dropped) of a bounded buffer, tick by tick: a fold over a small series (a row a tick)."""
    s = arrivals.agg(F.sort_array(F.collect_list(F.struct("tick", "n"))).alias("s"))
    start = F.struct(F.lit(0).cast("long").alias("b"), F.array().cast("array<struct<tick:bigint,handled:bigint,buffered:bigint,dropped:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        there = acc["b"] + x["n"]
        handled = F.least(there, F.lit(capacity).cast("long"))
        kept = F.least(there - handled, F.lit(most_buffer).cast("long"))
        row = F.struct(x["tick"].cast("long").alias("tick"), handled.alias("handled"), kept.alias("buffered"), (there - handled - kept).alias("dropped"))
        return F.struct(kept.alias("b"), F.concat(acc["out"], F.array(row)).alias("out"))

    return s.select(F.explode(F.aggregate("s", start, step)["out"]).alias("x")).select("x.*")
