"""Sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rideloom.common import table as t
from rideloom.plans.book import Book
from rideloom.sources import files as S
from rideloom.streaming import windows as X

book = Book()
q = book.query


def n_rows():
    return F.count(F.lit(1))


def _stream(spark, d):
    return X.stream_of(spark, f"{d}/events.parquet", "ts")


def _batches(spark, d):
    return X.stream_of_files(spark, X.staged(t(spark, d, "events"), "ts"))


@q("src02", "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def _(spark, d):
    path = S.new_path(spark, "checked")
    S.write_checked(t(spark, d, "customer"), {"c_custkey": "bigint", "c_acctbal": "double", "c_mktsegment": "string"}, path, ["c_mktsegment"], 5000)
    return spark.read.parquet(path).groupBy("c_mktsegment").agg(n_rows().alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@q("src05", "SELECT zone_id, zone_name, borough FROM dim_zones")
def _(spark, d):
    path = S.export(t(spark, d, "dim_zones"), "csv", S.new_path(spark, "zones"))
    return S.load(spark, "csv", path, t(spark, d, "dim_zones").schema).select("zone_id", "zone_name", "borough")


@q("src05_months", "SELECT CASE WHEN event_type = 'view' THEN 'green' ELSE 'yellow' END AS kind, strftime(ts, '%Y-%m') AS month, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(spark, d):
    """A file a kind and month, read again by a pattern over all of them."""
    e, path = t(spark, d, "events"), S.new_path(spark, "months")
    for kind, which in (("green", F.col("event_type") == "view"), ("yellow", F.col("event_type") != "view")):
        S.write_months(e.where(which), "ts", kind, path)
    return S.read_months(spark, path).groupBy("kind", "month").agg(n_rows().alias("n"), F.round(F.sum("value"), 4).alias("total"))


@q("src06", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(spark, d):
    n = t(spark, d, "nation")
    return S.load(spark, "json", S.export(n, "json", S.new_path(spark, "json")), n.schema)


@q("src08", "SELECT year(ts) AS year, month(ts) AS month, day(ts) AS day, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    path = S.new_path(spark, "archive")
    S.archive(t(spark, d, "events"), "ts", path)
    return spark.read.json(path).groupBy("year", "month", "day").agg(n_rows().alias("n"))


@q("src09", "SELECT 'fact' AS kind, count(*) AS n FROM events WHERE event_type = 'purchase' UNION ALL SELECT 'raw', count(*) FROM events")
def _(spark, d):
    out = X.run_dual(_stream(spark, d), lambda b: b.where("event_type = 'purchase'").select("event_id", "user_id", "value"))
    count = lambda df, kind: df.agg(n_rows().alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(spark.read.parquet(f"{out}/fact"), "fact").unionByName(count(spark.read.json(f"{out}/raw"), "raw"))


@q("src10", "SELECT event_id, event_type, CAST(props->>'k' AS INT) AS k FROM events")
def _(spark, d):
    """Envelopes as JSON text through a folder that stands in for the bus."""
    path = S.new_path(spark, "bus")
    e = t(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.to_json(F.struct("event_id", "event_type", "props")).alias("value"))
    e.write.parquet(path)
    s = X.stream_of(spark, path).select(F.from_json("value", "event_id long, event_type string, props string").alias("v"))
    out = X.drain(s.select("v.event_id", "v.event_type", F.get_json_object("v.props", "$.k").cast("int").alias("k")), "append")
    return spark.read.parquet(f"{out}/data").select("event_id", "event_type", "k")


@q("src11", "SELECT 'data' AS kind, count(*) FILTER (WHERE CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.app') END IS NOT NULL) AS n FROM driver_locations WHERE metadata IS NOT NULL UNION ALL SELECT 'dlq', count(*) FILTER (WHERE NOT (CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.app') END IS NOT NULL)) FROM driver_locations WHERE metadata IS NOT NULL")
def _(spark, d):
    s = X.stream_of(spark, f"{d}/driver_locations.parquet").where("metadata IS NOT NULL").select("id", "metadata")
    out = X.run_with_dead_letters(s, "metadata", "app string, batt int", "app")
    count = lambda kind: spark.read.parquet(f"{out}/{kind}").agg(n_rows().alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count("data").unionByName(count("dlq"))


@q("src13", "SELECT part, count(*) AS n FROM (SELECT strftime(o_orderdate, '%Y') AS part FROM orders) WHERE part IN ('1996', '1997') GROUP BY 1")
def _(spark, d):
    """The second load of a file changes nothing."""
    m, o = S.Manifest(spark, S.new_path(spark, "loads")), t(spark, d, "orders")
    for year in ("1996", "1997", "1996"):
        m.load(year, o.where(F.date_format("o_orderdate", "yyyy") == year))
    return m.read().groupBy(F.col("part").cast("string").alias("part")).agg(n_rows().alias("n"))


@q("src13_whole", "SELECT coalesce(strftime(o_orderdate, '%Y'), 'undated') AS part, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    """Every year of orders, each offered twice; orders without a date are a part of their own."""
    year = F.coalesce(F.date_format("o_orderdate", "yyyy"), F.lit("undated"))
    m, o = S.Manifest(spark, S.new_path(spark, "loads")), t(spark, d, "orders")
    years = sorted(r.y for r in o.select(year.alias("y")).distinct().collect())
    for y in years * 2:
        m.load(y, o.where(year == y))
    return m.read().groupBy(F.col("part").cast("string").alias("part")).agg(n_rows().alias("n"))


@q("src14", "SELECT borough AS station, count(*) AS zones, round(avg((lat_min + lat_max) / 2), 6) AS lat FROM dim_zones GROUP BY 1")
def _(spark, d):
    path = S.export(t(spark, d, "dim_zones"), "csv", S.new_path(spark, "stations"))
    z = S.load(spark, "csv", path, t(spark, d, "dim_zones").schema)
    return z.groupBy(F.col("borough").alias("station")).agg(n_rows().alias("zones"), F.round(F.avg((F.col("lat_min") + F.col("lat_max")) / 2), 6).alias("lat"))


@q("src15", "SELECT * FROM (VALUES ('parquet', true), ('json', true), ('csv', true), ('xlsx', false)) v(format, known)")
def _(spark, d):
    return spark.createDataFrame([(f, f in S.FORMATS) for f in ("parquet", "json", "csv", "xlsx")], "format string, known boolean")


@q("src15_ingest", "SELECT 'supplier' AS name, 'csv' AS format, count(*) AS n, round(sum(s_acctbal), 2) AS total FROM supplier UNION ALL SELECT 'customer', 'json', count(*), round(sum(c_acctbal), 2) FROM customer UNION ALL SELECT 'supplier', 'xml', NULL, NULL")
def _(spark, d):
    """Registered tables come in by their format and schema; another format is refused and has no rows."""
    jobs, out = S.Ingest(spark), None
    for name, fmt, key in (("supplier", "csv", "s_acctbal"), ("customer", "json", "c_acctbal"), ("supplier", "xml", "s_acctbal")):
        if fmt in S.FORMATS:
            jobs.register(name, fmt, t(spark, d, name).schema)
            path = S.export(t(spark, d, name), fmt, S.new_path(spark, f"{name}-{fmt}"))
        if jobs.accepts(name, fmt):
            x = jobs.run(name, fmt, path).agg(n_rows().alias("n"), F.round(F.sum(key), 2).alias("total"))
        else:
            x = spark.range(1).select(F.lit(None).cast("long").alias("n"), F.lit(None).cast("double").alias("total"))
        x = x.select(F.lit(name).alias("name"), F.lit(fmt).alias("format"), "n", "total")
        out = x if out is None else out.unionByName(x)
    return out


@q("src16", "SELECT count(*) AS n, max(updated_at) IS NOT NULL AS moved FROM subscriptions WHERE updated_at > TIMESTAMPTZ '2016-06-01 00:00:00+00'")
def _(spark, d):
    from rideloom.operators.pipeline import since

    path = S.new_path(spark, "sync")
    from datetime import datetime, timezone

    since(t(spark, d, "subscriptions"), "updated_at", datetime(2016, 6, 1, tzinfo=timezone.utc)).write.parquet(path)
    return spark.read.parquet(path).agg(n_rows().alias("n"), F.max("updated_at").isNotNull().alias("moved"))


@q("src17", " UNION ALL ".join(f"SELECT '{f}' AS format, count(*) AS n, round(sum(s_acctbal), 2) AS total FROM supplier" for f in ("csv", "json", "parquet")))
def _(spark, d):
    s, out = t(spark, d, "supplier"), None
    for f in ("csv", "json", "parquet"):
        x = S.load(spark, f, S.export(s, f, S.new_path(spark, f)), s.schema).agg(n_rows().alias("n"), F.round(F.sum("s_acctbal"), 2).alias("total")).select(F.lit(f).alias("format"), "n", "total")
        out = x if out is None else out.unionByName(x)
    return out


@q("src18")
def _(spark, d):
    return S.synthetic_events(spark, 20_000).groupBy("kind").agg(n_rows().alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@q("src18_modes")
def _(spark, d):
    """Every template in the made modes, and lineitem replayed: rows, keys and time span in seconds."""
    out = None
    for template in ("ride", "location", "payment", "driver"):
        for mode in ("synthetic", "stress"):
            x = S.generated(spark, template, 2_000, mode).agg(n_rows().alias("n"), F.count_distinct("driver_id").alias("keys"), (F.max("sent_at").cast("long") - F.min("sent_at").cast("long")).alias("span_s"))
            x = x.select(F.lit(template).alias("template"), F.lit(mode).alias("mode"), "n", "keys", "span_s")
            out = x if out is None else out.unionByName(x)
    r = S.generated(spark, "ride", 1_000, "replay", source=t(spark, d, "events")).agg(n_rows().alias("n"), F.count_distinct("user_id").alias("keys"), (F.max("sent_at").cast("long") - F.min("sent_at").cast("long")).alias("span_s"))
    return out.unionByName(r.select(F.lit("events").alias("template"), F.lit("replay").alias("mode"), "n", "keys", "span_s"))


_W = "CAST(floor(epoch(ts) / {s}) AS BIGINT) * {s}"
_AGG = "count(*) AS n, round(sum(value), 4) AS total"


def _aggs():
    return [n_rows().alias("n"), F.round(F.sum("value"), 4).alias("total")]


@q("str01", f"SELECT {_W.format(s=3600)} AS start, event_type, {_AGG} FROM events GROUP BY ALL")
def _(spark, d):
    """Four micro-batches in order of time; windows are updated over them."""
    return X.run_windowed(_batches(spark, d), "ts", "1 hour", _aggs(), ["event_type"])


@q("str02", f"SELECT {_W.format(s=3600)} - k * 3600 AS start, {_AGG} FROM events, range(0, 2) r(k) GROUP BY ALL")
def _(spark, d):
    return X.run_windowed(_batches(spark, d), "ts", "2 hours", _aggs(), slide="1 hour")


@q("str03", "WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) <= 7200000000 THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM g) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, CAST(floor(epoch(max(ts))) AS BIGINT) AS \"end\", count(*) AS n FROM s GROUP BY user_id, no")
def _(spark, d):
    """Sessions come out when closed; a last row past all of them closes those still open."""
    path = X.staged(t(spark, d, "events"), "ts", close="1 DAY")
    return X.run_sessions(X.stream_of_files(spark, path), "ts", "2 hours", "user_id")


@q("str04", f"SELECT {_W.format(s=600)} AS start, count(*) AS n, round(sum(value), 4) AS total, round(sum(value) / count(*), 6) AS mean FROM events GROUP BY 1")
def _(spark, d):
    e = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy((F.floor(F.unix_micros("ts") / 600_000_000) * 600).cast("long").alias("start")).agg(n_rows().alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.sum("value") / n_rows(), 6).alias("mean"))


@q("str05", f"SELECT {_W.format(s=60)} AS start, event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS lo, max(value) AS hi, arg_min(props, (ts, event_id)) AS dimensions FROM events GROUP BY ALL")
def _(spark, d):
    aggs = [n_rows().alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.min_by("props", F.struct("ts", "event_id")).alias("dimensions")]
    return X.run_windowed(_batches(spark, d), "ts", "60 seconds", aggs, ["event_type"])


@q("str06", "SELECT DISTINCT event_id FROM events")
def _(spark, d):
    return X.run_deduplicated(_stream(spark, d), "ts", "event_id", "1 hour").select("event_id")


@q("str07", "SELECT count(DISTINCT id) AS n FROM driver_locations")
def _(spark, d):
    s = X.stream_of(spark, f"{d}/driver_locations.parquet", "created_at").select("id", "created_at")
    return X.run_deduplicated(s, "created_at", "id", "60 days").agg(n_rows().alias("n"))


@q("str08", "SELECT event_id FROM (SELECT event_id, user_id, event_id * 7919 % 1000 AS seq, max(event_id * 7919 % 1000) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM events) WHERE top IS NULL OR seq > top")
def _(spark, d):
    seq = F.col("event_id") * 7919 % 1000
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, -1)
    e = t(spark, d, "events").withColumn("seq", seq)
    return e.withColumn("top", F.max("seq").over(w)).where("top IS NULL OR seq > top").select("event_id")


@q("str09", "SELECT count(*) AS n FROM events")
def _(spark, d):
    """A batch that is delivered again overwrites its own folder."""
    def twice(batch, batch_id, out):
        for _ in range(2):
            batch.write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")

    out = X.drain(_stream(spark, d).select("event_id"), "append", twice)
    return spark.read.parquet(f"{out}/data").agg(n_rows().alias("n"))


@q("str10", "SELECT n_nationkey AS part, ntile(4) OVER (ORDER BY n_nationkey) - 1 AS by_range, n_nationkey % 4 AS by_turn FROM nation")
def _(spark, d):
    n = t(spark, d, "nation")
    return n.select(F.col("n_nationkey").alias("part"), (F.ntile(4).over(W.orderBy("n_nationkey")) - 1).alias("by_range"), (F.col("n_nationkey") % 4).alias("by_turn"))


@q("str11", "SELECT user_id % 8 AS part, greatest(0, max(event_id) - coalesce(max(event_id) FILTER (WHERE event_type = 'purchase'), 0)) AS lag FROM events GROUP BY 1")
def _(spark, d):
    done = F.coalesce(F.max(F.when(F.col("event_type") == "purchase", F.col("event_id"))), F.lit(0))
    return t(spark, d, "events").groupBy((F.col("user_id") % 8).alias("part")).agg(F.greatest(F.lit(0), F.max("event_id") - done).alias("lag"))


@q("str12", "SELECT user_id, (rn - 1) // 100 AS flush, count(*) AS n FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) GROUP BY ALL")
def _(spark, d):
    rn = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return t(spark, d, "events").select("user_id", rn.alias("rn")).groupBy("user_id", F.expr("cast((rn - 1) div 100 as long)").alias("flush")).agg(n_rows().alias("n"))


@q("str13", "SELECT event_type, count(*) AS n, min(event_id) AS first FROM events WHERE event_id >= 1000 AND event_type IN ('click', 'error') GROUP BY 1")
def _(spark, d):
    e = t(spark, d, "events").where((F.col("event_id") >= 1000) & F.col("event_type").isin("click", "error"))
    return e.groupBy("event_type").agg(n_rows().alias("n"), F.min("event_id").alias("first"))


@q("str14", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS version, arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'purchase') AS fare FROM events GROUP BY 1")
def _(spark, d):
    at = F.struct("ts", "event_id")
    return t(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", at).alias("state"), n_rows().alias("version"), F.max_by("value", F.when(F.col("event_type") == "purchase", at)).alias("fare"))


@q("str15", "SELECT event_id FROM events WHERE event_id > 5000 AND event_type LIKE 'c%'")
def _(spark, d):
    from rideloom.functions.scalar import topic_pattern

    topic = F.concat_ws(".", F.lit("app"), "event_type")
    return t(spark, d, "events").where((F.col("event_id") > 5000) & topic.rlike(topic_pattern("app.*")) & F.col("event_type").startswith("c")).select("event_id")


@q("str16", "SELECT driver_id, CASE WHEN age > 60 THEN 'offline' WHEN age > 30 THEN 'away' ELSE 'online' END AS presence FROM (SELECT driver_id, epoch(TIMESTAMPTZ '2017-01-29 22:00:00+00') - epoch(max(recorded_at)) AS age FROM processed_locations GROUP BY 1)")
def _(spark, d):
    age = F.lit("2017-01-29 22:00:00").cast("timestamp").cast("double") - F.max("recorded_at").cast("double")
    return t(spark, d, "processed_locations").groupBy("driver_id").agg(F.when(age > 60, "offline").when(age > 30, "away").otherwise("online").alias("presence"))


@q("str17")
def _(spark, d):
    a = t(spark, d, "events").groupBy(F.expr("unix_seconds(cast(ts as timestamp)) div 3600").alias("tick")).agg(n_rows().alias("n"))
    return X.backpressure(a, 15, 20)


@q("str18", "SELECT count(*) FILTER (WHERE ok) AS processed, count(*) FILTER (WHERE NOT ok) AS failed FROM (SELECT coalesce(CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.app') END IS NOT NULL, false) AS ok FROM driver_locations)")
def _(spark, d):
    s = X.stream_of(spark, f"{d}/driver_locations.parquet").select("id", F.from_json("metadata", "app string").alias("m"))
    out = X.drain(s.select("id", F.col("m.app").isNotNull().alias("ok")), "append")
    return spark.read.parquet(f"{out}/data").agg(F.count_if("ok").alias("processed"), F.count_if(~F.col("ok")).alias("failed"))


@q("wh02", "SELECT event_type, round(sum(value), 2) AS total, count(*) AS rows FROM events GROUP BY 1")
def _(spark, d):
    return X.run_incremental_view(_stream(spark, d), ["event_type"], "value").select("event_type", F.round("sum", 2).alias("total"), "rows")


@q("udtf01", "SELECT doc_id, i AS chunk, least(50, len(w) - i * 35) AS tokens FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL), range(0, 1000) r(i) WHERE i < CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 50 THEN 1 ELSE ceil((len(w) - 50) / 35.0) + 1 END")
def _(spark, d):
    from rideloom.operators.features import chunks, words

    docs = t(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.posexplode(chunks(words(F.col("text")), 50, 15)).alias("chunk", "w")).select("doc_id", "chunk", F.size("w").alias("tokens"))


QUERIES, SQL = book.QUERIES, book.SQL
