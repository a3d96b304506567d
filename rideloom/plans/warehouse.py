"""Lake tables, layers, warehouse derivations, ETL, quality, anomalies, risk and governance."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rideloom.common import table as t
from rideloom.operators import joins as J
from rideloom.operators import lake as L
from rideloom.operators import pipeline as P
from rideloom.operators import quality as Q
from rideloom.plans.book import Book
from rideloom.session import shared_dir

book = Book()
q = book.query
r4 = lambda c: F.round(c, 4)


def n_rows():
    return F.count(F.lit(1))


def _lake(spark):
    import uuid

    return L.SnapshotTable(spark, f"{shared_dir(spark)}/lake-{uuid.uuid4().hex}")


def _parts(spark, d):
    p = t(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return p.where("p_partkey % 2 = 0"), p.where("p_partkey % 2 = 1")


_P = "SELECT p_partkey, p_size, p_retailprice FROM part"


@q("lake01", _P)
def _(spark, d):
    x, (a, b) = _lake(spark), _parts(spark, d)
    x.append(a), x.append(b)
    return x.read()


@q("lake02", f"{_P} WHERE p_partkey % 2 = 1")
def _(spark, d):
    x, (a, b) = _lake(spark), _parts(spark, d)
    x.append(a), x.overwrite(b)
    return x.read()


@q("lake03", f"{_P} WHERE p_partkey % 2 = 0 AND p_size <> 7")
def _(spark, d):
    x, (a, _b) = _lake(spark), _parts(spark, d)
    x.append(a), x.delete(F.col("p_size") == 7)
    return x.read()


@q("lake04", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 99 ELSE p_size END AS p_size, p_retailprice FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0")
def _(spark, d):
    x, (a, _b) = _lake(spark), _parts(spark, d)
    x.append(a)
    x.merge(t(spark, d, "part").where("p_partkey % 3 = 0").select("p_partkey", F.lit(99).alias("p_size"), "p_retailprice"), ["p_partkey"])
    return x.read()


@q("lake05", "SELECT p_partkey, p_size, p_retailprice, CAST(NULL AS VARCHAR) AS p_note FROM part WHERE p_partkey % 2 = 0")
def _(spark, d):
    x, (a, _b) = _lake(spark), _parts(spark, d)
    x.append(a), x.add_column("p_note", "string")
    return x.read()


@q("lake06", "SELECT 1 AS version, 'append' AS operation, count(*) FILTER (WHERE p_partkey % 2 = 0) AS rows FROM part UNION ALL SELECT 2, 'append', count(*) FROM part")
def _(spark, d):
    x, (a, b) = _lake(spark), _parts(spark, d)
    x.append(a), x.append(b)
    return x.history().select("version", "operation", "rows")


@q("lake07", f"{_P} WHERE p_partkey % 2 = 0")
def _(spark, d):
    x, (a, b) = _lake(spark), _parts(spark, d)
    x.append(a), x.append(b), x.overwrite(b)
    return x.read(version=1)


@q("lake08", _P)
def _(spark, d):
    x, (a, b) = _lake(spark), _parts(spark, d)
    x.append(a, "2024-01-01"), x.append(b, "2024-02-01"), x.overwrite(a, "2024-03-01")
    return x.read(as_of="2024-02-15")


@q("lake09", "SELECT * FROM (VALUES (1, 'append'), (2, 'delete'), (3, 'overwrite')) v(version, operation)")
def _(spark, d):
    x, (a, b) = _lake(spark), _parts(spark, d)
    x.append(a), x.delete(F.col("p_size") > 40), x.overwrite(b)
    return x.history().select("version", "operation")


@q("lake10", "SELECT 'even' AS layer, count(*) AS rows FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'odd', count(*) FROM part WHERE p_partkey % 2 = 1")
def _(spark, d):
    a, b = _parts(spark, d)
    return a.agg(n_rows().alias("rows")).select(F.lit("even").alias("layer"), "rows").unionByName(b.agg(n_rows().alias("rows")).select(F.lit("odd").alias("layer"), "rows"))


@q("med01", "SELECT count(*) AS rows, count(DISTINCT event_id) AS ids, 'events' AS source_name FROM events")
def _(spark, d):
    b = P.bronze(t(spark, d, "events"), "events", "2024-02-01")
    return b.groupBy("source_name").agg(n_rows().alias("rows"), F.count_distinct("record_id").alias("ids"))


def _silver(spark, d):
    p = t(spark, d, "driver_locations").select("id", "driver_id", F.col("accuracy").cast("string").alias("accuracy"))
    return P.silver(p, ["id", "accuracy"], {"accuracy": "double"}, {"accuracy": (0.0, 100.0)}, [F.col("id")])


_STATE = "SELECT CASE WHEN a IS NULL OR isnan(a) OR NOT (a BETWEEN 0 AND 100) THEN 'rejected' WHEN rn = 1 THEN 'accepted' ELSE 'repeated' END AS state, driver_id FROM (SELECT driver_id, CAST(accuracy AS DOUBLE) AS a, row_number() OVER (PARTITION BY id, driver_id, accuracy) AS rn FROM driver_locations)"


@q("med02", f"SELECT state, count(*) AS n FROM ({_STATE}) GROUP BY 1")
def _(spark, d):
    return _silver(spark, d).groupBy("state").agg(n_rows().alias("n"))


@q("med03", f"SELECT driver_id, count(*) AS record_count FROM ({_STATE}) WHERE state = 'accepted' GROUP BY 1")
def _(spark, d):
    from rideloom.operators.aggregates import gold

    return gold(_silver(spark, d).where("state = 'accepted'"), ["driver_id"], {"worst": ("accuracy", "max")}).select("driver_id", "record_count")


@q("med04", f"SELECT count(*) AS ingested, count(*) FILTER (WHERE state = 'accepted') AS accepted, count(*) FILTER (WHERE state = 'rejected') AS rejected, count(*) FILTER (WHERE state = 'repeated') AS deduped FROM ({_STATE})")
def _(spark, d):
    s = F.col("state")
    return _silver(spark, d).agg(n_rows().alias("ingested"), *[F.count_if(s == k).alias(a) for k, a in (("accepted", "accepted"), ("rejected", "rejected"), ("repeated", "deduped"))])


@q("med05", "SELECT count(DISTINCT (driver_id, speed, heading, source)) AS distinct_rows, count(*) AS rows FROM (SELECT driver_id, CASE WHEN speed IS NULL THEN 'null' ELSE CAST(CAST(speed * 100 AS BIGINT) AS VARCHAR) END AS speed, CASE WHEN heading IS NULL OR isnan(heading) THEN 'null' ELSE CAST(CAST(heading * 10 AS BIGINT) AS VARCHAR) END AS heading, source FROM driver_locations WHERE speed < 1000)")
def _(spark, d):
    """Fields to strings, nulls stripped, one row per source and content."""
    p = t(spark, d, "driver_locations").where("speed < 1000")
    fields = F.map_filter(F.create_map(F.lit("driver_id"), F.col("driver_id"), F.lit("speed"), F.round(F.col("speed").cast("double") * 100).cast("long").cast("string"), F.lit("heading"), F.when(~F.isnan("heading"), F.round(F.col("heading").cast("double") * 10).cast("long").cast("string"))), lambda k, v: v.isNotNull())
    p = p.select("source", F.to_json(fields).alias("body"))
    return p.agg(F.count_distinct("source", "body").alias("distinct_rows"), n_rows().alias("rows"))


_TEXT = "CASE WHEN {c} IS NOT NULL AND NOT isnan({c}) THEN CASE WHEN abs({c}) < 1e15 THEN CAST(CAST(CAST({c} AS DOUBLE) * {k} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END ELSE 'null' END AS {c}"


@q("med05_whole", f"SELECT count(DISTINCT (driver_id, speed, heading, source)) AS distinct_rows, count(*) AS rows FROM (SELECT coalesce('d' || driver_id, 'null') AS driver_id, {_TEXT.format(c='speed', k=100)}, {_TEXT.format(c='heading', k=10)}, coalesce('s' || source, 'null') AS source FROM driver_locations)")
def _(spark, d):
    """med05 over every ping: null and NaN fields are stripped, numbers too large to round keep their own text."""

    def text(c, k):
        x = F.col(c).cast("double")
        return F.when(~F.isnan(x), F.when(F.abs(x) < 1e15, F.round(x * k).cast("long").cast("string")).otherwise(F.col(c).cast("string")))

    p = t(spark, d, "driver_locations")
    fields = F.map_filter(F.create_map(F.lit("driver_id"), F.col("driver_id"), F.lit("speed"), text("speed", 100), F.lit("heading"), text("heading", 10)), lambda k, v: v.isNotNull())
    p = p.select("source", F.to_json(fields).alias("body"))
    return p.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(F.struct("source", "body")).alias("distinct_rows")).select("distinct_rows", "rows")


@q("med06", "SELECT event_type, count(*) AS n, 'k' AS fields, min(CAST(props->>'k' AS INT)) AS lo, max(CAST(props->>'k' AS INT)) AS hi FROM events GROUP BY 1")
def _(spark, d):
    e = t(spark, d, "events").select("event_type", F.from_json("props", "map<string,string>").alias("m"))
    x = e.select("event_type", F.explode("m").alias("k", "v"))
    return x.groupBy("event_type").agg(F.count_if(F.col("k") == "k").alias("n"), F.array_join(F.array_sort(F.collect_set("k")), ",").alias("fields"), F.min(F.col("v").cast("int")).alias("lo"), F.max(F.col("v").cast("int")).alias("hi"))


@q("wh01", "SELECT driver_id, snapshot_date, total_trips FROM (SELECT *, row_number() OVER (PARTITION BY driver_id, snapshot_date ORDER BY loaded_at DESC, total_trips DESC) AS rn FROM driver_snapshots) WHERE rn = 1")
def _(spark, d):
    return L.last_per_key(t(spark, d, "driver_snapshots"), ["driver_id", "snapshot_date"], [F.desc("loaded_at"), F.desc("total_trips")]).select("driver_id", "snapshot_date", "total_trips")


@q("wh03", "SELECT count(*) FILTER (WHERE zone_id IS NOT NULL AND driver_id IS NOT NULL AND NOT isnan(speed_kmh)) AS valid, count(*) FILTER (WHERE zone_id IS NULL OR driver_id IS NULL OR isnan(speed_kmh)) AS invalid FROM processed_locations")
def _(spark, d):
    ok = F.col("zone_id").isNotNull() & F.col("driver_id").isNotNull() & F.col("speed_kmh").isNotNull() & ~F.isnan("speed_kmh")
    return t(spark, d, "processed_locations").agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))


@q("wh04", "SELECT strftime(day, '%Y-%m-%d') AS day, isodow(day) AS weekday, isodow(day) >= 6 AS weekend, CAST(weekofyear(day) AS INT) AS week, quarter(day) AS quarter FROM (SELECT CAST(unnest(generate_series(DATE '2009-01-01', DATE '2009-01-01' + 6574, INTERVAL 1 DAY)) AS DATE) AS day)")
def _(spark, d):
    x = spark.range(6575).select(F.expr("date_add(DATE'2009-01-01', cast(id as int))").alias("day"))
    wd = F.weekday("day") + 1
    return x.select(F.date_format("day", "yyyy-MM-dd").alias("day"), wd.alias("weekday"), (wd >= 6).alias("weekend"), F.weekofyear("day").alias("week"), F.quarter("day").alias("quarter"))


@q("wh05", "SELECT l_orderkey, l_linenumber, l_partkey, date_diff('day', o_orderdate, l_shipdate) * 1440 AS minutes, isodow(o_orderdate) - 1 AS weekday, isodow(o_orderdate) >= 6 AS weekend, round(l_extendedprice * (1 + l_tax), 6) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(spark, d):
    x = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    wd = F.weekday("o_orderdate")
    return x.select("l_orderkey", "l_linenumber", "l_partkey", (F.datediff("l_shipdate", "o_orderdate") * 1440).alias("minutes"), wd.alias("weekday"), (wd >= 5).alias("weekend"), F.round(F.col("l_extendedprice") * (1 + F.col("l_tax")), 6).alias("total"))


@q("wh06", "SELECT o_orderkey, round(o_totalprice + 0.05, 2) AS total, lower(o_orderstatus) AS status FROM orders")
def _(spark, d):
    return t(spark, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") + 0.05, 2).alias("total"), F.lower("o_orderstatus").alias("status"))


@q("wh07", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY")
def _(spark, d):
    e = t(spark, d, "events")
    top = e.agg(F.max("ts").alias("top"))
    return e.join(F.broadcast(top), F.expr("ts >= top - INTERVAL 10 DAY")).select("event_id")  # one row


@q("wh08", "SELECT event_id FROM events LEFT JOIN (VALUES ('error', 20), ('view', 5)) r(kind, days) ON event_type = kind WHERE ts < TIMESTAMP '2024-01-31' - to_days(CAST(coalesce(days, 15) AS INTEGER))")
def _(spark, d):
    rules = spark.createDataFrame([("error", 20), ("view", 5)], "kind string, days int")
    e = t(spark, d, "events").join(F.broadcast(rules), F.col("event_type") == F.col("kind"), "left")
    return e.where(F.col("ts") < F.expr("TIMESTAMP_NTZ'2024-01-31' - make_dt_interval(coalesce(days, 15))")).select("event_id")


@q("wh09", "SELECT CASE WHEN strftime(o_orderdate, '%Y-%m') >= '2000-01' THEN 'hot' ELSE 'cold' END AS tier, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    return t(spark, d, "orders").groupBy(F.when(F.date_format("o_orderdate", "yyyy-MM") >= "2000-01", "hot").otherwise("cold").alias("tier")).agg(n_rows().alias("n"))


@q("etl01", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20'")
def _(spark, d):
    e = t(spark, d, "events")
    from datetime import datetime

    return P.since(e, "ts", datetime(2024, 1, 20)).select("event_id")


@q("etl02", "SELECT count(*) FILTER (WHERE event_id % 2 = 0 OR ts > (SELECT max(ts) FROM events WHERE event_id % 2 = 0)) AS loaded, max(ts) AS watermark FROM events")
def _(spark, d):
    e, x, load = t(spark, d, "events"), _lake(spark), P.IncrementalLoad("ts")
    load.run(e.where("event_id % 2 = 0"), x.append)
    load.run(e, x.append)
    return x.read().agg(n_rows().alias("loaded"), F.max("ts").alias("watermark"))


_CDC = "SELECT event_id AS sequence, user_id AS key, value, CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS operation FROM events"


def _cdc(spark, d):
    op = F.when(F.col("event_type") == "signup", "INSERT").when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE")
    return t(spark, d, "events").select(F.col("event_id").alias("sequence"), F.col("user_id").alias("key"), "value", op.alias("operation"))


@q("etl03", f"SELECT sequence, operation FROM ({_CDC}) WHERE sequence > 5000")
def _(spark, d):
    return P.since(_cdc(spark, d), "sequence", 5000).select("sequence", "operation")


@q("etl04", "SELECT id FROM subscriptions WHERE updated_at > TIMESTAMPTZ '2017-01-10 00:00:00+00'")
def _(spark, d):
    return t(spark, d, "subscriptions").where(F.col("updated_at") > F.lit("2017-01-10").cast("timestamp")).select("id")


@q("etl05", f"SELECT key, arg_max(value, sequence) AS value FROM ({_CDC}) GROUP BY key HAVING arg_max(operation, sequence) <> 'DELETE'")
def _(spark, d):
    c = _cdc(spark, d)
    return P.apply_changes(c.limit(0).select("key", "value"), c, "key", ["value"])


@q("etl06", "SELECT user_id, event_id, row_number() OVER w AS version, lead(ts) OVER w AS valid_to, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spend FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def _(spark, d):
    c = t(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("at"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("spend"))
    v = P.versions_of(c, "user_id", "at", ["spend"])
    return v.select("user_id", F.col("valid_from.event_id").alias("event_id"), "version", F.col("valid_to.ts").alias("valid_to"), "spend")


@q("etl07", "SELECT * FROM (VALUES ('extract', 0), ('clean', 1), ('dims', 1), ('facts', 2), ('report', 3)) v(task, level)")
def _(spark, d):
    levels = P.task_levels({"extract": [], "clean": ["extract"], "dims": ["extract"], "facts": ["clean", "dims"], "report": ["facts"]})
    return spark.createDataFrame([(x, i) for i, names in enumerate(levels) for x in names], "task string, level int")


@q("etl08", "SELECT event_id, dense_rank() OVER (ORDER BY event_type) AS type_key, CASE WHEN value >= 5 THEN value END AS fare FROM events")
def _(spark, d):
    """Surrogate keys from the small set of types, then a join; invalid measures become null."""
    e = t(spark, d, "events")
    keys = e.select("event_type").distinct().select("event_type", F.dense_rank().over(W.orderBy("event_type")).alias("type_key"))
    return e.join(J.small(keys), "event_type").select("event_id", "type_key", F.when(F.col("value") >= 5, F.col("value")).alias("fare"))


@q("dq01", "SELECT round(100.0 * count(*) FILTER (WHERE metadata IS NOT NULL AND metadata <> '') / count(*), 4) AS score FROM driver_locations")
def _(spark, d):
    return t(spark, d, "driver_locations").agg(r4(Q.complete("metadata")).alias("score"))


@q("dq02", "SELECT event_type, round((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(ts))) / 3.6e9, 4) AS age_hours, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(ts))) / 3.6e9 <= 24 AS fresh FROM events GROUP BY 1")
def _(spark, d):
    age = (F.unix_micros(F.lit("2024-01-31").cast("timestamp")) - F.unix_micros(F.max("ts").cast("timestamp"))) / 3.6e9
    return t(spark, d, "events").groupBy("event_type").agg(r4(age).alias("age_hours"), (age <= 24).alias("fresh"))


@q("dq03", "SELECT round(100.0 * count(*) FILTER (WHERE NOT isnan(speed) AND speed BETWEEN 0 AND 45) / count(speed), 4) AS score FROM driver_locations")
def _(spark, d):
    return t(spark, d, "driver_locations").agg(r4(Q.in_range("speed", 0, 45)).alias("score"))


@q("dq04", "SELECT round(100.0 * count(*) FILTER (WHERE expires_at IS NULL OR expires_at > started_at) / count(*), 4) AS ordered, round(100.0 * count(*) FILTER (WHERE status = 'cancelled' AND cancelled_at IS NOT NULL) / count(*) FILTER (WHERE status = 'cancelled'), 4) AS dated FROM subscriptions")
def _(spark, d):
    ordered = F.col("expires_at").isNull() | (F.col("expires_at") > F.col("started_at"))
    return t(spark, d, "subscriptions").agg(r4(Q.percent(ordered)).alias("ordered"), r4(Q.percent(F.col("cancelled_at").isNotNull(), F.col("status") == "cancelled")).alias("dated"))


@q("dq05", "SELECT round(100.0 * count(DISTINCT id) / count(id), 4) AS score FROM driver_locations")
def _(spark, d):
    return t(spark, d, "driver_locations").agg(r4(Q.unique("id")).alias("score"))


@q("dq06", "SELECT round(100.0 * count(*) FILTER (WHERE regexp_matches(license_number, '^KV-[0-9]{8}')) / count(license_number), 4) AS score FROM driver_snapshots")
def _(spark, d):
    return t(spark, d, "driver_snapshots").agg(r4(Q.formatted("license_number", "KV-[0-9]{8}")).alias("score"))


@q("dq07", "WITH s AS (SELECT 100.0 * count(text) FILTER (WHERE text <> '') / count(*) AS a, 100.0 * count(DISTINCT doc_id) / count(doc_id) AS b, 100.0 * count(*) FILTER (WHERE n_chars BETWEEN 1 AND 2000) / count(n_chars) AS c FROM documents) SELECT 'complete' AS rule, round(a, 4) AS score, a >= 99 AS passed FROM s UNION ALL SELECT 'unique', round(b, 4), b >= 100 FROM s UNION ALL SELECT 'length', round(c, 4), c >= 95 FROM s")
def _(spark, d):
    return Q.check_rules(t(spark, d, "documents"), {"complete": (Q.complete("text"), 99), "unique": (Q.unique("doc_id"), 100), "length": (Q.in_range("n_chars", 1, 2000), 95)})


_Z = "SELECT event_id, (value - avg(value) OVER ()) / stddev_pop(value) OVER () AS z FROM events"


@q("an01", f"SELECT event_id, CASE WHEN abs(z) > 4 THEN 'high' WHEN abs(z) > 3 THEN 'medium' ELSE 'low' END AS severity FROM ({_Z}) WHERE abs(z) > 2")
def _(spark, d):
    return Q.zscores(t(spark, d, "events"), "value", 2.0).select("event_id", "severity")


@q("an02", "WITH s AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1), x AS (SELECT event_id, greatest(a - 1.5 * (b - a) - value, value - b - 1.5 * (b - a)) AS o, b - a AS iqr FROM events JOIN s USING (event_type)) SELECT event_id, CASE WHEN o > 3 * iqr THEN 'high' WHEN o > iqr THEN 'medium' ELSE 'low' END AS severity FROM x WHERE o > 0")
def _(spark, d):
    return Q.iqr_outliers(t(spark, d, "events"), "value", 1.5, ["event_type"]).select("event_id", "severity")


@q("an03", "WITH x AS (SELECT event_id, user_id, value, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) SELECT event_id FROM x WHERE i > 10 AND abs(value - m) / nullif(s, 0) > 3")
def _(spark, d):
    from rideloom.operators.timeseries import moving_anomalies

    e = t(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    return moving_anomalies(e, ["user_id"], "at", "value", 10, 3.0).select("event_id")


@q("an04", "SELECT event_type, count(*) AS outliers FROM (SELECT event_type, abs(value - avg(value) OVER (PARTITION BY event_type)) / stddev_pop(value) OVER (PARTITION BY event_type) AS z FROM events) WHERE z > 3 GROUP BY 1")
def _(spark, d):
    return Q.zscores(t(spark, d, "events"), "value", 3.0, ["event_type"]).groupBy("event_type").agg(n_rows().alias("outliers"))


@q("an05", "WITH f AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events WHERE event_id % 2 = 0) SELECT event_id FROM events, f WHERE event_id % 2 = 1 AND abs(value - m) / s > 3")
def _(spark, d):
    """Fitted on one half, applied to the other."""
    e = t(spark, d, "events")
    f = e.where("event_id % 2 = 0").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return e.where("event_id % 2 = 1").crossJoin(F.broadcast(f)).where("abs(value - m) / s > 3").select("event_id")  # one row


@q("an06")
def _(spark, d):
    x = Q.isolation_scores(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"), ["l_quantity", "l_extendedprice", "l_discount"])
    return x.select("l_orderkey", "l_linenumber", F.round("score", 4).alias("score"))


@q("an07_lof")
def _(spark, d):
    """k-distance ratios over three features."""
    x = Q.lof_scores(t(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], 5)
    return x.select("p_partkey", F.round("lof", 4).alias("lof"))


@q("an07")
def _(spark, d):
    """Ratio of a supplier's distance to its k-th nearest by balance to that of the neighbours: on a sorted line neighbours are adjacent."""
    k = 5
    w = W.partitionBy("s_nationkey").orderBy("s_acctbal", "s_suppkey")
    s = t(spark, d, "supplier")
    near = F.array_compact(F.array(*[F.abs(F.col("s_acctbal") - f("s_acctbal", i).over(w)) for i in range(1, k + 1) for f in (F.lag, F.lead)]))
    s = s.withColumn("kdist", F.try_element_at(F.array_sort(near), F.lit(k)))
    around = F.array_compact(F.array(*[f("kdist", i).over(w) for i in range(1, k // 2 + 2) for f in (F.lag, F.lead)]))
    mean = F.aggregate(around, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(around), F.lit(0))
    return s.select("s_suppkey", F.round(F.try_divide("kdist", mean), 4).alias("lof"))


@q("an08", "WITH f AS (SELECT avg(l_quantity) AS qm, stddev_pop(l_quantity) AS qs, avg(l_extendedprice) AS pm, stddev_pop(l_extendedprice) AS ps FROM lineitem), x AS (SELECT l_orderkey, l_linenumber, l_partkey, 0.5 * least(abs(l_quantity - qm) / qs / 3, 1) + 0.3 * least(abs(l_extendedprice - pm) / ps / 3, 1) + 0.2 * (l_discount >= 0.1)::INT AS s FROM lineitem, f) SELECT l_orderkey, l_linenumber, l_partkey, round(s, 6) AS score FROM x WHERE s > 0.5")
def _(spark, d):
    x = t(spark, d, "lineitem")
    f = x.agg(F.avg("l_quantity").alias("qm"), F.stddev_pop("l_quantity").alias("qs"), F.avg("l_extendedprice").alias("pm"), F.stddev_pop("l_extendedprice").alias("ps"))
    z = lambda c, m, s: F.least(F.abs(F.col(c) - F.col(m)) / F.col(s) / 3, F.lit(1.0))
    x = x.crossJoin(F.broadcast(f)).withColumn("score", 0.5 * z("l_quantity", "qm", "qs") + 0.3 * z("l_extendedprice", "pm", "ps") + 0.2 * (F.col("l_discount") >= 0.1).cast("int"))  # one row
    return x.where("score > 0.5").select("l_orderkey", "l_linenumber", "l_partkey", F.round("score", 6).alias("score"))


@q("fr01", "SELECT o_orderkey, round(((o_totalprice > 300000)::INT * 0.5 + (o_orderpriority = '1-URGENT')::INT * 0.3 + (o_orderstatus = 'P')::INT * 0.2) / 1.0, 4) AS score FROM orders")
def _(spark, d):
    rules = {"large": (F.col("o_totalprice") > 300000, 0.5), "urgent": (F.col("o_orderpriority") == "1-URGENT", 0.3), "pending": (F.col("o_orderstatus") == "P", 0.2)}
    return t(spark, d, "orders").select("o_orderkey", r4(Q.weighted_rules(rules)).alias("score"))


@q("fr02", "WITH c AS (SELECT l_returnflag = 'R' AS bad, avg(l_quantity) AS a, avg(l_discount * 100) AS b FROM lineitem GROUP BY 1), x AS (SELECT l_orderkey, l_linenumber, l_partkey, max(sqrt(pow(l_quantity - a, 2) + pow(l_discount * 100 - b, 2))) FILTER (WHERE bad) AS df, max(sqrt(pow(l_quantity - a, 2) + pow(l_discount * 100 - b, 2))) FILTER (WHERE NOT bad) AS dl FROM lineitem, c GROUP BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_suppkey, l_extendedprice) SELECT l_orderkey, l_linenumber, l_partkey, round(dl / (df + dl), 5) AS score FROM x")
def _(spark, d):
    x = t(spark, d, "lineitem").withColumn("disc", F.col("l_discount") * 100)
    bad = F.col("l_returnflag") == "R"
    c = x.agg(*[F.avg(F.when(k, F.col(v))).alias(n) for k, v, n in ((bad, "l_quantity", "fa"), (bad, "disc", "fb"), (~bad, "l_quantity", "la"), (~bad, "disc", "lb"))])
    far = lambda a, b: F.sqrt(F.pow(F.col("l_quantity") - F.col(a), 2) + F.pow(F.col("disc") - F.col(b), 2))
    return x.crossJoin(F.broadcast(c)).select("l_orderkey", "l_linenumber", "l_partkey", F.round(far("la", "lb") / (far("fa", "fb") + far("la", "lb")), 5).alias("score"))  # one row


_GRID = "WITH g AS (SELECT a / 10.0 AS a, b / 10.0 AS b FROM range(1, 22) ra(a), range(-15, 16) rb(b)), x AS (SELECT l_discount * 10 AS s, (l_returnflag = 'R')::INT AS y, count(*) AS n FROM lineitem GROUP BY ALL)"


@q("fr03", f"{_GRID}, l AS (SELECT a, b, -sum(n * (y * ln(greatest(p, 1e-9)) + (1 - y) * ln(greatest(1 - p, 1e-9)))) / sum(n) AS loss FROM (SELECT a, b, y, n, 1 / (1 + exp(-(a * s + b))) AS p FROM g, x) GROUP BY ALL) SELECT a, b, round(loss, 6) AS loss FROM l ORDER BY loss, a, b LIMIT 1")
def _(spark, d):
    """Platt scaling by grid search: the data are reduced to distinct scores first, so the grid meets few rows."""
    x = t(spark, d, "lineitem").groupBy((F.col("l_discount") * 10).alias("s"), (F.col("l_returnflag") == "R").cast("int").alias("y")).agg(n_rows().alias("n"))
    g = spark.range(1, 22).select((F.col("id") / 10.0).alias("a")).crossJoin(spark.range(-15, 16).select((F.col("id") / 10.0).alias("b")))  # 651 rows
    p = 1 / (1 + F.exp(-(F.col("a") * F.col("s") + F.col("b"))))
    loss = -F.sum(F.col("n") * (F.col("y") * F.ln(F.greatest(p, F.lit(1e-9))) + (1 - F.col("y")) * F.ln(F.greatest(1 - p, F.lit(1e-9))))) / F.sum("n")
    return x.join(F.broadcast(g)).groupBy("a", "b").agg(loss.alias("loss")).orderBy("loss", "a", "b").limit(1).withColumn("loss", F.round("loss", 6))


@q("fr04", "SELECT o_orderkey, round(0.6 * least(o_totalprice / 400000, 1) + 0.4 * (o_orderstatus = 'P')::INT, 5) AS score, 0.6 * least(o_totalprice / 400000, 1) + 0.4 * (o_orderstatus = 'P')::INT >= 0.7 AS flagged FROM orders")
def _(spark, d):
    s = 0.6 * F.least(F.col("o_totalprice") / 400000, F.lit(1.0)) + 0.4 * (F.col("o_orderstatus") == "P").cast("int")
    return t(spark, d, "orders").select("o_orderkey", F.round(s, 5).alias("score"), (s >= 0.7).alias("flagged"))


@q("fr05", "SELECT user_id, round(0.6 * greatest(v, a, g) + 0.4 * (v + a + g) / 3, 5) AS score FROM (SELECT user_id, least(count(*) / 150.0, 1) AS v, least(avg(value) / 100, 1) AS a, least(count(DISTINCT event_type) / 5.0, 1) AS g FROM events GROUP BY 1)")
def _(spark, d):
    cut = lambda c: F.least(c, F.lit(1.0))
    u = t(spark, d, "events").groupBy("user_id").agg(cut(n_rows() / 150.0).alias("v"), cut(F.avg("value") / 100).alias("a"), cut(F.count_distinct("event_type") / 5.0).alias("g"))
    return u.select("user_id", F.round(0.6 * F.greatest("v", "a", "g") + 0.4 * (F.col("v") + F.col("a") + F.col("g")) / 3, 5).alias("score"))


_PAT = {"email": "[a-z0-9._+-]+@[a-z0-9-]+([.][a-z0-9-]+)+", "digits9": "[0-9]{3}-[0-9]{2}-[0-9]{4}", "phone": "[0-9]{3}-555-[0-9]{4}"}


@q("gov01", " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, len(regexp_extract_all(lower(text), '{p}')) AS hits FROM documents WHERE regexp_matches(lower(text), '{p}')" for k, p in _PAT.items()))
def _(spark, d):
    """Counts by plain patterns of structured kinds."""
    docs = t(spark, d, "documents")
    hits = F.array(*[F.struct(F.lit(k).alias("kind"), F.size(F.regexp_extract_all(F.lower("text"), F.lit(p), F.lit(0))).alias("hits")) for k, p in _PAT.items()])
    return docs.where("text IS NOT NULL").select("doc_id", F.explode(hits).alias("x")).select("doc_id", "x.*").where("hits > 0")


@q("gov02", "SELECT col AS field, count(*) AS hits FROM (SELECT unnest(['license_number', 'full_name']) AS col, unnest([license_number, full_name]) AS v FROM driver_snapshots) WHERE regexp_matches(v, '[0-9]{6,}') GROUP BY 1")
def _(spark, d):
    x = t(spark, d, "driver_snapshots").select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("v")) for c in ("license_number", "full_name")])).alias("x")).select("x.*")
    return x.where(F.col("v").rlike("[0-9]{6,}")).groupBy("field").agg(n_rows().alias("hits"))


@q("gov03", "SELECT driver_key, '[REDACTED]' AS full_name, CASE WHEN length(license_number) > 4 THEN repeat('*', length(license_number) - 4) || right(license_number, 4) ELSE repeat('*', length(license_number)) END AS license_number, substr(sha256(driver_id), 1, 8) AS driver FROM dim_drivers WHERE full_name IS NOT NULL")
def _(spark, d):
    x = t(spark, d, "dim_drivers").where("full_name IS NOT NULL")
    return x.select("driver_key", Q.mask(F.col("full_name"), "redact").alias("full_name"), Q.mask(F.col("license_number"), "last4").alias("license_number"), Q.mask(F.col("driver_id"), "hash").alias("driver"))


def _edges(spark, d):
    """A lineage: each part feeds the one of half its number."""
    return t(spark, d, "part").where("p_partkey >= 1").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst"))


_EDGE = "SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey >= 1"
_CLO = f"WITH RECURSIVE e AS ({_EDGE}), c AS (SELECT src AS start, dst AS node, 1 AS depth FROM e WHERE src IN (399, 200, 7) UNION ALL SELECT c.start, e.dst, c.depth + 1 FROM c JOIN e ON c.node = e.src)"


def _down(spark, d):
    starts = spark.createDataFrame([(399,), (200,), (7,)], "s long")
    return P.closure(_edges(spark, d), "src", "dst", starts)


@q("gov04", f"{_CLO} SELECT start, node, min(depth) AS depth FROM c GROUP BY ALL")
def _(spark, d):
    return _down(spark, d)


@q("gov05", f"{_CLO} SELECT DISTINCT start AS source, node AS sink FROM c WHERE node IN (SELECT node FROM c WHERE node BETWEEN 1 AND 3)")
def _(spark, d):
    return _down(spark, d).where("node BETWEEN 1 AND 3").select(F.col("start").alias("source"), F.col("node").alias("sink"))


@q("gov07", "SELECT id, strftime(timezone('UTC', created_at) + INTERVAL 30 DAY, '%Y-%m-%d') AS due, timezone('UTC', created_at) + INTERVAL 30 DAY < TIMESTAMP '2017-02-01' AS overdue FROM (SELECT DISTINCT id, created_at FROM subscriptions)")
def _(spark, d):
    due = F.expr("created_at + INTERVAL 30 DAY")
    return t(spark, d, "subscriptions").select("id", "created_at").distinct().select("id", F.date_format(due, "yyyy-MM-dd").alias("due"), (due < F.lit("2017-02-01").cast("timestamp")).alias("overdue"))


@q("gov08", f"{_CLO} SELECT start, max(depth) AS depth, round(1 + sum((1 + node % 3) / CAST(depth AS DOUBLE)), 4) AS impact FROM (SELECT start, node, min(depth) AS depth FROM c GROUP BY ALL) GROUP BY 1")
def _(spark, d):
    return _down(spark, d).groupBy("start").agg(F.max("depth").alias("depth"), r4(1 + F.sum((1 + F.col("node") % 3) / F.col("depth"))).alias("impact"))


_ALL = f"WITH RECURSIVE e AS ({_EDGE}), c AS (SELECT src AS start, dst AS node, 1 AS depth FROM e UNION ALL SELECT c.start, e.dst, c.depth + 1 FROM c JOIN e ON c.node = e.src)"


def _down_all(spark, d):
    e = _edges(spark, d)
    return P.closure(e, "src", "dst", e.select("src"))


@q("gov04_whole", f"{_ALL} SELECT start, node, min(depth) AS depth FROM c GROUP BY ALL")
def _(spark, d):
    return _down_all(spark, d)


@q("gov04_up_whole", f"{_ALL} SELECT node AS start, start AS node, min(depth) AS depth FROM c GROUP BY ALL")
def _(spark, d):
    """What every node comes from."""
    e = _edges(spark, d)
    return P.closure(e, "dst", "src", e.select("dst"))


@q("gov05_whole", f"{_ALL} SELECT DISTINCT start AS source, node AS sink FROM c WHERE node BETWEEN 1 AND 3")
def _(spark, d):
    return _down_all(spark, d).where("node BETWEEN 1 AND 3").select(F.col("start").alias("source"), F.col("node").alias("sink"))


@q("gov08_whole", f"{_ALL} SELECT start, max(depth) AS depth, round(1 + sum((1 + node % 3) / CAST(depth AS DOUBLE)), 4) AS impact FROM (SELECT start, node, min(depth) AS depth FROM c GROUP BY ALL) GROUP BY 1")
def _(spark, d):
    return _down_all(spark, d).groupBy("start").agg(F.max("depth").alias("depth"), r4(1 + F.sum((1 + F.col("node") % 3) / F.col("depth"))).alias("impact"))


QUERIES, SQL = book.QUERIES, book.SQL
