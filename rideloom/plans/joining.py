"""Joins."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rideloom.common import table as t
from rideloom.functions.geo import haversine
from rideloom.operators import joins as J
from rideloom.plans.book import Book

book = Book()
q = book.query
HAV = "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2))))"


@q("join01", "SELECT o_orderkey, c.c_name AS customer_c_name, c.c_mktsegment AS customer_c_mktsegment FROM orders LEFT JOIN customer c ON o_custkey = c.c_custkey")
def _(spark, d):
    return J.star(t(spark, d, "orders").select("o_orderkey", "o_custkey"), {"customer": (t(spark, d, "customer"), "o_custkey", ["c_name", "c_mktsegment"])}).drop("o_custkey")


_L = "SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'"
_F = "SELECT user_id, ts, value FROM events WHERE event_type = 'view'"


def _sides(spark, d):
    e = t(spark, d, "events")
    return e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'view'").select("user_id", F.col("ts").alias("fts"), "value", "event_id")


@q("join02", f"SELECT l.event_id, CASE WHEN epoch_us(l.ts) - epoch_us(f.ts) <= 86400000000 THEN f.ts END AS feature_time, CASE WHEN epoch_us(l.ts) - epoch_us(f.ts) <= 86400000000 THEN f.value END AS value FROM ({_L}) l ASOF LEFT JOIN ({_F}) f ON l.user_id = f.user_id AND l.ts >= f.ts")
def _(spark, d):
    labels, feats = _sides(spark, d)
    return J.as_of(labels, feats, entity="user_id", label_ts="ts", feature_ts="fts", values=["value"], lookback_s=86400).select("event_id", "feature_time", "value")


@q("join03", f"SELECT l.event_id, f.ts AS feature_time, f.value FROM ({_L}) l LEFT JOIN (SELECT user_id, arg_max(ts, event_id) AS ts, arg_max(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY user_id) f USING (user_id)")
def _(spark, d):
    labels, feats = _sides(spark, d)
    return J.latest(labels, feats.withColumnRenamed("event_id", "seq"), entity="user_id", feature_ts="fts", values=["value"], seq="seq").select("event_id", "feature_time", "value")


@q("join04", f"SELECT l.event_id, f.value FROM ({_L}) l ASOF LEFT JOIN ({_F}) f ON l.user_id = f.user_id AND l.ts >= f.ts")
def _(spark, d):
    labels, feats = _sides(spark, d)
    return J.as_of(labels, feats, entity="user_id", label_ts="ts", feature_ts="fts", values=["value"]).select("event_id", "value")


@q("join05", f"SELECT l.event_id, round((epoch_us(f.ts) - epoch_us(l.ts)) / 1e6, 3) AS leak_seconds FROM ({_L}) l JOIN (SELECT user_id, arg_max(ts, event_id) AS ts FROM events WHERE event_type = 'view' GROUP BY user_id) f USING (user_id) WHERE f.ts > l.ts")
def _(spark, d):
    labels, feats = _sides(spark, d)
    j = J.latest(labels, feats.withColumnRenamed("event_id", "seq"), entity="user_id", feature_ts="fts", values=["value"], seq="seq")
    return J.leaks(j, "ts").select("event_id", F.round("leak_seconds", 3).alias("leak_seconds"))


@q("join06", "SELECT DISTINCT p.driver_id, CAST(date_trunc('day', timezone('UTC', p.recorded_at)) AS DATE)::VARCHAR AS day, v.driver_key FROM processed_locations p LEFT JOIN (SELECT min(driver_key) AS driver_key, driver_id, valid_from, valid_to FROM dim_drivers GROUP BY driver_id, valid_from, valid_to) v ON p.driver_id = v.driver_id AND p.recorded_at >= v.valid_from AND (v.valid_to IS NULL OR p.recorded_at < v.valid_to)")
def _(spark, d):
    v = t(spark, d, "dim_drivers").groupBy("driver_id", "valid_from", "valid_to").agg(F.min("driver_key").alias("driver_key"))
    p = t(spark, d, "processed_locations").select("driver_id", "recorded_at")
    j = J.valid_at(p, v, key="driver_id", ts="recorded_at", dim_key="driver_id", attributes=["driver_key"])
    return j.select("driver_id", F.date_format("recorded_at", "yyyy-MM-dd").alias("day"), "driver_key").distinct()


@q("join07", "SELECT e.event_id, c.c_name AS rider, a.n AS hour_events FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey LEFT JOIN (SELECT strftime(ts, '%Y-%m-%d-%H') AS h, count(*) AS n FROM events GROUP BY 1) a ON strftime(e.ts, '%Y-%m-%d-%H') = a.h")
def _(spark, d):
    e, hour = t(spark, d, "events"), F.date_format("ts", "yyyy-MM-dd-HH")
    side = e.groupBy(hour.alias("h")).agg(F.count(F.lit(1)).alias("hour_events"))
    c = t(spark, d, "customer").select("c_custkey", F.col("c_name").alias("rider"))
    j = e.withColumn("hk", hour).join(J.small(c), F.col("user_id") == F.col("c_custkey"), "left").join(J.small(side), F.col("hk") == F.col("h"), "left")
    return j.select("event_id", "rider", "hour_events")


@q("join08", """SELECT l.id, min(z.zone_id) AS zone_id FROM (SELECT DISTINCT id, latitude, longitude FROM driver_locations) l LEFT JOIN dim_zones z ON latitude BETWEEN lat_min AND lat_max AND longitude BETWEEN lon_min AND lon_max
    AND abs(latitude) <= 90 AND abs(longitude) <= 180 AND NOT (latitude = 0 AND longitude = 0) GROUP BY l.id, latitude, longitude""")
def _(spark, d):
    from rideloom.operators.proximity import in_boxes

    p = t(spark, d, "driver_locations").select("id", "latitude", "longitude").distinct()
    z = t(spark, d, "dim_zones")
    return in_boxes(p, z, lat="latitude", lon="longitude", box_id="zone_id").select("id", F.col("found_box").alias("zone_id"))


_REQ = "SELECT zone_id, (lat_min + lat_max) / 2 AS lat, (lon_min + lon_max) / 2 AS lon FROM dim_zones"
_CAND = "SELECT driver_id, arg_max(latitude, (recorded_at, id)) AS lat, arg_max(longitude, (recorded_at, id)) AS lon FROM driver_locations WHERE abs(latitude) <= 90 AND NOT (latitude = 0 AND longitude = 0) GROUP BY driver_id"


def _req(spark, d):
    return t(spark, d, "dim_zones").select("zone_id", ((F.col("lat_min") + F.col("lat_max")) / 2).alias("lat"), ((F.col("lon_min") + F.col("lon_max")) / 2).alias("lon"))


def _cand(spark, d):
    p = t(spark, d, "driver_locations").where("abs(latitude) <= 90 AND NOT (latitude = 0 AND longitude = 0)")
    return p.groupBy("driver_id").agg(F.max_by(F.struct("latitude", "longitude"), F.struct("recorded_at", "id")).alias("x")).select("driver_id", F.col("x.latitude").alias("lat"), F.col("x.longitude").alias("lon"))


_KM = HAV.format(a="r.lat", b="c.lat", c="r.lon", d="c.lon")


@q("join09", f"SELECT zone_id, driver_id, round(km, 4) AS km, round(km / 30 * 60, 4) AS eta_min, rank FROM (SELECT zone_id, driver_id, km, row_number() OVER (PARTITION BY zone_id ORDER BY km, driver_id) AS rank FROM (SELECT r.zone_id, c.driver_id, {_KM} AS km FROM ({_REQ}) r, ({_CAND}) c)) WHERE rank <= 5")
def _(spark, d):
    n = J.nearest(_req(spark, d), _cand(spark, d), request_id="zone_id", candidate_id="driver_id", k=5)
    return n.select("zone_id", "driver_id", F.round("km", 4).alias("km"), F.round(F.col("km") / 30 * 60, 4).alias("eta_min"), "rank")


@q("join10", f"SELECT zone_id, driver_id FROM (SELECT zone_id, driver_id, row_number() OVER (PARTITION BY zone_id ORDER BY km, driver_id) AS rank FROM (SELECT r.zone_id, c.driver_id, {_KM} AS km FROM ({_REQ}) r, ({_CAND}) c)) WHERE rank = 1")
def _(spark, d):
    return J.nearest(_req(spark, d), _cand(spark, d), request_id="zone_id", candidate_id="driver_id", k=1).select("zone_id", "driver_id")


_RATE = "SELECT driver_id, avg(rating) / 5 AS acceptance, max(rating) AS rating FROM driver_snapshots WHERE rating IS NOT NULL AND NOT isnan(rating) GROUP BY driver_id"
_SCORE = "0.5 * least(greatest(1 - km / 5.0, 0), 1) + 0.3 * least(greatest(rating / 5, 0), 1) + 0.2 * least(greatest(acceptance, 0), 1)"


def _matched(spark, d):
    """Candidates within 5 km of a request, by grid cells, with their ratings."""
    from rideloom.operators.proximity import near_pairs

    rates = t(spark, d, "driver_snapshots").where("rating IS NOT NULL AND NOT isnan(rating)").groupBy("driver_id").agg((F.avg("rating") / 5).alias("acceptance"), F.max("rating").alias("rating"))
    r = _req(spark, d).select(F.concat(F.lit("!"), F.col("zone_id")).alias("id"), "lat", "lon", F.lit("request").alias("side"))
    c = _cand(spark, d).select(F.col("driver_id").alias("id"), "lat", "lon", F.lit("driver").alias("side"))
    near = near_pairs(r.unionByName(c), id_col="id", lat="lat", lon="lon", radius_m=5000.0, group="side")
    near = near.select(F.expr("cast(substr(id_a, 2) as int)").alias("zone_id"), F.col("id_b").alias("driver_id"), (F.col("distance_m") / 1000).alias("km"))
    return near.join(rates, "driver_id").withColumn("score", J.match_score(F.col("km"), F.col("rating"), F.col("acceptance"), 5.0))


@q("join11", f"SELECT zone_id, driver_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY score DESC, driver_id) AS rank FROM (SELECT *, {_SCORE} AS score FROM (SELECT r.zone_id, c.driver_id, {_KM} AS km FROM ({_REQ}) r, ({_CAND}) c) JOIN ({_RATE}) USING (driver_id) WHERE km <= 5.0)) WHERE rank <= 10")
def _(spark, d):
    s = _matched(spark, d).withColumn("rank", F.row_number().over(W.partitionBy("zone_id").orderBy(F.desc("score"), "driver_id"))).where("rank <= 10")
    return s.select("zone_id", "driver_id", F.round("score", 6).alias("score"), "rank")


@q("join12", f"SELECT zone_id, driver_id, rank FROM (SELECT zone_id, driver_id, dense_rank() OVER (PARTITION BY zone_id ORDER BY round(score, 4) DESC) AS rank FROM (SELECT *, {_SCORE} AS score FROM (SELECT r.zone_id, c.driver_id, {_KM} AS km FROM ({_REQ}) r, ({_CAND}) c) JOIN ({_RATE}) USING (driver_id) WHERE km <= 5.0 AND rating >= 4.5)) WHERE rank <= 5")
def _(spark, d):
    s = _matched(spark, d).where("rating >= 4.5")
    return s.select("zone_id", "driver_id", F.dense_rank().over(W.partitionBy("zone_id").orderBy(F.desc(F.round("score", 4)))).alias("rank")).where("rank <= 5")


def _costs(spark, d):
    """As many nearest drivers a request as the largest batch has requests: with fewer, others can take all of them; more are never needed."""
    z = t(spark, d, "dim_zones").select("zone_id", F.col("borough").alias("batch"))
    k = z.groupBy("batch").count().agg(F.max("count")).first()[0] or 1
    n = J.nearest(_req(spark, d), _cand(spark, d), request_id="zone_id", candidate_id="driver_id", k=k)
    return n.join(F.broadcast(z), "zone_id").select("batch", F.col("zone_id").alias("request"), F.col("driver_id").alias("candidate"), F.col("km").alias("cost"))  # 40 fixed rows


@q("join13")
def _(spark, d):
    return J.assign(_costs(spark, d), "greedy")


@q("join14")
def _(spark, d):
    return J.assign(_costs(spark, d), "optimal")


_Z = HAV.format(a="a.lat", b="b.lat", c="a.lon", d="b.lon")


@q("join15", f"SELECT a.zone_id AS a, b.zone_id AS b, round({_Z}, 4) AS km FROM ({_REQ}) a JOIN ({_REQ}) b ON a.zone_id < b.zone_id WHERE {_Z} <= 5.0")
def _(spark, d):
    from rideloom.operators.proximity import near_pairs

    z = _req(spark, d).withColumn("id", F.format_string("%06d", "zone_id"))
    p = near_pairs(z, id_col="id", lat="lat", lon="lon", radius_m=5000.0)
    return p.select(F.col("id_a").cast("int").alias("a"), F.col("id_b").cast("int").alias("b"), F.round(F.col("distance_m") / 1000, 4).alias("km"))


@q("join16", "SELECT e.event_id FROM events e JOIN (SELECT user_id, max(ts) AS last_error FROM events WHERE event_type = 'error' GROUP BY user_id) x USING (user_id) WHERE e.ts BETWEEN x.last_error - INTERVAL 1 DAY AND x.last_error")
def _(spark, d):
    e = t(spark, d, "events")
    x = e.where("event_type = 'error'").groupBy("user_id").agg(F.max("ts").alias("last_error"))
    return e.join(x, "user_id").where("ts BETWEEN last_error - INTERVAL 1 DAY AND last_error").select("event_id")


@q("join17", "SELECT DISTINCT least(a.x, a.y) AS a, greatest(a.x, a.y) AS b FROM (SELECT l_suppkey % 500 AS x, l_partkey % 500 AS y FROM lineitem WHERE l_quantity >= 48) a JOIN (SELECT l_suppkey % 500 AS x, l_partkey % 500 AS y FROM lineitem WHERE l_quantity >= 48) b ON a.x = b.y AND a.y = b.x WHERE a.x <> a.y")
def _(spark, d):
    e = t(spark, d, "lineitem").where("l_quantity >= 48").select((F.col("l_suppkey") % 500).alias("x"), (F.col("l_partkey") % 500).alias("y"))
    return J.pairs_both_ways(e, "x", "y")


@q("join17_whole", "SELECT DISTINCT least(a.l_suppkey, a.l_partkey) AS a, greatest(a.l_suppkey, a.l_partkey) AS b FROM lineitem a JOIN lineitem b ON a.l_suppkey = b.l_partkey AND a.l_partkey = b.l_suppkey WHERE a.l_suppkey <> a.l_partkey")
def _(spark, d):
    """All rows with their real ids; the SQL of join17 is bound to a part of the rows and to folded ids."""
    return J.pairs_both_ways(t(spark, d, "lineitem"), "l_suppkey", "l_partkey")


@q("join18", "SELECT p.event_type AS parent, c.event_type AS child, count(*) AS calls FROM (SELECT event_id, event_type FROM events) p JOIN (SELECT event_id, event_type, event_id // 3 AS parent_id FROM events WHERE event_id > 0) c ON c.parent_id = p.event_id GROUP BY ALL")
def _(spark, d):
    e = t(spark, d, "events").select("event_id", "event_type")
    c = e.where("event_id > 0").select(F.expr("event_id div 3").alias("parent_id"), F.col("event_type").alias("child"))
    return c.join(e, c["parent_id"] == e["event_id"]).groupBy(F.col("event_type").alias("parent"), "child").agg(F.count(F.lit(1)).alias("calls"))


@q("join19", "SELECT coalesce(n.p_partkey, o.p_partkey) AS p_partkey, CASE WHEN n.p_partkey IS NOT NULL THEN n.price ELSE o.price END AS price FROM (SELECT p_partkey, p_retailprice AS price FROM part WHERE p_partkey % 3 <> 0) o FULL JOIN (SELECT p_partkey, round(p_retailprice * 2, 2) AS price FROM part WHERE p_partkey % 2 = 0) n ON o.p_partkey = n.p_partkey")
def _(spark, d):
    from rideloom.operators.lake import upsert

    p = t(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("price"))
    return upsert(p.where("p_partkey % 3 <> 0"), p.where("p_partkey % 2 = 0").withColumn("price", F.round(F.col("price") * 2, 2)), ["p_partkey"])


@q("join20", "SELECT coalesce(n.n_name, 'unassigned') AS team, round(sum(s.s_acctbal), 2) AS cost FROM supplier s LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) n ON s.s_nationkey = n.n_nationkey GROUP BY 1")
def _(spark, d):
    n = t(spark, d, "nation").where("n_regionkey <> 2")
    s = t(spark, d, "supplier").join(J.small(n), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return s.groupBy(F.coalesce("n_name", F.lit("unassigned")).alias("team")).agg(F.round(F.sum("s_acctbal"), 2).alias("cost"))


@q("join21", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _(spark, d):
    return t(spark, d, "customer").join(t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@q("join21_month", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = 1995 AND month(o_orderdate) = 1)")
def _(spark, d):
    """Customers without an order in one month: both sides of the anti join have rows."""
    o = t(spark, d, "orders").where((F.year("o_orderdate") == 1995) & (F.month("o_orderdate") == 1))
    return t(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


QUERIES, SQL = book.QUERIES, book.SQL
