"""Scalar functions, geometry, pricing and closed-form models over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rideloom.common import table as t
from rideloom.functions import geo as G
from rideloom.functions import models as M
from rideloom.functions import scalar as S
from rideloom.plans.book import Book

book = Book()
q = book.query


def r(c, k=5):
    return F.round(c, k)


@q("fn01", "SELECT event_id, CASE WHEN value < 10 THEN 'low' WHEN value < 50 THEN 'mid' WHEN value < 100 THEN 'high' ELSE 'top' END AS band FROM events")
def _(spark, d):
    return t(spark, d, "events").select("event_id", S.bucketise(F.col("value"), [10, 50, 100], ["low", "mid", "high", "top"]).alias("band"))


@q("fn02", "SELECT event_id, round(ln(1 + value), 5) AS logged, round(exp(ln(1 + value)) - 1, 5) AS back FROM events")
def _(spark, d):
    return t(spark, d, "events").select("event_id", r(F.log1p("value")).alias("logged"), r(F.expm1(F.log1p("value"))).alias("back"))


@q("fn03", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity * l_discount, 5) AS product, round(CASE WHEN l_discount = 0 THEN 0 ELSE l_quantity / l_discount END, 5) AS ratio FROM lineitem")
def _(spark, d):
    a, b = F.col("l_quantity"), F.col("l_discount")
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r(S.interact(a, b, "multiply")).alias("product"), r(S.interact(a, b, "ratio")).alias("ratio"))


@q("fn04", "SELECT event_id, round((value - avg(value) OVER ()) / stddev_pop(value) OVER (), 5) AS z FROM events")
def _(spark, d):
    return S.standard(t(spark, d, "events").select("event_id", "value"), ["value"]).select("event_id", r("value_z").alias("z"))


@q("fn05", "SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 5) AS u FROM customer")
def _(spark, d):
    return S.min_max(t(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]).select("c_custkey", r("c_acctbal_u").alias("u"))


@q("fn06", "SELECT event_type AS value, row_number() OVER (ORDER BY min(event_id), event_type) - 1 AS index FROM events GROUP BY 1")
def _(spark, d):
    return S.category_index(t(spark, d, "events"), "event_type", "event_id")


@q("fn07", "SELECT event_id, round(sin(2 * pi() * hour(ts) / 24), 5) AS s, round(cos(2 * pi() * hour(ts) / 24), 5) AS c FROM events")
def _(spark, d):
    a = 2 * F.pi() * F.hour("ts") / 24
    return t(spark, d, "events").select("event_id", r(F.sin(a)).alias("s"), r(F.cos(a)).alias("c"))


_V = "SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings"
_C0 = f"WITH v AS ({_V}), z AS (SELECT e FROM v WHERE vec_id = 0)"
_COS = "list_dot_product(v.e, z.e) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(z.e, z.e)))"


def _with_first(spark, d):
    v = t(spark, d, "embeddings")
    z = v.where("vec_id = 0").select(F.col("embedding").alias("z"))
    return v.crossJoin(F.broadcast(z))  # one row


@q("fn08", f"{_C0} SELECT vec_id, round({_COS}, 5) AS cosine, round(list_distance(v.e, z.e), 5) AS distance FROM v, z")
def _(spark, d):
    return _with_first(spark, d).select("vec_id", r(S.cosine(F.col("embedding"), F.col("z"))).alias("cosine"), r(S.euclidean(F.col("embedding"), F.col("z"))).alias("distance"))


@q("fn09", f"{_C0} SELECT vec_id, round({_COS}, 5) AS cosine FROM v, z WHERE vec_id <> 0 ORDER BY {_COS} DESC, vec_id LIMIT 10")
def _(spark, d):
    x = _with_first(spark, d).where("vec_id <> 0").withColumn("c", S.cosine(F.col("embedding"), F.col("z")))
    return x.orderBy(F.desc("c"), "vec_id").limit(10).select("vec_id", r("c").alias("cosine"))


@q("fn10", f"{_C0} SELECT vec_id, round(list_dot_product(v.e[1:32], z.e[1:32]) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(z.e[1:32], z.e[1:32]))), 4) AS cosine FROM v, z")
def _(spark, d):
    """A query vector of half the length is padded with zeros."""
    x = _with_first(spark, d)
    half = F.transform(F.slice("z", 1, 32), lambda v: v.cast("double"))
    size = len(x.select("z").first()["z"])
    return x.select("vec_id", r(S.cosine(F.col("embedding"), S.fitted(half, size)), 4).alias("cosine"))


_UI = "SELECT l_suppkey AS u, l_partkey AS i, avg(l_quantity) AS r FROM lineitem GROUP BY ALL"


@q("fn11", f"WITH x AS ({_UI}) SELECT a.u AS a, b.u AS b, round(sum(a.r * b.r) / (sqrt(sum(a.r * a.r)) * sqrt(sum(b.r * b.r))), 5) AS similarity FROM x a JOIN x b ON a.i = b.i AND a.u < b.u GROUP BY ALL")
def _(spark, d):
    """Over co-rated items only."""
    x = t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("i")).agg(F.avg("l_quantity").alias("r"))
    a, b = x.select("i", F.col("u").alias("a"), F.col("r").alias("ra")), x.select("i", F.col("u").alias("b"), F.col("r").alias("rb"))
    j = a.join(b, "i").where("a < b")
    return j.groupBy("a", "b").agg(r(F.sum(F.col("ra") * F.col("rb")) / (F.sqrt(F.sum(F.col("ra") ** 2)) * F.sqrt(F.sum(F.col("rb") ** 2)))).alias("similarity"))


_B = "(('0x' || substr(md5(c_name), 1, 8))::UBIGINT % 10000 * 336 + ('0x' || substr(md5(c_name), 9, 8))::UBIGINT % 10000 * 1616 + ('0x' || substr(md5(c_name), 17, 8))::UBIGINT % 10000 * 7296 + ('0x' || substr(md5(c_name), 25, 8))::UBIGINT % 10000) % 10000"


@q("fn12", f"SELECT c_custkey, CAST({_B} AS BIGINT) AS bucket, CASE WHEN {_B} < 5000 THEN 'a' WHEN {_B} < 8000 THEN 'b' ELSE 'c' END AS arm FROM customer")
def _(spark, d):
    b = S.md5_bucket(F.col("c_name"))
    return t(spark, d, "customer").select("c_custkey", b.alias("bucket"), F.when(b < 5000, "a").when(b < 8000, "b").otherwise("c").alias("arm"))


@q("fn13", f"SELECT count(*) FILTER (WHERE {_B} / 100.0 < 5) AS canary, count(*) AS users FROM customer")
def _(spark, d):
    return t(spark, d, "customer").agg(F.count_if(S.md5_bucket(F.col("c_name")) / 100.0 < 5).alias("canary"), F.count(F.lit(1)).alias("users"))


@q("fn14", "SELECT event_id FROM events WHERE regexp_full_match('ride.' || event_type || '.' || user_id, 'ride[.][^.]+[.]1[0-9]*') AND 'ride.' || event_type || '.' || user_id LIKE 'ride.%'")
def _(spark, d):
    topic = F.concat_ws(".", F.lit("ride"), "event_type", F.col("user_id").cast("string"))
    return t(spark, d, "events").where(topic.rlike(S.topic_pattern("ride.*.*")) & topic.rlike(S.topic_pattern("ride.#")) & F.col("user_id").cast("string").startswith("1")).select("event_id")


@q("fn15", "SELECT event_id, md5(CAST(event_id AS VARCHAR)) AS trace_id, substr(md5(event_type), 1, 16) AS span_id, event_id % 2 = 1 AS sampled FROM events WHERE event_id % 5 <> 0")
def _(spark, d):
    e = t(spark, d, "events").withColumn("h", F.concat_ws("-", F.lit("00"), F.when(F.col("event_id") % 5 != 0, F.md5(F.col("event_id").cast("string"))).otherwise("short"), F.substring(F.md5("event_type"), 1, 16), F.when(F.col("event_id") % 2 == 1, "01").otherwise("00")))
    return e.select("event_id", S.trace_parts(F.col("h")).alias("x")).where("x IS NOT NULL").select("event_id", "x.*")


@q("fn16", "SELECT event_id, strftime(ts, '%Y-%m-%d-%H') AS hour_key, strftime(ts, '%Y-%m-%d') AS day_key FROM events")
def _(spark, d):
    return t(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd-HH").alias("hour_key"), F.date_format("ts", "yyyy-MM-dd").alias("day_key"))


@q("fn17", "SELECT o_orderkey, CASE WHEN length(s) >= 7 THEN substr(s, 1, 7) ELSE s END AS month FROM (SELECT o_orderkey, substr(strftime(o_orderdate, '%Y-%m-%d'), 1, CAST(o_orderkey % 10 AS INT) + 1) AS s FROM orders)")
def _(spark, d):
    s = F.substring(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(1), (F.col("o_orderkey") % 10 + 1).cast("int"))
    return t(spark, d, "orders").select("o_orderkey", F.when(F.length(s) >= 7, F.substring(s, 1, 7)).otherwise(s).alias("month"))


@q("fn18", "SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS text FROM (SELECT event_id, CAST(floor(value * 60) AS BIGINT) AS s FROM events)")
def _(spark, d):
    return t(spark, d, "events").select("event_id", S.duration_text(F.floor(F.col("value") * 60)).alias("text"))


_HAV = "2 * {r} * asin(least(1.0, sqrt(pow(sin(radians(44.15 - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(44.15)) * pow(sin(radians(-31.5 - longitude) / 2), 2))))"
_PTS = "(SELECT DISTINCT id, latitude, longitude FROM driver_locations WHERE abs(latitude) <= 90)"


def _pts(spark, d):
    return t(spark, d, "driver_locations").where("abs(latitude) <= 90").select("id", "latitude", "longitude").distinct()


def _here():
    return F.col("latitude"), F.col("longitude"), F.lit(44.15), F.lit(-31.5)


@q("geo01", f"SELECT id, round({_HAV.format(r='6371.0')}, 5) AS km FROM {_PTS}")
def _(spark, d):
    return _pts(spark, d).select("id", r(G.haversine(*_here(), G.EARTH_KM)).alias("km"))


@q("geo02", f"SELECT id, round({_HAV.format(r='3958.8')}, 5) AS miles FROM {_PTS}")
def _(spark, d):
    return _pts(spark, d).select("id", r(G.haversine(*_here(), G.EARTH_MILES)).alias("miles"))


@q("geo03", f"SELECT id, round(CASE WHEN b < 0 THEN b + 360 ELSE b END, 5) AS bearing FROM (SELECT id, degrees(atan2(sin(radians(-31.5 - longitude)) * cos(radians(44.15)), cos(radians(latitude)) * sin(radians(44.15)) - sin(radians(latitude)) * cos(radians(44.15)) * cos(radians(-31.5 - longitude)))) AS b FROM {_PTS})")
def _(spark, d):
    return _pts(spark, d).select("id", r(G.bearing(*_here())).alias("bearing"))


@q("geo04", f"SELECT id, round(degrees(la2), 6) AS lat, round(degrees(radians(longitude) + atan2(sin(radians(45)) * sin(5 / 6371.0) * cos(radians(latitude)), cos(5 / 6371.0) - sin(radians(latitude)) * sin(la2))), 6) AS lon FROM (SELECT *, asin(sin(radians(latitude)) * cos(5 / 6371.0) + cos(radians(latitude)) * sin(5 / 6371.0) * cos(radians(45))) AS la2 FROM {_PTS})")
def _(spark, d):
    la, lo = G.destination(F.col("latitude"), F.col("longitude"), F.lit(45.0), F.lit(5.0))
    return _pts(spark, d).select("id", la.alias("lat"), lo.alias("lon"))


@q("geo05", f"SELECT id FROM {_PTS} WHERE latitude > 44.1 AND longitude > -31.6 AND (latitude - 44.1) / 0.1 + (longitude + 31.6) / 0.2 < 1")
def _(spark, d):
    from rideloom.operators.proximity import in_polygon

    ring = F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in ((44.1, -31.6), (44.2, -31.6), (44.1, -31.4))])
    return _pts(spark, d).where(in_polygon(F.col("latitude"), F.col("longitude"), ring)).select("id")


@q("geo06", f"SELECT id, round(greatest(latitude - 2 / 111.32, -90), 6) AS lat_min, round(least(longitude + 2 / 111.32 / greatest(cos(radians(latitude)), 1e-9), 180), 6) AS lon_max FROM {_PTS}")
def _(spark, d):
    b = G.box_around(F.col("latitude"), F.col("longitude"), 2.0)
    return _pts(spark, d).select("id", r(b["lat_min"], 6).alias("lat_min"), r(b["lon_max"], 6).alias("lon_max"))


@q("geo07")
def _(spark, d):
    p = _pts(spark, d)
    return p.select(G.geohash(F.col("latitude"), F.col("longitude"), 6).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


@q("geo08", f"SELECT id, true AS inside FROM {_PTS}")
def _(spark, d):
    """Each point lies in the box its code decodes to."""
    p = _pts(spark, d).withColumn("b", G.geohash_box(G.geohash(F.col("latitude"), F.col("longitude"), 8)))
    return p.select("id", (F.col("latitude").between(F.col("b.lat_min"), F.col("b.lat_max")) & F.col("longitude").between(F.col("b.lon_min"), F.col("b.lon_max"))).alias("inside"))


@q("geo09", "SELECT zone_id, 8 AS cells FROM dim_zones")
def _(spark, d):
    return t(spark, d, "dim_zones").select("zone_id", F.size(G.geohash_neighbours(F.col("lat_min"), F.col("lon_min"), 6)).alias("cells"))


@q("geo10")
def _(spark, d):
    """Cells that cover each zone's box, by steps of half a cell."""
    h, w = 180.0 / 2**15, 360.0 / 2**15
    steps = lambda a, b, s: F.concat(F.transform(F.sequence(F.lit(0), F.floor((F.col(b) - F.col(a)) / (s / 2)).cast("int")), lambda i: F.col(a) + i * (s / 2)), F.array(F.col(b)))
    z = t(spark, d, "dim_zones").withColumn("la", F.explode(steps("lat_min", "lat_max", h))).withColumn("lo", F.explode(steps("lon_min", "lon_max", w)))
    return z.select("zone_id", G.geohash(F.col("la"), F.col("lo"), 6).alias("cell")).distinct()


@q("geo11", f"SELECT '5_' || CAST(trunc(longitude / 0.3125 * (2.0::DOUBLE / 3)) AS INT) || '_' || CAST(trunc((latitude - longitude * 0.5) / 0.3125 * (2.0::DOUBLE / 3)) AS INT) AS cell, count(*) AS n FROM {_PTS} GROUP BY 1")
def _(spark, d):
    return _pts(spark, d).groupBy(G.hex_cell(F.col("latitude"), F.col("longitude"), 5).alias("cell")).agg(F.count(F.lit(1)).alias("n"))


@q("geo12", "SELECT z.zone_id, z.zone_id + i AS q, j AS r FROM dim_zones z, range(-2, 3) ri(i), range(-2, 3) rj(j) WHERE abs(i + j) <= 2")
def _(spark, d):
    z = t(spark, d, "dim_zones").select("zone_id", F.explode(G.hex_disk(F.col("zone_id").cast("long"), F.lit(0).cast("long"), 2)).alias("c"))
    return z.select("zone_id", "c.q", "c.r")


_DS = "SELECT zone_id, count(*) FILTER (WHERE status = 'busy') AS demand, count(*) FILTER (WHERE status = 'online') AS supply FROM processed_locations WHERE zone_id IS NOT NULL GROUP BY 1"


def _ds(spark, d):
    return t(spark, d, "processed_locations").where("zone_id IS NOT NULL").groupBy("zone_id").agg(F.count_if(F.col("status") == "busy").alias("demand"), F.count_if(F.col("status") == "online").alias("supply"))


@q("prc01", f"SELECT zone_id, round(CASE WHEN supply <= 0 THEN 3.0 ELSE least(greatest(1 + 0.5 * greatest(demand / supply - 1, 0), 1), 3) END, 5) AS linear, round(CASE WHEN supply <= 0 THEN 3.0 ELSE least(greatest(exp(0.5 * greatest(demand / supply - 1, 0)), 1), 3) END, 5) AS exponential FROM ({_DS})")
def _(spark, d):
    a, b = F.col("demand"), F.col("supply")
    return _ds(spark, d).select("zone_id", r(M.surge(a, b)).alias("linear"), r(M.surge(a, b, "exponential")).alias("exponential"))


@q("prc02", "SELECT o_orderkey, round(greatest((2.5 + 1.5 * (o_totalprice / 20000) + 0.3 * 10) * 1.25, 5.0), 2) AS fare FROM orders")
def _(spark, d):
    return t(spark, d, "orders").select("o_orderkey", M.fare(F.col("o_totalprice") / 20000, F.lit(10.0), F.lit(1.25)).alias("fare"))


@q("prc03", f"SELECT zone_id, round(demand * pow(1.2::DOUBLE, -0.8), 5) AS demand_after FROM ({_DS})")
def _(spark, d):
    return _ds(spark, d).select("zone_id", r(M.demand_after(F.col("demand"), F.lit(10.0), F.lit(12.0), -0.8)).alias("demand_after"))


@q("prc04", "SELECT h.h AS hour, round(coalesce(busy, 0) / greatest(coalesce(online, 0), 1), 5) AS ratio FROM range(0, 24) h(h) LEFT JOIN (SELECT hour(timezone('UTC', recorded_at)) AS h, count(*) FILTER (WHERE status = 'busy') AS busy, count(*) FILTER (WHERE status = 'online') AS online FROM processed_locations GROUP BY 1) x ON h.h = x.h")
def _(spark, d):
    x = t(spark, d, "processed_locations").groupBy(F.hour("recorded_at").alias("hour")).agg(F.count_if(F.col("status") == "busy").alias("busy"), F.count_if(F.col("status") == "online").alias("online"))
    h = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    return h.join(x, "hour", "left").select("hour", r(F.coalesce("busy", F.lit(0)) / F.greatest(F.coalesce("online", F.lit(0)), F.lit(1))).alias("ratio"))


@q("prc05", "SELECT driver_key, round(least(greatest(rating / 5.0, 0), 1), 5) AS rating_n, round(least(greatest(1 - total_trips / 5000.0, 0), 1), 5) AS trips_n FROM dim_drivers WHERE rating IS NOT NULL AND NOT isnan(rating)")
def _(spark, d):
    cut = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    x = t(spark, d, "dim_drivers").where("rating IS NOT NULL AND NOT isnan(rating)")
    return x.select("driver_key", r(cut(F.col("rating").cast("double") / 5)).alias("rating_n"), r(cut(1 - F.col("total_trips") / 5000.0)).alias("trips_n"))


@q("prc06", "SELECT event_type, round(avg(CASE WHEN value < 20 THEN 1.0 WHEN value < 80 THEN 1.3 ELSE 1.8 END), 5) AS multiplier FROM events GROUP BY 1")
def _(spark, d):
    v = F.col("value")
    return t(spark, d, "events").groupBy("event_type").agg(r(F.avg(F.when(v < 20, 1.0).when(v < 80, 1.3).otherwise(1.8))).alias("multiplier"))


@q("prc07", "SELECT zone_id, round(avg(CAST(speed_kmh / 50 < 0.5 AS INT)), 5) AS congested, CASE WHEN avg(speed_kmh) / 50 < 0.25 THEN 'severe' WHEN avg(speed_kmh) / 50 < 0.5 THEN 'heavy' WHEN avg(speed_kmh) / 50 < 0.75 THEN 'moderate' ELSE 'free' END AS level FROM processed_locations WHERE speed_kmh > 0 AND speed_kmh < 250 GROUP BY 1")
def _(spark, d):
    ratio = F.avg("speed_kmh") / 50
    p = t(spark, d, "processed_locations").where("speed_kmh > 0 AND speed_kmh < 250")
    return p.groupBy("zone_id").agg(r(F.avg((F.col("speed_kmh") / 50 < 0.5).cast("int"))).alias("congested"), F.when(ratio < 0.25, "severe").when(ratio < 0.5, "heavy").when(ratio < 0.75, "moderate").otherwise("free").alias("level"))


@q("que01", f"SELECT zone_id, round(a / 50.0, 6) AS utilisation, round((a / 50.0) / (1 - a / 50.0), 6) AS in_system, round(erl, 6) AS waits FROM (SELECT zone_id, demand % 40 + 1 AS a, (pow(x, 3) / 6 * 3 / (3 - x)) / (1 + x + pow(x, 2) / 2 + pow(x, 3) / 6 * 3 / (3 - x)) AS erl FROM (SELECT *, (demand % 40 + 1) / 20.0 AS x FROM ({_DS})))")
def _(spark, d):
    x = _ds(spark, d).withColumn("a", F.col("demand") % 40 + 1)
    m = M.mm1(F.col("a").cast("double"), F.lit(50.0))
    return x.select("zone_id", r(m["utilisation"], 6).alias("utilisation"), r(m["in_system"], 6).alias("in_system"), r(M.erlang_c(F.col("a") / 20.0, 3), 6).alias("waits"))


@q("cap01", "SELECT event_type, CAST(ceil(1.3 * peak / 7.0) AS BIGINT) AS instances, round(CASE WHEN peak >= 50 THEN 0 ELSE ln(50.0 / peak) / ln(1.1::DOUBLE) END, 4) AS periods FROM (SELECT event_type, max(n) AS peak FROM (SELECT event_type, date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1)")
def _(spark, d):
    x = t(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("h")).agg(F.count(F.lit(1)).alias("n")).groupBy("event_type").agg(F.max("n").alias("peak"))
    return x.select("event_type", M.instances(F.col("peak"), 7.0).alias("instances"), r(M.exhausted_after(F.col("peak"), 50.0, 0.1), 4).alias("periods"))


@q("city01", f"SELECT zone_id, round((2.0 + 1.2 * 3 + 0.25 * 8) * least(greatest(demand / greatest(supply, 1), 1), 3), 5) AS fare, round(0.5 / (1 + 2.0) + 0.3 * 4.5 / 5 + 0.2 * least(demand / 100.0, 1), 5) AS score FROM ({_DS})")
def _(spark, d):
    """The simulation's own pricing: no minimum, no rounding of the fare itself."""
    s = F.least(F.greatest(F.col("demand") / F.greatest(F.col("supply"), F.lit(1)), F.lit(1.0)), F.lit(3.0))
    return _ds(spark, d).select("zone_id", r((2.0 + 1.2 * 3 + 0.25 * 8) * s).alias("fare"), r(0.5 / F.lit(3.0) + 0.3 * 4.5 / 5 + 0.2 * F.least(F.col("demand") / 100.0, F.lit(1.0))).alias("score"))


@q("crd01", "SELECT c.user_id, c.total, w.value AS register FROM (SELECT user_id, sum(m) AS total FROM (SELECT user_id, event_type AS node, max(event_id % 100) AS m FROM events GROUP BY ALL) GROUP BY 1) c JOIN (SELECT user_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1) w USING (user_id)")
def _(spark, d):
    """Grow-only counters merge by the greatest count of each node; a register keeps the last write."""
    e = t(spark, d, "events")
    c = e.groupBy("user_id", "event_type").agg(F.max(F.col("event_id") % 100).alias("m")).groupBy("user_id").agg(F.sum("m").alias("total"))
    w = e.groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("register"))
    return c.join(w, "user_id")


QUERIES, SQL = book.QUERIES, book.SQL
