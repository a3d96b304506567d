"""Aggregations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rideloom.common import table as t
from rideloom.operators import aggregates as A
from rideloom.plans.book import Book

book = Book()
q = book.query


def n_rows():
    return F.count(F.lit(1))


r4 = lambda c: F.round(c, 4)


@q("agg01", "SELECT l_returnflag, round(avg(l_extendedprice), 4) AS value FROM lineitem GROUP BY 1")
def _(spark, d):
    return A.measure(t(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "avg")


@q("agg02", "SELECT source, round(coalesce(sum(speed), 0.0), 2) AS total, round(coalesce(max(accuracy), 0.0), 2) AS worst, count(*) AS record_count FROM (SELECT source, CAST(CASE WHEN isnan(speed) THEN NULL ELSE speed END AS DOUBLE) AS speed, CAST(CASE WHEN isnan(accuracy) THEN NULL ELSE accuracy END AS DOUBLE) AS accuracy FROM driver_locations) GROUP BY source")
def _(spark, d):
    p = t(spark, d, "driver_locations").select("source", *[F.when(~F.isnan(c), F.col(c).cast("double")).alias(c) for c in ("speed", "accuracy")])
    g = A.gold(p, ["source"], {"total": ("speed", "sum"), "worst": ("accuracy", "max")})
    return g.withColumns({c: F.round(c, 2) for c in ("total", "worst")})


@q("agg03", "SELECT event_type, round(sum(value) FILTER (WHERE value < 100) / count(*), 4) AS avg_all, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    """The view's average counts rows without a value in its denominator."""
    e = t(spark, d, "events").withColumn("v", F.when(F.col("value") < 100, F.col("value")))
    s = A.merged_states(A.states(e.where("event_id % 2 = 0"), ["event_type"], "v"), A.states(e.where("event_id % 2 = 1"), ["event_type"], "v"))
    return s.select("event_type", r4(F.col("sum") / F.col("rows")).alias("avg_all"), F.col("rows").alias("n"))


@q("agg04", "SELECT l_suppkey, round(sum(l_quantity), 2) AS total, count(l_quantity) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1")
def _(spark, d):
    s = A.merged_states(*[A.states(t(spark, d, "lineitem").where(f"l_linenumber % 3 = {i}"), ["l_suppkey"], "l_quantity") for i in range(3)])
    return s.select("l_suppkey", F.round("sum", 2).alias("total"), F.col("count").alias("n"), F.col("min").alias("lo"), F.col("max").alias("hi"))


@q("agg05", "SELECT l_orderkey, round(sum(l_extendedprice), 2) AS price, arg_min(l_shipdate, (l_linenumber, l_partkey, l_suppkey)) AS first_ship FROM lineitem GROUP BY 1")
def _(spark, d):
    return t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("price"), F.min_by("l_shipdate", F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("first_ship"))


@q("agg06", "SELECT CAST(floor(epoch(recorded_at) / 3600) AS BIGINT) AS hour, zone_id, count(*) AS n, round(sum(speed_kmh), 2) AS speed_sum, round(sum(speed_kmh) / count(speed_kmh), 8) AS speed_avg FROM processed_locations WHERE NOT isnan(speed_kmh) GROUP BY ALL")
def _(spark, d):
    p = t(spark, d, "processed_locations").where(~F.isnan("speed_kmh"))
    h = F.expr("unix_seconds(recorded_at) div 3600")
    return p.groupBy(h.alias("hour"), "zone_id").agg(n_rows().alias("n"), F.round(F.sum("speed_kmh"), 2).alias("speed_sum"), F.round(F.sum("speed_kmh") / F.count("speed_kmh"), 8).alias("speed_avg"))


@q("agg07", "SELECT CAST(o_orderdate AS DATE)::VARCHAR AS day, c_nationkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def _(spark, d):
    o = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "c_nationkey").agg(n_rows().alias("n"))


@q("agg08", "SELECT driver_id, count(*) AS pings, round(avg(accuracy), 4) AS accuracy_avg, round(max(accuracy), 2) AS accuracy_max FROM (SELECT driver_id, CAST(accuracy AS DOUBLE) AS accuracy FROM driver_locations WHERE NOT isnan(accuracy)) GROUP BY 1")
def _(spark, d):
    p = t(spark, d, "driver_locations").where("accuracy IS NOT NULL AND NOT isnan(accuracy)").select("driver_id", F.col("accuracy").cast("double"), F.to_date("recorded_at").alias("day"))
    days = A.states(p, ["driver_id", "day"], "accuracy")  # kept states, merged below
    s = days.groupBy("driver_id").agg(F.sum("rows").alias("pings"), r4(F.sum("sum") / F.sum("count")).alias("accuracy_avg"), F.round(F.max("max"), 2).alias("accuracy_max"))
    return s


@q("agg09", "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    return t(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "event_type").agg(n_rows().alias("n"))


@q("agg10", "SELECT event_type, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, min(value) AS lo, max(value) AS hi, count(value) AS n FROM events GROUP BY 1")
def _(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(r4(F.sum("value")).alias("total"), r4(F.avg("value")).alias("mean"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("value").alias("n"))


@q("agg11", "SELECT event_type, round(CASE WHEN count(*) < 2 THEN 0 ELSE (arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id))) / count(*) END, 6) AS rate FROM events GROUP BY 1")
def _(spark, d):
    at = F.struct("ts", "event_id")
    rate = F.when(n_rows() < 2, 0.0).otherwise((F.max_by("value", at) - F.min_by("value", at)) / n_rows())
    return t(spark, d, "events").groupBy("event_type").agg(F.round(rate, 6).alias("rate"))


@q("agg12", "SELECT event_type, list_sort(list(value))[CAST(least(floor(count(value) * 0.95), count(value) - 1) AS BIGINT) + 1] AS value FROM events GROUP BY 1")
def _(spark, d):
    return A.ranked_value(t(spark, d, "events"), ["event_type"], "value", 0.95)


@q("agg13", "SELECT event_type, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.9), 4) AS p90, round(quantile_cont(value, 0.99), 4) AS p99 FROM events GROUP BY 1")
def _(spark, d):
    x = A.interpolated(t(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    return x.select("event_type", *[r4(F.col(c)).alias(c) for c in ("p50", "p90", "p99")])


@q("agg14", "SELECT count(*) AS n, round(avg(value), 4) AS mean, min(value) AS lo, max(value) AS hi, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99 FROM events")
def _(spark, d):
    e = t(spark, d, "events")
    x = A.interpolated(e, [], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).select(*[r4(F.col(c)).alias(c) for c in ("p50", "p95", "p99")])
    return e.agg(n_rows().alias("n"), r4(F.avg("value")).alias("mean"), F.min("value").alias("lo"), F.max("value").alias("hi")).crossJoin(F.broadcast(x))  # one row each


@q("agg15", "SELECT CASE WHEN value < 10 THEN '0-10' WHEN value < 50 THEN '10-50' WHEN value < 100 THEN '50-100' ELSE '100+' END AS bucket, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    v = F.col("value")
    return t(spark, d, "events").groupBy(F.when(v < 10, "0-10").when(v < 50, "10-50").when(v < 100, "50-100").otherwise("100+").alias("bucket")).agg(n_rows().alias("n"))


@q("agg16", "SELECT CASE WHEN le > 1e300 THEN '+Inf' ELSE CAST(CAST(le AS INT) AS VARCHAR) END AS le, count(*) FILTER (WHERE value <= le) AS n FROM events, (VALUES (5.0::DOUBLE), (10), (25), (50), (100), ('Infinity'::DOUBLE)) b(le) GROUP BY ALL")
def _(spark, d):
    les = [5.0, 10.0, 25.0, 50.0, 100.0, float("inf")]
    one = t(spark, d, "events").agg(*[F.count_if(F.col("value") <= x).alias(f"b{i}") for i, x in enumerate(les)])
    return one.select(F.explode(F.array(*[F.struct(F.lit("+Inf" if x == float("inf") else str(int(x))).alias("le"), F.col(f"b{i}").alias("n")) for i, x in enumerate(les)])).alias("x")).select("x.*")


@q("agg17", "SELECT user_id, round(quantile_cont(value, 0.5), 4) AS p50 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 20 GROUP BY 1")
def _(spark, d):
    w = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    e = t(spark, d, "events").withColumn("rn", F.row_number().over(w)).where("rn <= 20")
    return e.groupBy("user_id").agg(r4(F.percentile("value", F.lit(0.5))).alias("p50"))


@q("agg18", "SELECT event_type, round((count(*) FILTER (WHERE value < 40) + 0.5 * count(*) FILTER (WHERE value >= 40 AND value < 160)) / count(value), 4) AS apdex FROM events GROUP BY 1")
def _(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(r4(A.apdex(F.col("value"), 40.0)).alias("apdex"))


@q("agg19", "SELECT l_suppkey AS zone, rides, avg_fare, row_number() OVER (ORDER BY rides DESC, l_suppkey) AS rank FROM (SELECT l_suppkey, count(*) AS rides, round(sum(l_extendedprice) / count(*), 2) AS avg_fare FROM lineitem GROUP BY 1 ORDER BY rides DESC, l_suppkey LIMIT 10)")
def _(spark, d):
    from rideloom.operators.relational import ranked

    z = t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("zone")).agg(n_rows().alias("rides"), F.round(F.sum("l_extendedprice") / n_rows(), 2).alias("avg_fare"))
    return ranked(z, [F.desc("rides"), F.col("zone")], 10)


@q("agg20", "SELECT count(*) AS pings, count(DISTINCT driver_id) AS drivers, count(DISTINCT zone_id) AS zones, round(count(*) / nullif(count(DISTINCT driver_id), 0), 4) AS per_driver, round(avg(CAST(status = 'busy' AS INT)), 4) AS busy FROM processed_locations")
def _(spark, d):
    p = t(spark, d, "processed_locations")
    return p.agg(n_rows().alias("pings"), F.count_distinct("driver_id").alias("drivers"), F.count_distinct("zone_id").alias("zones"), r4(F.try_divide(n_rows(), F.count_distinct("driver_id"))).alias("per_driver"), r4(F.avg((F.col("status") == "busy").cast("int"))).alias("busy"))


@q("agg21", "SELECT c_nationkey AS origin, s_nationkey AS destination, round(avg(date_diff('day', o_orderdate, l_shipdate)), 4) AS mean_days FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL")
def _(spark, d):
    x = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return x.groupBy(F.col("c_nationkey").alias("origin"), F.col("s_nationkey").alias("destination")).agg(r4(F.avg(F.datediff("l_shipdate", "o_orderdate"))).alias("mean_days"))


@q("agg22", "SELECT tag, round(sum(p_retailprice), 2) AS cost, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS tag, p_retailprice FROM part) GROUP BY 1")
def _(spark, d):
    p = t(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("tag"), "p_retailprice")
    return p.groupBy("tag").agg(F.round(F.sum("p_retailprice"), 2).alias("cost"), n_rows().alias("n"))


@q("agg23", "SELECT s_suppkey, round(10000.0 * (s_acctbal + 1000) / sum(s_acctbal + 1000) OVER (PARTITION BY s_nationkey), 4) AS part, round(10000.0 / count(*) OVER (PARTITION BY s_nationkey), 4) AS even FROM supplier")
def _(spark, d):
    w = W.partitionBy("s_nationkey")
    use = F.col("s_acctbal") + 1000
    return t(spark, d, "supplier").select("s_suppkey", r4(10000.0 * use / F.sum(use).over(w)).alias("part"), r4(10000.0 / n_rows().over(w)).alias("even"))


@q("agg24", "SELECT count(DISTINCT CAST(speed_kmh AS VARCHAR)) AS speeds, count(DISTINCT status) AS states, count(DISTINCT zone_id) AS zones FROM processed_locations")
def _(spark, d):
    return t(spark, d, "processed_locations").agg(F.count_distinct(F.col("speed_kmh").cast("string")).alias("speeds"), F.count_distinct("status").alias("states"), F.count_distinct("zone_id").alias("zones"))


@q("agg25")
def _(spark, d):
    """Approximate distinct from sketches of parts, merged."""
    o = t(spark, d, "orders")
    parts = o.groupBy("o_orderpriority").agg(F.hll_sketch_agg("o_custkey", F.lit(12)).alias("sketch"))
    return parts.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("customers"))


@q("agg26", "SELECT c AS \"column\", count(*) AS rows, count(*) - count(v) AS nulls, min(v) AS min, max(v) AS max, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, round(quantile_cont(v, 0.5), 4) AS median FROM (SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS c, unnest([l_quantity, l_discount, l_tax]) AS v FROM lineitem) GROUP BY 1")
def _(spark, d):
    return A.profile(t(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"])


@q("agg27", "WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events), b AS (SELECT unnest(range(0, 12)) AS bin), c AS (SELECT CAST(least(floor((value - lo) / ((hi - lo) / 12)), 11) AS INT) AS bin, count(*) AS n FROM events, e GROUP BY 1) SELECT CAST(b.bin AS INT) AS bin, round(lo + b.bin * ((hi - lo) / 12), 4) AS lo, round(lo + (b.bin + 1) * ((hi - lo) / 12), 4) AS hi, coalesce(n, 0) AS n FROM e, b LEFT JOIN c ON b.bin = c.bin")
def _(spark, d):
    return A.equal_width(t(spark, d, "events"), "value", 12)


@q("agg28", "WITH m AS (SELECT event_type, avg(value) AS m FROM events GROUP BY 1) SELECT event_type, round(avg(pow(value - m, 3)) / pow(avg(pow(value - m, 2)), 1.5), 4) AS skew FROM events JOIN m USING (event_type) GROUP BY 1")
def _(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(r4(F.skewness("value")).alias("skew"))


@q("agg29", "SELECT user_id % 20 AS service, count(*) AS spans, round(avg(value), 4) AS mean, round(avg(CAST(event_type = 'error' AS INT)) * 100, 4) AS errors FROM events GROUP BY 1")
def _(spark, d):
    return t(spark, d, "events").groupBy((F.col("user_id") % 20).alias("service")).agg(n_rows().alias("spans"), r4(F.avg("value")).alias("mean"), r4(F.avg((F.col("event_type") == "error").cast("int")) * 100).alias("errors"))


@q("agg30", "SELECT user_id AS trace, count(DISTINCT event_type) AS services, arg_min(event_type, (ts, event_id)) AS root, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS seconds FROM events GROUP BY 1")
def _(spark, d):
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return t(spark, d, "events").groupBy(F.col("user_id").alias("trace")).agg(F.count_distinct("event_type").alias("services"), F.min_by("event_type", F.struct("ts", "event_id")).alias("root"), F.round((us(F.max("ts")) - us(F.min("ts"))) / 1e6, 3).alias("seconds"))


@q("agg31", "SELECT source, lang, count(*) AS n, count(ride_id) AS traced FROM documents GROUP BY ALL")
def _(spark, d):
    return t(spark, d, "documents").groupBy("source", "lang").agg(n_rows().alias("n"), F.count("ride_id").alias("traced"))


@q("agg32", "SELECT event_type, round(100 * good, 4) AS actual, round(greatest(0, 1 - (1 - good) / 0.3) * 100, 4) AS budget_left, round((1 - good) / 0.3, 4) AS burn FROM (SELECT event_type, avg(CAST(value < 60 AS INT)) AS good FROM events GROUP BY 1)")
def _(spark, d):
    g = t(spark, d, "events").groupBy("event_type").agg(F.avg((F.col("value") < 60).cast("int")).alias("good"))
    burn = (1 - F.col("good")) / 0.3
    return g.select("event_type", r4(100 * F.col("good")).alias("actual"), r4(F.greatest(F.lit(0.0), 1 - burn) * 100).alias("budget_left"), r4(burn).alias("burn"))


@q("agg33", "SELECT user_id % 7 AS run, round(avg(value), 4) AS latency, max(value) AS worst, count(*) AS requests FROM events GROUP BY 1")
def _(spark, d):
    return t(spark, d, "events").groupBy((F.col("user_id") % 7).alias("run")).agg(r4(F.avg("value")).alias("latency"), F.max("value").alias("worst"), n_rows().alias("requests"))


@q("agg34", "SELECT round(avg(CASE WHEN online > 0 THEN busy / online END), 4) AS utilisation, round(avg(online / busy) FILTER (WHERE busy > 0), 4) AS supply_demand, round(sum(busy) / count(*), 4) AS per_tick FROM (SELECT floor(epoch(recorded_at) / 3600) AS tick, count(*) FILTER (WHERE status = 'busy') AS busy, count(*) FILTER (WHERE status <> 'offline') AS online FROM processed_locations GROUP BY 1)")
def _(spark, d):
    p = t(spark, d, "processed_locations").groupBy(F.expr("unix_seconds(recorded_at) div 3600").alias("tick")).agg(F.count_if(F.col("status") == "busy").alias("busy"), F.count_if(F.col("status") != "offline").alias("online"))
    return p.agg(r4(F.avg(F.try_divide("busy", "online"))).alias("utilisation"), r4(F.avg(F.try_divide("online", "busy"))).alias("supply_demand"), r4(F.sum("busy") / n_rows()).alias("per_tick"))


@q("agg35", "SELECT source, round(100 * avg(CAST(coalesce(accuracy > 0 AND accuracy < 100 AND NOT isnan(accuracy), false) AS INT)), 4) AS score FROM driver_locations GROUP BY 1")
def _(spark, d):
    ok = F.coalesce((F.col("accuracy") > 0) & (F.col("accuracy") < 100) & ~F.isnan("accuracy"), F.lit(False))
    return t(spark, d, "driver_locations").groupBy("source").agg(r4(100 * F.avg(ok.cast("int"))).alias("score"))


@q("agg36", "SELECT l_partkey AS item, round(count(*) * avg(nullif(l_quantity - 10, 0)), 4) AS popularity FROM lineitem GROUP BY 1")
def _(spark, d):
    return t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("item")).agg(r4(n_rows() * F.avg(F.nullif(F.col("l_quantity") - 10, F.lit(0.0)))).alias("popularity"))


@q("agg37", "WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, sum(o_totalprice) AS revenue, count(*) AS trips FROM orders GROUP BY 1) SELECT round(sum(revenue) / sum(trips), 4) AS per_trip, round((sum(revenue) - sum(trips) * 1000) / sum(revenue), 4) AS margin, round((arg_max(revenue, month) - arg_min(revenue, month)) / arg_min(revenue, month), 4) AS growth FROM m")
def _(spark, d):
    m = t(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.sum("o_totalprice").alias("revenue"), n_rows().alias("trips"))
    first, last = F.min_by("revenue", "month"), F.max_by("revenue", "month")
    return m.agg(r4(F.sum("revenue") / F.sum("trips")).alias("per_trip"), r4((F.sum("revenue") - F.sum("trips") * 1000) / F.sum("revenue")).alias("margin"), r4((last - first) / first).alias("growth"))


@q("udaf01")
def _(spark, d):
    """Distinct counts by day from sketches that also give those of all days."""
    days = t(spark, d, "driver_locations").groupBy(F.date_format("recorded_at", "yyyy-MM-dd").alias("day")).agg(F.hll_sketch_agg("driver_id", F.lit(12)).alias("s"))
    every = days.agg(F.hll_union_agg("s").alias("s")).select(F.lit("all").alias("day"), "s")
    return days.unionByName(every).select("day", F.hll_sketch_estimate("s").alias("drivers"))


QUERIES, SQL = book.QUERIES, book.SQL
