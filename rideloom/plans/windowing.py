"""Ordered computations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rideloom.common import table as t
from rideloom.operators import timeseries as TS
from rideloom.plans.book import Book

book = Book()
q = book.query


def n_rows():
    return F.count(F.lit(1))


r4 = lambda c: F.round(c, 4)
_DAY = "SELECT event_type, CAST(ts AS DATE) AS day, sum(value) AS v, count(*) AS n FROM events GROUP BY ALL"


def _days(spark, d):
    return t(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"), n_rows().alias("n"))


def by_day():
    return W.partitionBy("event_type").orderBy("day")


def day():
    return F.date_format("day", "yyyy-MM-dd").alias("day")


@q("win01", f"SELECT event_type, strftime(day, '%Y-%m-%d') AS day, round(avg(v) OVER w, 4) AS mean, round(coalesce(stddev_samp(v) OVER w, 0), 4) AS std, round(min(v) OVER w, 4) AS lo, round(max(v) OVER w, 4) AS hi, round(sum(v) OVER w, 4) AS total FROM ({_DAY}) WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)")
def _(spark, d):
    w = by_day().rowsBetween(-6, 0)
    return _days(spark, d).select("event_type", day(), r4(F.avg("v").over(w)).alias("mean"), r4(F.coalesce(F.stddev_samp("v").over(w), F.lit(0.0))).alias("std"), r4(F.min("v").over(w)).alias("lo"), r4(F.max("v").over(w)).alias("hi"), r4(F.sum("v").over(w)).alias("total"))


@q("win02", "SELECT month, round(revenue, 2) AS revenue, coalesce(round((revenue - lag(revenue) OVER (ORDER BY month)) / lag(revenue) OVER (ORDER BY month) * 100, 2), 0) AS change FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, sum(o_totalprice) AS revenue FROM orders GROUP BY 1)")
def _(spark, d):
    m = t(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.sum("o_totalprice").alias("revenue"))
    before = F.lag("revenue").over(W.orderBy("month"))  # a row a month
    return m.select("month", F.round("revenue", 2).alias("revenue"), F.coalesce(F.round((F.col("revenue") - before) / before * 100, 2), F.lit(0.0)).alias("change"))


@q("win03", f"SELECT event_type, strftime(day, '%Y-%m-%d') AS day FROM (SELECT *, avg(v) OVER w AS m, stddev_pop(v) OVER w AS s, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i FROM ({_DAY}) WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)) WHERE i > 7 AND CASE WHEN s = 0 THEN v <> m ELSE abs(v - m) / s > 2 END")
def _(spark, d):
    return TS.moving_anomalies(_days(spark, d), ["event_type"], "day", "v", 7, 2.0).select("event_type", day())


@q("win04", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer")
def _(spark, d):
    return t(spark, d, "customer").select("c_custkey", F.row_number().over(W.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")).alias("rank"))


_RANKS = "WITH a AS (SELECT l_suppkey AS f, row_number() OVER (ORDER BY sum(l_quantity) DESC, l_suppkey) AS r FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_suppkey AS f, row_number() OVER (ORDER BY sum(l_quantity) DESC, l_suppkey) AS r FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)"


@q("win05", f"{_RANKS} SELECT count(*) AS n, round(1 - 6 * sum(pow(a.r - b.r, 2)) / (count(*) * (pow(count(*), 2) - 1)), 6) AS spearman, count(*) FILTER (WHERE abs(a.r - b.r) > 2) AS shifted FROM a JOIN b USING (f)")
def _(spark, d):
    rank = lambda flag, name: t(spark, d, "lineitem").where(F.col("l_returnflag") == flag).groupBy(F.col("l_suppkey").alias("f")).agg(F.sum("l_quantity").alias("x")).select("f", F.row_number().over(W.orderBy(F.desc("x"), "f")).alias(name))
    j, n = rank("A", "ra").join(rank("R", "rb"), "f"), n_rows()
    return j.agg(n.alias("n"), F.round(1 - 6 * F.sum(F.pow(F.col("ra") - F.col("rb"), 2)) / (n * (F.pow(n, 2) - 1)), 6).alias("spearman"), F.count_if(F.abs(F.col("ra") - F.col("rb")) > 2).alias("shifted"))


@q("win06", f"SELECT event_type, strftime(day, '%Y-%m-%d') AS day, round(CASE WHEN count(*) OVER w = 7 THEN avg(v) OVER w END, 4) AS trend FROM ({_DAY}) WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)")
def _(spark, d):
    return TS.centred_average(_days(spark, d), ["event_type"], "day", "v", 7).select("event_type", day(), r4("trend").alias("trend"))


@q("win07", f"SELECT event_type, strftime(day, '%Y-%m-%d') AS day, round(v - 2 * lag(v) OVER w + lag(v, 2) OVER w, 4) AS second FROM ({_DAY}) WINDOW w AS (PARTITION BY event_type ORDER BY day)")
def _(spark, d):
    return TS.difference(_days(spark, d), ["event_type"], "day", "v", 2).select("event_type", day(), r4("diff").alias("second"))


@q("win08", f"WITH s AS (SELECT event_type, v - avg(v) OVER (PARTITION BY event_type) AS x, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i FROM ({_DAY})) SELECT event_type, k AS lag, round(num / den, 4) AS acf FROM (SELECT a.event_type, k, sum(a.x * b.x) AS num FROM (SELECT unnest([1, 2, 7]) AS k) kk, s a, s b WHERE a.event_type = b.event_type AND b.i = a.i - k GROUP BY a.event_type, k) JOIN (SELECT event_type, sum(x * x) AS den FROM s GROUP BY 1) USING (event_type)")
def _(spark, d):
    return TS.autocorrelation(_days(spark, d), ["event_type"], "day", "v", [1, 2, 7]).withColumn("acf", r4("acf"))


@q("win09", f"SELECT event_type, round(corr(v, l), 4) AS weekly FROM (SELECT event_type, v, lag(v, 7) OVER (PARTITION BY event_type ORDER BY day) AS l FROM ({_DAY})) WHERE l IS NOT NULL GROUP BY 1")
def _(spark, d):
    return _days(spark, d).withColumn("l", F.lag("v", 7).over(by_day())).where("l IS NOT NULL").groupBy("event_type").agg(r4(F.corr("v", "l")).alias("weekly"))


@q("win10", "WITH h AS (SELECT event_type, hour(ts) AS h, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT event_type, h, (n + lead(n) OVER (PARTITION BY event_type ORDER BY h)) / 2.0 / avg(n) OVER (PARTITION BY event_type) AS ratio FROM h) SELECT event_type, arg_max(h, (ratio, -h)) AS peak_hour, round(max(ratio), 4) AS ratio FROM r WHERE ratio IS NOT NULL GROUP BY 1")
def _(spark, d):
    h = t(spark, d, "events").groupBy("event_type", F.hour("ts").alias("h")).agg(n_rows().alias("n"))
    w = W.partitionBy("event_type")
    r = h.withColumn("ratio", (F.col("n") + F.lead("n").over(w.orderBy("h"))) / 2.0 / F.avg("n").over(w)).where("ratio IS NOT NULL")
    return r.groupBy("event_type").agg(F.max_by("h", F.struct("ratio", -F.col("h"))).alias("peak_hour"), r4(F.max("ratio")).alias("ratio"))


@q("win11", "SELECT event_id FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 600 SECOND FOLLOWING) AS a, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 600 SECOND PRECEDING AND CURRENT ROW) AS b FROM events) WHERE a > 1 OR b > 1")
def _(spark, d):
    e = t(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    w, s = W.partitionBy("user_id").orderBy("us"), 600_000_000
    e = e.withColumn("a", n_rows().over(w.rangeBetween(0, s))).withColumn("b", n_rows().over(w.rangeBetween(-s, 0)))
    return e.where("a > 1 OR b > 1").select("event_id")


@q("win12", "SELECT l_orderkey, l_linenumber, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn = 1")
def _(spark, d):
    from rideloom.operators.lake import last_per_key

    return last_per_key(t(spark, d, "lineitem"), ["l_orderkey"], [F.desc("l_shipdate"), F.col("l_linenumber"), F.col("l_partkey")]).select("l_orderkey", "l_linenumber", "l_shipdate")


@q("win13", "SELECT driver_id, driver_key, row_number() OVER (PARTITION BY driver_id ORDER BY valid_from, valid_to NULLS FIRST, driver_key) AS version FROM dim_drivers")
def _(spark, d):
    return t(spark, d, "dim_drivers").select("driver_id", "driver_key", F.row_number().over(W.partitionBy("driver_id").orderBy("valid_from", F.col("valid_to").asc_nulls_first(), "driver_key")).alias("version"))


_ERR = "SELECT event_type, abs(value - 50) AS err, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events"


@q("win14", f"SELECT event_type, round(avg(err) FILTER (WHERE i <= n // 2), 4) AS first_half, round(avg(err) FILTER (WHERE i > n // 2), 4) AS second_half FROM ({_ERR}) GROUP BY 1")
def _(spark, d):
    w = W.partitionBy("event_type")
    e = t(spark, d, "events").select("event_type", F.abs(F.col("value") - 50).alias("err"), F.row_number().over(w.orderBy("ts", "event_id")).alias("i"), n_rows().over(w).alias("n"))
    early = F.col("i") <= F.expr("n div 2")
    return e.groupBy("event_type").agg(r4(F.avg(F.when(early, F.col("err")))).alias("first_half"), r4(F.avg(F.when(~early, F.col("err")))).alias("second_half"))


@q("win15", f"WITH m AS (SELECT event_type, i, err - avg(err) OVER (PARTITION BY event_type ORDER BY i) - 0.005 AS x FROM ({_ERR})), c AS (SELECT event_type, i, sum(x) OVER (PARTITION BY event_type ORDER BY i) AS cum FROM m), p AS (SELECT event_type, i, cum - min(cum) OVER (PARTITION BY event_type ORDER BY i) AS ph FROM c) SELECT event_type, round(max(ph), 3) AS highest, count(*) FILTER (WHERE ph > 50) > 0 AS drift FROM p GROUP BY 1")
def _(spark, d):
    e = t(spark, d, "events").select("event_type", F.abs(F.col("value") - 50).alias("err"), "ts", "event_id")
    p = TS.page_hinkley(e, ["event_type"], [F.col("ts"), F.col("event_id")], "err", 0.005)
    return p.groupBy("event_type").agg(F.round(F.max("ph"), 3).alias("highest"), (F.count_if(F.col("ph") > 50) > 0).alias("drift"))


@q("win16")
def _(spark, d):
    e = _days(spark, d).select("event_type", "day", "v")
    return TS.adwin(e, "event_type", "day", "v", 0.002)


@q("win17", "WITH u AS (SELECT value AS v, 1.0 / count(*) OVER () AS a, 0.0 AS b FROM events WHERE event_type = 'view' UNION ALL SELECT value, 0.0, 1.0 / count(*) OVER () FROM events WHERE event_type = 'click'), g AS (SELECT v, sum(a) AS a, sum(b) AS b FROM u GROUP BY 1) SELECT round(max(abs(fa - fb)), 6) AS ks FROM (SELECT sum(a) OVER (ORDER BY v) AS fa, sum(b) OVER (ORDER BY v) AS fb FROM g)")
def _(spark, d):
    from rideloom.operators.stats import ks

    e = t(spark, d, "events")
    return ks(e.where("event_type = 'view'").select("value"), e.where("event_type = 'click'").select("value"), "value").select(F.round("ks", 6).alias("ks"))


@q("win18", f"SELECT event_type, strftime(day, '%Y-%m-%d') AS day, n FROM ({_DAY}) WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'")
def _(spark, d):
    return _days(spark, d).where(F.col("day").between("2024-01-05", "2024-01-12")).select("event_type", day(), "n")


@q("win19", "WITH p AS (SELECT n_nationkey AS id, (n_nationkey * 7 % 25 + 1) / 500.0 AS p FROM nation), r AS (SELECT *, row_number() OVER (ORDER BY p, id) AS i, count(*) OVER () AS m FROM p) SELECT id, min(CAST(p <= 0.05 / (m - i + 1) AS INT)) OVER (ORDER BY i) = 1 AS rejected, p <= 0.05 / m AS bonferroni FROM r")
def _(spark, d):
    from rideloom.operators.stats import holm

    p = t(spark, d, "nation").select(F.col("n_nationkey").alias("id"), ((F.col("n_nationkey") * 7 % 25 + 1) / 500.0).alias("p"))
    return holm(p, "id", "p", 0.05)


@q("win20", "SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag <> prev) AS turns FROM (SELECT l_orderkey, l_returnflag, lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS prev FROM lineitem) GROUP BY 1")
def _(spark, d):
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    x = t(spark, d, "lineitem").select("l_orderkey", "l_returnflag", F.lag("l_returnflag").over(w).alias("prev"))
    return x.groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") != F.col("prev")).alias("turns"))


QUERIES, SQL = book.QUERIES, book.SQL
