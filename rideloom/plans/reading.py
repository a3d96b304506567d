"""Scans, filters, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rideloom.common import table as t
from rideloom.operators import relational as R
from rideloom.plans.book import Book

book = Book()
q = book.query


@q("src01", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return R.where_equal(t(spark, d, "lineitem"), {"l_returnflag": "R", "l_linestatus": "F"}).select("l_orderkey", "l_linenumber", "l_quantity")


@q("src03", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity >= 45 AND l_discount < 0.03")
def _(spark, d):
    return R.where_compare(t(spark, d, "lineitem"), [("l_quantity", "gte", 45.0), ("l_discount", "lt", 0.03)]).select("l_orderkey", "l_partkey")


@q("src04", "SELECT event_type, count(*) AS n, count(try_cast(props->>'k' AS INTEGER)) AS good FROM events GROUP BY event_type")
def _(spark, d):
    e = t(spark, d, "events")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(F.expr("try_cast(get_json_object(props, '$.k') AS INT)")).alias("good"))


@q("src07", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(spark, d):
    return t(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")


@q("src12", "SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000 GROUP BY n_name")
def _(spark, d):
    c, n = t(spark, d, "customer"), t(spark, d, "nation")
    return spark.sql("SELECT n_name, count(*) AS customers FROM {c} JOIN {n} ON c_nationkey = n_nationkey WHERE c_acctbal > :least GROUP BY n_name", args={"least": 5000.0}, c=c, n=n)


@q("src19", "SELECT strftime(o_orderdate, '%Y-%m') AS part, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    return t(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@q("flt01", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def _(spark, d):
    return R.where_equal(t(spark, d, "orders"), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}).select("o_orderkey", "o_totalprice")


@q("flt02", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 120000 AND o_orderstatus = 'O'")
def _(spark, d):
    return R.where_in(t(spark, d, "orders"), {"o_totalprice": (100000.0, 120000.0), "o_orderstatus": "O"}).select("o_orderkey")


@q("flt03", "SELECT driver_id, status, count(*) AS n FROM processed_locations WHERE status = 'busy' GROUP BY ALL")
def _(spark, d):
    return R.where_equal(t(spark, d, "processed_locations"), {"status": "busy"}).groupBy("driver_id", "status").agg(F.count(F.lit(1)).alias("n"))


@q("flt04", "SELECT p_partkey, CAST(NULL AS DOUBLE) AS p_weight FROM part")
def _(spark, d):
    return R.project(t(spark, d, "part"), {"p_partkey": "long", "p_weight": "double"})


@q("flt05", "SELECT id FROM driver_locations WHERE speed > 10 AND speed <= 12 AND NOT isnan(speed) AND accuracy >= 5 AND accuracy < 9 AND source = 'gps'")
def _(spark, d):
    return R.where_compare(t(spark, d, "driver_locations").where(~F.isnan("speed")), [("speed", "gt", 10), ("speed", "lte", 12), ("accuracy", "gte", 5), ("accuracy", "lt", 9), ("source", "eq", "gps")]).select("id")


@q("flt06", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey BETWEEN 100 AND 140")
def _(spark, d):
    return R.where_in(t(spark, d, "lineitem"), {"l_partkey": (100, 140)}).select("l_orderkey", "l_linenumber")


@q("flt07", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderdate < TIMESTAMP '1997-03-16'")
def _(spark, d):
    return R.in_days(t(spark, d, "orders"), "o_orderdate", "1997-03-01", "1997-03-15").select("o_orderkey")


@q("flt08", "SELECT event_id FROM events WHERE CAST(props->>'k' AS INTEGER) = 42 AND event_type = 'click' AND ts >= TIMESTAMP '2024-01-05'")
def _(spark, d):
    e = t(spark, d, "events").withColumn("labels", F.from_json("props", "map<string,string>"))
    return e.where((F.col("labels")["k"] == "42") & (F.col("event_type") == "click") & (F.col("ts") >= F.lit("2024-01-05").cast("timestamp_ntz"))).select("event_id")


@q("flt09", "SELECT doc_id FROM documents WHERE source = 'support_ticket' AND contains(lower(text), 'refund') ORDER BY doc_id LIMIT 100")
def _(spark, d):
    return R.search(R.where_equal(t(spark, d, "documents"), {"source": "support_ticket"}), ["text"], "Refund").select("doc_id").orderBy("doc_id").limit(100)


@q("flt10", "SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-03 06:00:00'")
def _(spark, d):
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-03 00:00:00", "2024-01-03 06:00:00"))
    return t(spark, d, "events").where(F.col("ts").between(lo, hi)).select("event_id", "ts")


@q("flt11", "SELECT p_partkey, p_name, count(*) OVER () AS total FROM part WHERE contains(lower(p_name), 'ring') AND p_type = 'SMALL' ORDER BY p_partkey LIMIT 20 OFFSET 10")
def _(spark, d):
    hits = R.search(R.where_equal(t(spark, d, "part"), {"p_type": "SMALL"}), ["p_name"], "RING")
    return R.page(hits.select("p_partkey", "p_name"), [F.col("p_partkey")], 10, 20)


@q("flt12", "SELECT * FROM (SELECT n_name AS name, 'nation' AS kind FROM nation WHERE contains(lower(n_name), '1') UNION ALL SELECT zone_name, 'zone' FROM dim_zones WHERE contains(lower(zone_name), 'ya')) ORDER BY name, kind LIMIT 10")
def _(spark, d):
    a = R.search(t(spark, d, "nation"), ["n_name"], "1").select(F.col("n_name").alias("name"), F.lit("nation").alias("kind"))
    b = R.search(t(spark, d, "dim_zones"), ["zone_name"], "ya").select(F.col("zone_name").alias("name"), F.lit("zone").alias("kind"))
    return a.unionByName(b).orderBy("name", "kind").limit(10)


@q("flt13", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'bolt') OR len(list_filter(string_split(lower(p_name), ' '), lambda x: x = 'hot')) > 0")
def _(spark, d):
    p = t(spark, d, "part").withColumn("tags", F.split(F.lower("p_name"), " "))
    return p.where(F.contains(F.lower("p_name"), F.lit("bolt")) | F.exists("tags", lambda x: x == "hot")).select("p_partkey")


@q("flt14", """SELECT zone_id, round(demand / supply, 4) AS multiplier FROM (SELECT zone_id, count(*) FILTER (WHERE status = 'busy') AS demand, count(*) FILTER (WHERE status = 'online') AS supply
    FROM processed_locations WHERE zone_id IS NOT NULL GROUP BY zone_id) WHERE supply > 0 AND demand / supply > 1.0""")
def _(spark, d):
    z = t(spark, d, "processed_locations").where("zone_id IS NOT NULL").groupBy("zone_id").agg(F.count_if(F.col("status") == "busy").alias("demand"), F.count_if(F.col("status") == "online").alias("supply"))
    z = z.withColumn("multiplier", F.try_divide("demand", "supply")).where(F.col("multiplier") > 1.0)
    return z.select("zone_id", F.round("multiplier", 4).alias("multiplier"))


@q("flt15", """SELECT user_id, plan_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, plan_id ORDER BY created_at DESC, id DESC, updated_at DESC) AS rn FROM subscriptions)
    WHERE rn = 1 AND status = 'active' AND (expires_at IS NULL OR expires_at > TIMESTAMPTZ '2017-01-15 00:00:00+00')""")
def _(spark, d):
    """The latest record of each subject and purpose decides."""
    s = t(spark, d, "subscriptions").groupBy("user_id", "plan_id").agg(F.max(F.struct("created_at", "id", "updated_at", "status", "expires_at")).alias("x"))
    return s.where((F.col("x.status") == "active") & (F.col("x.expires_at").isNull() | (F.col("x.expires_at") > F.lit("2017-01-15").cast("timestamp")))).select("user_id", "plan_id")


@q("flt16", """WITH h AS (SELECT event_type, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS h, avg(value) > 55 AS hot FROM events GROUP BY ALL),
    g AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY h) - row_number() OVER (PARTITION BY event_type, hot ORDER BY h) AS grp FROM h),
    r AS (SELECT event_type, h, hot, row_number() OVER (PARTITION BY event_type, hot, grp ORDER BY h) AS n FROM g)
    SELECT event_type, h, CASE WHEN NOT hot THEN 'inactive' WHEN n >= 3 THEN 'firing' ELSE 'pending' END AS state FROM r""")
def _(spark, d):
    """A condition holds, then pends, then fires once it has held for three periods in a row."""
    from pyspark.sql import Window as W

    h = t(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("h")).agg((F.avg("value") > 55).alias("hot"))
    w = W.partitionBy("event_type").orderBy("h")
    h = h.withColumn("grp", F.row_number().over(w) - F.row_number().over(W.partitionBy("event_type", "hot").orderBy("h")))
    n = F.row_number().over(W.partitionBy("event_type", "hot", "grp").orderBy("h"))
    return h.select("event_type", "h", F.when(~F.col("hot"), "inactive").when(n >= 3, "firing").otherwise("pending").alias("state"))


@q("flt17", "SELECT event_id FROM events WHERE NOT (event_type = 'error' AND ts BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-20') AND NOT (event_type = 'view' AND ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12')")
def _(spark, d):
    silences = spark.createDataFrame([("error", "2024-01-02", "2024-01-20"), ("view", "2024-01-10", "2024-01-12")], "kind string, a string, b string")
    s = silences.select("kind", F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"))
    e = t(spark, d, "events")
    return e.join(F.broadcast(s), (e["event_type"] == s["kind"]) & e["ts"].between(s["a"], s["b"]), "left_anti").select("event_id")


@q("srt01", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos FROM orders")
def _(spark, d):
    from pyspark.sql import Window as W

    return t(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("pos"))


@q("srt02", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(spark, d):
    return t(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@q("srt03", "SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 15 OFFSET 30")
def _(spark, d):
    return t(spark, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").offset(30).limit(15).select("c_custkey", "c_name")


@q("set01", """WITH a AS (SELECT p_partkey, round(p_retailprice / 1000, 4) AS a FROM part WHERE p_size <= 10), b AS (SELECT l_partkey, count(*) AS b FROM lineitem GROUP BY l_partkey HAVING count(*) > 30)
    SELECT coalesce(p_partkey, l_partkey) AS item, coalesce(a, 0) AS content, coalesce(b, 0) AS popular FROM a FULL JOIN b ON p_partkey = l_partkey""")
def _(spark, d):
    a = t(spark, d, "part").where("p_size <= 10").select(F.col("p_partkey").alias("item"), F.round(F.col("p_retailprice") / 1000, 4).alias("content"))
    b = t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("item")).agg(F.count(F.lit(1)).alias("popular")).where("popular > 30")
    return a.join(b, "item", "full").select("item", F.coalesce("content", F.lit(0.0)).alias("content"), F.coalesce("popular", F.lit(0)).alias("popular"))


_OLD, _NEW = "SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'", "SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01'"


@q("set02", f"SELECT n.*, 'added' AS change FROM ({_NEW}) n WHERE NOT EXISTS (SELECT 1 FROM ({_OLD}) o WHERE o.o_custkey = n.o_custkey AND o.o_orderpriority = n.o_orderpriority) UNION ALL SELECT o.*, 'removed' FROM ({_OLD}) o WHERE NOT EXISTS (SELECT 1 FROM ({_NEW}) n WHERE o.o_custkey = n.o_custkey AND o.o_orderpriority = n.o_orderpriority)")
def _(spark, d):
    o = t(spark, d, "orders")
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    old, new = o.where(F.col("o_orderdate") < at("1996-01-01")), o.where(F.col("o_orderdate") >= at("2001-01-01"))
    return R.diff(old.select("o_custkey", "o_orderpriority"), new.select("o_custkey", "o_orderpriority"))


@q("set04", "SELECT min(doc_id) AS doc_id, text FROM documents WHERE text IS NOT NULL GROUP BY text")
def _(spark, d):
    return R.first_by_content(t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text"), ["text"], [F.col("doc_id")])


@q("set05", "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0")
def _(spark, d):
    return t(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).intersect(t(spark, d, "supplier").where("s_acctbal < 0").select("s_nationkey"))


# Set, subquery and grouping forms beyond the reference's own.
@q("extra_except_all", "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT ALL SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def _(spark, d):
    x = t(spark, d, "lineitem")
    return x.where("l_returnflag = 'A'").select("l_partkey").exceptAll(x.where("l_returnflag = 'R'").select("l_partkey"))


@q("extra_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(spark, d):
    return t(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@q("extra_rollup", "SELECT borough, service_zone, count(*) AS zones FROM dim_zones GROUP BY ROLLUP (borough, service_zone)")
def _(spark, d):
    return t(spark, d, "dim_zones").rollup("borough", "service_zone").agg(F.count(F.lit(1)).alias("zones"))


@q("extra_correlated", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.9 * avg(o_totalprice) FROM orders i WHERE i.o_orderpriority = o.o_orderpriority)")
def _(spark, d):
    o = t(spark, d, "orders")
    return spark.sql("SELECT o_orderkey FROM {o} o WHERE o_totalprice > (SELECT 1.9 * avg(o_totalprice) FROM {o} i WHERE i.o_orderpriority = o.o_orderpriority)", o=o)


@q("extra_pivot", "SELECT event_type, count(*) FILTER (WHERE user_id % 2 = 0) AS even, count(*) FILTER (WHERE user_id % 2 = 1) AS odd FROM events GROUP BY event_type")
def _(spark, d):
    e = t(spark, d, "events").withColumn("side", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd"))
    return e.groupBy("event_type").pivot("side", ["even", "odd"]).agg(F.count(F.lit(1))).na.fill(0)


QUERIES, SQL = book.QUERIES, book.SQL
