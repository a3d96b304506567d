"""Statistics, features, models, series, space, graphs and text."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rideloom.common import table as t
from rideloom.common import written
from rideloom.operators import features as X
from rideloom.operators import learners as L
from rideloom.operators import stats as S
from rideloom.operators import timeseries as TS
from rideloom.operators.aggregates import interpolated
from rideloom.plans.book import Book

book = Book()
q = book.query


def r(c, k=5):
    return F.round(c, k)


def n_rows():
    return F.count(F.lit(1))


def _half(spark, d, kind):
    return t(spark, d, "events").where(F.col("event_type") == kind).select("value")


# ---- drift -------------------------------------------------------------------------------------------------------

EDGES = (5.0, 15.0, 30.0, 50.0, 80.0, 120.0)
_LIST = "[" + ", ".join(map(str, EDGES)) + "]"
_BINS = f"WITH b AS (SELECT unnest(range(0, {len(EDGES) + 1})) AS bin), p AS (SELECT len(list_filter({_LIST}, lambda e: e <= value)) AS bin, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1), c AS (SELECT len(list_filter({_LIST}, lambda e: e <= value)) AS bin, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1), x AS (SELECT b.bin, coalesce(p.n, 0) / (SELECT sum(n) FROM p) AS p, coalesce(c.n, 0) / (SELECT sum(n) FROM c) AS q FROM b LEFT JOIN p USING (bin) LEFT JOIN c USING (bin))"


def _pq(spark, d):
    return S.against(_half(spark, d, "view"), _half(spark, d, "click"), "value", EDGES)


def _edges_of(df, bins):
    """Quantile edges of a reference sample."""
    return [float(x) for x in interpolated(df, [], "value", {f"q{i}": i / bins for i in range(1, bins)}).first()]


_QUANT = "WITH e AS (SELECT list_transform([0.25, 0.5, 0.75], lambda x: x) AS z, [quantile_cont(value, 0.25), quantile_cont(value, 0.5), quantile_cont(value, 0.75)] AS ed FROM events WHERE event_type = 'view'), s AS (SELECT event_type, len(list_filter(ed, lambda v: v <= value)) AS bin FROM events, e WHERE event_type IN ('view', 'click')), x AS (SELECT bin, count(*) FILTER (WHERE event_type = 'view') / (SELECT count(*) FROM s WHERE event_type = 'view') AS p, count(*) FILTER (WHERE event_type = 'click') / (SELECT count(*) FROM s WHERE event_type = 'click') AS q FROM s GROUP BY 1)"


@q("st01", f"{_QUANT} SELECT round(psi, 6) AS psi, CASE WHEN psi < 0.1 THEN 'none' WHEN psi < 0.25 THEN 'moderate' ELSE 'significant' END AS drift FROM (SELECT sum((q + 1e-6 - p - 1e-6) * ln((q + 1e-6) / (p + 1e-6))) AS psi FROM x)")
def _(spark, d):
    ref = _half(spark, d, "view")
    x = S.against(ref, _half(spark, d, "click"), "value", _edges_of(ref, 4)).agg(F.sum(S.psi(F.col("p"), F.col("q"))).alias("v"))
    return x.select(r("v", 6).alias("psi"), F.when(F.col("v") < 0.1, "none").when(F.col("v") < 0.25, "moderate").otherwise("significant").alias("drift"))


@q("st02", f"{_BINS} SELECT round(sum((q - p) * ln((q + 1e-10) / (p + 1e-10))), 6) AS psi FROM x WHERE p > 0 OR q > 0")
def _(spark, d):
    return _pq(spark, d).where("p > 0 OR q > 0").agg(r(F.sum(S.psi(F.col("p"), F.col("q"), 1e-10)), 6).alias("psi"))


@q("st03", f"{_BINS} SELECT round(sum((greatest(q, 1e-4) - greatest(p, 1e-4)) * ln(greatest(q, 1e-4) / greatest(p, 1e-4))), 6) AS psi FROM x")
def _(spark, d):
    return _pq(spark, d).agg(r(F.sum(S.psi(F.col("p"), F.col("q"), 1e-4, floor=True)), 6).alias("psi"))


_KS = "WITH u AS (SELECT value AS v, 1.0 / count(*) OVER () AS a, 0.0 AS b, 1 AS x, 0 AS y FROM events WHERE event_type = 'view' UNION ALL SELECT value, 0.0, 1.0 / count(*) OVER (), 0, 1 FROM events WHERE event_type = 'error'), g AS (SELECT v, sum(a) AS a, sum(b) AS b FROM u GROUP BY 1), k AS (SELECT max(abs(fa - fb)) AS ks FROM (SELECT sum(a) OVER (ORDER BY v) AS fa, sum(b) OVER (ORDER BY v) AS fb FROM g)), n AS (SELECT sum(x) AS n, sum(y) AS m FROM u)"


@q("st04", f"{_KS} SELECT round(ks, 6) AS ks, CAST(n AS BIGINT) AS n_a, CAST(m AS BIGINT) AS n_b, round(least(1, 2 * exp(-2 * pow(sqrt(n * m / (n + m)) * ks, 2))), 5) AS p FROM k, n")
def _(spark, d):
    x = S.ks(_half(spark, d, "view"), _half(spark, d, "error"), "value")
    return x.select(r("ks", 6).alias("ks"), "n_a", "n_b", r("p").alias("p"))


@q("st05", f"{_BINS} SELECT round(sum((CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2), 6) AS js FROM x")
def _(spark, d):
    return _pq(spark, d).agg(r(F.sum(S.jensen_shannon(F.col("p"), F.col("q"))), 6).alias("js"))


@q("st06", f"{_KS} SELECT least(1, 2 * exp(-2 * pow(sqrt(n * m / (n + m)) * ks, 2))) < 0.05 AS drift_by_ks FROM k, n")
def _(spark, d):
    return S.ks(_half(spark, d, "view"), _half(spark, d, "error"), "value").select((F.col("p") < 0.05).alias("drift_by_ks"))


_ERR = "SELECT abs(value - 50) AS err, row_number() OVER (ORDER BY ts, event_id) AS i, count(*) OVER () AS n FROM events WHERE event_type = 'purchase'"


@q("st07", f"SELECT round(b - a, 5) AS shift, b > a * 1.1 AS drift FROM (SELECT avg(err) FILTER (WHERE i <= n // 2) AS a, avg(err) FILTER (WHERE i > n // 2) AS b FROM ({_ERR}))")
def _(spark, d):
    """The middle of a series is found from counts by day and hour before any row is ranked."""
    e = t(spark, d, "events").where("event_type = 'purchase'").select(F.abs(F.col("value") - 50).alias("err"), "ts", "event_id")
    hours = e.groupBy(F.date_trunc("hour", "ts").alias("h")).agg(n_rows().alias("n"))
    before = F.sum("n").over(W.orderBy("h")) - F.col("n")
    hours = hours.select("h", before.alias("before"), F.sum("n").over(W.partitionBy(F.lit(1))).alias("total"))
    e = e.withColumn("h", F.date_trunc("hour", "ts")).join(F.broadcast(hours), "h")
    i = F.col("before") + F.row_number().over(W.partitionBy("h").orderBy("ts", "event_id"))
    e = e.withColumn("early", i <= F.expr("total div 2"))
    x = e.agg(F.avg(F.when(F.col("early"), F.col("err"))).alias("a"), F.avg(F.when(~F.col("early"), F.col("err"))).alias("b"))
    return x.select(r(F.col("b") - F.col("a")).alias("shift"), (F.col("b") > F.col("a") * 1.1).alias("drift"))


@q("st08", f"{_BINS} SELECT CASE WHEN psi >= 0.25 THEN 'retrain' WHEN psi >= 0.1 THEN 'watch' ELSE 'keep' END AS decision FROM (SELECT sum((q + 1e-6 - p - 1e-6) * ln((q + 1e-6) / (p + 1e-6))) AS psi FROM x)")
def _(spark, d):
    v = _pq(spark, d).agg(F.sum(S.psi(F.col("p"), F.col("q"))).alias("v"))
    return v.select(F.when(F.col("v") >= 0.25, "retrain").when(F.col("v") >= 0.1, "watch").otherwise("keep").alias("decision"))


@q("st09", "SELECT round(sqrt(avg(pow(y - p, 2))), 5) AS rmse, round(avg(abs(y - p)), 5) AS mae, round(avg(abs((y - p) / nullif(y, 0))) * 100, 5) AS mape, round(1 - sum(pow(y - p, 2)) / (sum(y * y) - pow(sum(y), 2) / count(*)), 5) AS r2 FROM (SELECT l_quantity AS y, l_extendedprice / 2000 AS p FROM lineitem)")
def _(spark, d):
    y, p = F.col("l_quantity"), F.col("l_extendedprice") / 2000
    return t(spark, d, "lineitem").agg(r(F.sqrt(F.avg(F.pow(y - p, 2)))).alias("rmse"), r(F.avg(F.abs(y - p))).alias("mae"), r(F.avg(F.abs(F.try_divide(y - p, y))) * 100).alias("mape"), r(1 - F.sum(F.pow(y - p, 2)) / (F.sum(y * y) - F.pow(F.sum(y), 2) / n_rows())).alias("r2"))


@q("st10", "SELECT tp, fp, fn, tn, round((tp + tn) / (tp + tn + fp + fn), 5) AS accuracy, round(tp / (tp + fp), 5) AS precision, round(tp / (tp + fn), 5) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 5) AS f1 FROM (SELECT count(*) FILTER (WHERE a AND b) AS tp, count(*) FILTER (WHERE NOT a AND b) AS fp, count(*) FILTER (WHERE a AND NOT b) AS fn, count(*) FILTER (WHERE NOT a AND NOT b) AS tn FROM (SELECT l_returnflag = 'R' AS a, l_quantity > 25 AS b FROM lineitem))")
def _(spark, d):
    a, b = F.col("l_returnflag") == "R", F.col("l_quantity") > 25
    c = t(spark, d, "lineitem").agg(F.count_if(a & b).alias("tp"), F.count_if(~a & b).alias("fp"), F.count_if(a & ~b).alias("fn"), F.count_if(~a & ~b).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("*", r((tp + tn) / (tp + tn + fp + fn)).alias("accuracy"), r(tp / (tp + fp)).alias("precision"), r(tp / (tp + fn)).alias("recall"), r(2.0 * tp / (2 * tp + fp + fn)).alias("f1"))


_AB = "SELECT count(*) FILTER (WHERE user_id % 2 = 0) AS n1, count(*) FILTER (WHERE user_id % 2 = 1) AS n2, count(*) FILTER (WHERE user_id % 2 = 0 AND event_type = 'purchase') AS c1, count(*) FILTER (WHERE user_id % 2 = 1 AND event_type = 'purchase') AS c2 FROM events"


def _ab(spark, d):
    even, buys = F.col("user_id") % 2 == 0, F.col("event_type") == "purchase"
    x = t(spark, d, "events").agg(F.count_if(even).alias("n1"), F.count_if(~even).alias("n2"), F.count_if(even & buys).alias("c1"), F.count_if(~even & buys).alias("c2"))
    x = x.withColumns({"p1": F.col("c1") / F.col("n1"), "p2": F.col("c2") / F.col("n2"), "pp": (F.col("c1") + F.col("c2")) / (F.col("n1") + F.col("n2"))})
    return x.withColumn("z", (F.col("p2") - F.col("p1")) / F.sqrt(F.col("pp") * (1 - F.col("pp")) * (1 / F.col("n1") + 1 / F.col("n2"))))


_ZS = f"WITH a AS (SELECT *, c1 / n1 AS p1, c2 / n2 AS p2, (c1 + c2) / (n1 + n2) AS pp FROM ({_AB})), z AS (SELECT *, (p2 - p1) / sqrt(pp * (1 - pp) * (1.0 / n1 + 1.0 / n2)) AS z FROM a)"
_K = "(1 / (1 + 0.2316419 * abs(z)))"
_TAIL = f"(exp(-z * z / 2) / sqrt(2 * pi()) * ({_K} * (0.319381530 + {_K} * (-0.356563782 + {_K} * (1.781477937 + {_K} * (-1.821255978 + {_K} * 1.330274429))))))"


@q("st11", f"{_ZS} SELECT round(z, 5) AS z, round(p2 / p1 - 1, 5) AS lift, round(2 * {_TAIL}, 5) AS p FROM z")
def _(spark, d):
    return _ab(spark, d).select(r("z").alias("z"), r(F.col("p2") / F.col("p1") - 1).alias("lift"), r(S.two_sided(F.col("z"))).alias("p"))


@q("st12", f"{_ZS} SELECT round(abs(z) / 1.96, 5) AS boundary_share, abs(z) > 1.96 AS stop FROM z")
def _(spark, d):
    return _ab(spark, d).select(r(F.abs("z") / 1.96).alias("boundary_share"), (F.abs("z") > 1.96).alias("stop"))


@q("st13", "WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY ALL), e AS (SELECT n, sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS e FROM c) SELECT round(sum(pow(n - e, 2) / e), 5) AS chi2, round(exp(-sum(pow(n - e, 2) / e) / 2), 5) AS p FROM e")
def _(spark, d):
    """Two degrees of freedom here, where the tail is exact."""
    c = t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(n_rows().alias("n"))
    s = lambda *k: F.sum("n").over(W.partitionBy(*k) if k else W.partitionBy(F.lit(1)))
    chi = F.sum(F.pow(F.col("n") - F.col("e"), 2) / F.col("e"))
    return c.withColumn("e", s("l_returnflag") * s("l_linestatus") / s()).agg(r(chi).alias("chi2"), r(F.exp(-chi / 2)).alias("p"))


@q("st14", f"{_ZS} SELECT round(2 * asin(sqrt(p2)) - 2 * asin(sqrt(p1)), 6) AS h, CAST(ceil(pow(1.959964 + 0.841621, 2) * (p1 * (1 - p1) + 0.22 * 0.78) / pow(0.22 - p1, 2)) AS BIGINT) AS n FROM z")
def _(spark, d):
    p1, p2 = F.col("p1"), F.col("p2")
    n = F.ceil(F.lit((1.959964 + 0.841621) ** 2) * (p1 * (1 - p1) + 0.22 * 0.78) / F.pow(0.22 - p1, 2))
    return _ab(spark, d).select(r(2 * F.asin(F.sqrt(p2)) - 2 * F.asin(F.sqrt(p1)), 6).alias("h"), n.cast("long").alias("n"))


@q("st15", f"SELECT round(llr, 4) AS llr, CASE WHEN llr >= ln(0.8 / 0.05) THEN 'accept_h1' WHEN llr <= ln(0.2 / 0.95) THEN 'accept_h0' ELSE 'continue' END AS decision FROM (SELECT c1 * ln(0.22 / 0.20) + (n1 - c1) * ln(0.78 / 0.80) AS llr FROM ({_AB}))")
def _(spark, d):
    import math

    llr = F.col("c1") * math.log(0.22 / 0.20) + (F.col("n1") - F.col("c1")) * math.log(0.78 / 0.80)
    return _ab(spark, d).select(r(llr, 4).alias("llr"), F.when(llr >= math.log(0.8 / 0.05), "accept_h1").when(llr <= math.log(0.2 / 0.95), "accept_h0").otherwise("continue").alias("decision"))


@q("st16", "SELECT n_nationkey AS id, (n_nationkey + 1) / 1000.0 <= 0.05 / 25 AS bonferroni FROM nation")
def _(spark, d):
    return S.holm(t(spark, d, "nation").select(F.col("n_nationkey").alias("id"), ((F.col("n_nationkey") + 1) / 1000.0).alias("p")), "id", "p", 0.05).select("id", "bonferroni")


@q("st17", "SELECT segment, round(m2 / m1 - 1, 5) AS lift, round((m2 - m1) / sqrt(v1 / n1 + v2 / n2), 4) AS z FROM (SELECT event_type AS segment, avg(value) FILTER (WHERE user_id % 2 = 0) AS m1, avg(value) FILTER (WHERE user_id % 2 = 1) AS m2, var_samp(value) FILTER (WHERE user_id % 2 = 0) AS v1, var_samp(value) FILTER (WHERE user_id % 2 = 1) AS v2, count(*) FILTER (WHERE user_id % 2 = 0) AS n1, count(*) FILTER (WHERE user_id % 2 = 1) AS n2 FROM events GROUP BY 1)")
def _(spark, d):
    arm = lambda k: F.when(F.col("user_id") % 2 == k, F.col("value"))
    m = lambda k: F.avg(arm(k))
    return t(spark, d, "events").groupBy(F.col("event_type").alias("segment")).agg(r(m(1) / m(0) - 1).alias("lift"), r((m(1) - m(0)) / F.sqrt(F.var_samp(arm(0)) / F.count(arm(0)) + F.var_samp(arm(1)) / F.count(arm(1))), 4).alias("z"))


@q("st18", "SELECT event_type, round(greatest(exp(-z * z / 2), 0.001), 5) AS p FROM (SELECT event_type, (avg(value) FILTER (WHERE user_id % 2 = 1) - avg(value) FILTER (WHERE user_id % 2 = 0)) / sqrt(var_pop(value) / count(*)) AS z FROM events GROUP BY 1)")
def _(spark, d):
    arm = lambda k: F.avg(F.when(F.col("user_id") % 2 == k, F.col("value")))
    z = (arm(1) - arm(0)) / F.sqrt(F.var_pop("value") / n_rows())
    return t(spark, d, "events").groupBy("event_type").agg(r(F.greatest(F.exp(-z * z / 2), F.lit(0.001))).alias("p"))


@q("st19", "SELECT l_returnflag AS model, count(*) AS n, round(avg(abs(l_quantity - l_extendedprice / 2000)), 5) AS divergence FROM lineitem GROUP BY 1")
def _(spark, d):
    return t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("model")).agg(n_rows().alias("n"), r(F.avg(F.abs(F.col("l_quantity") - F.col("l_extendedprice") / 2000))).alias("divergence"))


@q("st20", "SELECT event_type AS arm, round(avg(value) / 100 + sqrt(2 * ln((SELECT count(*) FROM events)) / count(*)), 5) AS ucb FROM events GROUP BY 1")
def _(spark, d):
    """The deterministic choice of UCB1: reward mean and confidence of each arm."""
    a = t(spark, d, "events").groupBy(F.col("event_type").alias("arm")).agg(F.avg("value").alias("m"), n_rows().alias("n"))
    total = F.sum("n").over(W.partitionBy(F.lit(1)))  # a row an arm
    return a.select("arm", r(F.col("m") / 100 + F.sqrt(2 * F.ln(total) / F.col("n"))).alias("ucb"))


@q("st20_regret", "SELECT event_type AS arm, count(*) AS n, round(count(*) * ((SELECT max(m) FROM (SELECT avg(value) AS m FROM events GROUP BY event_type)) - avg(value)), 2) AS regret FROM events GROUP BY 1")
def _(spark, d):
    """What each arm's plays cost against the best arm's mean."""
    a = t(spark, d, "events").groupBy(F.col("event_type").alias("arm")).agg(F.avg("value").alias("m"), n_rows().alias("n"))
    return a.select("arm", "n", r(F.col("n") * (F.max("m").over(W.partitionBy(F.lit(1))) - F.col("m")), 2).alias("regret"))  # a row an arm


@q("st20_policies")
def _(spark, d):
    """Epsilon-greedy, UCB1 and Thompson against arms whose chances are the shares of large values, ten seeds each."""
    arms = t(spark, d, "events").groupBy("event_type").agg(F.avg((F.col("value") > 50).cast("double")).alias("p")).agg(F.transform(F.sort_array(F.collect_list(F.struct("event_type", "p"))), lambda x: x["p"]).alias("arms"))  # a row an arm
    runs = spark.range(30).select(F.col("id").alias("run"), F.element_at(F.array(F.lit("epsilon"), F.lit("ucb1"), F.lit("thompson")), (F.col("id") % 3 + 1).cast("int")).alias("policy"), F.col("id").alias("seed"))
    return L.bandit_runs(runs.crossJoin(F.broadcast(arms)), 1000).select("run", "policy", r("rewards", 1).alias("rewards"), r("regret", 4).alias("regret"), r("best_share").alias("best_share"))  # one row


# ---- features ----------------------------------------------------------------------------------------------------


@q("ft02", "SELECT c_custkey, CASE WHEN last IS NULL THEN 'unknown' WHEN epoch(TIMESTAMP '2024-01-31') - epoch(last) <= 36000 THEN 'fresh' ELSE 'stale' END AS state FROM customer LEFT JOIN (SELECT user_id, max(ts) AS last FROM events GROUP BY 1) ON c_custkey = user_id")
def _(spark, d):
    last = t(spark, d, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("ts").alias("last"))
    c = t(spark, d, "customer").select("c_custkey", F.lit(36000).alias("sla"))
    return X.freshness(c, last, "c_custkey", "last", "2024-01-31", "sla").select("c_custkey", "state")


@q("ft03", "SELECT user_id, max(CASE WHEN event_type = 'view' THEN v END) AS view, max(CASE WHEN event_type = 'click' THEN v END) AS click FROM (SELECT user_id, event_type, arg_max(value, event_id) AS v FROM events GROUP BY ALL) GROUP BY 1")
def _(spark, d):
    last = t(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("v"))
    return last.groupBy("user_id").agg(*[F.max(F.when(F.col("event_type") == k, F.col("v"))).alias(k) for k in ("view", "click")])


@q("ft04", "SELECT user_id, event_id, value FROM events WHERE user_id IN (3, 5, 8) AND ts <= TIMESTAMP '2024-01-20'")
def _(spark, d):
    return t(spark, d, "events").where(F.col("user_id").isin(3, 5, 8) & (F.col("ts") <= F.lit("2024-01-20").cast("timestamp_ntz"))).select("user_id", "event_id", "value").orderBy(F.desc("event_id"))


@q("ft05", "SELECT driver_id, count(DISTINCT event_id) AS pings, count(DISTINCT zone_id) AS zones, round(avg(CAST(status = 'busy' AS INT)), 5) AS busy, count(DISTINCT CAST(timezone('UTC', recorded_at) AS DATE)) AS days FROM processed_locations GROUP BY 1")
def _(spark, d):
    p = t(spark, d, "processed_locations")
    return p.groupBy("driver_id").agg(F.count_distinct("event_id").alias("pings"), F.count_distinct("zone_id").alias("zones"), r(F.avg((F.col("status") == "busy").cast("int"))).alias("busy"), F.count_distinct(F.to_date("recorded_at")).alias("days"))


@q("ft06", "SELECT zone_id, hour(timezone('UTC', recorded_at)) AS hour, count(*) AS pings, count(DISTINCT driver_id) AS drivers FROM processed_locations WHERE zone_id IS NOT NULL GROUP BY ALL")
def _(spark, d):
    return t(spark, d, "processed_locations").where("zone_id IS NOT NULL").groupBy("zone_id", F.hour("recorded_at").alias("hour")).agg(n_rows().alias("pings"), F.count_distinct("driver_id").alias("drivers"))


@q("ft07", "SELECT event_type AS station, hour(ts) AS hour, round(avg(value), 5) AS mean, round(max(value) - min(value), 5) AS span FROM events GROUP BY ALL")
def _(spark, d):
    return t(spark, d, "events").groupBy(F.col("event_type").alias("station"), F.hour("ts").alias("hour")).agg(r(F.avg("value")).alias("mean"), r(F.max("value") - F.min("value")).alias("span"))


@q("ft08")
def _(spark, d):
    return X.hashed_split(t(spark, d, "orders"), "o_orderkey", [0.7, 0.15, 0.15]).groupBy("part").agg(n_rows().alias("n"))


@q("ft08_time", "WITH a AS (SELECT o_orderdate AS moment, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1), b AS (SELECT moment, n, coalesce(sum(n) OVER (ORDER BY moment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER () AS q FROM a) SELECT CAST(q + 1e-12 >= 0.7 AS INT) + CAST(q + 1e-12 >= 0.85 AS INT) AS part, CAST(sum(n) AS BIGINT) AS n, CAST(min(moment) AS DATE) AS first, CAST(max(moment) AS DATE) AS last FROM b GROUP BY 1")
def _(spark, d):
    x = X.split_by_time(t(spark, d, "orders"), "o_orderdate", [0.7, 0.15, 0.15])
    return x.groupBy("part").agg(n_rows().alias("n"), F.to_date(F.min("o_orderdate")).alias("first"), F.to_date(F.max("o_orderdate")).alias("last"))


@q("ft08_strata", "SELECT o_orderpriority, CAST(q + 1e-12 >= 0.7 AS INT) + CAST(q + 1e-12 >= 0.85 AS INT) AS part, count(*) AS n FROM (SELECT o_orderpriority, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) / count(*) OVER (PARTITION BY o_orderpriority) AS q FROM orders) GROUP BY ALL")
def _(spark, d):
    return X.stratified_split(t(spark, d, "orders"), "o_orderpriority", "o_orderkey", [0.7, 0.15, 0.15]).groupBy("o_orderpriority", "part").agg(n_rows().alias("n"))


@q("ft09")
def _(spark, d):
    return X.folds(t(spark, d, "orders"), "o_orderkey", 5).groupBy("fold").agg(n_rows().alias("n"))


# ---- models ------------------------------------------------------------------------------------------------------

_UI = "SELECT l_suppkey AS u, l_partkey AS i, avg(l_quantity) AS r FROM lineitem GROUP BY ALL"


def _ratings(spark, d):
    return t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("i")).agg(F.avg("l_quantity").alias("r"))


_SIM = f"WITH x AS ({_UI}), s AS (SELECT a.u AS a, b.u AS b, sum(a.r * b.r) / (sqrt(sum(a.r * a.r)) * sqrt(sum(b.r * b.r))) AS s FROM x a JOIN x b ON a.i = b.i AND a.u <> b.u GROUP BY ALL HAVING count(*) >= 2), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(s, 9) DESC, b) AS k FROM s) WHERE k <= 10), c AS (SELECT n.a AS u, x.i, sum(n.s * x.r) / sum(n.s) AS score FROM n JOIN x ON n.b = x.u GROUP BY ALL)"


@q("ml01", f"{_SIM} SELECT u, i, round(score, 4) AS score, rank FROM (SELECT c.*, row_number() OVER (PARTITION BY c.u ORDER BY round(score, 9) DESC, c.i) AS rank FROM c LEFT JOIN x ON c.u = x.u AND c.i = x.i WHERE x.u IS NULL) WHERE rank <= 5")
def _(spark, d):
    return X.recommend(_ratings(spark, d)).select("u", "i", r("score", 4).alias("score"), "rank")


@q("ml02", "WITH p AS (SELECT l_suppkey AS u, p_size % 10 AS f, sum(l_quantity) AS w FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), n AS (SELECT u, sqrt(sum(w * w)) AS n FROM p GROUP BY 1) SELECT u, f, round(w / n, 5) AS cosine FROM p JOIN n USING (u)")
def _(spark, d):
    """Profile of features weighted by rating against one-feature items."""
    x = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    p = x.groupBy(F.col("l_suppkey").alias("u"), (F.col("p_size") % 10).alias("f")).agg(F.sum("l_quantity").alias("w"))
    return p.select("u", "f", r(F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("u")))).alias("cosine"))


@q("ml03", "WITH a AS (SELECT l_partkey AS i, count(*) AS x FROM lineitem GROUP BY 1 ORDER BY x DESC, i LIMIT 30), b AS (SELECT p_partkey AS i, p_retailprice AS y FROM part ORDER BY y DESC, i LIMIT 30), na AS (SELECT i, (x - min(x) OVER ()) / nullif(max(x) OVER () - min(x) OVER (), 0) AS x FROM a), nb AS (SELECT i, (y - min(y) OVER ()) / nullif(max(y) OVER () - min(y) OVER (), 0) AS y FROM b) SELECT coalesce(na.i, nb.i) AS i, round(0.6 * coalesce(x, 0) + 0.4 * coalesce(y, 0), 5) AS score FROM na FULL JOIN nb ON na.i = nb.i")
def _(spark, d):
    a = t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("i")).agg(n_rows().alias("x")).orderBy(F.desc("x"), "i").limit(30)
    b = t(spark, d, "part").select(F.col("p_partkey").alias("i"), F.col("p_retailprice").alias("y")).orderBy(F.desc("y"), "i").limit(30)
    w = W.partitionBy(F.lit(1))
    scale = lambda c: F.try_divide(F.col(c) - F.min(c).over(w), F.max(c).over(w) - F.min(c).over(w))
    j = a.select("i", scale("x").alias("x")).join(b.select("i", scale("y").alias("y")), "i", "full")
    return j.select("i", r(0.6 * F.coalesce("x", F.lit(0.0)) + 0.4 * F.coalesce("y", F.lit(0.0))).alias("score"))


@q("ml04", "SELECT p_partkey, round(coalesce(n, 0) * coalesce(m, 0) / 100 + CASE WHEN p_type = 'SMALL' THEN 1.5 ELSE 0 END, 4) AS score FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, avg(l_quantity) AS m FROM lineitem GROUP BY 1) ON p_partkey = l_partkey")
def _(spark, d):
    pop = t(spark, d, "lineitem").groupBy("l_partkey").agg(n_rows().alias("n"), F.avg("l_quantity").alias("m"))
    p = t(spark, d, "part").join(pop, F.col("p_partkey") == F.col("l_partkey"), "left")
    return p.select("p_partkey", r(F.coalesce("n", F.lit(0)) * F.coalesce("m", F.lit(0.0)) / 100 + F.when(F.col("p_type") == "SMALL", 1.5).otherwise(0.0), 4).alias("score"))


@q("ml05")
def _(spark, d):
    """Explicit factors by alternating least squares; (user, item, prediction) over the rated pairs."""
    from pyspark.ml.recommendation import ALS

    x = _ratings(spark, d).select(F.col("u").cast("int"), F.col("i").cast("int"), F.col("r").cast("float"))
    model = ALS(rank=6, maxIter=8, regParam=0.1, userCol="u", itemCol="i", ratingCol="r", seed=3, coldStartStrategy="drop").fit(x)
    return model.transform(x).select("u", "i", "r", F.round("prediction", 3).alias("prediction"))


@q("ml05_rmse")
def _(spark, d):
    """Error of the factors on a hashed fifth of the ratings they did not see, against that of the mean rating."""
    from pyspark.ml.recommendation import ALS

    x = X.hashed_split(_ratings(spark, d).select(F.col("u").cast("int"), F.col("i").cast("int"), F.col("r").cast("float"), F.xxhash64("u", "i").alias("k")), "k", [0.8, 0.2])
    train = x.where("part = 0")
    p = ALS(rank=6, maxIter=8, regParam=0.1, userCol="u", itemCol="i", ratingCol="r", seed=3, coldStartStrategy="drop").fit(train).transform(x.where("part = 1"))
    p = p.crossJoin(F.broadcast(train.agg(F.avg("r").alias("m"))))  # one row
    return p.agg(n_rows().alias("n"), r(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("r"), 2))), 4).alias("rmse"), r(F.sqrt(F.avg(F.pow(F.col("m") - F.col("r"), 2))), 4).alias("rmse_of_mean"))


_NET = ["l_quantity", "l_discount", "l_tax"]


@q("ml06_net")
def _(spark, d):
    """The two-layer net: its epochs with rate and validation loss."""
    net = L.train_net(t(spark, d, "lineitem"), _NET, "l_extendedprice", hidden=6, epochs=12, batches=2, schedule=L.step_decay(0.02, 4), patience=3)
    return spark.createDataFrame([(h["epoch"], float(h["rate"]), float(round(h["loss"], 6))) for h in net.history], "epoch int, rate double, loss double")


@q("ml07_search")
def _(spark, d):
    """Grid, seeded random and tree-structured search over two smoothing factors; the points of a round share one pass."""
    w = W.partitionBy("event_type").orderBy("day")
    e = t(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v")).withColumns({"p1": F.lag("v").over(w), "p2": F.lag("v", 2).over(w), "p3": F.lag("v", 3).over(w)}).where("p3 IS NOT NULL")
    e = written(e, "lags")  # a row a day and type

    def score(points):
        err = lambda p: F.col("v") - (p["a"] * F.col("p1") + (1 - p["a"]) * (p["b"] * F.col("p2") + (1 - p["b"]) * F.col("p3")))
        return list(e.agg(*[F.sqrt(F.avg(err(p) * err(p))).alias(f"s{i}") for i, p in enumerate(points)]).first())

    space = {"a": (0.0, 1.0), "b": (0.0, 1.0)}
    rows = [(how, i, p["a"], p["b"], s) for how in ("grid", "random", "tree") for i, (p, s) in enumerate(L.search(space, score, how, trials=16))]
    return spark.createDataFrame(rows, "how string, trial int, a double, b double, rmse double")


@q("udf04", "WITH x AS (SELECT *, o_orderkey % 4 AS fold FROM orders), m AS (SELECT f.fold, avg(o_totalprice) AS p FROM x, (SELECT DISTINCT fold FROM x) f WHERE x.fold <> f.fold GROUP BY 1) SELECT fold, round(sqrt(avg((o_totalprice - p) * (o_totalprice - p))), 3) AS rmse, round(avg(abs(o_totalprice - p)), 3) AS mae, round(avg(CASE WHEN o_totalprice > 2 * p THEN 1.0 ELSE 0.0 END), 5) AS far FROM x JOIN m USING (fold) GROUP BY 1")
def _(spark, d):
    """Cross-validation of a mean with metrics given as functions, one of the caller's own among them."""
    x = t(spark, d, "orders").withColumn("fold", F.col("o_orderkey") % 4)

    def fit(train):
        m = train.agg(F.avg("o_totalprice").alias("prediction"))
        return lambda test: test.crossJoin(F.broadcast(m))  # one row

    own = {"rmse": L.METRICS["rmse"], "mae": L.METRICS["mae"], "far": lambda y, p: F.avg((y > 2 * p).cast("double"))}
    return L.cross_validated(x, "fold", "o_totalprice", fit, own).select("fold", r("rmse", 3).alias("rmse"), r("mae", 3).alias("mae"), r("far").alias("far"))


@q("ml06")
def _(spark, d):
    """A linear network with elastic stopping, by the built-in optimiser."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    x = VectorAssembler(inputCols=["l_quantity", "l_discount", "l_tax"], outputCol="f").transform(t(spark, d, "lineitem"))
    m = LinearRegression(featuresCol="f", labelCol="l_extendedprice", maxIter=20, regParam=0.01).fit(x)
    return m.transform(x).agg(F.round(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("l_extendedprice"), 2))), 2).alias("rmse"))


@q("ml07")
def _(spark, d):
    """Grid over smoothing factors: error of each from one pass."""
    grid = [0.1, 0.3, 0.5, 0.7, 0.9]
    w = W.partitionBy("event_type").orderBy("day")
    e = t(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v")).withColumns({"p1": F.lag("v").over(w), "p2": F.lag("v", 2).over(w)}).where("p2 IS NOT NULL")
    one = e.agg(*[F.sqrt(F.avg(F.pow(F.col("v") - (a * F.col("p1") + (1 - a) * F.col("p2")), 2))).alias(f"g{i}") for i, a in enumerate(grid)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("alpha"), F.round(f"g{i}", 4).alias("rmse")) for i, a in enumerate(grid)])).alias("x")).select("x.*")


@q("ml08", "SELECT user_id AS run, arg_max(value, (ts, event_id)) AS last, max(value) AS best FROM events GROUP BY 1")
def _(spark, d):
    return t(spark, d, "events").groupBy(F.col("user_id").alias("run")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("last"), F.max("value").alias("best"))


# ---- series ------------------------------------------------------------------------------------------------------

_DAY = "SELECT event_type, CAST(ts AS DATE) AS day, sum(value) AS v FROM events GROUP BY ALL"
_DEC = f"WITH s AS (SELECT event_type, day, v, (row_number() OVER (PARTITION BY event_type ORDER BY day) - 1) % 7 AS p, CASE WHEN count(*) OVER w = 7 THEN avg(v) OVER w END AS tr FROM ({_DAY}) WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))"


def _days(spark, d):
    return t(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))


@q("ts01", f"{_DEC}, m AS (SELECT event_type, p, avg(v - tr) AS s FROM s GROUP BY ALL), c AS (SELECT event_type, p, s - avg(s) OVER (PARTITION BY event_type) AS seasonal FROM m) SELECT event_type, strftime(day, '%Y-%m-%d') AS day, round(tr, 4) AS trend, round(seasonal, 4) AS seasonal, round(v - tr - seasonal, 4) AS residual FROM s JOIN c USING (event_type, p)")
def _(spark, d):
    x = TS.decompose(_days(spark, d), ["event_type"], "day", "v", 7)
    return x.select("event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), *[r(c, 4).alias(c) for c in ("trend", "seasonal", "residual")])


@q("ts02", f"{_DEC}, m AS (SELECT event_type, p, avg(v / tr) AS s FROM s GROUP BY ALL), c AS (SELECT event_type, p, s / avg(s) OVER (PARTITION BY event_type) AS seasonal FROM m) SELECT event_type, strftime(day, '%Y-%m-%d') AS day, round(seasonal, 5) AS seasonal, round(v / (tr * seasonal), 5) AS residual FROM s JOIN c USING (event_type, p)")
def _(spark, d):
    x = TS.decompose(_days(spark, d), ["event_type"], "day", "v", 7, multiplicative=True)
    return x.select("event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), *[r(c).alias(c) for c in ("seasonal", "residual")])


@q("ts03", f"{_DEC} SELECT event_type, CAST(p AS BIGINT) AS position, round(avg(v - tr), 4) AS seasonal FROM s GROUP BY ALL")
def _(spark, d):
    """The variant whose seasonal part is not centred."""
    w = W.partitionBy("event_type").orderBy("day")
    x = TS.centred_average(_days(spark, d), ["event_type"], "day", "v", 7).withColumn("position", (F.row_number().over(w) - 1) % 7)
    return x.groupBy("event_type", F.col("position").cast("long").alias("position")).agg(r(F.avg(F.col("v") - F.col("trend")), 4).alias("seasonal"))


@q("ts04")
def _(spark, d):
    return TS.yule_walker(_days(spark, d), "event_type", "day", "v", 2, 5).withColumn("forecast", F.round("forecast", 4))


@q("ts05", f"SELECT event_type, abs(b - a) / abs(a) < 0.2 AND vb / va < 2 AND va / vb < 2 AS stationary FROM (SELECT event_type, avg(v) FILTER (WHERE i <= n // 2) AS a, avg(v) FILTER (WHERE i > n // 2) AS b, var_pop(v) FILTER (WHERE i <= n // 2) AS va, var_pop(v) FILTER (WHERE i > n // 2) AS vb FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM ({_DAY})) GROUP BY 1)")
def _(spark, d):
    w = W.partitionBy("event_type")
    x = _days(spark, d).withColumns({"i": F.row_number().over(w.orderBy("day")), "n": n_rows().over(w)})
    early = F.col("i") <= F.expr("n div 2")
    a, b, va, vb = F.avg(F.when(early, F.col("v"))), F.avg(F.when(~early, F.col("v"))), F.var_pop(F.when(early, F.col("v"))), F.var_pop(F.when(~early, F.col("v")))
    return x.groupBy("event_type").agg(((F.abs(b - a) / F.abs(a) < 0.2) & (vb / va < 2) & (va / vb < 2)).alias("stationary"))


@q("ts06", f"SELECT event_type, round(regr_slope(v, i), 4) AS slope, round(regr_intercept(v, i), 4) AS intercept, round(greatest(regr_intercept(v, i) + regr_slope(v, i) * (max(i) + 7), 0), 4) AS next_week FROM (SELECT event_type, v, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i FROM ({_DAY})) GROUP BY 1")
def _(spark, d):
    x = _days(spark, d).withColumn("i", F.row_number().over(W.partitionBy("event_type").orderBy("day")))
    s, c = F.regr_slope("v", "i"), F.regr_intercept("v", "i")
    return x.groupBy("event_type").agg(r(s, 4).alias("slope"), r(c, 4).alias("intercept"), r(F.greatest(c + s * (F.max("i") + 7), F.lit(0.0)), 4).alias("next_week"))


@q("ts07", "SELECT f.f AS fold, 0 AS train_first, n - (4 - f.f) * 3 - 1 AS train_last, n - (4 - f.f) * 3 AS test_first, n - (4 - f.f) * 3 + 2 AS test_last FROM range(0, 4) f(f), (SELECT count(DISTINCT CAST(ts AS DATE)) AS n FROM events)")
def _(spark, d):
    days = t(spark, d, "events").select(F.to_date("ts").alias("day")).distinct()
    return TS.splits(days, [F.col("day")], 4, 3)


@q("ts08", f"SELECT event_type, round(list_sort(list(e))[CAST(least(floor(count(e) * 0.9), count(e) - 1) AS BIGINT) + 1], 4) AS width FROM (SELECT event_type, abs(v - lag(v) OVER (PARTITION BY event_type ORDER BY day)) AS e FROM ({_DAY})) WHERE e IS NOT NULL GROUP BY 1")
def _(spark, d):
    """Conformal width of a naive forecast: a rank of its absolute errors."""
    from rideloom.operators.aggregates import ranked_value

    x = _days(spark, d).withColumn("e", F.abs(F.col("v") - F.lag("v").over(W.partitionBy("event_type").orderBy("day")))).where("e IS NOT NULL")
    return ranked_value(x, ["event_type"], "e", 0.9).select("event_type", r("value", 4).alias("width"))


@q("ts08_bootstrap")
def _(spark, d):
    """Bootstrap intervals of each type's mean."""
    x = L.bootstrap_means(t(spark, d, "events"), ["event_type"], "event_id", "value", 100)
    return x.select("event_type", r("mean", 4).alias("mean"), r("lo", 4).alias("lo"), r("hi", 4).alias("hi"))


@q("ts09", "WITH b AS (SELECT event_type, list_sort(list(value)) AS l FROM events GROUP BY 1), e AS (SELECT event_type, l[CAST(floor(len(l) * 0.1) AS BIGINT) + 1] AS lo, l[CAST(floor(len(l) * 0.9) AS BIGINT) + 1] AS hi FROM b) SELECT event_type, lo, hi, round(avg(CAST(value < lo OR value > hi AS INT)), 5) AS outside FROM events JOIN e USING (event_type) GROUP BY ALL")
def _(spark, d):
    from rideloom.operators.aggregates import ranked_value

    e = t(spark, d, "events")
    lo, hi = (ranked_value(e, ["event_type"], "value", p).withColumnRenamed("value", n) for p, n in ((0.1, "lo"), (0.9, "hi")))
    j = e.join(F.broadcast(lo.join(hi, "event_type")), "event_type")  # a row a type
    return j.groupBy("event_type", "lo", "hi").agg(r(F.avg(((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi"))).cast("int"))).alias("outside"))


@q("ts10", "SELECT event_type, round(avg(n) FILTER (WHERE h BETWEEN 7 AND 9) / avg(n), 5) AS morning, round(avg(n) FILTER (WHERE h BETWEEN 17 AND 19) / avg(n), 5) AS evening FROM (SELECT event_type, hour(ts) AS h, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1")
def _(spark, d):
    x = t(spark, d, "events").groupBy("event_type", F.hour("ts").alias("h")).agg(n_rows().alias("n"))
    at = lambda a, b: F.avg(F.when(F.col("h").between(a, b), F.col("n"))) / F.avg("n")
    return x.groupBy("event_type").agg(r(at(7, 9)).alias("morning"), r(at(17, 19)).alias("evening"))


# ---- space -------------------------------------------------------------------------------------------------------

_ZONE = "WITH z AS (SELECT zone_id, (lat_min + lat_max) / 2 AS la, (lon_min + lon_max) / 2 AS lo FROM dim_zones), n AS (SELECT z.zone_id, la, lo, count(p.event_id) AS x FROM z LEFT JOIN (SELECT DISTINCT event_id, zone_id FROM processed_locations) p USING (zone_id) GROUP BY ALL), k AS (SELECT a.zone_id AS a, b.zone_id AS b, b.x, 2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(b.la - a.la) / 2), 2) + cos(radians(a.la)) * cos(radians(b.la)) * pow(sin(radians(b.lo - a.lo) / 2), 2)))) AS km FROM n a JOIN n b ON a.zone_id <> b.zone_id)"


def _zones(spark, d):
    """(zone_id, x) and near pairs within 5 km, both of the 40 fixed zones."""
    from rideloom.operators.proximity import near_pairs

    z = t(spark, d, "dim_zones").select("zone_id", ((F.col("lat_min") + F.col("lat_max")) / 2).alias("lat"), ((F.col("lon_min") + F.col("lon_max")) / 2).alias("lon"))
    p = t(spark, d, "processed_locations").select("event_id", "zone_id").distinct().groupBy("zone_id").agg(n_rows().alias("x"))
    n = z.join(p, "zone_id", "left").select("zone_id", F.coalesce("x", F.lit(0)).alias("x"))
    k = near_pairs(z.withColumn("id", F.format_string("%06d", "zone_id")), id_col="id", lat="lat", lon="lon", radius_m=5000.0)
    k = k.select(F.col("id_a").cast("int").alias("a"), F.col("id_b").cast("int").alias("b"), (F.col("distance_m") / 1000).alias("km"))
    return n, k.unionByName(k.select(F.col("b").alias("a"), F.col("a").alias("b"), "km"))


@q("spa01", f"{_ZONE}, s AS (SELECT avg(x) AS m, stddev_pop(x) AS sd FROM n) SELECT k.a AS zone_id, round((n.x - m) / sd * avg((k.x - m) / sd), 4) AS local FROM k JOIN n ON n.zone_id = k.a, s WHERE km <= 5 GROUP BY k.a, n.x, m, sd")
def _(spark, d):
    n, k = _zones(spark, d)
    s = n.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"))
    z = n.crossJoin(F.broadcast(s)).select("zone_id", ((F.col("x") - F.col("m")) / F.col("sd")).alias("z"))  # one row
    j = k.join(z.withColumnRenamed("z", "zb"), k["b"] == F.col("zone_id")).groupBy("a").agg(F.avg("zb").alias("around"))
    return j.join(z, j["a"] == z["zone_id"]).select("zone_id", r(F.col("z") * F.col("around"), 4).alias("local"))


@q("spa02", "SELECT zone_id, arg_max(h, (n, -h)) AS peak, arg_min(h, (n, h)) AS trough, max(n) - min(n) AS amplitude FROM (SELECT zone_id, hour(timezone('UTC', recorded_at)) AS h, count(*) AS n FROM processed_locations WHERE zone_id IS NOT NULL GROUP BY ALL) GROUP BY 1")
def _(spark, d):
    x = t(spark, d, "processed_locations").where("zone_id IS NOT NULL").groupBy("zone_id", F.hour("recorded_at").alias("h")).agg(n_rows().alias("n"))
    return x.groupBy("zone_id").agg(F.max_by("h", F.struct("n", -F.col("h"))).alias("peak"), F.min_by("h", F.struct("n", "h")).alias("trough"), (F.max("n") - F.min("n")).alias("amplitude"))


@q("spa03", f"{_ZONE} SELECT a AS zone_id, round(CASE WHEN min(km) < 0.001 THEN arg_min(x, km) ELSE sum(x / km) / sum(1 / km) END, 4) AS estimate FROM k WHERE km <= 5 GROUP BY 1")
def _(spark, d):
    n, k = _zones(spark, d)
    j = k.join(n, k["b"] == n["zone_id"])
    return j.groupBy(F.col("a").alias("zone_id")).agg(r(F.when(F.min("km") < 0.001, F.min_by("x", "km").cast("double")).otherwise(F.sum(F.col("x") / F.col("km")) / F.sum(1 / F.col("km"))), 4).alias("estimate"))


# ---- graphs ------------------------------------------------------------------------------------------------------


@q("gr01", "SELECT l_suppkey, count(DISTINCT l_partkey) AS fan_out FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) > 20")
def _(spark, d):
    return t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("fan_out")).where("fan_out > 20")


@q("gr02")
def _(spark, d):
    return X.pagerank(t(spark, d, "lineitem"), "l_suppkey", "l_partkey").select("node", "rank")  # not rounded: ranks of many nodes are small


def _roads(spark, d):
    return t(spark, d, "lineitem").where("l_suppkey <> l_partkey").select((F.col("l_suppkey") % 40).alias("s"), (F.col("l_partkey") % 40).alias("t"), F.col("l_quantity").alias("w")).where("s <> t")


@q("gr03", "WITH RECURSIVE e AS (SELECT s, t, min(w) AS w FROM (SELECT l_suppkey % 40 AS s, l_partkey % 40 AS t, l_quantity AS w FROM lineitem WHERE l_suppkey <> l_partkey) WHERE s <> t GROUP BY ALL), p AS (SELECT 0::BIGINT AS node, 0.0::DOUBLE AS cost, 0 AS hops UNION SELECT e.t, p.cost + e.w, p.hops + 1 FROM p JOIN e ON p.node = e.s WHERE p.hops < 4 AND p.cost + e.w <= 8) SELECT node, min(cost) AS cost FROM p GROUP BY 1 HAVING min(cost) <= 4")
def _(spark, d):
    return X.shortest(_roads(spark, d), "s", "t", "w", 0).where("cost <= 4")


def _first(spark, d):
    return t(spark, d, "lineitem").agg(F.min("l_suppkey")).first()[0]


@q("gr03_whole")
def _(spark, d):
    """Every node that the first supplier reaches, whatever its cost, on real ids."""
    return X.shortest(t(spark, d, "lineitem"), "l_suppkey", "l_partkey", "l_quantity", _first(spark, d))


@q("gr03_hour")
def _(spark, d):
    """By minutes at 8 o'clock: a row is a segment of l_quantity km, two thirds of them with speeds by hour."""
    x = t(spark, d, "lineitem").select(F.struct("l_suppkey", "l_partkey").alias("segment"), F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("t"), F.col("l_quantity").alias("km"), F.lit(50.0).alias("limit"))
    p = x.where("s % 3 <> 0").select("segment", F.explode(F.array(F.lit(8), F.lit(12))).alias("hour"), "s").select("segment", "hour", (20.0 + F.col("hour") + F.col("s") % 40).alias("speed"))
    return X.shortest(X.minutes_at(x, p, 8), "s", "t", "minutes", _first(spark, d))


_GV = "WITH e AS (SELECT l_suppkey AS s, l_partkey % 100 AS t, sum(l_quantity) AS w FROM lineitem WHERE l_suppkey <> l_partkey % 100 GROUP BY ALL), v AS (SELECT s_suppkey AS node, s_acctbal AS value FROM supplier)"


def _graph(spark, d):
    e = t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s"), (F.col("l_partkey") % 100).alias("t")).agg(F.sum("l_quantity").alias("w")).where("s <> t")
    return t(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_acctbal").alias("value")), e


@q("gr04", f"{_GV}, m AS (SELECT s AS node, sum(w * value) / sum(w) AS a FROM e JOIN v ON e.t = v.node GROUP BY 1) SELECT v.node, round(coalesce(m.a, v.value), 4) AS value FROM v LEFT JOIN m USING (node)")
def _(spark, d):
    v, e = _graph(spark, d)
    return X.neighbour_mean(v, e).select("node", r("value", 4).alias("value"))


@q("gr05", "SELECT o_orderkey, round(sum(l_quantity / coalesce(sp.v, 50)), 8) AS eta FROM orders JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN (SELECT s_suppkey, 30 + s_suppkey % 40 AS v FROM supplier WHERE s_suppkey % 3 = 0) sp ON l_suppkey = s_suppkey GROUP BY 1")
def _(spark, d):
    sp = t(spark, d, "supplier").where("s_suppkey % 3 = 0").select("s_suppkey", (30 + F.col("s_suppkey") % 40).alias("v"))
    x = t(spark, d, "lineitem").join(sp, F.col("l_suppkey") == F.col("s_suppkey"), "left").withColumn("h", F.col("l_quantity") / F.coalesce("v", F.lit(50)))
    x = x.groupBy("l_orderkey").agg(F.sum("h").alias("eta"))
    return x.join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select(F.col("l_orderkey").alias("o_orderkey"), r("eta", 8).alias("eta"))


@q("gr06", "WITH RECURSIVE s AS (SELECT event_id AS id, event_id // 2 AS up, value FROM events WHERE event_id >= 1), p AS (SELECT id, up, value AS total FROM s WHERE id = 1 UNION ALL SELECT s.id, s.up, p.total + s.value FROM s JOIN p ON s.up = p.id WHERE s.id <> 1) SELECT round(max(total), 4) AS critical FROM p")
def _(spark, d):
    e = t(spark, d, "events").where("event_id >= 1").select(F.col("event_id").alias("id"), F.expr("event_id div 2").alias("up"), "value")
    return X.path_totals(e, "id", "up", "value", 1).agg(r(F.max("total"), 4).alias("critical"))


@q("gr07", f"{_GV}, m AS (SELECT s AS node, sum(w * value) / sum(w) AS a FROM e JOIN v ON e.t = v.node GROUP BY 1) SELECT v.node, round(CASE WHEN m.a IS NULL THEN v.value ELSE 0.5 * v.value + 0.5 * m.a END, 4) AS value FROM v LEFT JOIN m USING (node)")
def _(spark, d):
    v, e = _graph(spark, d)
    return X.neighbour_mean(v, e, own=0.5).select("node", r("value", 4).alias("value"))


# ---- text (plain operators of the query surface) -----------------------------------------------------------------

_W = "SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL"


@q("tx01", f"SELECT doc_id, len(w) AS tokens FROM ({_W})")
def _(spark, d):
    return t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.size(X.words(F.col("text"))).alias("tokens"))


@q("tx02", f"SELECT doc_id, CAST(CASE WHEN n = 0 THEN 0 WHEN n <= 50 THEN 1 ELSE ceil((n - 50) / 35.0) + 1 END AS INTEGER) AS chunks FROM (SELECT doc_id, len(w) AS n FROM ({_W}))")
def _(spark, d):
    c = X.chunks(X.words(F.col("text")), 50, 15)
    return t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.size(c).alias("chunks"))


_TF = f"WITH w AS ({_W}), c AS (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM w), tc AS (SELECT doc_id, term, n, count(*) AS tf FROM c GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM tc GROUP BY 1), x AS (SELECT doc_id, term, tf / n * ln((SELECT count(*) FROM w) / df) AS wt FROM tc JOIN d USING (term))"


@q("tx03", f"{_TF} SELECT doc_id, round(score, 6) AS score FROM (SELECT doc_id, sum(CASE WHEN term IN ('refund', 'bag', 'driver') THEN wt ELSE 0 END) / (sqrt(sum(wt * wt)) * sqrt(3)) AS score FROM x GROUP BY 1 HAVING sqrt(sum(wt * wt)) > 0) WHERE score > 0 ORDER BY round(score, 9) DESC, doc_id LIMIT 20")
def _(spark, d):
    return X.retrieve(X.tfidf(t(spark, d, "documents"), "doc_id", "text"), "doc_id", ["refund", "bag", "driver"], 20).select("doc_id", r("score", 6).alias("score"))


@q("tx04", f"WITH w AS ({_W}), a AS (SELECT avg(len(w)) AS al FROM w), tc AS (SELECT doc_id, term, n, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM w) GROUP BY ALL) SELECT doc_id, round(sum(ln(2) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / al))), 5) AS score FROM tc, a WHERE term IN ('refund', 'receipt') GROUP BY 1")
def _(spark, d):
    docs = t(spark, d, "documents").where("text IS NOT NULL")
    al = docs.agg(F.avg(F.size(X.words(F.col("text")))).alias("al"))
    c = X.term_counts(docs, "doc_id", "text").crossJoin(F.broadcast(al))  # one row
    return X.bm25(c, "doc_id", ["refund", "receipt"], F.col("al")).select("doc_id", r("score").alias("score"))


_BM = f"WITH w AS ({_W}), a AS (SELECT avg(len(w)) AS al FROM w), tc AS (SELECT doc_id, term, n, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM w) GROUP BY ALL), s AS (SELECT doc_id, n, sum(ln(2) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / al))) AS score FROM tc, a WHERE term IN ('refund', 'receipt') GROUP BY ALL)"


@q("tx05", f"{_BM} SELECT doc_id FROM (SELECT doc_id, sum(n) OVER (ORDER BY round(score, 9) DESC, doc_id) AS upto FROM (SELECT * FROM s ORDER BY round(score, 9) DESC, doc_id LIMIT 50)) WHERE upto <= 3000")
def _(spark, d):
    """The best passages of a query that fit a budget of tokens; retrieval hands on 50."""
    docs = t(spark, d, "documents").where("text IS NOT NULL")
    al = docs.agg(F.avg(F.size(X.words(F.col("text")))).alias("al"))
    c = X.term_counts(docs, "doc_id", "text").crossJoin(F.broadcast(al))  # one row
    best = [F.desc(F.round("score", 9)), F.col("doc_id")]
    top = X.bm25(c, "doc_id", ["refund", "receipt"], F.col("al")).orderBy(*best).limit(50)
    n = docs.select("doc_id", F.size(X.words(F.col("text"))).alias("n"))
    return n.join(F.broadcast(top), "doc_id").select("doc_id", F.sum("n").over(W.orderBy(*best)).alias("upto")).where("upto <= 3000").select("doc_id")


_INTENT = {"refund": ["refund", "charged"], "lost": ["bag", "lost", "forgot"], "delay": ["late", "waited", "queue"]}


@q("tx06", " UNION ALL ".join(f"SELECT doc_id, '{k}' AS intent, round(({' + '.join(f'CAST(contains(lower(text), {chr(39)}{x}{chr(39)}) AS INT)' for x in ws)}) / {len(ws)}.0, 5) AS score FROM documents WHERE text IS NOT NULL" for k, ws in _INTENT.items()))
def _(spark, d):
    low = F.lower("text")
    parts = F.array(*[F.struct(F.lit(k).alias("intent"), r(sum((F.contains(low, F.lit(x)).cast("int") for x in ws), F.lit(0)) / float(len(ws))).alias("score")) for k, ws in _INTENT.items()])
    return t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.explode(parts).alias("x")).select("doc_id", "x.*")


@q("tx07", "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[.!?]'), lambda s: contains(lower(s), 'refund') OR contains(lower(s), 'charged'))) AS refund_sentences FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    hit = lambda s: F.contains(F.lower(s), F.lit("refund")) | F.contains(F.lower(s), F.lit("charged"))
    return t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.size(F.filter(F.split("text", "[.!?]"), hit)).alias("refund_sentences"))


@q("tx08")
def _(spark, d):
    """Zones named in a text, with the offset of their first mention."""
    z = t(spark, d, "dim_zones").select("zone_id", F.lower("zone_name").alias("zn"))
    docs = t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.lower("text").alias("low"))
    return docs.join(F.broadcast(z), F.contains("low", "zn")).select("doc_id", "zone_id", (F.instr("low", F.col("zn")) - 1).alias("start"))  # 40 fixed rows


_STARTS = "list_sum(list_transform(parts[1:i], lambda p: length(p)))"


@q("tx08_all", f"WITH z AS (SELECT zone_id, lower(zone_name) AS zn FROM dim_zones), x AS (SELECT doc_id, zone_id, zn, string_split(lower(text), zn) AS parts FROM documents, z WHERE contains(lower(text), zn)), y AS (SELECT *, unnest(range(1, len(parts))) AS i FROM x) SELECT doc_id, zone_id, CAST({_STARTS} + (i - 1) * length(zn) AS BIGINT) AS start FROM y")
def _(spark, d):
    """Every mention of a zone with its offset, linked to the zone by its name in lower case."""
    import re

    z = t(spark, d, "dim_zones").select(F.lit("zone").alias("kind"), F.lower("zone_name").alias("alias"), F.col("zone_id").alias("entity"))
    names = sorted({x["alias"] for x in z.select("alias").distinct().limit(1001).collect()})  # 40 fixed rows
    docs = t(spark, d, "documents").select("doc_id", F.lower("text").alias("low"))
    found = X.mentions(docs, "doc_id", "low", [("zone", re.escape(n)) for n in names])
    return X.linked(found, F.broadcast(z)).select("doc_id", F.col("entity").alias("zone_id"), F.col("start").cast("long").alias("start"))


_OWN = [("money", "[$€][0-9]+[.,][0-9][0-9]"), ("ticket", "[A-Z][A-Z]+-[0-9]+-[0-9]+")]


@q("udf06", " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, hits[i] AS mention, CAST({_STARTS} + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS BIGINT) AS start FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '{x}') AS parts, regexp_extract_all(text, '{x}') AS hits FROM documents WHERE text IS NOT NULL))" for k, x in _OWN))
def _(spark, d):
    """Entities by the caller's own patterns."""
    return X.mentions(t(spark, d, "documents"), "doc_id", "text", _OWN).select("doc_id", "kind", "mention", F.col("start").cast("long").alias("start"))


_POS, _NEG = ["clean", "quiet", "smooth", "spotless", "brilliant", "thanks"], ["slow", "late", "declined", "crashed", "stuck", "wrong"]


@q("tx09", "SELECT doc_id, len(list_intersect(w, ['" + "', '".join(_POS) + "'])) - len(list_intersect(w, ['" + "', '".join(_NEG) + "'])) AS sentiment FROM (SELECT doc_id, list_distinct(string_split_regex(lower(text), '[ ]+')) AS w FROM documents WHERE text IS NOT NULL)")
def _(spark, d):
    w = F.array_distinct(F.split(F.lower("text"), "[ ]+"))
    count = lambda ws: F.size(F.array_intersect(w, F.array(*[F.lit(x) for x in ws])))
    return t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", (count(_POS) - count(_NEG)).alias("sentiment"))


QUERIES, SQL = book.QUERIES, book.SQL
