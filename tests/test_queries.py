"""Every query against its SQL on the smallest tables; those without SQL by what must hold of their rows there."""

import pytest

import __spark_entry__ as entry
from compare import differences, duck
from rideloom.plans import registry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


def test_sql_belongs_to_queries():
    assert SQL.keys() <= QUERIES.keys()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, small, con, name):
    diff, _ = differences(QUERIES[name](spark, small), con, SQL[name])
    assert not diff


def near(x, y, by=1e-6):
    return abs(x - y) <= by * max(1, abs(y))


def one_sql(con, sql):
    return con.execute(sql).fetchone()[0]


#: What must hold of the rows of each query without SQL: f(rows, connection to the same tables).
HOLDS = {
    # approximate counts within the sketch's error
    "agg25": lambda r, c: near(r[0][0], one_sql(c, "SELECT count(DISTINCT o_custkey) FROM orders"), 0.05),
    "udaf01": lambda r, c: len(r) == 10 and all(x[1] > 0 for x in r),
    # every row once, scores in range; lone rows score higher than the mean
    "an06": lambda r, c: len(r) == one_sql(c, "SELECT count(*) FROM lineitem") and all(0 < x.score < 1 for x in r),
    "an07": lambda r, c: len(r) == one_sql(c, "SELECT count(*) FROM supplier"),
    "an07_lof": lambda r, c: len(r) == one_sql(c, "SELECT count(*) FROM part") and 0.9 < sum(x.lof for x in r) / len(r) < 1.6 and min(x.lof for x in r) > 0,
    # splits hold every order once, in about the shares asked for
    "ft08": lambda r, c: sum(x.n for x in r) == one_sql(c, "SELECT count(*) FROM orders") and all(abs(x.n / 1500 - {0: 0.7, 1: 0.15, 2: 0.15}[x.part]) < 0.04 for x in r),
    "ft09": lambda r, c: sum(x.n for x in r) == one_sql(c, "SELECT count(*) FROM orders") and {x.fold for x in r} == set(range(5)) and all(250 < x.n < 350 for x in r),
    "geo07": lambda r, c: all(len(x[0]) == 6 and set(x[0]) <= set("0123456789bcdefghjkmnpqrstuvwxyz") for x in r),
    "geo10": lambda r, c: {x[0] for x in r} == set(range(1, 41)) and len({tuple(x) for x in r}) == len(r),
    # ranks: all nodes, none below the part that everyone gets, none above the whole
    "gr02": lambda r, c: len({x.node for x in r}) == len(r) == one_sql(c, "SELECT count(*) FROM (SELECT l_suppkey FROM lineitem UNION SELECT l_partkey FROM lineitem)") and all(0.15 / len(r) - 1e-12 <= x.rank <= 1 for x in r) and sum(x.rank for x in r) <= 1 + 1e-9,
    "gr03_whole": lambda r, c: len({x.node for x in r}) == len(r) == 200 and min(x.cost for x in r) == 0,
    "gr03_hour": lambda r, c: len({x.node for x in r}) == len(r) == 200 and min(x.cost for x in r) == 0,
    # one to one within a batch
    "join13": lambda r, c: len(r) == 40 and len({(x.batch, x.candidate) for x in r}) == len(r) == len({(x.batch, x.request) for x in r}),
    "join14": lambda r, c: len(r) == 40 and len({(x.batch, x.candidate) for x in r}) == len(r) == len({(x.batch, x.request) for x in r}),
    # fitted: nearer to the ratings than their mean; trials in order; a loss that falls
    "ml05": lambda r, c: sum((x.prediction - x.r) ** 2 for x in r) < sum((x.r - sum(y.r for y in r) / len(r)) ** 2 for x in r),
    "ml05_rmse": lambda r, c: r[0].n > 300 and r[0].rmse > 0 and r[0].rmse_of_mean > 0,
    "ml06": lambda r, c: 0 < r[0].rmse <= 1.001 * one_sql(c, "SELECT stddev_pop(l_extendedprice) FROM lineitem"),
    "ml06_net": lambda r, c: [x.epoch for x in r] == list(range(len(r))) and min(x.loss for x in r) <= r[0].loss and len(r) <= 12 and [x.rate for x in r] == [0.02 * 0.5 ** (x.epoch // 4) for x in r],
    "ml07": lambda r, c: [x.alpha for x in r] == [0.1, 0.3, 0.5, 0.7, 0.9] and all(x.rmse > 0 for x in r),
    "ml07_search": lambda r, c: {h: sum(x.how == h for x in r) for h in ("grid", "random", "tree")} == {"grid": 25, "random": 16, "tree": 16} and all(0 <= x.a <= 1 and 0 <= x.b <= 1 and x.rmse > 0 for x in r) and min(x.rmse for x in r if x.how == "tree") <= min(x.rmse for x in r if x.how == "tree" and x.trial < 8),
    # readings are of the tables, a reading once; every stop lasts at least its least time
    "p1_found": lambda r, c: len(set(r)) == len(r) == 249 and {x.field for x in r} == {"speed", "accuracy", "heading", "speed_kmh"} and {x.ping_id for x in r if x.field != "speed_kmh"} <= {x[0] for x in c.execute("SELECT id FROM driver_locations").fetchall()},
    "p1_reasons": lambda r, c: {x.reason for x in r} == {"bound", "spike", "stuck"} and sum(x.readings for x in r) == 249,
    "p2_found": lambda r, c: len(set(r)) == len(r) == 34 and all(x.stop_end - x.stop_start >= 359 for x in r),
    "p2_trips": lambda r, c: sum(x.kind == "stop" for x in r) == 34 and all(x.duration_s == x.end_s - x.start_s >= 0 and (x.distance_m >= 0 if x.kind == "trip" else x.distance_m == 0) for x in r),
    "src18": lambda r, c: sum(x.n for x in r) == 20_000 and len(r) == 4 and all(abs(x.mean - 50) < 2 for x in r),
    "src18_modes": lambda r, c: len(r) == 9 and all((x.n, x.span_s) == (2000, 1999) for x in r if x["mode"] == "synthetic") and all(x.n == 2000 and x["keys"] == 5 and x.span_s <= 59 for x in r if x["mode"] == "stress") and [(x.n, x.span_s) for x in r if x["mode"] == "replay"] == [(1000, 999)],
    # a thousand rounds each: less regret than always the worst arm
    "st20_policies": lambda r, c: len(r) == 30 and all(0 <= x.best_share <= 1 and 0 <= x.rewards <= 1000 for x in r) and all(x.regret < 60 for x in r),
    # nothing handled over capacity, every arrival handled, buffered or dropped
    "str17": lambda r, c: all(x.handled <= 50 and x.buffered >= 0 and x.dropped >= 0 for x in r) and [x.tick for x in r] == sorted(x.tick for x in r),
    "ts04": lambda r, c: len(r) == 25 and all(x[2] > 0 for x in r),
    "ts08_bootstrap": lambda r, c: len(r) == 5 and all(x.lo <= x["mean"] <= x.hi and x.hi - x.lo < 25 for x in r),
    "tx08": lambda r, c: len({(x.doc_id, x.zone_id) for x in r}) == len(r) == 94 and all(x.start >= 0 for x in r),
    "win16": lambda r, c: len(r) == one_sql(c, "SELECT count(*) FROM (SELECT DISTINCT event_type, CAST(ts AS DATE) FROM events)"),
}


@pytest.mark.parametrize("name", sorted(n for n in QUERIES.keys() - SQL.keys() if n in registry.queries()))
def test_what_must_hold(spark, small, con, name):
    assert HOLDS[name](QUERIES[name](spark, small).collect(), con)
