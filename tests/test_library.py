"""Literals of small frames, invariants and plan checks of the query surface."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rideloom.common import table
from rideloom.functions import geo, models, scalar
from rideloom.operators import aggregates, joins, lake, pipeline, quality, relational, timeseries
from rideloom.plans import advisor
from rideloom.sources import files


def test_filters_reach_the_scan(spark, small):
    df = relational.where_in(table(spark, small, "orders"), {"o_totalprice": (1.0, 2.0), "o_orderstatus": "F"}).select("o_orderkey")
    facts = advisor.plan_facts(df)
    assert any("GreaterThanOrEqual(o_totalprice" in p for p in facts["pushed"])
    assert facts["columns"] == ["o_orderkey", "o_orderstatus", "o_totalprice"]


def test_star_join_is_broadcast_only_when_small(spark):
    fact = spark.createDataFrame([("z1", 25.0), ("z9", 1.0)], "zone_id string, fare double")
    dim = spark.createDataFrame([("z1", "Manhattan")], "zone_id string, zone_name string")
    got = joins.star(fact, {"zones": (dim, "zone_id", ["zone_name"])})
    assert {(r.zone_id, r.zones_zone_name) for r in got.collect()} == {("z1", "Manhattan"), ("z9", None)}
    assert joins.small(dim, most=0) is dim


def test_as_of_join(spark):
    labels = spark.createDataFrame([("d1", 1000.0, 25.0), ("d1", 2000.0, 30.0), ("d2", 1500.0, 15.0), ("d3", 10.0, 1.0)], "driver_id string, ts double, label double").withColumn("ts", F.timestamp_seconds("ts"))
    feats = spark.createDataFrame([("d1", 500.0, 30.0), ("d1", 900.0, 35.0), ("d1", 1500.0, 20.0), ("d2", 1400.0, 45.0)], "driver_id string, fts double, speed double").withColumn("fts", F.timestamp_seconds("fts"))
    got = joins.as_of(labels, feats, entity="driver_id", label_ts="ts", feature_ts="fts", values=["speed"], lookback_s=3600)
    assert {(r.driver_id, r.label): r.speed for r in got.collect()} == {("d1", 25.0): 35.0, ("d1", 30.0): 20.0, ("d2", 15.0): 45.0, ("d3", 1.0): None}


def test_assignment_is_optimal_in_any_shape():
    rng = random.Random(1)
    for n, m in itertools.product(range(1, 5), repeat=2):
        for _ in range(15):
            c = np.array([[rng.randint(0, 20) for _ in range(m)] for _ in range(n)], float)
            pairs = joins.solve_assignment(c)
            assert len(pairs) == min(n, m) and len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)
            small, big = (range(n), range(m)) if n <= m else (range(m), range(n))
            best = min(sum(c[i, j] if n <= m else c[j, i] for i, j in zip(small, p)) for p in itertools.permutations(big, len(small)))
            assert sum(c[a, b] for a, b in pairs) == best


def test_snapshot_table(spark):
    x = lake.SnapshotTable(spark, files.new_path(spark, "lake-test"))
    a = spark.createDataFrame([(1, "old"), (2, "two")], "id int, val string")
    with pytest.raises(ValueError):
        x.read()
    x.append(a, "2024-01-01")
    x.merge(spark.createDataFrame([(1, "new"), (3, "three")], "id int, val string"), ["id"], "2024-02-01")
    x.delete(F.col("val") == "two", "2024-03-01")
    rows = lambda **k: sorted(map(tuple, x.read(**k).collect()))
    assert rows() == [(1, "new"), (3, "three")]
    assert rows(version=1) == [(1, "old"), (2, "two")] == rows(as_of="2024-01-15")
    with pytest.raises(ValueError):
        x.read(version=9)
    assert [r.operation for r in x.history().orderBy("version").collect()] == ["append", "merge", "delete"]


def test_incremental_load_keeps_its_watermark_on_failure(spark):
    load = pipeline.IncrementalLoad("ts")
    src = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "id int, ts string")
    assert load.run(src, lambda df: df.count()) == 2
    more = src.union(spark.createDataFrame([(3, "2024-01-03")], "id int, ts string"))

    def broken(_df):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        load.run(more, broken)
    assert load.watermark == "2024-01-02" and load.run(more, lambda df: df.count()) == 1


def test_changes_and_versions(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "key int, v string")
    log = spark.createDataFrame([(1, "UPDATE", 1, "x"), (2, "DELETE", 2, None), (3, "INSERT", 3, "c"), (4, "UPDATE", 1, "y")], "sequence int, operation string, key int, v string")
    assert sorted(map(tuple, pipeline.apply_changes(target, log, "key", ["v"]).collect())) == [(1, "y"), (3, "c")]
    ch = spark.createDataFrame([("d", "2024-01-01", "sedan", 1), ("d", "2024-06-01", "luxury", None)], "key string, at string, vehicle string, seats int")
    v = pipeline.versions_of(ch, "key", "at", ["vehicle", "seats"])
    assert [tuple(r) for r in v.orderBy("version").select("vehicle", "seats", "valid_to", "is_current").collect()] == [("sedan", 1, "2024-06-01", False), ("luxury", 1, None, True)]


def test_tasks():
    assert pipeline.task_levels({"a": [], "b": ["a"], "c": ["a"], "d": ["b", "c"]}) == [["a"], ["b", "c"], ["d"]]
    with pytest.raises(ValueError):
        pipeline.task_levels({"a": ["b"], "b": ["a"]})
    assert pipeline.run_tasks({"a": ([], lambda: 1 / 0), "b": (["a"], lambda: 1), "c": ([], lambda: 1)}) == {"a": "failed", "b": "skipped", "c": "success"}


def test_silver_states(spark):
    df = spark.createDataFrame([("1", "A", "25"), ("2", "A", "30"), ("2", "A", "30"), ("3", "B", None), ("4", "B", "x"), ("5", "B", "999")], "id string, zone string, fare string")
    s = pipeline.silver(df, ["id", "fare"], {"fare": "double"}, {"fare": (0, 500)}, [F.col("id")])
    assert {r.state: r["count"] for r in s.groupBy("state").count().collect()} == {"accepted": 2, "repeated": 1, "rejected": 3}


def test_quality_and_outliers(spark):
    df = spark.createDataFrame([(10.0,), (11.0,), (10.0,), (12.0,), (11.0,), (10.0,), (11.0,), (100.0,)], "v double")
    assert [r.v for r in quality.zscores(df, "v", 2.0).collect()] == [100.0]
    assert [r.v for r in quality.iqr_outliers(df, "v").collect()] == [100.0]
    assert quality.zscores(df.where("v = 11"), "v", 2.0).count() == 0
    s = quality.isolation_scores(df, ["v"]).orderBy(F.desc("score")).first()
    assert s.v == 100.0
    assert quality.check_rules(df.limit(0), {"r": (quality.complete("v"), 99)}).first().score == 100.0


def test_rank_percentile_and_states(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 21)], "g string, v double")
    assert aggregates.ranked_value(df, ["g"], "v", 0.95).first().value == 20.0
    s = aggregates.merged_states(aggregates.states(df.where("v < 5"), ["g"], "v"), aggregates.states(df.where("v >= 5"), ["g"], "v")).first()
    assert (s["sum"], s["count"], s["min"], s["max"]) == (210.0, 20, 1.0, 20.0)


def test_differences_restore(spark):
    df = spark.createDataFrame([("a", i, float(i * i)) for i in range(6)], "g string, i int, v double")
    d = timeseries.difference(df, ["g"], "i", "v", 1)
    back = timeseries.undifference(d, ["g"], "i", "diff", F.lit(0.0))
    assert [r.restored for r in back.orderBy("i").collect()] == [float(i * i) for i in range(6)]


def test_geo(spark):
    one = spark.range(1)
    km = one.select(geo.haversine(F.lit(40.7484), F.lit(-73.9857), F.lit(40.7580), F.lit(-73.9855), geo.EARTH_KM).alias("x")).first().x
    assert 0.5 < km < 2.0
    pts = [(57.64911, 10.40744, "u4pruydqqvj"), (-25.382708, -49.265506, "6gkzwgjzn82"), (90.0, 180.0, None), (0.0, 0.0, "s0000000000")]
    for la, lo, want in pts:
        r = one.select(geo.geohash(F.lit(la), F.lit(lo), 11).alias("h")).select("h", geo.geohash_box(F.col("h")).alias("b")).first()
        assert want is None or r.h == want
        assert r.b.lat_min <= la <= r.b.lat_max and r.b.lon_min <= lo <= r.b.lon_max
    with pytest.raises(ValueError):
        geo.geohash(F.lit(0.0), F.lit(0.0), 13)


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(scalar.bucketise(F.lit(10), [10, 20])) == "bucket_1" and value(scalar.bucketise(F.lit(None).cast("int"), [1])) is None
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert value(scalar.cosine(v(1, 0), v(0, 0))) == 0.0 and abs(value(scalar.cosine(v(1, 2), v(2, 4))) - 1) < 1e-12
    import hashlib

    assert value(scalar.md5_bucket(F.lit("user_1"))) == int(hashlib.md5(b"user_1").hexdigest(), 16) % 10_000
    import re

    p = scalar.topic_pattern("ride.*.#")
    assert re.match(p, "ride.a.b.c") and not re.match(p, "ride.a") and not re.match(p, "rideXa.b")
    assert value(models.surge(F.lit(4), F.lit(0))) == 3.0


def test_schemas_and_advice():
    a = T.StructType.fromDDL("a int, b string")
    assert relational.backward_compatible(a, T.StructType.fromDDL("a bigint, b string, c int")) == []
    assert relational.backward_compatible(a, T.StructType.fromDDL("a string")) == ["b removed"]
    assert relational.schema_change(a, T.StructType.fromDDL("b int, c int")) == {"added": ["c"], "removed": ["a"], "changed": ["b"]}
    assert advisor.index_for(10, 10_000) == "set" and advisor.index_for(9000, 10_000) == "bloom" and advisor.index_for(5, 5, ranged=True) == "minmax"
    assert advisor.bloom_size(1000, 0.01) == (9586, 7)
    assert advisor.partition_for({"day": 9, "zone": 2}, 400, 1_000_000)["grain"] == "month"


def test_feature_groups(spark):
    g = advisor.FeatureGroup("driver", [advisor.Feature("speed", "double", "driver_id"), advisor.Feature("trips", "bigint", "driver_id")])
    assert g.problems(spark.createDataFrame([(1.0,)], "speed double")) == ["trips is missing, not bigint"]
