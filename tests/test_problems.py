"""Operators of problems 1, 2 and 4 to 7: splitting of busy keys changes nothing, brute force, edge cases."""

import math
import random
from datetime import date, datetime, timedelta, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from brute_stops import all_stops
from rideloom import common
from rideloom.common import table
from rideloom.operators import history, intervals, late, proximity, spikes, trips

SPLIT = {"hot_part": 0.0005, "hot_least": 50}
T0 = datetime(2024, 3, 1, tzinfo=timezone.utc)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_spikes_do_not_depend_on_splitting(spark, small):
    pings = table(spark, small, "driver_locations")
    keys = ("reading_id", "field", "reason")
    whole = rows(spikes.implausible_pings(pings).select(*keys))
    assert whole and rows(spikes.implausible_pings(pings, **SPLIT, slice_hours=1).select(*keys)) == whole


def test_windows_reach_over_slices(spark):
    """Spikes, contexts and standing at slice edges, with slices thinner than the windows."""
    rng = random.Random(11)
    data, at = [], T0 - timedelta(minutes=3)
    for i in range(700):
        at += timedelta(seconds=rng.choice([20, 60, 60, 1500 if i % 40 == 0 else 60]))
        fast = i % 100 in (3, 4, 5, 58)
        accuracy = 90.0 if i % 61 == 7 else rng.uniform(4, 9)
        data.append((f"r{i:04}", "d", 25.0 if fast else 2.0 + rng.random() / 5, accuracy, 90.0 if 300 <= i < 320 else rng.uniform(0, 360), rng.choice(["gps", "gps", "gps", "network", "", None]), at))
    data = [(a, b, None if i % 7 == 0 else c, d, e, f, g) for i, (a, b, c, d, e, f, g) in enumerate(data)]
    df = spark.createDataFrame(data, PING)
    keys = ("reading_id", "field", "reason")
    whole = rows(spikes.implausible_pings(df).select(*keys))
    assert {r[2] for r in whole} == {"spike", "stuck"}
    for hours in (1, 3):
        assert rows(spikes.implausible_pings(df, **SPLIT, slice_hours=hours).select(*keys)) == whole


def test_many_hot_keys(spark, monkeypatch):
    df = spark.range(1000).select((F.col("id") % 10).cast("string").alias("k")).union(spark.range(30).select(F.lit(None).cast("string")))
    want = {str(i): True for i in range(10)} | {None: False}
    for listed, shipped in ((100, 100), (3, 100), (3, 3)):
        monkeypatch.setattr(common, "MOST_LISTED", listed)
        monkeypatch.setattr(common, "MOST_SHIPPED", shipped)
        marked, any_hot = common.mark_hot(df, "k", "hot", part=0.9, least=10, most=50)
        assert any_hot and {r.k: r.hot for r in marked.distinct().collect()} == want
    assert common.mark_hot(df, "k", "hot", part=0.9, least=10)[1] is False


PING = "id string, driver_id string, speed float, accuracy float, heading float, source string, recorded_at timestamp"


def series(values, field="speed", **fixed):
    base = {"id": None, "driver_id": "d", "speed": None, "accuracy": None, "heading": None, "source": "gps"} | fixed
    return [tuple((base | {"id": f"p{i:04}", field: v}).values()) + (T0 + timedelta(seconds=10 * i),) for i, v in enumerate(values)]


def test_spikes_edge_cases(spark):
    assert spikes.implausible_pings(spark.createDataFrame([], PING)).count() == 0
    rng = random.Random(1)
    speeds = [10 + rng.random() * 4 for _ in range(60)]
    speeds[20], speeds[30], speeds[31] = 60.0, -3.0, None
    speeds[40:51] = [11.5] * 11
    df = spark.createDataFrame(series(speeds) + series([5.0, math.nan, 0.0], "accuracy", driver_id=None), PING)
    df = df.withColumn("_dev", F.lit(1)).withColumn("_slice", F.lit("x")).union(df.withColumn("_dev", F.lit(1)).withColumn("_slice", F.lit("x")))  # clashing names, repeated rows
    got = rows(spikes.implausible_pings(df).select("reading_id", "field", "reason").distinct())
    want = [("p0001", "accuracy", "bound"), ("p0002", "accuracy", "bound"), ("p0020", "speed", "spike"), ("p0030", "speed", "bound")] + [(f"p{i:04}", "speed", "stuck") for i in range(40, 51)]
    assert got == sorted(want, key=str)


def test_coarse_device_is_not_stuck(spark):
    df = spark.createDataFrame(series([5.0] * 40 + [6.0] * 3 + [5.0] * 3 + [6.0] * 4 + [5.0] * 30, "accuracy"), PING)
    assert spikes.implausible_pings(df).count() == 0


def test_stops_against_brute_force(spark, small):
    pings = table(spark, small, "driver_locations")
    pdf = pings.select("driver_id", "latitude", "longitude", F.unix_micros("recorded_at").alias("us")).toPandas()
    want = set(all_stops(pdf))
    sec = lambda c: F.floor(F.col(c) / 1_000_000).cast("long")
    found = lambda **o: {tuple(r) for r in trips.stops(pings, **o).select("driver_id", sec("start_us"), sec("end_us")).collect()}
    got = found()
    assert len(got & want) >= 0.95 * max(len(want), len(got))
    assert found(**SPLIT) == got


def test_stops_edge_cases(spark):
    schema = "driver_id string, latitude double, longitude double, recorded_at timestamp, session int"
    ping = lambda i, lat=44.0, lon=-31.0: ("d", lat, lon, T0 + timedelta(seconds=30 * i), 7)
    at = [ping(i) for i in range(20)]
    at[5], at[6] = ping(5, 45.0), ping(6, 0.0, 0.0)  # two strays do not end it
    away = [ping(20 + i, 44.0 + 0.005 * (i + 1)) for i in range(20)]
    df = spark.createDataFrame(at + away + at[:3] + [("d", None, None, T0, 1), (None, 44.0, -31.0, T0, 1)], schema)
    got = trips.stops_and_trips(df)
    got = got.orderBy("start_s").collect()
    assert [(r.kind, r.duration_s) for r in got] == [("stop", 570), ("trip", 570)]
    assert got[0].distance_m == 0 and abs(got[1].distance_m - 19 * 0.005 * 111195) < 1200  # strays add nothing
    assert trips.stops(spark.createDataFrame([], schema)).count() == 0


def test_late_events(spark):
    schema = "event_id string, driver_id string, recorded_at timestamp, processed_at timestamp"
    at = lambda s: T0 + timedelta(seconds=s)
    ev = [("a", "d", at(10), at(20)), ("a", "d", at(10), at(9000)), ("b", "d", at(20), at(3899)), ("c", "d", at(30), at(3900)), ("d", "d", at(30), at(25199)), ("e", "d", at(30), at(25200)), ("f", "e", at(100), at(5000)), ("g", None, at(1), at(2)), ("h", "d", None, at(2))]
    df = spark.createDataFrame(ev, schema)
    got = {r.driver_id: tuple(r)[2:5] for r in late.driver_hours(df).collect()}
    assert got == {"d": (2, 4, 1), "e": (0, 1, 0)}
    # windows of two hours every hour: a late event touches both that cover its pane
    both = late.driver_hours(df, size_s=7200, slide_s=3600)
    assert sorted((r.driver_id, r.period_start - int(T0.timestamp())) for r in both.collect()) == [("d", -3600), ("d", 0), ("e", -3600), ("e", 0)]
    assert late.driver_hours(df.limit(0)).count() == 0


def test_interval_map_against_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        m, covered = intervals.IntervalMap(), set()
        for _ in range(rng.randint(0, 12)):
            a = rng.randint(0, 40)
            b = a + rng.randint(-2, 9)
            m.insert(a, b)
            covered |= set(range(a, b))
        assert {x for s, e in m.periods() for x in range(s, e)} == covered
        assert all(e < s for e, s in m.gaps())


def test_intervals_do_not_depend_on_splitting(spark, small):
    subs = table(spark, small, "subscriptions")
    whole, cut = intervals.subscription_periods(subs), intervals.subscription_periods(subs, hot_part=0.0001, hot_least=1)
    assert rows(intervals.gaps(whole)) == rows(intervals.gaps(cut))
    assert rows(intervals.periods_of(whole)) == rows(intervals.periods_of(cut))
    assert cut.select("slice").distinct().count() > 5
    assert intervals.subscription_periods(subs.limit(0)).count() == 0


def great_circle(a, b):
    la1, lo1, la2, lo2 = map(math.radians, (*a, *b))
    x = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
    return 2 * 6371000 * math.asin(min(1, math.sqrt(x)))


@pytest.mark.parametrize("crowd", [3, 2000])
@pytest.mark.parametrize("centre", [(44.0, -31.0), (0.0, 180.0), (89.9999, 10.0)])
def test_near_pairs_against_brute_force(spark, centre, crowd):
    rng = random.Random(7)
    pts = []
    for i in range(250):
        lat = max(-90.0, min(90.0, centre[0] + rng.uniform(-1, 1) * 0.001))
        lon = (centre[1] + rng.uniform(-1, 1) * (0.001 if abs(centre[0]) < 80 else 180) + 540) % 360 - 180
        pts.append((f"p{i:03}", f"d{i % 7}", lat, lon, T0 + timedelta(seconds=rng.uniform(0, 60)), "x"))
    pts += [pts[0], ("z", "d", 0.0, 0.0, T0, "x"), ("y", "d", 91.0, 0.0, T0, "x"), ("n", "d", None, None, T0, "x")]
    df = spark.createDataFrame(pts, "id string, driver_id string, lat double, lon double, ts timestamp, row string")
    got = {(r.id_a, r.id_b) for r in proximity.near_pairs(df, id_col="id", lat="lat", lon="lon", radius_m=25, group="driver_id", ts="ts", reach_s=10, crowd=crowd).collect()}
    good = pts[:250]
    want = {(a[0], b[0]) for a in good for b in good if a[0] < b[0] and a[1] != b[1] and abs((a[4] - b[4]).total_seconds()) <= 10 and great_circle(a[2:4], b[2:4]) <= 25}
    assert got == want and want


def test_boxes_and_polygons(spark):
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.0, 1.0), (3, 5.0, 5.0), (4, None, 1.0), (5, 0.0, 0.0)], "i int, lat double, lon double")
    boxes = spark.createDataFrame([(9, 0.0, 1.0, 0.0, 1.0), (4, 0.9, 2.0, 0.9, 2.0), (1, 3.0, 2.0, 0.0, 9.0)], "zone_id int, lat_min double, lat_max double, lon_min double, lon_max double")
    for most in (0, 10_000):
        got = proximity.in_boxes(pts, boxes, lat="lat", lon="lon", box_id="zone_id", most_broadcast=most)
        assert {r.i: r.found_box for r in got.collect()} == {1: 9, 2: 4, 3: None, 4: None, 5: None}
    ring = F.array(*[F.struct(F.lit(float(a)).alias("lat"), F.lit(float(b)).alias("lon")) for a, b in ((0, 0), (0, 4), (4, 0))])
    got = pts.select("i", proximity.in_polygon(F.col("lat"), F.col("lon"), ring).alias("x")).where("x").collect()
    assert [r.i for r in got] == [1, 2, 5]


@pytest.mark.parametrize("days", [1, 14, 10_000])
def test_history_against_brute_force(spark, small, days):
    snaps = table(spark, small, "driver_snapshots")
    got = {(r.driver_id, r.valid_from.date()) for r in history.driver_history(snaps, days).collect()}
    best = {}
    for r in sorted(snaps.collect(), key=lambda r: (r.loaded_at, str(r.full_name), str(r.license_number), str(r.rating))):
        best[r.driver_id, r.snapshot_date] = r
    want, known = set(), {}
    for (d, day), r in sorted(best.items()):
        now = [" ".join(r.full_name.split()).lower() if r.full_name is not None else None, r.license_number, None if r.rating is None or math.isnan(r.rating) else round(r.rating + 1e-9, 2)]
        was = known.get(d)
        kept = [n if n is not None else (was[i] if was else None) for i, n in enumerate(now)]
        if kept != was:
            want.add((d, day))
        known[d] = kept
    assert got == want


def test_history_does_not_depend_on_periods(spark, small):
    snaps = table(spark, small, "driver_snapshots")
    whole = rows(history.driver_history(snaps, 10_000))
    assert whole and all(rows(history.driver_history(snaps, d)) == whole for d in (1, 7, 14))


def test_stored_history_against_one_pass(spark, small, tmp_path):
    """Batches out of order, late and repeated; each update starts from a stored checkpoint."""
    snaps = table(spark, small, "driver_snapshots")
    store = history.DriverHistory(spark, f"file://{tmp_path}", 5)
    assert store.history() is None and store.state_at(date(2024, 1, 1)) is None
    part = F.pmod(F.xxhash64("driver_id", "snapshot_date", "loaded_at"), F.lit(3))
    early = F.col("snapshot_date") < snaps.agg(F.expr("percentile(unix_date(snapshot_date), 0.5)").cast("int").alias("m")).select(F.date_from_unix_date("m")).first()[0]
    store.update(snaps.where(early & (part != 0)))
    store.update(snaps.where(~early & (part == 1)))
    before = store.manifest()["folders"]
    store.update(snaps.where(~early))
    kept = store.manifest()["folders"]
    assert any(kept[p] == before[p] for p in before)  # earlier periods stay
    store.update(snaps.where(early))
    store.update(snaps.limit(0))
    assert rows(store.history()) == rows(history.driver_history(snaps))
    day = snaps.agg(F.max("snapshot_date")).first()[0]
    current = {(r.driver_id, r.full_name, r.license_number, r.rating) for r in store.history().where("is_current = 1").collect()}
    assert {(r.entity, r.full_name, r.license_number, None if r.rating is None else round(r.rating + 1e-9, 2)) for r in store.state_at(day).collect()} == current


def test_history_shape(spark):
    schema = "snapshot_date date, driver_id string, full_name string, license_number string, rating double, total_trips long, loaded_at timestamp, period int"
    day = lambda n: date(2024, 1, n)
    data = [(day(1), "d", " Ann  Lee", "L1", None, 1, T0, 0), (day(2), "d", "ann lee", None, 4.5, 2, T0, 0), (day(20), "d", "Ann Lee", "L2", 4.504, 3, T0, 0), (day(20), "d", "Bob", "L9", 1.0, 3, T0 - timedelta(1), 0), (None, "d", "x", "y", 1.0, 1, T0, 0)]
    h = history.driver_history(spark.createDataFrame(data, schema)).orderBy("valid_from").collect()
    assert [(r.full_name, r.license_number, r.rating, r.valid_from.day, r.valid_to.day if r.valid_to else None, r.is_current) for r in h] == [("Ann Lee", "L1", None, 1, 2, 0), ("Ann Lee", "L1", 4.5, 2, 20, 0), ("Ann Lee", "L2", 4.5, 20, None, 1)]
    assert history.driver_history(spark.createDataFrame([], schema)).count() == 0
