"""Fitting, searching, bandits, bootstrap, outliers, mentions and splits on small fixtures."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rideloom.operators import features, joins, learners, quality, relational
from rideloom.sources import files


def test_net_fits_what_a_line_cannot(spark):
    rng = random.Random(2)
    data = [(a := rng.uniform(-2, 2), b := rng.uniform(-2, 2), abs(a) * 3 - b) for _ in range(1500)] + [(None, 1.0, 2.0)]
    df = spark.createDataFrame(data, "a double, b double, y double")
    net = learners.train_net(df, ["a", "b"], "y", hidden=8, epochs=25, batches=3, schedule=learners.step_decay(0.1, 10), patience=25)
    best = min(h["loss"] for h in net.history)
    assert best < 0.05 < net.history[0]["loss"]  # a line leaves about three quarters
    out = learners.predicted(df.dropna(), net, ["a", "b"]).agg(F.sqrt(F.avg((F.col("prediction") - F.col("y")) ** 2))).first()[0]
    assert out < 0.25 * df.agg(F.stddev("y")).first()[0]
    stopped = learners.train_net(df, ["a", "b"], "y", epochs=20, schedule=lambda e: 0.0, patience=2)
    assert len(stopped.history) == 3  # no gain after the first
    with pytest.raises(ValueError):
        learners.train_net(df.limit(0), ["a"], "y")
    assert learners.cosine_decay(1.0, 10)(0) == 1 and learners.cosine_decay(1.0, 10)(10) == pytest.approx(0)


def test_searches():
    space = {"x": (-1.0, 3.0), "y": (0.0, 2.0)}
    score = lambda ps: [(p["x"] - 1.1) ** 2 + (p["y"] - 0.4) ** 2 for p in ps]
    best = {how: min(s for _, s in learners.search(space, score, how, trials=40, seed=3)) for how in ("grid", "random", "tree")}
    assert best["grid"] == pytest.approx(0.01 + 0.01) and best["tree"] < best["random"] and best["tree"] < 0.01
    assert learners.search(space, score, "random", 5, seed=3) == learners.search(space, score, "random", 5, seed=3)


def test_bandits():
    arms = [0.2, 0.5, 0.8]
    for policy in ("epsilon", "ucb1", "thompson"):
        x = learners.play(arms, policy, 3000, seed=4)
        assert sum(a == 2 for a, _, _ in x) > 1500 and x == learners.play(arms, policy, 3000, seed=4)
        assert x[-1][2] == pytest.approx(sum(0.8 - arms[a] for a, _, _ in x)) and x[-1][2] < 3000 * 0.3 / 2
    with pytest.raises(ValueError):
        learners.play(arms, "other", 1)


def test_bootstrap(spark):
    rng = random.Random(5)
    data = [(i, "g", rng.gauss(10, 4)) for i in range(800)] + [(900, "h", 3.0), (901, "n", None)]
    got = {r.g: r for r in learners.bootstrap_means(spark.createDataFrame(data, "i long, g string, v double"), ["g"], "i", "v", 100).collect()}
    assert set(got) == {"g", "h"} and got["h"].lo == got["h"].hi == 3
    half = 1.645 * 4 / math.sqrt(800)
    assert abs((got["g"].hi - got["g"].lo) / 2 - half) < 0.35 * half


def test_local_outliers_against_brute_force(spark):
    rng = random.Random(6)
    pts = [(i, rng.gauss(0, 1), rng.gauss(5, 3)) for i in range(60)] + [(60, 9.0, 30.0), (61, 0.0, 5.0), (62, 0.0, 5.0), (63, None, 1.0)]
    got = {r.i: r.lof for r in quality.lof_scores(spark.createDataFrame(pts, "i int, a double, b double"), ["a", "b"], 4).collect()}
    z = np.array([p[1:] for p in pts if p[1] is not None])
    z = (z - z.mean(0)) / z.std(0)
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :4]
    kd = np.take_along_axis(d, order, 1)[:, -1]
    want = kd / kd[order].mean(1)
    assert len(got) == 63 and all(abs(got[i] - want[i]) < 1e-9 for i in range(61)) and got[60] == max(got.values())
    assert quality.lof_scores(spark.createDataFrame(pts[:3], "i int, a double, b double"), ["a", "b"], 4).where("lof IS NOT NULL").count() == 0


def test_mentions(spark):
    docs = spark.createDataFrame([(1, "😀 Ann met Ann-Lee at 10:30, not 9:45"), (2, ""), (3, None), (4, "ANN")], "k int, t string")
    found = features.mentions(docs, "k", "t", [("who", features.gazetteer(["Ann", "Ann-Lee", " ", None])), ("clock", "[0-9]+:[0-9][0-9]")])
    assert sorted(tuple(r) for r in found.collect()) == [(1, "clock", 21, "10:30"), (1, "clock", 32, "9:45"), (1, "who", 2, "Ann"), (1, "who", 10, "Ann-Lee"), (4, "who", 0, "ANN")]
    aliases = spark.createDataFrame([("who", "ann", 7), ("who", "ann", 7), ("who", None, 8)], "kind string, alias string, entity int")
    
    assert {(r.mention, r.entity) for r in features.linked(found, aliases).where("kind = 'who'").collect()} == {("Ann", 7), ("Ann-Lee", None), ("ANN", 7)}
    assert features.mentions(docs, "k", "t", [("who", features.gazetteer([]))]).count() == 0


def test_splits(spark):
    t0 = datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, "a" if i % 3 else "b", t0 + timedelta(hours=i // 2)) for i in range(100)] + [(100, None, None)], "i int, s string, t timestamp")
    by_time = {r.i: r.part for r in features.split_by_time(df, "t", [0.5, 0.3, 0.2]).collect()}
    assert by_time[100] is None and [by_time[i] for i in range(100)] == [0] * 50 + [1] * 30 + [2] * 20
    strata = features.stratified_split(df, "s", "i", [0.5, 0.5]).groupBy("s", "part").count().collect()
    assert {(r.s, r.part): r["count"] for r in strata} == {("a", 0): 33, ("a", 1): 33, ("b", 0): 17, ("b", 1): 17, (None, 0): 1}


def test_schemas():
    old, new = T.StructType.fromDDL("a int, b string"), T.StructType.fromDDL("a bigint, b string, c int")
    assert relational.backward_compatible(old, new) == [] and relational.forward_compatible(old, new) == ["a bigint to int"]
    assert relational.fully_compatible(old, T.StructType.fromDDL("a int, b string, c int")) == []
    assert relational.fully_compatible(old, T.StructType.fromDDL("a int")) == ["backward: b removed"]


def test_sources(spark):
    jobs = files.Ingest(spark)
    jobs.register("n", "json", "a int")
    assert jobs.accepts("n", "json") and not jobs.accepts("n", "csv") and not jobs.accepts("m", "json")
    for bad in (lambda: jobs.run("n", "csv", "x"), lambda: jobs.register("n", "xlsx", "a int"), lambda: files.generated(spark, "ride", 1, "replay"), lambda: files.generated(spark, "boat", 1), lambda: files.generated(spark, "ride", 1, "slow")):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize("k", [1, 3, 50])
def test_nearest_against_brute_force(spark, k):
    """Clusters, a request far off, both sides of the date line, poles, fewer candidates than asked for."""
    rng = random.Random(8)
    cand = [(i, rng.uniform(43, 45), rng.uniform(-32, -30)) for i in range(30)] + [(90, 0.0, 179.9), (91, 89.5, 10.0), (92, None, 1.0)]
    req = [(100 + i, rng.uniform(43, 45), rng.uniform(-32, -30)) for i in range(6)] + [(200, 0.0, -179.95), (201, -60.0, 100.0), (202, 89.9, -170.0)]
    df = lambda x, n: spark.createDataFrame(x, f"{n} int, lat double, lon double")

    def km(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371 * math.asin(min(1, math.sqrt(x)))

    got = {(r.q, r.rank): r.c for r in joins.nearest(df(req, "q"), df(cand, "c"), request_id="q", candidate_id="c", k=k, cell_deg=0.1).collect()}
    want = {}
    for r in req:
        for i, c in enumerate(sorted((c for c in cand if c[1] is not None), key=lambda c: (km(r, c), c[0]))[:k]):
            want[r[0], i + 1] = c[0]
    assert got == want


def test_similarity_by_blocks(spark):
    rng = random.Random(9)
    data = {(rng.randint(0, 25), rng.choice([0, 0, 0, 1, 2, 3, 4])): rng.uniform(1, 5) for _ in range(160)}
    df = spark.createDataFrame([(u, i, r) for (u, i), r in data.items()], "u int, i int, r double")
    sets = [{(r.a, r.b): round(r.similarity, 9) for r in features.item_similarity(df, 2, block).collect()} for block in (2000, 5, 1)]
    want = {}
    for a in range(26):
        for b in range(26):
            common = [i for i in range(5) if (a, i) in data and (b, i) in data]
            if a != b and len(common) >= 2:
                x, y = [data[a, i] for i in common], [data[b, i] for i in common]
                want[a, b] = round(sum(p * q for p, q in zip(x, y)) / math.sqrt(sum(p * p for p in x) * sum(q * q for q in y)), 9)
    assert want and all(s == want for s in sets)
