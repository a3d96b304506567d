import math
import random
from collections import Counter

import pytest

from rideloom.llm import mixing as M
from rideloom.llm import plans
from pyspark.sql import functions as F


def test_cdf_and_rate():
    assert M.poisson_cdf(2.0, 3)[0] == math.exp(-2)
    rng = random.Random(1)
    h = [rng.random() for _ in range(M.BINS)]
    for target in (0.1, 0.9, 1.7):
        mean = M.solve_rate(h, target * sum(h), 3)
        drawn = 0.0
        for c in M.poisson_cdf(mean, 3):
            drawn += sum(x for i, x in enumerate(h) if (i + 0.5) / M.BINS > c)
        assert abs(drawn / sum(h) - target) < 0.002
    assert M.solve_rate(h, 3 * sum(h), 3) == math.inf
    assert M.solve_rate(h, 0, 3) == 0


def test_mix_against_brute_force(spark):
    rng = random.Random(2)
    docs = [(i, rng.choice(["a", "a", "a", "b", "c", None]), rng.randint(1, 50)) for i in range(6000)]
    sizes = spark.createDataFrame(docs, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.4, 4), ("z", 0.1, 3)], "source string, weight double, max_repeats int")
    lines = M.plan(sizes, targets)
    got = M.mix(sizes, lines).collect()
    copies = Counter((r.doc_id, r.source) for r in got)
    u = {r.doc_id: r.u for r in sizes.select("doc_id", M.uniform(1, "doc_id").alias("u")).collect()}
    want = {}
    for line in lines:
        cdf = M.poisson_cdf(line["mean"], line["max_repeats"])
        for i, s, _ in docs:
            if s == line["source"] and line["mean"] > 0 and (n := sum(c < u[i] for c in cdf)):
                want[i, s] = n
    assert copies == want
    assert [r.place for r in got] == sorted(r.place for r in got)
    report = {r.source: r for r in M.report(M.mix(sizes, lines), lines).collect()}
    assert abs(report["a"].share - 0.5 / 0.9) < 0.01 and abs(report["b"].share - 0.4 / 0.9) < 0.01
    assert report["z"].share == 0 and report["z"].documents == 0
    assert all(r.most_repeats <= r.max_repeats for r in report.values())


def test_edges(spark, small):
    schema = "doc_id long, text string, source string, copy int, place string"
    docs = spark.createDataFrame([(1, "one two", "a", 9, "x"), (1, "one two", "a", 9, "x"), (2, None, "a", 9, "x"), (3, "x", None, 9, "x"), (None, "y", "a", 9, "x")], schema)
    sizes = M.sized(docs)
    assert sorted((r.doc_id, r.tokens) for r in sizes.collect()) == [(1, 2), (2, 0)]
    none = spark.createDataFrame([], "source string, weight double, max_repeats int")
    assert M.mix(sizes, M.plan(sizes, none)).count() == 0
    one = spark.createDataFrame([("a", 1.0, 2)], "source string, weight double, max_repeats int")
    lines = M.plan(sizes, one)
    assert M.mix(sizes, lines).groupBy("doc_id").count().orderBy("doc_id").collect() == [(1, 2), (2, 2)]
    assert M.mix(sizes.limit(0), M.plan(sizes.limit(0), one)).count() == 0
    over = M.plan(sizes, one, total_tokens=100.0)
    assert M.report(M.mix(sizes, over), over).first().tokens == 4  # capped, and said so
    assert plans.p9_shares(spark, small).count() == 8


def test_large_caps(spark):
    """A small source repeated some 3,000 times, under a cap of 5,000; more than can be tabulated is an error."""
    docs = [(i, "small", 10) for i in range(40)] + [(100 + i, "large", 100) for i in range(12_000)]
    sizes = spark.createDataFrame(docs, "doc_id long, source string, tokens long")
    targets = lambda cap: spark.createDataFrame([("small", 0.5, cap), ("large", 0.5, 1)], "source string, weight double, max_repeats int")
    lines = M.plan(sizes, targets(5000))
    report = {r.source: r for r in M.report(M.mix(sizes, lines), lines).collect()}
    assert 2900 < report["small"].mean_repeats < 3100 and report["small"].most_repeats <= 5000 and abs(report["small"].share - 0.5) < 0.02
    for mean in (5.0, 900.0, 40_000.0):
        cdf = M.poisson_cdf(mean, int(mean * 3))
        assert abs(cdf[int(mean)] - 0.5) < 0.2 and abs(cdf[-1] - 1) < 1e-2 and cdf == sorted(cdf)
    with pytest.raises(ValueError, match="max_repeats"):
        M.plan(sizes, targets(M.MOST_REPEATS + 1))


def test_texts_of_the_mix(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    drawn = plans.p9_mix(spark, small)
    got = M.with_texts(drawn, docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == drawn.count() and all(r.text == texts[r.doc_id] for r in got)
    assert [r.place for r in got] == sorted(r.place for r in got)
