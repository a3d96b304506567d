import math
import random

from pyspark.sql import functions as F

from rideloom.common import value_counts
from rideloom.llm import percentiles


def test_percentiles_merge_and_bound(spark):
    rng = random.Random(3)
    data = [(rng.choice(["a", "b", None]), rng.choice([rng.gauss(50, 20), 7.0]), i % 3) for i in range(3000)] + [("a", math.nan, 0), ("a", None, 1)]
    df = spark.createDataFrame(data, "g string, v double, part int")
    qs = (0.0, 0.01, 0.5, 0.9, 1.0)
    exact = {}
    for g in ("a", "b", None):
        vs = sorted(v for x, v, _ in data if x == g and v is not None and not math.isnan(v))
        exact |= {(g, q): vs[max(1, math.ceil(round(q * len(vs), 6))) - 1] for q in qs}
    states = [value_counts(df.where(F.col("part") == i), ["g"], "v") for i in range(3)]
    got = {(r.g, r.quantile): r.percentile for r in percentiles.percentiles_of(percentiles.merge_counts(*states), ["g"], qs).collect()}
    assert got == exact
    near = {(r.g, r.quantile): r.percentile for r in percentiles.percentiles(df, ["g"], "v", qs, resolution=0.5).collect()}
    assert all(abs(near[k] - exact[k]) <= 0.25 + 1e-9 for k in exact)
    assert percentiles.percentiles(df.limit(0), ["g"], "v", qs).count() == 0
