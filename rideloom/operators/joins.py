"""Purpose-built joins: star, as-of, validity, nearest, radius, pairs, assignment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rideloom.common import mark_hot, time_slice, written
from rideloom.functions.geo import haversine

#: Dimensions with no more rows than this go to every executor; larger ones are shuffled.
MOST_BROADCAST_ROWS = 100_000


def small(df: DataFrame, most: int = MOST_BROADCAST_ROWS) -> DataFrame:
    """Marks a table for broadcast if it is proven small; the check reads at most one row more than the bound."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def star(fact: DataFrame, dims: Mapping[str, tuple[DataFrame, str, Sequence[str]]]) -> DataFrame:
    """Fact left joined to dimensions: name -> (dimension, fact key, attributes); attributes come prefixed by the name."""
    for name, (dim, key, attributes) in dims.items():
        slim = dim.select(F.col(dim.columns[0]).alias(f"_{name}"), *[F.col(a).alias(f"{name}_{a}") for a in attributes])
        fact = fact.join(small(slim), fact[key] == F.col(f"_{name}"), "left").drop(f"_{name}")
    return fact


def as_of(labels: DataFrame, features: DataFrame, *, entity: str, label_ts: str, feature_ts: str, values: Sequence[str], lookback_s: float | None = None, slice_hours: int = 24) -> DataFrame:
    """Each label with the entity's last feature values at or before it, null if older than the lookback; adds feature_time.

    Union of both sides and a running last value: one shuffle, no range join. Busy entities are cut into time slices,
    and the last features of earlier slices are carried in. Equal feature times: the greater values count.
    """
    carried = F.struct(F.col(feature_ts).alias("feature_time"), *values)
    left = labels.select(F.struct(*labels.columns).alias("label"), F.col(entity).alias("e"), F.col(label_ts).alias("at"), F.lit(1).alias("side"))
    right = features.where(F.col(feature_ts).isNotNull()).select(carried.alias("feature"), F.col(entity).alias("e"), F.col(feature_ts).alias("at"), F.lit(0).alias("side"))
    both = left.unionByName(right, allowMissingColumns=True)
    both, hot = mark_hot(both, "e", "hot")
    both = both.withColumn("slice", F.when(F.col("hot"), time_slice(F.col("at").cast("timestamp"), slice_hours)).otherwise(F.lit(0).cast("long")))
    w = Window.partitionBy("e", "slice").orderBy("at", "side", "feature").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("found", F.last("feature", ignorenulls=True).over(w)).where("side = 1")
    if hot:
        ends = both.where("hot").groupBy("e", "slice").agg(F.max("feature").alias("last"))
        before = Window.partitionBy("e").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select("e", "slice", F.last("last", ignorenulls=True).over(before).alias("earlier"))
        found = found.join(ends, ["e", "slice"], "left").withColumn("found", F.coalesce("found", "earlier"))
    if lookback_s is not None:
        age = F.col("at").cast("timestamp").cast("double") - F.col("found.feature_time").cast("timestamp").cast("double")
        found = found.withColumn("found", F.when(age <= lookback_s, F.col("found")))
    return found.select("label.*", "found.*")


def latest(labels: DataFrame, features: DataFrame, *, entity: str, feature_ts: str, values: Sequence[str], seq: str) -> DataFrame:
    """The last value by input order whatever its time: leaks the future, kept as the counter-example."""
    last = features.groupBy(entity).agg(F.max_by(F.struct(F.col(feature_ts).alias("feature_time"), *values), seq).alias("x")).select(entity, "x.*")
    return labels.join(last, entity, "left")


def leaks(joined: DataFrame, label_ts: str) -> DataFrame:
    gap = F.col("feature_time").cast("timestamp").cast("double") - F.col(label_ts).cast("timestamp").cast("double")
    return joined.where(F.col("feature_time") > F.col(label_ts)).withColumn("leak_seconds", gap)


def valid_at(fact: DataFrame, dim: DataFrame, *, key: str, ts: str, dim_key: str, attributes: Sequence[str], valid_from: str = "valid_from", valid_to: str = "valid_to") -> DataFrame:
    """Fact left joined to the version valid at its time: valid_from <= t < valid_to, open if null."""
    v = dim.select(F.col(dim_key).alias("_k"), F.col(valid_from).alias("_f"), F.col(valid_to).alias("_t"), *attributes)
    on = (fact[key] == v["_k"]) & (fact[ts] >= v["_f"]) & (v["_t"].isNull() | (fact[ts] < v["_t"]))
    return fact.join(v, on, "left").drop("_k", "_f", "_t")


def nearest(requests: DataFrame, candidates: DataFrame, *, request_id: str, candidate_id: str, k: int, cell_deg: float = 0.02) -> DataFrame:
    """The k nearest candidates of each request (lat, lon columns on both) by great circle, rank from 1.

    By grid cells: candidates of the request's cell and the eight around it are tried first. A request is settled if its
    k-th is nearer than the edge of these nine; the others go on with cells four times as wide, until the nine cover the
    globe. Every round is a join by cell. Requests and candidates without a position are left out.
    """
    r = requests.select(F.col(request_id).alias("_r"), F.col("lat").alias("_rlat"), F.col("lon").alias("_rlon")).dropna()
    c = candidates.select(F.col(candidate_id).alias("_c"), F.col("lat").alias("_clat"), F.col("lon").alias("_clon")).dropna()
    order = Window.partitionBy("_r").orderBy("km", "_c")
    dist = haversine(F.col("_rlat"), F.col("_rlon"), F.col("_clat"), F.col("_clon"), 6371.0)
    cols, found, cell = ["_r", "_c", "km", "rank"], None, cell_deg
    while True:
        last = cell >= 180
        columns = max(1, int(360 // cell))  # of equal width, at least cell degrees; they wrap at the date line
        row = lambda lat: F.floor((F.col(lat) + 90) / cell).cast("long")
        col = lambda lon: F.floor((F.col(lon) + 180) / (360 / columns)).cast("long")
        steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
        near = r.withColumn("gr", F.explode(F.transform(steps, lambda i: row("_rlat") + i))).withColumn("gc", F.explode(F.array_distinct(F.transform(steps, lambda i: F.pmod(col("_rlon") + i, F.lit(columns))))))
        placed = c.withColumn("gr", row("_clat")).withColumn("gc", F.pmod(col("_clon"), F.lit(columns)))
        hits = near.join(placed, ["gr", "gc"]).withColumn("km", dist).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if last:
            return hits.select(*cols).unionByName(found).withColumnsRenamed({"_r": request_id, "_c": candidate_id}) if found is not None else hits.select(*cols).withColumnsRenamed({"_r": request_id, "_c": candidate_id})
        # No candidate outside the nine cells is nearer than one cell, taken at its narrower side.
        edge = F.lit(cell * 6371.0 * np.pi / 180) * F.cos(F.radians(F.least(F.abs(F.col("_rlat")) + 2 * cell, F.lit(89.0))))
        hits = written(hits.withColumn("edge", edge), "nearest")
        sure = hits.where((F.col("rank") == k) & (F.col("km") <= F.col("edge"))).select("_r")
        kept = hits.join(sure, "_r", "left_semi").select(*cols)
        found = kept if found is None else found.unionByName(kept)
        r = written(r.join(sure, "_r", "left_anti"), "unsettled")
        if r.isEmpty():
            return found.withColumnsRenamed({"_r": request_id, "_c": candidate_id})
        cell *= 4


def pairs_both_ways(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Unordered pairs with edges in both directions: one grouping, no self join."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    g = edges.where(F.col(a) != F.col(b)).groupBy(lo.alias("a"), hi.alias("b")).agg(F.max((F.col(a) == lo).cast("int")).alias("there"), F.max((F.col(a) == hi).cast("int")).alias("back"))
    return g.where("there = 1 AND back = 1").select("a", "b")


def greedy_assignment(pdf: pd.DataFrame) -> pd.DataFrame:
    """Requests in order each take the cheapest candidate left; rows: batch, request, candidate, cost."""
    taken, out = set(), []
    for req, rows in pdf.sort_values(["request", "cost", "candidate"]).groupby("request", sort=True):
        for r in rows.itertuples():
            if r.candidate not in taken:
                taken.add(r.candidate)
                out.append((r.batch, req, r.candidate, r.cost))
                break
    return pd.DataFrame(out, columns=["batch", "request", "candidate", "cost"])


def solve_assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Minimum-cost one-to-one assignment of the smaller side, by shortest augmenting paths with potentials."""
    swap = cost.shape[0] > cost.shape[1]
    c = cost.T if swap else cost
    n, m = c.shape
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for start in range(n):
        low, way, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, col = start, -1
        while True:
            red = c[row] - u[row] - v
            better = ~done & (red < low)
            low[better], way[better] = red[better], col
            col = int(np.argmin(np.where(done, np.inf, low)))
            step = low[col]
            done[col] = True
            # Potentials move so that the column just reached becomes tight.
            used = np.flatnonzero(done[: m])
            inside = [j for j in used if j != col]
            u[start] += step
            for j in inside:
                u[owner[j]] += step
                v[j] -= step
            low[~done] -= step
            low[col] = 0
            if owner[col] < 0:
                break
            row = owner[col]
        while col >= 0:
            back = way[col]
            owner[col] = owner[back] if back >= 0 else start
            col = back
    found = [(int(owner[j]), j) for j in range(m) if owner[j] >= 0]
    return sorted((b, a) if swap else (a, b) for a, b in found)


def optimal_assignment(pdf: pd.DataFrame) -> pd.DataFrame:
    grid = pdf.pivot_table(index="request", columns="candidate", values="cost", aggfunc="min")
    big = float(np.nanmax(grid.to_numpy())) * grid.size + 1.0
    pairs = solve_assignment(np.where(np.isnan(grid.to_numpy()), big, grid.to_numpy()))
    rows = [(pdf["batch"].iloc[0], grid.index[i], grid.columns[j], float(grid.iloc[i, j])) for i, j in pairs if not np.isnan(grid.iloc[i, j])]
    return pd.DataFrame(rows, columns=["batch", "request", "candidate", "cost"])


def assign(costs: DataFrame, how: str = "optimal") -> DataFrame:
    """costs: batch, request, candidate, cost. A dispatch batch is the unit of work."""
    schema = ", ".join(f"{c} {t}" for c, t in costs.select("batch", "request", "candidate", "cost").dtypes)
    return costs.select("batch", "request", "candidate", "cost").groupBy("batch").applyInPandas(optimal_assignment if how == "optimal" else greedy_assignment, schema)


def match_score(km: Column, rating: Column, acceptance: Column, max_km: float, weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> Column:
    """Weighted sum of closeness, rating of 5 and acceptance, each cut to 0 .. 1."""
    cut = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return weights[0] * cut(1 - km / max_km) + weights[1] * cut(rating / 5) + weights[2] * cut(acceptance)
