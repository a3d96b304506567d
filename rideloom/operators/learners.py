"""Model fitting and search: a two-layer net by distributed gradient steps, cross-validation with any metric,
grid, random and tree-structured search, bandits, bootstrap.

The driver only ever holds weights, a line a trial and a number a metric; rows stay in their partitions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- two-layer net -----------------------------------------------------------------------------------------------


@dataclass
class Net:
    """One hidden layer of rectified units, standardised inputs and output."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    mean: np.ndarray
    scale: np.ndarray
    history: list[dict] = field(default_factory=list)  # a line an epoch: rate, loss, best

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(x @ self.w1 + self.b1, 0.0)
        return h, h @ self.w2 + self.b2

    def predict(self, x: np.ndarray) -> np.ndarray:
        k = len(self.mean) - 1
        return self.forward((x - self.mean[:k]) / self.scale[:k])[1] * self.scale[k] + self.mean[k]


def step_decay(rate: float, every: int = 10, factor: float = 0.5) -> Callable[[int], float]:
    return lambda epoch: rate * factor ** (epoch // every)


def cosine_decay(rate: float, epochs: int) -> Callable[[int], float]:
    return lambda epoch: rate * (1 + math.cos(math.pi * min(epoch, epochs) / epochs)) / 2


def train_net(df: DataFrame, features: Sequence[str], label: str, *, hidden: int = 8, epochs: int = 30, batches: int = 4, schedule: Callable[[int], float] | None = None, patience: int = 5, least_gain: float = 1e-4, valid: float = 0.2, seed: int = 7) -> Net:
    """Mini-batch gradient descent with momentum over all rows; stops when the validation loss has not gained for `patience` epochs and keeps the best weights.

    A batch is a seeded hash part of the rows; each partition adds up its gradient and sends one line. Rows with nulls are left out.
    """
    cols = [*features, label]
    d = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    stats = d.agg(*[F.avg(c) for c in cols], *[F.stddev_pop(c) for c in cols]).first()
    k = len(features)
    if stats[0] is None:
        raise ValueError("no rows to fit")
    mean, scale = np.array(stats[: k + 1]), np.array([s if s else 1.0 for s in stats[k + 1 :]])
    rng = np.random.default_rng(seed)
    net = Net(rng.normal(0, math.sqrt(2 / k), (k, hidden)), np.zeros(hidden), rng.normal(0, math.sqrt(2 / hidden), hidden), 0.0, mean, scale)
    part = F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(10_000)) / 10_000.0
    d = d.withColumn("_part", F.when(part < valid, -1).otherwise(F.floor((part - valid) / (1 - valid) * batches)).cast("int"))
    schedule = schedule or step_decay(0.05)
    size = k * hidden + 2 * hidden + 1
    speed, best, best_at, waited = np.zeros(size), math.inf, net, 0
    for epoch in range(epochs):
        rate = schedule(epoch)
        for b in range(batches):
            total = _sums(d.where(F.col("_part") == b), net, size, gradient=True)
            if total[-2]:
                speed = 0.9 * speed - rate * total[:size] / total[-2]
                net = _moved(net, speed)
        checked = _sums(d.where(F.col("_part") == -1), net, size, gradient=False)
        loss = checked[-1] / checked[-2] if checked[-2] else 0.0
        net.history.append({"epoch": epoch, "rate": rate, "loss": loss})
        if loss < best - least_gain:
            best, best_at, waited = loss, net, 0
        else:
            waited += 1
            if waited >= patience:
                break
    best_at.history = net.history
    return best_at


def _moved(net: Net, by: np.ndarray) -> Net:
    k, h = net.w1.shape
    a, b, c = k * h, k * h + h, k * h + 2 * h
    return Net(net.w1 + by[:a].reshape(k, h), net.b1 + by[a:b], net.w2 + by[b:c], net.b2 + by[c], net.mean, net.scale, net.history)


def _sums(d: DataFrame, net: Net, size: int, gradient: bool) -> np.ndarray:
    """Gradient (or zeros), rows and squared error, added up over partitions: a line a partition reaches the driver."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size + 2)
        for f in frames:
            x = (f.iloc[:, : len(net.mean)].to_numpy(float) - net.mean) / net.scale
            y, x = x[:, -1], x[:, :-1]
            h, out = net.forward(x)
            e = out - y
            if gradient:
                back = np.outer(e, net.w2) * (h > 0)
                total[:size] += np.concatenate([(x.T @ back).ravel(), back.sum(0), h.T @ e, [e.sum()]])
            total[-2:] += len(y), float(e @ e)
        yield pd.DataFrame({"sums": [total.tolist()]})

    parts = d.mapInPandas(run, "sums array<double>")
    added = parts.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("v")).collect()  # as many lines as weights
    out = np.zeros(size + 2)
    for r in added:
        out[r["pos"]] = r["v"]
    return out


def predicted(df: DataFrame, net: Net, features: Sequence[str], name: str = "prediction") -> DataFrame:
    @F.pandas_udf("double")
    def f(*cols: pd.Series) -> pd.Series:
        return pd.Series(net.predict(np.column_stack([c.to_numpy(float) for c in cols])))

    return df.withColumn(name, f(*[F.col(c).cast("double") for c in features]))


# ---- cross-validation and search ---------------------------------------------------------------------------------

#: Metrics by name: aggregates of a label and a prediction. Any function of two columns can stand in their place.
METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "rmse": lambda y, p: F.sqrt(F.avg((y - p) * (y - p))),
    "mae": lambda y, p: F.avg(F.abs(y - p)),
    "bias": lambda y, p: F.avg(p - y),
    "accuracy": lambda y, p: F.avg((y == p).cast("double")),
}


def cross_validated(df: DataFrame, fold: str, label: str, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], metrics: Mapping[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """(fold, metric...): fit on all other folds gives a function that adds a column prediction; metrics are aggregates of label and prediction."""
    out = None
    for k in sorted(r[0] for r in df.select(fold).distinct().collect()):  # few folds
        model = fit(df.where(F.col(fold) != k))
        p = model(df.where(F.col(fold) == k)).agg(*[m(F.col(label), F.col("prediction")).alias(n) for n, m in metrics.items()]).select(F.lit(k).alias(fold), *metrics)
        out = p if out is None else out.unionByName(p)
    return out


def grid_points(space: Mapping[str, tuple[float, float]], steps: int = 5) -> list[dict[str, float]]:
    """Every combination of equally spaced values, ends included."""
    points: list[dict[str, float]] = [{}]
    for name, (lo, hi) in space.items():
        points = [p | {name: lo + (hi - lo) * i / max(1, steps - 1)} for p in points for i in range(steps)]
    return points


def random_points(space: Mapping[str, tuple[float, float]], n: int, seed: int = 1) -> list[dict[str, float]]:
    rng = np.random.default_rng(seed)
    return [{k: float(rng.uniform(lo, hi)) for k, (lo, hi) in space.items()} for _ in range(n)]


def search(space: Mapping[str, tuple[float, float]], score: Callable[[Sequence[dict[str, float]]], Sequence[float]], how: str = "grid", trials: int = 20, start: int = 8, seed: int = 1, tries: int = 24) -> list[tuple[dict[str, float], float]]:
    """(point, score) of all trials, the least score best, in order of trial. score takes a list of points, so that one pass over the data can serve many.

    "tree" draws the first points at random; then each next point is the one, of `tries` drawn around the best quarter,
    at which the density of good points (normal, each around a good point) most exceeds that of the others.
    """
    if how == "grid":
        points = grid_points(space)
        return list(zip(points, score(points)))
    points = random_points(space, trials if how == "random" else min(start, trials), seed)
    done = list(zip(points, score(points)))
    if how == "random":
        return done
    rng = np.random.default_rng(seed + 1)
    low, wide = np.array([a for a, _ in space.values()]), np.array([max(b - a, 1e-12) for a, b in space.values()])
    while len(done) < trials:
        ranked = sorted(done, key=lambda d: d[1])
        x = (np.array([list(p.values()) for p, _ in ranked]) - low) / wide
        cut = max(2, len(x) // 4)
        good, rest = x[:cut], x[cut:]
        width = max(0.05, float(np.std(good, axis=0).mean()))
        tried = np.clip(good[rng.integers(0, cut, tries)] + rng.normal(0, width, (tries, x.shape[1])), 0, 1)
        density = lambda at: np.exp(-((tried[:, None, :] - at[None]) ** 2).sum(2) / (2 * width**2)).mean(1) + 1e-12
        best = low + wide * tried[np.argmax(density(good) / density(rest))]
        point = dict(zip(space, map(float, best)))
        done.append((point, score([point])[0]))
    return done


# ---- bandits -----------------------------------------------------------------------------------------------------


def play(arms: Sequence[float], policy: str, rounds: int, seed: int = 1, epsilon: float = 0.1) -> list[tuple[int, float, float]]:
    """(arm, reward, regret so far) of each round against arms with these chances of a reward of 1.

    epsilon: explores with that probability; ucb1: mean plus sqrt(2 ln t / n), each arm once first;
    thompson: the arm with the best draw from its Beta distribution. Regret is the best chance less the chosen one.
    """
    rng = np.random.default_rng(seed)
    n, won, out, regret = np.zeros(len(arms)), np.zeros(len(arms)), [], 0.0
    for t in range(1, rounds + 1):
        mean = np.divide(won, n, out=np.zeros(len(arms)), where=n > 0)
        if policy == "epsilon":
            arm = int(rng.integers(len(arms))) if rng.random() < epsilon else int(np.argmax(mean))
        elif policy == "ucb1":
            arm = int(np.argmin(n)) if (n == 0).any() else int(np.argmax(mean + np.sqrt(2 * math.log(t) / n)))
        elif policy == "thompson":
            arm = int(np.argmax(rng.beta(1 + won, 1 + n - won)))
        else:
            raise ValueError(f"policy {policy}: epsilon, ucb1 or thompson")
        reward = float(rng.random() < arms[arm])
        n[arm] += 1
        won[arm] += reward
        regret += max(arms) - arms[arm]
        out.append((arm, reward, regret))
    return out


def bandit_runs(runs: DataFrame, rounds: int) -> DataFrame:
    """(run, policy, seed, rewards, regret, best_share) of each row (run, policy, seed, arms array<double>): runs are spread over tasks."""

    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            lines = []
            for r in f.itertuples(index=False):
                x = play(list(r.arms), r.policy, rounds, int(r.seed))
                best = int(np.argmax(r.arms))
                lines.append((r.run, r.policy, r.seed, sum(b for _, b, _ in x), x[-1][2], sum(a == best for a, _, _ in x) / rounds))
            yield pd.DataFrame(lines, columns=["run", "policy", "seed", "rewards", "regret", "best_share"])

    return runs.select("run", "policy", "seed", "arms").mapInPandas(go, "run long, policy string, seed long, rewards double, regret double, best_share double")


# ---- bootstrap ---------------------------------------------------------------------------------------------------


def bootstrap_means(df: DataFrame, group: Sequence[str], key: str, value: str, rounds: int = 100, part: float = 0.9, seed: int = 1) -> DataFrame:
    """(group..., mean, lo, hi): percentile interval of the mean. A row enters a round as often as a Poisson draw of mean 1 from a seeded hash of its key says.

    One pass: sums of all rounds are aggregates side by side. Rows without a value are left out; a round without rows counts as none.
    """
    steps, term, total = [], math.exp(-1), 0.0
    for k in range(8):
        total += term
        steps.append(total)
        term /= k + 1
    v = F.col(value).cast("double")
    d = df.where(v.isNotNull())
    weights = []
    for i in range(rounds):
        u = F.pmod(F.xxhash64(F.lit(seed), F.lit(i), F.col(key)), F.lit(2**40)) / float(2**40)
        weights.append(sum(((u >= s).cast("int") for s in steps[1:]), (u >= steps[0]).cast("int")))
    aggs = [F.try_divide(F.sum(w * v), F.sum(w)).alias(f"_b{i}") for i, w in enumerate(weights)]
    x = d.groupBy(*group).agg(F.avg(v).alias("mean"), *aggs)
    ordered = F.sort_array(F.array_compact(F.array(*[F.col(f"_b{i}") for i in range(rounds)])))
    at = lambda q: F.try_element_at(F.col("_s"), (F.floor(F.lit(q) * (F.size("_s") - 1)) + 1).cast("int"))
    return x.withColumn("_s", ordered).select(*group, "mean", at((1 - part) / 2).alias("lo"), at((1 + part) / 2).alias("hi"))
