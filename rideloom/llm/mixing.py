"""Mixing of sources to target weights by Poisson replication.

Each document gets a uniform number from a seeded hash of its id, and its number of copies is the inverse of the
Poisson distribution at that number, with the repetition rate its source needs as the mean, cut at the source's cap.
The mean is set so that the copies really drawn, cap and chance included, reach the target: the tokens of a source
by bins of the hashed number are a small histogram, added up over all documents, on which the rate is solved.
Documents are exploded by their count and shuffled globally by another seeded hash.

Weights are those of sources that have tokens, scaled to sum 1; a target without documents is reported with share 0,
documents of no target are not drawn. Without a given total the largest one is taken at which no source needs more
than its cap; with a larger one the capped sources fall short, and the report says so.

Defined results: rows sharing an id are one document (the least row counts); a null id or source is never drawn; empty
and null texts have no tokens and are repeated like others of their source; repeated targets: the least row counts;
empty tables give no rows (targets: a report of zeros); other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rideloom.llm.tokens import token_counts

BINS = 4096
#: The plan of a mix is made on the driver; it holds one line a target.
MOST_TARGETS = 1000
#: A cap beyond this is an error, since the distribution is tabulated up to the cap.
MOST_REPEATS = 100_000


def poisson_cdf(mean: float, upto: int) -> list[float]:
    """P(X <= k) for k = 0 .. upto - 1, by logarithms, so that no mean is too large."""
    if mean == math.inf:
        return [0.0] * upto
    if mean <= 0:
        return [1.0] * upto
    out, total, log_mean = [], 0.0, math.log(mean)
    for k in range(upto):
        total += math.exp(k * log_mean - mean - math.lgamma(k + 1))
        out.append(min(1.0, total))
    return out


def _steps(cdf: list[float]) -> tuple[int, list[float]]:
    """Steps below every number drawn, and those that tell numbers apart; steps of 1 are above every number."""
    least = 0.5 / 2**52
    return sum(c < least for c in cdf), [c for c in cdf if least <= c < 1.0]


def solve_rate(histogram: list[float], target: float, cap: int) -> float:
    """The mean at which documents with these tokens by bins of their number bring the target; inf: every document cap times."""
    n = len(histogram)
    above = [0.0] * (n + 1)  # tokens of bins from i on
    for i in range(n - 1, -1, -1):
        above[i] = above[i + 1] + histogram[i]

    def drawn(mean: float) -> float:
        total = 0.0
        for c in poisson_cdf(mean, cap):  # one more copy for each step of the distribution below the number
            x = c * n
            i = min(n - 1, int(x))
            total += above[i + 1] + histogram[i] * (i + 1 - x)
        return total

    if target <= 0 or cap <= 0:
        return 0.0
    if target >= above[0] * cap * (1 - 1e-9):
        return math.inf
    lo, hi = 0.0, 1.0
    while drawn(hi) < target and hi < 1e12:
        hi *= 2
    for _ in range(70):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if drawn(mid) < target else (lo, mid)
    return (lo + hi) / 2


def uniform(seed: int, *columns: str):
    """A number in (0, 1) from a seeded hash."""
    return (F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(2**52)) + F.lit(0.5)) / F.lit(float(2**52))


def sized(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, tokens), each id once."""
    t = token_counts(documents, keep=("source",), path=path).where(F.col("doc_id").isNotNull() & F.col("source").isNotNull())
    return t.groupBy("doc_id").agg(F.min(F.struct("source", "tokens")).alias("x")).select("doc_id", "x.source", "x.tokens")


def plan(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 1) -> list[dict]:
    """A line a target: what it has, should bring, and the mean of its repetitions."""
    t = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.min(F.struct("weight", "max_repeats")).alias("x")).select("source", "x.*")
    wanted = t.orderBy("source").limit(MOST_TARGETS + 1).collect()
    if len(wanted) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    bins = sizes.join(F.broadcast(t.select("source")), "source")  # as many rows as targets, checked above
    bins = bins.withColumn("bin", F.floor(uniform(seed, "doc_id") * BINS).cast("int")).groupBy("source", "bin").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    histograms: dict[str, list[float]] = {r["source"]: [0.0] * BINS for r in wanted}
    docs: dict[str, int] = {r["source"]: 0 for r in wanted}
    for r in bins.toLocalIterator():  # at most targets x bins numbers
        histograms[r["source"]][r["bin"]] += r["tokens"]
        docs[r["source"]] += r["docs"]
    lines = []
    for r in wanted:
        cap = max(0, r["max_repeats"] if r["max_repeats"] is not None else 1)
        if cap > MOST_REPEATS:
            raise ValueError(f"{r['source']}: max_repeats over {MOST_REPEATS}")
        lines.append({"source": r["source"], "weight": max(0.0, r["weight"] or 0.0), "max_repeats": cap, "documents": docs[r["source"]], "available": sum(histograms[r["source"]])})
    live = [x for x in lines if x["available"] > 0 and x["weight"] > 0 and x["max_repeats"] > 0]
    weights = sum(x["weight"] for x in live)
    reach = min((x["available"] * x["max_repeats"] / (x["weight"] / weights) for x in live), default=0.0)
    total = reach if total_tokens is None else total_tokens
    for x in lines:
        x["share"] = x["weight"] / weights if x in live else 0.0
        x["target"] = x["share"] * total
        x["mean"] = solve_rate(histograms[x["source"]], x["target"], x["max_repeats"])
    return lines


def mix(sizes: DataFrame, lines: list[dict], seed: int = 1) -> DataFrame:
    """(doc_id, source, tokens, copy, place): each drawn copy, in global shuffle order by place."""
    spark = sizes.sparkSession
    steps = [(x["source"], *_steps(poisson_cdf(x["mean"], x["max_repeats"]))) for x in lines if x["mean"] > 0]
    cdfs = spark.createDataFrame(steps, "source string, sure int, cdf array<double>")
    d = sizes.join(F.broadcast(cdfs), "source")  # as many rows as targets
    count = F.col("sure") + F.size(F.filter("cdf", lambda c: c < uniform(seed, "doc_id")))
    d = d.withColumn("copy", F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))))
    d = d.select("doc_id", "source", "tokens", "copy", F.xxhash64(F.lit(seed + 1), "doc_id", "copy").alias("place"))
    return d.repartitionByRange("place").sortWithinPartitions("place", "doc_id", "copy")


def with_texts(drawn: DataFrame, documents: DataFrame) -> DataFrame:
    """The drawn copies with their texts, in the global order: (doc_id, source, tokens, copy, place, text).

    Of rows sharing an id the one counted (the least source) brings the text, the least of several.
    """
    texts = documents.where(F.col("doc_id").isNotNull() & F.col("source").isNotNull()).groupBy("doc_id", "source").agg(F.min("text").alias("text"))
    return drawn.join(texts, ["doc_id", "source"]).repartitionByRange("place").sortWithinPartitions("place", "doc_id", "copy")


def report(drawn: DataFrame, lines: list[dict]) -> DataFrame:
    """(source, weight, target_share, share, tokens, copies, documents, mean_repeats, most_repeats, max_repeats) of each target."""
    spark = drawn.sparkSession
    wanted = spark.createDataFrame([(x["source"], float(x["weight"]), float(x["share"]), int(x["max_repeats"]), int(x["documents"])) for x in lines], "source string, weight double, target_share double, max_repeats int, documents long")
    got = drawn.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("copies"), (F.max("copy") + 1).alias("most_repeats"))
    total = got.agg(F.sum("tokens").alias("all_tokens"))
    r = F.broadcast(wanted).join(got, "source", "left").crossJoin(F.broadcast(total))  # one row
    zero = lambda c: F.coalesce(c, F.lit(0))
    return r.select("source", "weight", "target_share", F.coalesce(F.try_divide(zero(F.col("tokens")), F.col("all_tokens")), F.lit(0.0)).alias("share"), zero(F.col("tokens")).alias("tokens"), zero(F.col("copies")).alias("copies"), "documents", F.coalesce(F.try_divide(zero(F.col("copies")), F.col("documents")), F.lit(0.0)).alias("mean_repeats"), zero(F.col("most_repeats")).alias("most_repeats"), "max_repeats")
