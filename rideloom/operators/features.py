"""Features, splits, recommendation, text retrieval and graph operators on DataFrames."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rideloom.common import cumulated, value_counts, written
from rideloom.session import shared_dir


def hashed_split(df: DataFrame, key: str, parts: Sequence[float], seed: int = 1) -> DataFrame:
    """Adds part 0, 1, ...: shares of the rows by a seeded hash of the key, the same wherever the row is."""
    u = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) / 1_000_000.0
    edges, at = [], 0.0
    for p in parts[:-1]:
        at += p
        edges.append(at)
    return df.withColumn("part", F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= u)) if edges else F.lit(0))


def folds(df: DataFrame, key: str, k: int, seed: int = 1) -> DataFrame:
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(k)).cast("int"))


def split_by_time(df: DataFrame, ts: str, parts: Sequence[float]) -> DataFrame:
    """Adds part 0, 1, ...: earlier rows first, shares of the rows by cumulative counts of distinct times; equal times stay together.

    A time belongs to the part in which its first row falls. Rows without a time have no part.
    """
    key = F.unix_micros(F.col(ts).cast("timestamp")).cast("double")
    at = cumulated(value_counts(df.select(key.alias("_us")), [], "_us"), []).select(F.col("value").alias("_us"), ((F.col("upto") - F.col("n")) / F.col("total")).alias("_q"))
    edges = [sum(parts[: i + 1]) for i in range(len(parts) - 1)]
    part = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= F.col("_q") + 1e-12)) if edges else F.lit(0)
    return df.withColumn("_us", key).join(at.withColumn("part", part).drop("_q"), "_us", "left").drop("_us")


def stratified_split(df: DataFrame, stratum: str, key: str, parts: Sequence[float], seed: int = 1) -> DataFrame:
    """Adds part 0, 1, ...: the same shares of each stratum, exact to a row. Rows are ordered by a seeded hash of the key within bands of the stratum."""
    bands = 256
    h = F.xxhash64(F.lit(seed), F.col(key))
    x = df.withColumn("_h", h).withColumn("_band", F.pmod(F.shiftrightunsigned(F.col("_h"), 16), F.lit(bands)))
    counts = x.groupBy(F.col(stratum).alias("_s"), F.col("_band").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))  # strata x bands
    by = Window.partitionBy("_s")
    counts = counts.select("_s", "_b", (F.sum("_n").over(by.orderBy("_b")) - F.col("_n")).alias("_before"), F.sum("_n").over(by).alias("_all"))
    x = x.withColumn("_i", F.row_number().over(Window.partitionBy(stratum, "_band").orderBy("_h", key)))
    x = x.join(counts, F.col(stratum).eqNullSafe(F.col("_s")) & (F.col("_band") == F.col("_b")))
    at = (F.col("_before") + F.col("_i") - 1) / F.col("_all")
    edges = [sum(parts[: i + 1]) for i in range(len(parts) - 1)]
    part = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= at + 1e-12)) if edges else F.lit(0)
    return x.withColumn("part", part).select(*df.columns, "part")


def freshness(expected: DataFrame, latest: DataFrame, key: str, ts: str, now: str, sla_s: str) -> DataFrame:
    """Adds state fresh, stale or unknown (never written)."""
    age = F.lit(now).cast("timestamp").cast("double") - F.col(ts).cast("timestamp").cast("double")
    return expected.join(latest, key, "left").withColumn("state", F.when(F.col(ts).isNull(), "unknown").when(age <= F.col(sla_s), "fresh").otherwise("stale"))


def item_similarity(ratings: DataFrame, least_common: int = 2, block: int = 2_000) -> DataFrame:
    """(a, b, similarity) of users over co-rated items: ratings are u, i, r, one row a pair.

    The join is by item, each pair once; its size is half the sum of squared item popularities, which an exact measure
    needs. Raters of popular items are dealt over blocks and blocks are joined in pairs, so no item is one task.
    """
    many = ratings.groupBy("i").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    x = ratings.join(many, "i").withColumn("k", F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int"))
    # Of the pair of blocks the lower comes first: a rater stands in one block and visits the others.
    a = x.withColumn("k2", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("i", F.least("k", "k2").alias("k1"), F.greatest("k", "k2").alias("k2"), F.col("u"), F.col("r"), F.col("k"))
    b = a.select("i", "k1", "k2", F.col("u").alias("b"), F.col("r").alias("rb"), F.col("k").alias("kb"))
    a = a.select("i", "k1", "k2", F.col("u").alias("a"), F.col("r").alias("ra"), F.col("k").alias("ka"))
    # In a mixed pair of blocks only raters of different ones meet.
    s = a.join(b, ["i", "k1", "k2"]).where("a < b AND (k1 = k2 OR ka <> kb)").groupBy("a", "b").agg(F.sum(F.col("ra") * F.col("rb")).alias("xy"), F.sum(F.col("ra") ** 2).alias("xx"), F.sum(F.col("rb") ** 2).alias("yy"), F.count(F.lit(1)).alias("n"))
    s = s.where(F.col("n") >= least_common).select("a", "b", (F.col("xy") / (F.sqrt("xx") * F.sqrt("yy"))).alias("similarity"))
    both = F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return s.select(F.explode(both).alias("x"), "similarity").select("x.a", "x.b", "similarity")


def recommend(ratings: DataFrame, neighbours: int = 10, k: int = 5, least_common: int = 2) -> DataFrame:
    """(u, i, score, rank): similarity-weighted means of the nearest users' ratings over items not rated."""
    near = item_similarity(ratings, least_common)
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy(F.desc(F.round("similarity", 9)), "b"))).where(F.col("n") <= neighbours)
    c = near.join(ratings.withColumnRenamed("u", "b"), "b").groupBy(F.col("a").alias("u"), "i").agg((F.sum(F.col("similarity") * F.col("r")) / F.sum("similarity")).alias("score"))
    c = c.join(ratings.select("u", "i"), ["u", "i"], "left_anti")
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy(F.desc(F.round("score", 9)), "i"))).where(F.col("rank") <= k)


# ---- text --------------------------------------------------------------------------------------------------------


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def chunks(tokens: Column, size: int = 200, overlap: int = 50) -> Column:
    """Array of overlapping slices; the last is the first that reaches the end."""
    step = size - overlap
    n = F.size(tokens)
    count = F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / step) + 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), lambda i: F.slice(tokens, i * step + 1, size))).otherwise(F.array().cast("array<array<string>>"))


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, length)."""
    w = docs.where(F.col(text).isNotNull()).select(key, words(F.col(text)).alias("w"))
    return w.select(key, F.size("w").alias("length"), F.explode("w").alias("term")).groupBy(key, "term", "length").agg(F.count(F.lit(1)).alias("tf"))


def tfidf(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, weight) with tf over length times ln(N / df)."""
    tc = term_counts(docs, key, text)
    n = docs.where(F.col(text).isNotNull()).agg(F.count(F.lit(1)).alias("N"))
    df = tc.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n))  # one row
    return tc.join(df, "term").select(key, "term", (F.col("tf") / F.col("length") * F.ln(F.col("N") / F.col("df"))).alias("weight"))


def retrieve(weights: DataFrame, key: str, query: Sequence[str], k: int) -> DataFrame:
    """(key, score): cosine of documents with a bag of query words, each of weight 1, best first."""
    q = sorted(set(query))
    s = weights.groupBy(key).agg(F.sum(F.when(F.col("term").isin(q), F.col("weight")).otherwise(0.0)).alias("xy"), F.sqrt(F.sum(F.col("weight") ** 2)).alias("n"))
    s = s.withColumn("score", F.coalesce(F.try_divide(F.col("xy"), F.col("n") * F.lit(float(len(q)) ** 0.5)), F.lit(0.0))).where("score > 0")
    return s.orderBy(F.desc(F.round("score", 9)), key).limit(k).select(key, "score")


def bm25(counts: DataFrame, key: str, query: Sequence[str], average_length: Column, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) with a constant inverse document frequency of ln 2."""
    part = F.ln(F.lit(2.0)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / average_length))
    return counts.where(F.col("term").isin(*query)).groupBy(key).agg(F.sum(part).alias("score"))


def mentions(docs: DataFrame, key: str, text: str, patterns: Sequence[tuple[str, str]]) -> DataFrame:
    """(key, kind, start, mention): every match of each (kind, regular expression), with its offset in characters.

    A kind may have several patterns, the caller's own included; matches of one pattern don't overlap.
    """
    found = []
    for kind, rx in patterns:
        parts, hits = F.split(text, rx, -1), F.regexp_extract_all(text, F.lit(rx), F.lit(0))
        sizes = F.zip_with(F.slice(parts, 1, F.size(hits)), hits, lambda a, b: F.struct(F.length(a).alias("gap"), F.length(b).alias("n"), b.alias("m")))
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,mention:string>>").alias("out"))
        step = lambda acc, x: F.struct((acc["at"] + x["gap"] + x["n"]).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), x["m"].alias("mention")))).alias("out"))
        named = F.lit(kind).alias("kind")
        found.append(F.transform(F.aggregate(sizes, none, step)["out"], lambda x: F.struct(named, x["start"].alias("start"), x["mention"].alias("mention"))))  # noqa: B023  called at once
    return docs.where(F.col(text).isNotNull()).select(key, F.explode(F.flatten(F.array(*found))).alias("x")).select(key, "x.kind", "x.start", "x.mention")


def linked(found: DataFrame, aliases: DataFrame) -> DataFrame:
    """Mentions joined to the entities they may mean: aliases (kind, alias, entity), compared without case and outer blanks; unknown ones stay, with a null entity."""
    a = aliases.where(F.col("alias").isNotNull()).select(F.col("kind").alias("_k"), F.lower(F.trim("alias")).alias("_a"), "entity").distinct()
    return found.join(a, (F.col("kind") == F.col("_k")) & (F.lower(F.trim("mention")) == F.col("_a")), "left").drop("_k", "_a")


def gazetteer(names: Sequence[str], least: int = 2) -> str:
    """One pattern of a bounded list of names, longest first; names shorter than `least` are left to other patterns."""
    import re

    kept = sorted({n.strip() for n in names if n and len(n.strip()) >= least}, key=lambda n: (-len(n), n))
    return "(?i)(?:" + "|".join(re.escape(n) for n in kept) + ")" if kept else "(?!)"


# ---- graphs ------------------------------------------------------------------------------------------------------


def pagerank(edges: DataFrame, src: str, dst: str, rounds: int = 20, damping: float = 0.85, save_every: int = 5) -> DataFrame:
    """(node, rank): edges count as often as they occur; dangling ranks are not handed on.

    Each round joins ranks to edges grouped by source; the lineage is cut by written tables.
    """
    e = edges.groupBy(F.col(src).alias("s"), F.col(dst).alias("t")).agg(F.count(F.lit(1)).alias("w"))
    e = written(e.join(e.groupBy("s").agg(F.sum("w").alias("out")), "s").select("s", "t", (F.col("w") / F.col("out")).alias("part")), "edges")
    nodes = written(e.select(F.col("s").alias("node")).union(e.select("t")).distinct(), "nodes")
    n = nodes.count()
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for i in range(1, rounds + 1):
        got = e.join(ranks, e["s"] == ranks["node"]).groupBy(F.col("t").alias("node")).agg(F.sum(F.col("rank") * F.col("part")).alias("sum"))
        ranks = nodes.join(got, "node", "left").select("node", (F.lit((1 - damping) / max(n, 1)) + damping * F.coalesce("sum", F.lit(0.0))).alias("rank"))
        if i % save_every == 0:
            ranks = written(ranks, "ranks")
    return ranks


def shortest(edges: DataFrame, src: str, dst: str, weight: str, start, most_rounds: int | None = None) -> DataFrame:
    """(node, cost) from a start by repeated relaxation of improved nodes only, until none improves; weights are not negative.

    With most_rounds, a graph that needs more rounds is an error.
    """
    e = edges.groupBy(F.col(src).alias("s"), F.col(dst).alias("t")).agg(F.min(weight).alias("w"))
    if not e.where("w < 0").isEmpty():
        raise ValueError("negative weights")
    kind = dict(edges.dtypes)[src]
    best = edges.sparkSession.createDataFrame([(start, 0.0)], f"node {kind}, cost double")
    front, rounds = best, 0
    while True:
        step = front.join(e, front["node"] == e["s"]).groupBy(F.col("t").alias("node")).agg(F.min(F.col("cost") + F.col("w")).alias("new"))
        step = step.where(F.col("new").isNotNull())
        front = written(step.join(best, "node", "left").where(F.col("cost").isNull() | (F.col("new") < F.col("cost"))).select("node", F.col("new").alias("cost")), "front")
        if front.isEmpty():
            return best
        if rounds == most_rounds:
            raise RuntimeError(f"nodes still improve after {most_rounds} rounds")
        best, rounds = written(best.join(front, "node", "left_anti").unionByName(front), "best"), rounds + 1


def path_totals(nodes: DataFrame, node: str, up: str, value: str, root, most_depth: int | None = None) -> DataFrame:
    """(node, depth, total): values summed along the path from the root, for the nodes whose path is whole; of several paths of one depth the largest sum.

    Frontier by frontier until none follows. The nodes are written once, sorted by what they hang on, so a step reads
    only those between the ends of its frontier. With most_depth, nodes beyond it are an error; a cycle needs it to end.
    """
    spark, out = nodes.sparkSession, f"{shared_dir(nodes.sparkSession)}/rideloom-paths-{uuid.uuid4().hex}"
    x = nodes.select(F.col(node).alias("node"), F.col(up).alias("_up"), F.col(value).cast("double").alias("_value"))
    step = x.where(F.col("node") == F.lit(root)).select("node", F.col("_value").alias("total"), F.col("_value").alias("low"))
    x = written(x.where((F.col("node") != F.lit(root)) & F.col("_up").isNotNull()).repartitionByRange("_up", "node").sortWithinPartitions("_up"), "tree")
    for depth in itertools.count(0):
        # The lowest sum goes along: with opposite infinities it may be the one that becomes NaN, which is above all.
        step.groupBy("node").agg(F.max(F.greatest("total", "low")).alias("total"), F.min(F.least("total", "low")).alias("low")).write.parquet(f"{out}/depth={depth}")
        front = spark.read.schema(step.schema).parquet(f"{out}/depth={depth}")
        first, last = front.agg(F.min("node"), F.max("node")).first()
        if first is None:
            return spark.read.schema(f"node {dict(step.dtypes)['node']}, total double, low double, depth int").parquet(out).select("node", "depth", "total")
        if most_depth is not None and depth > most_depth:
            raise RuntimeError(f"nodes beyond depth {most_depth}")
        near = x.where(F.col("_up").between(F.lit(first), F.lit(last)))
        step = front.withColumnRenamed("node", "_at").join(near, F.col("_at") == F.col("_up")).select("node", (F.col("total") + F.col("_value")).alias("total"), (F.col("low") + F.col("_value")).alias("low"))


def minutes_at(segments: DataFrame, profiles: DataFrame, hour: int) -> DataFrame:
    """Segments (segment, s, t, km, limit) with the minutes they take at an hour: by the profile (segment, hour, speed) of that hour, the fastest of several, else by the limit."""
    at = profiles.where(F.col("hour") == hour).groupBy("segment").agg(F.max("speed").alias("speed"))
    x = segments.join(at, "segment", "left").withColumn("speed", F.coalesce("speed", "limit"))
    if not x.where("speed <= 0").isEmpty():
        raise ValueError("speeds must be positive")
    return x.withColumn("minutes", F.col("km") / F.col("speed") * 60)


def neighbour_mean(values: DataFrame, edges: DataFrame, own: float = 0.0, default: float = 0.0) -> DataFrame:
    """(node, value): weighted mean of the neighbours' values (edges s, t, w), blended with the node's own."""
    got = edges.join(values, edges["t"] == values["node"]).groupBy(F.col("s").alias("node")).agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("around"))
    return values.join(got, "node", "left").select("node", F.when(F.col("around").isNull(), F.coalesce("value", F.lit(default))).otherwise(own * F.coalesce("value", F.lit(default)) + (1 - own) * F.col("around")).alias("value"))
