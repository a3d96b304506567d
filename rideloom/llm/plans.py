"""Queries p3 and p8 to p10 over the given tables, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rideloom.common import table, value_counts, written
from rideloom.llm import mixing, percentiles, pii, tokens

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def _zone_speeds(spark: SparkSession, d: str) -> DataFrame:
    """One row per event: its copies are equal but for when they were processed."""
    e = table(spark, d, "processed_locations").select("event_id", "zone_id", "speed_kmh", F.to_date("recorded_at").alias("day"))
    return e.groupBy("event_id").agg(F.min(F.struct("zone_id", "day", "speed_kmh")).alias("x")).select("x.*")


def p3_zone_day_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.percentiles(_zone_speeds(spark, d), ["zone_id", "day"], "speed_kmh", QUANTILES)


def p3_zone_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """From the states of the days, added up."""
    days = value_counts(_zone_speeds(spark, d), ["zone_id", "day"], "speed_kmh")
    return percentiles.percentiles_of(written(percentiles.roll_up(days, ["zone_id"]), "counts"), ["zone_id"], QUANTILES)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(table(spark, d, "documents"))


def p8_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and characters by source and language; null is a group."""
    docs = table(spark, d, "documents")
    counts = tokens.token_counts(docs, keep=("source", "lang", "n_chars"))
    return counts.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"), F.sum(F.coalesce("n_chars", F.lit(0))).alias("chars"))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, list[dict]]:
    sizes = written(mixing.sized(table(spark, d, "documents")), "sizes")  # the texts are encoded once
    lines = mixing.plan(sizes, table(spark, d, "mix_targets"))
    return mixing.mix(sizes, lines), lines


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(*_mix(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_spans(table(spark, d, "documents"), pii.model_of(table(spark, d, "known_names"))).distinct()


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(table(spark, d, "documents"), pii.model_of(table(spark, d, "known_names")))


QUERIES = {f.__name__: f for f in (p3_zone_day_percentiles, p3_zone_percentiles, p8_ids, p8_tokens, p9_mix, p9_shares, p10_found, p10_redacted)}
_EVENTS = "SELECT event_id, min(zone_id) AS zone_id, min(CAST(timezone('UTC', recorded_at) AS DATE)) AS day, min(speed_kmh) AS speed_kmh FROM processed_locations GROUP BY event_id"


def _percentiles(keys: str, day: bool) -> str:
    qs = ", ".join(f"({q})" for q in QUANTILES)
    on = "r.zone_id IS NOT DISTINCT FROM t.zone_id" + (" AND r.day = t.day" if day else "")
    return f"""WITH e AS ({_EVENTS}), r AS (
        SELECT {keys}, speed_kmh, row_number() OVER (PARTITION BY {keys} ORDER BY speed_kmh) AS rn, count(*) OVER (PARTITION BY {keys}) AS n
        FROM e WHERE speed_kmh IS NOT NULL AND NOT isnan(speed_kmh)), q AS (SELECT CAST(col0 AS DOUBLE) AS quantile FROM (VALUES {qs}))
        SELECT {', '.join('r.' + k.strip() for k in keys.split(','))}, r.n, q.quantile, r.speed_kmh AS percentile
        FROM r, q WHERE r.rn = greatest(1, CAST(ceil(round(q.quantile * r.n, 6)) AS BIGINT))"""


#: Tokenizers, hashed draws and fitted models have no SQL; tests/llm holds their brute-force checks.
SQL = {
    "p3_zone_day_percentiles": _percentiles("zone_id, day", True),
    "p3_zone_percentiles": _percentiles("zone_id", False),
}
