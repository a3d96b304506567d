"""Queries p1, p2 and p4 to p7 over the given tables, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rideloom.common import epoch, table
from rideloom.operators import history, intervals, late, proximity, spikes, trips

def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = spikes.implausible(table(spark, d, "driver_locations"), table(spark, d, "processed_locations"))
    return found.select(F.col("reading_id").alias("ping_id"), "field").where(F.col("ping_id").isNotNull()).distinct()


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    found = spikes.implausible(table(spark, d, "driver_locations"), table(spark, d, "processed_locations"))
    return found.groupBy("field", "reason").agg(F.count(F.lit(1)).alias("readings"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    s = trips.stops(table(spark, d, "driver_locations"))
    sec = lambda c: F.floor(F.col(c) / 1_000_000).cast("long")
    return s.select("driver_id", sec("start_us").alias("stop_start"), sec("end_us").alias("stop_end")).distinct()


def p2_trips(spark: SparkSession, d: str) -> DataFrame:
    return trips.stops_and_trips(table(spark, d, "driver_locations"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return late.corrected_hours(table(spark, d, "processed_locations"))


def p4_driver_hours(spark: SparkSession, d: str) -> DataFrame:
    return late.driver_hours(table(spark, d, "processed_locations")).drop("revisions")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    g = intervals.gaps(intervals.subscription_periods(table(spark, d, "subscriptions")))
    return g.select(F.col("entity").alias("user_id"), "gap_start", "gap_end").distinct()


def p5_periods(spark: SparkSession, d: str) -> DataFrame:
    p = intervals.periods_of(intervals.subscription_periods(table(spark, d, "subscriptions")))
    return p.withColumnRenamed("entity", "user_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = proximity.near_pairs(table(spark, d, "driver_locations"), id_col="id", lat="latitude", lon="longitude", radius_m=25.0, group="driver_id", ts="recorded_at", reach_s=10.0)
    return pairs.select("id_a", "id_b")


def p6_zones(spark: SparkSession, d: str) -> DataFrame:
    """The zone that holds each processed ping, against the zone recorded for it."""
    p = table(spark, d, "processed_locations").select("event_id", "latitude", "longitude", "zone_id").distinct()
    p = proximity.in_boxes(p, table(spark, d, "dim_zones"), lat="latitude", lon="longitude", box_id="zone_id")
    return p.select("event_id", "zone_id", "found_box", p["found_box"].eqNullSafe(p["zone_id"]).alias("agrees")).withColumnRenamed("found_box", "found_zone_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    h = history.driver_history(table(spark, d, "driver_snapshots"))
    return h.select("driver_id", F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from")).distinct()


def p7_history(spark: SparkSession, d: str) -> DataFrame:
    h = history.driver_history(table(spark, d, "driver_snapshots"))
    return h.select("driver_id", "full_name", "license_number", "rating", "total_trips", epoch(F.col("valid_from")).alias("valid_from"), epoch(F.col("valid_to")).alias("valid_to"), "is_current")


QUERIES = {f.__name__: f for f in (p1_found, p1_reasons, p2_found, p2_trips, p4_found, p4_driver_hours, p5_found, p5_periods, p6_found, p6_zones, p7_found, p7_history)}

_FIRST = "SELECT event_id, min(processed_at) AS p, min(recorded_at) AS r, min(driver_id) AS driver_id FROM processed_locations WHERE driver_id IS NOT NULL AND recorded_at IS NOT NULL AND processed_at IS NOT NULL GROUP BY event_id"
_HOURS = f"SELECT driver_id, CAST(floor(epoch(r) / 3600) AS BIGINT) * 3600 AS period_start, epoch_us(p) AS p FROM ({_FIRST})"
_COVER = """SELECT user_id, CAST(floor(epoch(started_at)) AS BIGINT) AS s, CAST(coalesce(least(floor(epoch(expires_at)), floor(epoch(cancelled_at))), 4611686018427387904) AS BIGINT) AS e
    FROM subscriptions WHERE user_id IS NOT NULL AND started_at IS NOT NULL"""
_ISLANDS = f"""WITH c AS (SELECT DISTINCT * FROM ({_COVER}) WHERE e > s),
    m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c)"""
_SNAP = """WITH x AS (SELECT driver_id, snapshot_date, full_name, license_number, rating, total_trips,
        row_number() OVER (PARTITION BY driver_id, snapshot_date ORDER BY loaded_at DESC, full_name DESC, license_number DESC, rating DESC, total_trips DESC) AS rn FROM driver_snapshots),
    y AS (SELECT driver_id, snapshot_date, trim(regexp_replace(full_name, '\\s+', ' ', 'g')) AS sp, license_number AS li, round(rating, 2) AS ra, total_trips FROM x WHERE rn = 1),
    f AS (SELECT *, lower(sp) AS own,
        last_value(lower(sp) IGNORE NULLS) OVER w AS nm, last_value(li IGNORE NULLS) OVER w AS lic, last_value(ra IGNORE NULLS) OVER w AS rat FROM y
        WINDOW w AS (PARTITION BY driver_id ORDER BY snapshot_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    g AS (SELECT *, row_number() OVER v AS no, lag(nm) OVER v AS pn, lag(lic) OVER v AS pl, lag(rat) OVER v AS pr FROM f WINDOW v AS (PARTITION BY driver_id ORDER BY snapshot_date)),
    s AS (SELECT *, last_value(CASE WHEN own IS NOT NULL AND own IS DISTINCT FROM pn THEN sp END IGNORE NULLS) OVER
        (PARTITION BY driver_id ORDER BY snapshot_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spelled FROM g),
    h AS (SELECT * FROM s WHERE no = 1 OR nm IS DISTINCT FROM pn OR lic IS DISTINCT FROM pl OR rat IS DISTINCT FROM pr)"""

SQL = {
    "p4_found": f"SELECT DISTINCT driver_id, period_start FROM ({_HOURS}) WHERE p >= (period_start + 3900) * 1000000 AND p < (period_start + 25200) * 1000000",
    "p4_driver_hours": f"""SELECT driver_id, period_start, count(*) FILTER (WHERE p < (period_start + 3900) * 1000000) AS n_published,
        count(*) FILTER (WHERE p < (period_start + 25200) * 1000000) AS n_corrected, count(*) FILTER (WHERE p >= (period_start + 25200) * 1000000) AS n_too_late
        FROM ({_HOURS}) GROUP BY driver_id, period_start""",
    "p5_found": f"{_ISLANDS} SELECT user_id, before AS gap_start, s AS gap_end FROM m WHERE s > before",
    "p5_periods": f"""{_ISLANDS}, n AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e) AS no FROM m)
        SELECT user_id, min(s) AS period_start, CASE WHEN max(e) < 4611686018427387904 THEN max(e) END AS period_end FROM n GROUP BY user_id, no""",
    "p6_found": """WITH p AS (SELECT DISTINCT id, driver_id, latitude AS la, longitude AS lo, epoch_us(recorded_at) AS us FROM driver_locations
            WHERE id IS NOT NULL AND recorded_at IS NOT NULL AND abs(latitude) <= 90 AND abs(longitude) <= 180 AND NOT (latitude = 0 AND longitude = 0)),
        b AS (SELECT *, us // 10000000 AS k FROM p), n AS (SELECT *, k + unnest([-1, 0, 1]) AS kk FROM b)
        SELECT DISTINCT b.id AS id_a, n.id AS id_b FROM b JOIN n ON b.k = n.kk
        WHERE b.id < n.id AND b.driver_id <> n.driver_id AND abs(b.us - n.us) <= 10000000
        AND 2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(n.la - b.la) / 2), 2) + cos(radians(b.la)) * cos(radians(n.la)) * pow(sin(radians(n.lo - b.lo) / 2), 2)))) <= 25.0""",
    "p6_zones": """SELECT p.event_id, p.zone_id, min(z.zone_id) AS found_zone_id, min(z.zone_id) IS NOT DISTINCT FROM p.zone_id AS agrees
        FROM (SELECT DISTINCT event_id, latitude, longitude, zone_id FROM processed_locations) p
        LEFT JOIN dim_zones z ON p.latitude BETWEEN z.lat_min AND z.lat_max AND p.longitude BETWEEN z.lon_min AND z.lon_max AND abs(p.latitude) <= 90 AND abs(p.longitude) <= 180 AND NOT (p.latitude = 0 AND p.longitude = 0)
        GROUP BY p.event_id, p.latitude, p.longitude, p.zone_id""",
    "p7_found": f"{_SNAP} SELECT driver_id, strftime(snapshot_date, '%Y-%m-%d') AS valid_from FROM h",
    "p7_history": f"""{_SNAP}, e AS (SELECT *, lead(snapshot_date) OVER (PARTITION BY driver_id ORDER BY snapshot_date) AS nxt FROM h)
        SELECT driver_id, spelled AS full_name, lic AS license_number, rat AS rating, total_trips, CAST(epoch(snapshot_date) AS BIGINT) AS valid_from, CAST(epoch(nxt) AS BIGINT) AS valid_to, CAST(nxt IS NULL AS INTEGER) AS is_current FROM e""",
}
