"""Points near points and points in regions, by a grid of cells.

Latitude is cut into rows, each row into cells of about the same width in metres, time (if any) into buckets.
A point belongs to the cell it lies in and is copied to those neighbouring cells that its radius (and time
reach) touches; the join is by cell, and the exact great-circle distance decides. A pair is found once, in the cell
of its point with the lower id. Cells are several radii wide, so most points are copied nowhere.

A crowded cell is salted: the points lying in it are dealt over parts, the copies visiting it go to all parts.
Nothing is dropped, and no cell is one task.

Defined results: positions that are no place (see geo.is_place) and rows with a null id or time take no part;
rows sharing an id are one record; cells wrap at the date line; empty input gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rideloom.common import need
from rideloom.functions.geo import EARTH_M, haversine, is_place

#: Cell width in radii and in time reaches.
CELL_RADII, CELL_REACHES = 8.0, 6.0
#: Points lying in one cell from which on the cell is dealt over parts of so many points.
CROWD = 2000
#: A list of crowded cells up to this length goes to every executor; a longer one is joined by a shuffle.
MOST_CROWDED = 10_000
METRES_A_DEGREE = EARTH_M * math.pi / 180


def _row(lat: Column, step: float) -> Column:
    return F.floor((lat + 90.0) / F.lit(step)).cast("long")


def _cells_in_row(row: Column, step: float) -> Column:
    """How many cells a row has, from its edge nearer to a pole: cells there are at least as wide as asked for."""
    edge = F.least(F.greatest(F.abs(row * step - 90.0), F.abs((row + 1) * step - 90.0)), F.lit(90.0))
    return F.greatest(F.lit(1), F.floor(F.lit(360.0 / step) * F.cos(F.radians(edge)))).cast("long")


def _home(lat: Column, lon: Column, step: float) -> tuple[Column, Column]:
    row = _row(lat, step)
    n = _cells_in_row(row, step)
    return row, F.pmod(F.floor((lon + 180.0) / 360.0 * n).cast("long"), n)


def _reached(lat: Column, lon: Column, step: float, radius_deg: float) -> Column:
    """Array of (row, col) touched by a circle: for each row in reach the columns its width there spans."""
    rows = F.sequence(_row(F.greatest(lat - radius_deg, F.lit(-90.0)), step), _row(F.least(lat + radius_deg, F.lit(90.0)), step))
    # Half width in longitude anywhere within the circle, exact bound: asin(sin r / cos lat).
    ratio = F.sin(F.radians(F.lit(radius_deg))) / F.greatest(F.cos(F.radians(lat)), F.lit(1e-12))
    half = F.when(ratio >= 1, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * 1.0000001 + 1e-9)

    def in_row(r: Column) -> Column:
        n = _cells_in_row(r, step)
        lo, hi = F.floor((lon - half + 180.0) / 360.0 * n).cast("long"), F.floor((lon + half + 180.0) / 360.0 * n).cast("long")
        cols = F.transform(F.sequence(lo, F.least(hi, lo + n - 1)), lambda c: F.struct(r.alias("row"), F.pmod(c, n).alias("col")))
        return cols

    return F.flatten(F.transform(rows, in_row))


def near_pairs(points: DataFrame, *, id_col: str, lat: str, lon: str, radius_m: float, group: str | None = None, ts: str | None = None, reach_s: float | None = None, crowd: int = CROWD) -> DataFrame:
    """(id_a, id_b, distance_m): pairs at most radius_m (and reach_s) apart, id_a < id_b, of different groups if a group is given."""
    cols = [id_col, lat, lon] + [c for c in (group, ts) if c]
    p = need(points, *cols).select(F.col(id_col).alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"), (F.col(group) if group else F.lit(None).cast("string")).alias("grp"), (F.unix_micros(F.col(ts).cast("timestamp")) if ts else F.lit(0).cast("long")).alias("us"))
    p = p.where(is_place(F.col("lat"), F.col("lon")) & F.col("id").isNotNull() & F.col("us").isNotNull())
    if group:
        p = p.where(F.col("grp").isNotNull()).withColumn("grp", _short_key(p, "grp"))
    p = p.withColumn("id", _packed(F.col("id").cast("string")))
    radius_deg = radius_m / METRES_A_DEGREE
    step = radius_deg * CELL_RADII
    reach_us = int((reach_s or 0) * 1_000_000)
    bucket = max(1, int(reach_us * CELL_REACHES))
    at = lambda us: F.floor(us / bucket).cast("long")
    home_row, home_col = _home(F.col("lat"), F.col("lon"), step)
    home_bucket = at(F.col("us")) if ts else F.lit(0).cast("long")
    p = p.withColumn("home", F.xxhash64(home_row, home_col, home_bucket))
    # The key of a cell is a hash: cells that share one by chance only bring candidates the exact tests turn away.
    counts = p.groupBy("home").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd)
    crowded = counts.select(F.col("home").alias("cell"), F.ceil(F.col("n") / crowd).cast("int").alias("parts"))
    some = crowded.limit(MOST_CROWDED + 1).count()
    home = p.withColumn("cell", F.col("home"))
    buckets = F.sequence(at(F.col("us") - reach_us), at(F.col("us") + reach_us)) if ts else F.array(F.lit(0).cast("long"))
    touched = F.flatten(F.transform(_reached(F.col("lat"), F.col("lon"), step, radius_deg), lambda c: F.transform(buckets, lambda b: F.xxhash64(c["row"], c["col"], b))))
    visit = p.withColumn("cell", F.explode(F.array_distinct(touched)))
    if some:
        crowded = F.broadcast(crowded) if some <= MOST_CROWDED else crowded
        parts = F.coalesce("parts", F.lit(1))
        home = home.join(crowded, "cell", "left").withColumn("cell", F.xxhash64("cell", F.pmod(F.xxhash64("id"), parts)))
        visit = visit.join(crowded, "cell", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), (parts - 1).cast("long")))).withColumn("cell", F.xxhash64("cell", "part"))
    a = home.select("cell", F.col("id").alias("id_a"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), F.col("grp").alias("grp_a"), F.col("us").alias("us_a"))
    b = visit.select("cell", F.col("id").alias("id_b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"), F.col("grp").alias("grp_b"), F.col("us").alias("us_b"))
    # A cheap box test first, then the exact distance.
    on = (F.col("id_a") < F.col("id_b")) & (F.abs(F.col("us_a") - F.col("us_b")) <= reach_us) & (F.abs(F.col("lat_a") - F.col("lat_b")) <= radius_deg * 1.000001)
    if group:
        on = on & (F.col("grp_a") != F.col("grp_b"))
    pairs = a.hint("merge").join(b, "cell").where(on)
    pairs = pairs.withColumn("m", haversine(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))).where(F.col("m") <= radius_m)
    pairs = pairs.groupBy("id_a", "id_b").agg(F.min("m").alias("distance_m"))
    x, y = _unpacked(F.col("id_a")), _unpacked(F.col("id_b"))
    return pairs.select(F.least(x, y).alias("id_a"), F.greatest(x, y).alias("id_b"), "distance_m")


_UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def _packed(text: Column) -> Column:
    """Bytes of a text, reversibly: half a byte a sign for lower-case UUIDs, which halves what is shuffled."""
    return F.when(text.rlike(_UUID), F.concat(F.unhex(F.lit("01")), F.unhex(F.translate(text, "-", "")))).otherwise(F.concat(F.unhex(F.lit("02")), F.encode(text, "utf-8")))


def _unpacked(packed: Column) -> Column:
    body = F.substring(packed, 2, 2**31 - 1)
    h = F.lower(F.hex(body))
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    return F.when(F.hex(F.substring(packed, 1, 1)) == "01", uuid).otherwise(F.decode(body, "utf-8"))


def _short_key(df: DataFrame, c: str) -> Column:
    """A hash that tells the values of a column apart; the column itself in the improbable case that it doesn't."""
    n = df.select(c).distinct().agg(F.count(F.lit(1)).alias("a"), F.count_distinct(F.xxhash64(c)).alias("b")).first()
    return F.xxhash64(c) if n["a"] == n["b"] else F.col(c)


def in_boxes(points: DataFrame, boxes: DataFrame, *, lat: str, lon: str, box_id: str, cell_deg: float = 0.02, most_broadcast: int = 10_000) -> DataFrame:
    """The points with found_box: the lowest id of the inclusive boxes that hold them, null if none does.

    Boxes are laid over grid cells and joined by cell. Their number is checked: up to most_broadcast cells go to
    every executor, more are shuffled by cell. Boxes with nulls or swapped bounds hold nothing.
    """
    b = need(boxes, box_id, "lat_min", "lat_max", "lon_min", "lon_max").dropna()
    cell = lambda x: F.floor(x / F.lit(cell_deg)).cast("long")
    b = b.where((F.col("lat_min") <= F.col("lat_max")) & (F.col("lon_min") <= F.col("lon_max")))
    b = b.select(F.col(box_id).alias("found_box"), "lat_min", "lat_max", "lon_min", "lon_max").withColumn("gr", F.explode(F.sequence(cell(F.col("lat_min")), cell(F.col("lat_max"))))).withColumn("gc", F.explode(F.sequence(cell(F.col("lon_min")), cell(F.col("lon_max")))))
    inside = F.struct(F.col("found_box").alias("id"), F.col("lat_min").alias("a"), F.col("lat_max").alias("b"), F.col("lon_min").alias("c"), F.col("lon_max").alias("d"))
    by_cell = b.groupBy("gr", "gc").agg(F.sort_array(F.collect_set(inside)).alias("_boxes"))
    if by_cell.limit(most_broadcast + 1).count() <= most_broadcast:
        by_cell = F.broadcast(by_cell)
    ok = is_place(F.col(lat), F.col(lon))
    p = points.withColumn("gr", F.when(ok, cell(F.col(lat)))).withColumn("gc", F.when(ok, cell(F.col(lon))))
    p = p.join(by_cell, ["gr", "gc"], "left")
    hits = F.filter("_boxes", lambda x: (F.col(lat) >= x["a"]) & (F.col(lat) <= x["b"]) & (F.col(lon) >= x["c"]) & (F.col(lon) <= x["d"]))
    return p.withColumn("found_box", F.try_element_at(hits, F.lit(1))["id"]).drop("gr", "gc", "_boxes")


def in_polygon(lat: Column, lon: Column, ring: Column) -> Column:
    """Ray casting over an array of struct(lat, lon); fewer than three corners hold nothing."""
    n = F.size(ring)
    pairs = F.zip_with(ring, F.concat(F.slice(ring, n, 1), F.slice(ring, 1, F.greatest(n - 1, F.lit(0)))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        straddles = (a["lon"] > lon) != (b["lon"] > lon)
        return straddles & (lat < (b["lat"] - a["lat"]) * (lon - a["lon"]) / F.nullif(b["lon"] - a["lon"], F.lit(0.0)) + a["lat"])

    odd = F.aggregate(pairs, F.lit(False), lambda acc, e: acc != F.coalesce(crosses(e), F.lit(False)))
    return F.when(n < 3, F.lit(False)).otherwise(odd)
