"""Stops and trips from location pings, with SQL windows only.

Pings of a device are cut into sessions at long silences (no stop crosses one), so a busy device is many
independent groups and never one task. Within a session: rolling medians give a displacement speed, hysteresis
on it marks standing stretches (gaps and islands), each stretch's median is its place, and a stop is the
longest run of pings within the radius of a place that contains no more than the allowed strays in a row.
Neighbouring stretches at one place are merged; trips are what lies between consecutive stops.

Defined results: repeated rows and pings sent again for the same moment and position count once; pings without
device or time are ignored; a position that is no place (see geo.is_place) is a stray; empty input gives no rows;
other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rideloom.common import mark_hot, need, tasks_for, time_slice
from rideloom.functions.geo import haversine, is_place

RADIUS_M = 100.0
LEAST_STOP_S = 360
LONGEST_SILENCE_S = 1800
MOST_STRAYS = 2
#: Rolling medians look this far to either side; standing begins under the first displacement and ends over the second.
LOOK_S, ENTER_M, LEAVE_M = 120, 45.0, 90.0
#: A position this far from the median of the fifteen around it is left out of distances.
GROSS_M = 20_000.0
SLICE_HOURS = 24


def _middle(s: Column) -> Column:
    """The median of a sorted array, null of an empty one."""
    n = F.size(s)
    return F.when(n > 0, (F.try_element_at(s, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(s, F.floor(n / 2).cast("int") + 1)) / 2)


def _median(a: Column) -> Column:
    return _middle(F.sort_array(a))  # array_sort would compare by an interpreted function


def sessions(pings: DataFrame, silence_s: float = LONGEST_SILENCE_S, hot_part: float | None = None, hot_least: int | None = None) -> DataFrame:
    """Distinct pings with their session number per device; a session ends at a silence longer than silence_s.

    Devices that hold a large part of all rows are numbered in time slices: the last moment and the number of
    sessions of earlier slices are carried over, so the numbers are the same as without slices.
    """
    p = need(pings, "driver_id", "latitude", "longitude", "recorded_at").where(F.col("driver_id").isNotNull() & F.col("recorded_at").isNotNull())
    p = p.select("driver_id", "latitude", "longitude", F.unix_micros(F.col("recorded_at").cast("timestamp")).alias("us"), F.col("recorded_at").cast("timestamp").alias("ts"))
    limits = {k: v for k, v in (("part", hot_part), ("least", hot_least)) if v is not None}
    p, hot = mark_hot(p, "driver_id", "hot", **limits)
    p = p.withColumn("slice", F.when(F.col("hot"), time_slice(F.col("ts"), SLICE_HOURS)).otherwise(F.lit(0).cast("long"))).drop("ts")
    order = Window.partitionBy("driver_id", "slice").orderBy("us", "latitude", "longitude")
    same = (F.col("us") == F.lag("us").over(order)) & F.lag("latitude").over(order).eqNullSafe(F.col("latitude")) & F.lag("longitude").over(order).eqNullSafe(F.col("longitude"))
    p = p.withColumn("again", F.coalesce(same, F.lit(False))).where(~F.col("again")).drop("again")
    p = p.withColumn("before", F.lag("us").over(order))
    far = F.col("us") - F.col("before") > F.lit(silence_s * 1_000_000)
    if not hot:
        return p.withColumn("session", F.sum(F.coalesce(far, F.lit(False)).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("slice", "before", "hot")
    slices = p.where("hot").groupBy("driver_id", "slice").agg(F.min("us").alias("first"), F.max("us").alias("last"), F.sum(F.coalesce(far, F.lit(False)).cast("long")).alias("inner"))
    over = Window.partitionBy("driver_id").orderBy("slice")
    opens = F.coalesce(F.col("first") - F.lag("last").over(over) > F.lit(silence_s * 1_000_000), F.lit(False)).cast("long")
    slices = slices.withColumn("opens", opens).withColumn("base", F.sum(F.col("opens") + F.col("inner")).over(over.rowsBetween(Window.unboundedPreceding, 0)) - F.col("inner"))
    p = p.join(slices.select("driver_id", "slice", "base"), ["driver_id", "slice"], "left")
    within = F.sum(F.coalesce(far, F.lit(False)).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return p.withColumn("session", within + F.coalesce("base", F.lit(0).cast("long"))).drop("slice", "before", "base", "hot")


#: Moving pings farther than this many radii from the places before and after them can join neither and are left out.
REACH_RADII = 3


def stops(pings: DataFrame, radius_m: float = RADIUS_M, least_s: int = LEAST_STOP_S, silence_s: float = LONGEST_SILENCE_S, most_strays: int = MOST_STRAYS, **options) -> DataFrame:
    """(driver_id, session, stop_no, start_us, end_us, latitude, longitude, pings) of each stop.

    Rows are numbered once; what is far from every place then drops out, and strays are counted by the numbers that
    are missing. Windows are written so that consecutive ones need the same sort.
    """
    return _stops(sessions(pings, silence_s, **options).repartition(tasks_for(pings), *GROUP), radius_m, least_s, most_strays)


GROUP = ["driver_id", "session"]
_BEFORE, _UPTO, _ALL = (Window.unboundedPreceding, -1), (Window.unboundedPreceding, 0), (Window.unboundedPreceding, Window.unboundedFollowing)


def _part():
    return Window.partitionBy(*GROUP)


def _stops(s: DataFrame, radius_m: float, least_s: int, most_strays: int) -> DataFrame:
    order = _part().orderBy("us", "latitude", "longitude")
    good = is_place(F.col("latitude"), F.col("longitude"))
    place = F.when(good, F.struct(F.col("latitude").alias("lat"), F.col("longitude").alias("lon")))
    by_time = _part().orderBy("us")
    back, ahead = by_time.rangeBetween(-LOOK_S * 1_000_000, 0), by_time.rangeBetween(0, LOOK_S * 1_000_000)
    s = s.withColumns({"n": F.row_number().over(order), "b": F.collect_list(place).over(back), "a": F.collect_list(place).over(ahead)})
    # Each step its own projection, so that every array is sorted once.
    base = [*GROUP, "n", "us", "latitude", "longitude"]
    s = s.select(*base, *[F.sort_array(F.col(f"{w}.{c}")).alias(f"{c}_{w}") for w in "ba" for c in ("lat", "lon")])
    s = s.select(*base, *[_middle(F.col(f"{c}_{w}")).alias(f"{c}_{w}") for w in "ba" for c in ("lat", "lon")])
    s = s.select(*base, haversine(F.col("lat_b"), F.col("lon_b"), F.col("lat_a"), F.col("lon_a")).alias("moved"))
    # Hysteresis: the last clear sign decides.
    sign = F.when(F.col("moved") <= ENTER_M, 1).when(F.col("moved") >= LEAVE_M, 0)
    s = s.withColumns({"still": F.last(sign, ignorenulls=True).over(order.rowsBetween(*_UPTO)), "was": F.last(sign, ignorenulls=True).over(order.rowsBetween(*_BEFORE))})
    edge = (F.coalesce("still", F.lit(0)) != F.coalesce("was", F.lit(0))).cast("int")
    s = s.withColumn("seg", F.sum(edge).over(order.rowsBetween(*_UPTO)))
    s = s.select(*GROUP, "n", "us", F.when(good, F.col("latitude")).alias("lat"), F.when(good, F.col("longitude")).alias("lon"), "seg", (F.col("still") == 1).alias("own"))
    s = _placed(s, F.coalesce("own", F.lit(False)))
    # Strays that agree among themselves look like a stretch of their own; what no more pings than strays are at is none.
    there = F.coalesce(haversine(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon")) <= radius_m, F.lit(False)).cast("int")
    s = s.withColumn("there", F.sum(there).over(_island()))
    own = F.coalesce(F.col("own") & (F.col("there") > most_strays), F.lit(False))
    s = s.select(*GROUP, "n", "us", "lat", "lon", "seg", F.when(own, F.struct(F.col("seg").alias("no"), "clat", "clon")).alias("own"))
    s = s.withColumn("prev", F.last("own", ignorenulls=True).over(_ahead().rowsBetween(*_BEFORE)))
    s = s.withColumn("next", F.last("own", ignorenulls=True).over(_back().rowsBetween(*_BEFORE)))
    s = s.where(F.col("own").isNotNull() | _near("prev", REACH_RADII * radius_m) | _near("next", REACH_RADII * radius_m)).drop("prev", "next")
    # Stretches at one place with few strays between them are one: compare with the place before.
    for _ in range(2):
        s = _merged(s, radius_m, most_strays)
    s = _grown(s, radius_m, most_strays)
    # The place again from the pings now known to be at it, then the final runs.
    s = _placed(s.withColumn("seg", F.col("to.no")).drop("to"), F.col("is_in") & F.col("seg").isNotNull())
    s = s.select(*GROUP, "n", "us", "lat", "lon", "seg", F.when(F.col("seg").isNotNull() & F.col("clat").isNotNull(), F.struct(F.col("seg").alias("no"), "clat", "clon")).alias("own"))
    s = _grown(s, radius_m, most_strays, monotone=False)
    s = s.where("is_in").select(*GROUP, "n", "us", "to")
    # Runs within one place: more than the allowed strays in a row, the place's own included, break it.
    mine = Window.partitionBy(*GROUP, "to.no").orderBy("n")
    s = s.withColumn("cut", F.coalesce(F.col("n") - F.lag("n").over(mine) - 1 > most_strays, F.lit(False)).cast("int"))
    s = s.withColumn("run", F.sum("cut").over(mine.rowsBetween(*_UPTO)))
    found = s.groupBy(*GROUP, F.col("to.no").alias("stop_no"), "run").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.first("to.clat").alias("latitude"), F.first("to.clon").alias("longitude"), F.count(F.lit(1)).alias("pings"))
    return found.where(F.col("end_us") - F.col("start_us") >= least_s * 1_000_000).drop("run")


# Segments are numbered in the order of rows, so all of these but the last need the same sort.
def _island():
    return Window.partitionBy(*GROUP, "seg").orderBy("n").rowsBetween(*_ALL)


def _ahead():
    return _part().orderBy("seg", "n")


def _back():
    return _part().orderBy(F.desc("n"))


def _near(place: str, radius_m: float) -> Column:
    return F.coalesce(haversine(F.col("lat"), F.col("lon"), F.col(f"{place}.clat"), F.col(f"{place}.clon")) <= radius_m, F.lit(False))


def _placed(s: DataFrame, members: Column) -> DataFrame:
    """clat and clon: the medians of a segment's members, null for segments without."""
    s = s.withColumn("at", members)
    return s.withColumns({c: F.percentile_approx(F.when(F.col("at"), F.col(x)), F.lit(0.5), F.lit(1000)).over(_island()) for c, x in (("clat", "lat"), ("clon", "lon"))}).drop("at")


def _merged(s: DataFrame, radius_m: float, most_strays: int) -> DataFrame:
    """Segments (a stretch and what follows it until the next) anew: stretches at the place of the one before, with no more than the strays between, become one."""
    order = _ahead()
    s = s.withColumn("last_place", F.last("own", ignorenulls=True).over(order.rowsBetween(*_BEFORE)))
    s = s.withColumn("at", F.when(F.col("own").isNotNull() | _near("last_place", radius_m), F.col("n")))
    s = s.withColumn("last_at", F.last("at", ignorenulls=True).over(order.rowsBetween(*_BEFORE)))
    s = s.withColumn("broken", F.sum(F.coalesce(F.col("at") - F.col("last_at") - 1 > most_strays, F.lit(False)).cast("int")).over(order.rowsBetween(*_UPTO)))
    s = s.withColumn("broken_then", F.last(F.when(F.col("own").isNotNull(), F.col("broken")), ignorenulls=True).over(order.rowsBetween(*_BEFORE)))
    starts = F.col("own").isNotNull() & (F.col("last_place").isNull() | (F.col("last_place.no") != F.col("own.no")))
    near = haversine(F.col("own.clat"), F.col("own.clon"), F.col("last_place.clat"), F.col("last_place.clon")) <= radius_m / 2
    fresh = starts & ~F.coalesce(near & (F.col("broken") == F.col("broken_then")), F.lit(False))
    s = s.withColumn("seg2", F.sum(fresh.cast("int")).over(order.rowsBetween(*_UPTO)))
    s = _placed(s.select(*GROUP, "n", "us", "lat", "lon", F.col("seg2").alias("seg"), F.col("own").isNotNull().alias("own")), F.col("own"))
    return s.select(*GROUP, "n", "us", "lat", "lon", "seg", F.when(F.col("own"), F.struct(F.col("seg").alias("no"), "clat", "clon")).alias("own"))


def _grown(s: DataFrame, radius_m: float, most_strays: int, monotone: bool = True) -> DataFrame:
    """Pings between stretches join the one before or after as long as no more than the strays lie in between.

    Sets to (the place a ping belongs to, null for none) and is_in (within its radius).
    """
    s = s.withColumn("at_own", F.when(F.col("own").isNotNull(), _near("own", radius_m)))
    # Seen from a place: own pings by their own place, others by the place before (after); breaks count strays in a row.
    for name, w in (("prev", _ahead() if monotone else _part().orderBy("n")), ("next", _back())):
        before, upto = w.rowsBetween(*_BEFORE), w.rowsBetween(*_UPTO)
        s = s.withColumn(name, F.last("own", ignorenulls=True).over(before))
        s = s.withColumn("in", F.when(F.coalesce(F.col("at_own"), _near(name, radius_m)), F.col("n")))
        s = s.withColumn("last_in", F.last("in", ignorenulls=True).over(before))
        s = s.withColumn("breaks", F.sum(F.coalesce(F.abs(F.col("in") - F.col("last_in")) - 1 > most_strays, F.lit(False)).cast("int")).over(upto))
        s = s.withColumn("then", F.last(F.when(F.col("at_own"), F.col("breaks")), ignorenulls=True).over(before))
        joins = F.col("own").isNull() & F.col("in").isNotNull() & (F.col("breaks") == F.col("then"))
        s = s.withColumn(name, F.when(joins, F.col(name))).drop("in", "last_in", "breaks", "then")
    s = s.withColumn("to", F.coalesce("own", "prev", "next"))
    return s.select(*GROUP, "n", "us", "lat", "lon", "to", F.coalesce("at_own", F.col("to").isNotNull()).alias("is_in"))


def stops_and_trips(pings: DataFrame, **options) -> DataFrame:
    """(driver_id, kind, start_s, end_s, duration_s, distance_m, pings): stops, and trips between consecutive stops.

    A trip's distance is the sum over its pings of the distance to the ping before, both moved to the rolling median
    of five pings, so that up to two strays in a row add nothing. A stop's distance is 0.
    """
    s = sessions(pings, options.get("silence_s", LONGEST_SILENCE_S), **{k: v for k, v in options.items() if k.startswith("hot_")})
    found = stops(pings, **options)
    ends = found.select("driver_id", "session", F.col("start_us").alias("us"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.struct("start_us", "end_us").alias("stop"))
    good = is_place(F.col("latitude"), F.col("longitude"))
    rows = s.where(good).select("driver_id", "session", "us", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.lit(None).cast("struct<start_us:bigint,end_us:bigint>").alias("stop"))
    order = Window.partitionBy("driver_id", "session").orderBy("us", F.col("stop").isNull(), "lat", "lon")
    r = rows.unionByName(ends)
    r = r.withColumn("here", F.last("stop", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    r = r.where(F.col("stop").isNull())
    r = r.withColumn("in_stop", F.coalesce((F.col("us") >= F.col("here.start_us")) & (F.col("us") <= F.col("here.end_us")), F.lit(False)))
    # Gross strays first (more can follow each other than five pings outvote), then the small ones by the median of five.
    order = Window.partitionBy("driver_id", "session").orderBy("us", "lat", "lon")
    wide = order.rowsBetween(-7, 7)
    off = haversine(F.col("lat"), F.col("lon"), _median(F.collect_list("lat").over(wide)), _median(F.collect_list("lon").over(wide)))
    r = r.withColumn("off", off).where(F.col("off") <= GROSS_M).drop("off")
    five = order.rowsBetween(-2, 2)
    r = r.withColumn("mlat", _median(F.collect_list("lat").over(five))).withColumn("mlon", _median(F.collect_list("lon").over(five)))
    step = haversine(F.lag("mlat").over(order), F.lag("mlon").over(order), F.col("mlat"), F.col("mlon"))
    r = r.withColumn("step", F.coalesce(step, F.lit(0.0)))
    leg = F.col("here.start_us")
    out = r.groupBy("driver_id", "session", leg.alias("leg"), "in_stop").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.sum(F.when(F.col("in_stop"), F.lit(0.0)).otherwise(F.col("step"))).alias("distance_m"), F.count(F.lit(1)).alias("pings"))
    sec = lambda c: F.floor(F.col(c) / 1_000_000).cast("long")
    return out.select("driver_id", F.when(F.col("in_stop"), "stop").otherwise("trip").alias("kind"), sec("start_us").alias("start_s"), sec("end_us").alias("end_s"), (sec("end_us") - sec("start_us")).alias("duration_s"), F.round("distance_m", 1).alias("distance_m"), "pings")
