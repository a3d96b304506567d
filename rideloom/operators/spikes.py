"""Implausible readings: Hampel filter per source, run lengths of stuck values, physical bounds.

One shuffle brings each device's readings together; every window of the operator uses that partitioning.
A device that holds a large part of all rows is split into time slices; runs of equal values are joined again over
the slice edges, and windows reach over them by the nearest rows of the slices before and after, so a split changes
no result.

Defined results: null is never a case; NaN always is; rows sharing an id are one record (the first by time);
a null device or time forms no series, so only the physical bounds apply; empty input gives no rows;
other columns of the input, clashing names included, are ignored. A device with fewer readings of a field than its
least_n is held to the lower of its own and the fleet's level, since its own says little yet.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rideloom.common import mark_hot, need, time_slice, written


@dataclass(frozen=True)
class Field:
    """One measurement. All limits are parameters of the operator, not of the data's size."""

    name: str
    low: float | None = None  # physical bounds; a reading outside is impossible
    high: float | None = None
    low_open: bool = False  # the lower bound itself is impossible too
    above: float | None = None  # a reading more than this times the device's normal level is a candidate
    normal: float = 0.5  # quantile of the device's readings that counts as its normal level
    by_context: bool = False  # the normal level is per device and context (e.g. location source)
    moving_over: float | None = None  # only readings above this count as moving and can be far off or stuck
    moving_field: str | None = None  # the field that tells whether the device moves, if not this one
    stuck: bool = True
    least_n: int = 30  # with fewer readings the level of the whole fleet limits the device's own


#: Rows to either side in which a missing reading of the moving field is looked up.
LOOK_ROWS = 3
#: Hampel filter: half width of the rolling window in rows, factor, least spread as part of the rolling median.
HALF, FACTOR, LEAST_SPREAD = 10, 2.5, 0.25
#: Readings in a row that make a stuck stretch; share of repeats elsewhere at which a device reports so coarsely that it can't be told.
STUCK_RUN, COARSE = 10, 0.35
SLICE_HOURS = 24
MAD_TO_SIGMA = 1.4826


def _median(a: Column) -> Column:
    """Of a non-empty array; sort_array, since array_sort compares by an interpreted function."""
    s, n = F.sort_array(a), F.size(a)
    return (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2).cast("int") + 1)) / 2


def _impossible(f: Field, v: Column) -> Column:
    bad = F.isnan(v)
    if f.low is not None:
        bad = bad | (v <= f.low if f.low_open else v < f.low)
    if f.high is not None:
        bad = bad | (v > f.high)
    return F.coalesce(v.isNotNull() & bad, F.lit(False))


def _judged(f: Field, v: Column) -> Column:
    """Whether the reading can enter a level: possible and, where that matters, moving."""
    ok = v.isNotNull() & ~_impossible(f, v)
    return ok & (v > f.moving_over) if f.moving_over is not None and f.moving_field is None else ok


def _order(*more: str):
    return Window.partitionBy("_dev", "_slice", *more).orderBy("_ts", "_id")


def _distinct(raw: DataFrame) -> DataFrame:
    """Rows sharing an id once."""
    rows = raw.withColumn("_before", F.lag("_id").over(_order()))
    return rows.where(F.col("_before").isNull() | (F.col("_id") != F.col("_before")) | F.col("_id").isNull()).drop("_before")


def _context(ctx: Column) -> Column:
    """A map key that tells null and empty contexts apart."""
    return F.coalesce(F.concat(F.lit("="), ctx), F.lit(""))


def _around_slices(rows: DataFrame, value: Column, name: str, many: int, by_context: bool = False) -> DataFrame:
    """(_dev, _slice, <name>: before, after): values of the last `many` rows of earlier slices and the first of later ones.

    Values are null where a row has none. With by_context a map from each context to its own such rows. Each slice
    there is holds a row at least, so `many` slices to either side are enough, however thin they are.
    """
    more = ["_ctx"] if by_context else []
    x = rows.select("_dev", "_slice", *more, value.alias("v"), F.row_number().over(_order(*more)).alias("p"), F.count(F.lit(1)).over(Window.partitionBy("_dev", "_slice", *more)).alias("m"))
    pick = lambda where: F.sort_array(F.collect_list(F.when(where, F.struct("p", "v"))))["v"]
    x = x.where((F.col("p") <= many) | (F.col("p") > F.col("m") - many)).groupBy("_dev", "_slice", *more).agg(pick(F.col("p") <= many).alias("head"), pick(F.col("p") > F.col("m") - many).alias("tail"))
    over = Window.partitionBy("_dev", *more).orderBy("_slice")
    before, after = F.flatten(F.collect_list("tail").over(over.rowsBetween(-many, -1))), F.flatten(F.collect_list("head").over(over.rowsBetween(1, many)))
    x = x.select("_dev", "_slice", *more, before.alias("b"), after.alias("a"))
    x = x.withColumn(name, F.struct(F.slice("b", F.greatest(F.size("b") - many, F.lit(0)) + 1, many).alias("before"), F.slice("a", 1, many).alias("after")))
    if by_context:
        x = x.groupBy("_dev", "_slice").agg(F.map_from_entries(F.collect_list(F.struct(_context(F.col("_ctx")), F.col(name)))).alias(name))
    return x.select("_dev", "_slice", name)


def _with_runs(raw: DataFrame, fields: list[Field], hot: Column | None) -> DataFrame:
    """Distinct readings with, per field that can be stuck, whether it is active, its run number and the run's length.

    Windows of one device and slice: a single shuffle and sort serves all of them. hot marks rows of split devices.
    """
    order, rows = _order(), _distinct(raw)
    movers = {f.moving_field: next(m for m in fields if m.name == f.moving_field) for f in fields if f.moving_field}
    if movers:
        seen = {n: F.when(_judged(Field(n, m.low, m.high, m.low_open), F.col(n)), F.col(n)) for n, m in movers.items()}
        beyond = {}
        if hot is not None:
            for n in movers:
                beyond[n] = f"_{n}_beyond"
                rows = rows.join(_around_slices(_distinct(raw.where(hot)), seen[n], beyond[n], LOOK_ROWS), ["_dev", "_slice"], "left")
            rows = rows.withColumns({"_p": F.row_number().over(order), "_m": F.count(F.lit(1)).over(Window.partitionBy("_dev", "_slice"))})
        rows = rows.withColumns({f"_{n}_seen": seen[n] for n in movers})

        def step(n: str, back: bool, i: int) -> Column:
            inside = (F.lag if back else F.lead)(f"_{n}_seen", i).over(order)
            if hot is None:
                return inside
            if back:  # i rows back are i - p + 1 rows before the slice
                far = F.reverse(F.col(beyond[n])["before"])
                return F.when(F.col("_p") > i, inside).otherwise(F.try_element_at(far, (i - F.col("_p") + 1).cast("int")))
            over = F.col("_p") + i - F.col("_m")
            return F.when(over <= 0, inside).otherwise(F.try_element_at(F.col(beyond[n])["after"], over.cast("int")))

        around = lambda n, back: F.coalesce(*[step(n, back, i) for i in range(1, LOOK_ROWS + 1)])
        rows = rows.withColumns({f"_{n}_near": F.coalesce(f"_{n}_seen", F.least(around(n, True), around(n, False))) for n in movers})
        rows = rows.drop("_p", "_m", *beyond.values())

    def active(f: Field) -> Column:
        v = F.col(f.name)
        ok = v.isNotNull() & ~F.isnan(v) & F.col("_dev").isNotNull() & F.col("_ts").isNotNull()
        if f.moving_over is not None:
            ok = ok & ((F.col(f"_{f.moving_field}_near") if f.moving_field else v) > f.moving_over)
        return F.coalesce(ok, F.lit(False))

    stuck = [f for f in fields if f.stuck]
    so_far, until = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"{f.name}_act": active(f) for f in stuck})
    rows = rows.withColumns({f"{f.name}_prev": F.last(F.when(F.col(f"{f.name}_act"), F.col(f.name)), ignorenulls=True).over(so_far) for f in stuck})
    changed = lambda f: F.col(f"{f.name}_act") & (F.col(f"{f.name}_prev").isNull() | (F.col(f.name) != F.col(f"{f.name}_prev")))
    rows = rows.withColumns({f"{f.name}_run": F.sum(changed(f).cast("int")).over(until) for f in stuck})
    return rows.withColumns({f"{f.name}_len": F.sum(F.col(f"{f.name}_act").cast("int")).over(Window.partitionBy("_dev", "_slice", f"{f.name}_run")) for f in stuck})


def _short(f: Field) -> Column:
    return (F.col(f"{f.name}_act") & (F.col(f"{f.name}_len") < STUCK_RUN)).cast("int")


def _same(f: Field) -> Column:
    return _short(f) * F.coalesce((F.col(f"{f.name}_prev") == F.col(f.name)).cast("int"), F.lit(0))


def _over_slices(rows: DataFrame, stuck: list[Field]) -> DataFrame:
    """(_dev, _slice, per field: short, same of the whole device, longer: run number to whole length) of split devices.

    Each slice adds its first and last run; equal ones at an edge are one run. Only these leave the slices.
    """
    aggs = []
    for f in stuck:
        n, run = f.name, F.col(f"{f.name}_run")
        key, end = F.when(F.col(f"{n}_act"), F.struct("_ts", "_id")), F.struct(F.col(n).alias("v"), F.col(f"{n}_len").alias("len"), run.alias("run"))
        aggs += [F.sum(_short(f)).alias(f"{n}_short"), F.sum(_same(f)).alias(f"{n}_same"), F.min_by(end, key).alias(f"{n}_head"), F.max_by(end, key).alias(f"{n}_tail")]
    s = rows.groupBy("_dev", "_slice").agg(*aggs)
    over = Window.partitionBy("_dev").orderBy("_slice")
    before, upto, device = over.rowsBetween(Window.unboundedPreceding, -1), over.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("_dev")
    s = s.withColumns({f"{f.name}_was": F.last(f"{f.name}_tail", ignorenulls=True).over(before)["v"] for f in stuck})
    inner = {f.name: F.when(F.col(f"{f.name}_head").isNull() | (F.col(f"{f.name}_head.run") == F.col(f"{f.name}_tail.run")), 0).otherwise(1) for f in stuck}
    fresh = {f.name: F.when(F.col(f"{f.name}_head").isNull(), 0).otherwise(F.coalesce((F.col(f"{f.name}_head.v") != F.col(f"{f.name}_was")).cast("int"), F.lit(1))) for f in stuck}
    s = s.withColumns({f"{n}_no": F.sum(fresh[n] + inner[n]).over(upto) for n in inner})
    ends = None
    for f in stuck:
        n = f.name
        there = s.where(F.col(f"{n}_head").isNotNull())
        head = there.select("_dev", "_slice", F.lit(n).alias("field"), (F.col(f"{n}_no") - inner[n]).alias("no"), F.col(f"{n}_head.run").alias("run"), F.col(f"{n}_head.len").alias("len"))
        tail = there.where(inner[n] == 1).select("_dev", "_slice", F.lit(n).alias("field"), F.col(f"{n}_no").alias("no"), F.col(f"{n}_tail.run").alias("run"), F.col(f"{n}_tail.len").alias("len"))
        ends = head.unionByName(tail) if ends is None else ends.unionByName(head).unionByName(tail)
    ends = ends.withColumn("whole", F.sum("len").over(Window.partitionBy("_dev", "field", "no")))
    longer = ends.groupBy("_dev", "_slice").agg(*[F.map_from_entries(F.collect_list(F.when(F.col("field") == f.name, F.struct("run", "whole")))).alias(f"{f.name}_longer") for f in stuck])
    totals = s.select("_dev", "_slice", *[F.sum(f"{f.name}_{k}").over(device).alias(f"{f.name}_all_{k}") for f in stuck for k in ("short", "same")])
    return totals.join(longer, ["_dev", "_slice"], "left")


def flag_readings(df: DataFrame, fields: list[Field], *, id_col: str, device: str, ts: str, context: str | None = None, hot_part: float | None = None, hot_least: int | None = None, slice_hours: int = SLICE_HOURS) -> DataFrame:
    """(reading_id, field, value, reason) of each implausible reading; reason is bound, spike or stuck."""
    names = [f.name for f in fields]
    raw = need(df, id_col, device, ts, *([context] if context else []), *names)
    raw = raw.select(F.col(id_col).alias("_id"), F.col(device).alias("_dev"), F.col(ts).cast("timestamp").alias("_ts"), (F.col(context) if context else F.lit(None).cast("string")).alias("_ctx"), *[F.col(n) for n in names])
    limits = {k: v for k, v in (("part", hot_part), ("least", hot_least)) if v is not None}
    raw, hot = mark_hot(raw, "_dev", "_hot", **limits)
    raw = raw.withColumn("_slice", F.when(F.col("_hot"), F.coalesce(time_slice(F.col("_ts"), slice_hours), F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long")))
    spiky, stuck = [f for f in fields if f.above is not None], [f for f in fields if f.stuck]

    # Levels of each device and of the fleet: mergeable sketches, partially aggregated before the shuffle.
    def level(f: Field) -> list[Column]:
        v = F.when(_judged(f, F.col(f.name)), F.col(f.name).cast("double"))
        return [F.percentile_approx(v, F.lit(f.normal), F.lit(2000)).alias("lvl"), F.count(v).alias("n")]

    facts = raw.groupBy("_dev", "_slice").agg(F.count(F.lit(1)).alias("_rows")).drop("_rows")
    for f in spiky:
        keys = ["_dev", "_ctx"] if f.by_context else ["_dev"]
        own = raw.groupBy(*keys).agg(*level(f))
        if f.by_context:
            every = raw.groupBy("_ctx").agg(*level(f)).select(F.col("_ctx").alias("_c"), F.col("lvl").alias("all"))
            own = own.join(every, F.col("_ctx").eqNullSafe(F.col("_c")), "left").drop("_c")
            entry = F.struct(_context(F.col("_ctx")), F.struct("lvl", "n", "all"))
            own = own.groupBy("_dev").agg(F.map_from_entries(F.collect_list(entry)).alias(f"{f.name}_of"))  # a line a context
        else:
            every = raw.agg(*level(f)).select(F.col("lvl").alias("all"))
            own = own.crossJoin(F.broadcast(every)).select("_dev", F.struct("lvl", "n", "all").alias(f"{f.name}_of"))  # one row
        facts = facts.join(own, "_dev", "left")

    raw = raw.withColumns({n: F.col(n).cast("double") for n in names})
    is_hot = F.col("_hot") if hot else None
    rows = _with_runs(raw, fields, is_hot)
    # Rolling values around each reading; the sort of them is only paid for candidates.
    around = Window.partitionBy("_dev", "_slice").orderBy("_ts", "_id").rowsBetween(-HALF, HALF)
    around_ctx = Window.partitionBy("_dev", "_slice", "_ctx").orderBy("_ts", "_id").rowsBetween(-HALF, HALF)
    whole = Window.partitionBy("_dev", "_slice")
    rows = rows.withColumns(
        {f"{f.name}_near": F.collect_list(F.when(_judged(f, F.col(f.name)), F.col(f.name))).over(around_ctx if f.by_context else around) for f in spiky}
        | {f"{f.name}_{k}": F.sum(c(f)).over(whole) for f in stuck for k, c in (("short", _short), ("same", _same))}
    )
    if hot and stuck:
        facts = facts.join(_over_slices(_with_runs(raw.where(is_hot), fields, is_hot), stuck), ["_dev", "_slice"], "left")
    if hot:
        for f in spiky:
            value = F.when(_judged(f, F.col(f.name)), F.col(f.name))
            facts = facts.join(_around_slices(_distinct(raw.where(is_hot)), value, f"{f.name}_beyond", HALF, f.by_context), ["_dev", "_slice"], "left")
        for tag, more in (("", []), ("_c", ["_ctx"])):
            rows = rows.withColumns({f"_p{tag}": F.row_number().over(_order(*more)), f"_m{tag}": F.count(F.lit(1)).over(Window.partitionBy("_dev", "_slice", *more))})
    judged = rows.join(facts, ["_dev", "_slice"], "left")

    def far(f: Field) -> Column:
        v, near, of = F.col(f.name), F.col(f"{f.name}_near"), F.col(f"{f.name}_of")
        if f.by_context:
            of = F.try_element_at(of, _context(F.col("_ctx")))
        if hot:
            beyond, p, m = F.col(f"{f.name}_beyond"), F.col("_p_c" if f.by_context else "_p"), F.col("_m_c" if f.by_context else "_m")
            if f.by_context:
                beyond = F.try_element_at(beyond, _context(F.col("_ctx")))
            lack, over = F.greatest(HALF - p + 1, F.lit(0)), F.greatest(p + HALF - m, F.lit(0)).cast("int")
            before = F.slice(beyond["before"], F.greatest(F.size(beyond["before"]) - lack, F.lit(0)) + 1, HALF)
            near = F.when(beyond.isNotNull() & ((lack > 0) | (over > 0)), F.array_compact(F.concat(before, near, F.slice(beyond["after"], F.lit(1), over)))).otherwise(near)
        few = F.coalesce(of["n"], F.lit(0)) < f.least_n
        normal = F.when(few, F.least(of["lvl"], of["all"])).otherwise(of["lvl"])
        med = _median(near)
        spread = F.greatest(F.lit(MAD_TO_SIGMA) * _median(F.transform(near, lambda x: F.abs(x - med))), F.lit(LEAST_SPREAD * MAD_TO_SIGMA) * med)
        local = F.when(F.size(near) < 5, F.lit(True)).otherwise(v > med + F.lit(FACTOR) * spread)
        return F.coalesce(F.when(_judged(f, v) & (v > normal * f.above), local), F.lit(False))

    def is_stuck(f: Field) -> Column:
        n = f.name
        length, short, same = F.col(f"{n}_len"), F.col(f"{n}_short"), F.col(f"{n}_same")
        if hot:
            length = F.coalesce(F.try_element_at(f"{n}_longer", F.col(f"{n}_run").cast("long")), length)
            short, same = F.coalesce(f"{n}_all_short", short), F.coalesce(f"{n}_all_same", same)
        return F.coalesce(F.col(f"{n}_act") & (length >= STUCK_RUN) & (short > 0) & (same <= short * COARSE), F.lit(False))

    reasons = []
    for f in fields:
        v = F.col(f.name)
        why = F.when(_impossible(f, v), F.lit("bound"))
        if f.above is not None:
            why = why.when(far(f), F.lit("spike"))
        if f.stuck:
            why = why.when(is_stuck(f), F.lit("stuck"))
        reasons.append(F.struct(F.lit(f.name).alias("field"), v.alias("value"), why.alias("reason")))
    found = judged.select(F.col("_id").alias("reading_id"), F.filter(F.array(*reasons), lambda x: x["reason"].isNotNull()).alias("found")).where(F.size("found") > 0)
    return found.select("reading_id", F.explode("found").alias("x")).select("reading_id", "x.field", "x.value", "x.reason")


#: Metres a second; a road vehicle does not reach 70 m/s. Speeds up to 0.5 m/s are standing with noise.
PING_FIELDS = [
    Field("speed", low=0.0, high=70.0, above=2.0, normal=0.9, moving_over=0.5),
    Field("accuracy", low=0.0, low_open=True, high=100_000.0, above=5.0, by_context=True, least_n=5),
    Field("heading", low=0.0, high=360.0, moving_field="speed", moving_over=1.0),
]
PROCESSED_FIELDS = [Field("speed_kmh", low=0.0, high=252.0, above=2.0, normal=0.9, moving_over=1.8)]


def implausible_pings(pings: DataFrame, **options) -> DataFrame:
    """Readings of driver_locations: (reading_id, field, value, reason)."""
    return flag_readings(pings, PING_FIELDS, id_col="id", device="driver_id", ts="recorded_at", context="source", **options)


def implausible_processed(processed: DataFrame, flagged_pings: DataFrame | None = None, **options) -> DataFrame:
    """Readings of processed_locations; also those that show a flagged ping speed (within rounding of 3.6 times it)."""
    own = flag_readings(processed, PROCESSED_FIELDS, id_col="event_id", device="driver_id", ts="recorded_at", **options)
    if flagged_pings is None:
        return own
    bad = flagged_pings.where(F.col("field") == "speed").select(F.col("reading_id").alias("_ping"), F.col("value").alias("_speed"), "reason")
    shown = need(processed, "event_id", "speed_kmh").join(bad, F.col("event_id") == F.col("_ping"))
    shown = shown.where((F.abs(F.col("speed_kmh") - F.col("_speed") * 3.6) < 0.011) | (F.isnan("speed_kmh") & F.isnan("_speed")))
    return own.unionByName(shown.select(F.col("event_id").alias("reading_id"), F.lit("speed_kmh").alias("field"), F.col("speed_kmh").alias("value"), "reason"))


def implausible(pings: DataFrame, processed: DataFrame, **options) -> DataFrame:
    """All implausible readings of both tables, each reading once."""
    p = written(implausible_pings(pings, **options), "flagged")  # used twice
    both = p.unionByName(implausible_processed(processed, p, **options))
    return both.groupBy("reading_id", "field").agg(F.first("value").alias("value"), F.min("reason").alias("reason"))
