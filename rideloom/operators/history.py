"""History of changing attributes: checkpoints and patches, folded into versions with their validity.

Storage is three tables by period: the records that count (one an entity and date), a patch for each date on which
something changed, holding only the changed attributes, and a checkpoint with the state of every entity before the
period, made by folding patches, so that a value keeps the spelling of the record that brought it wherever periods
are cut. Versions are rebuilt by folding the patches of a period over its checkpoint: one period of one entity is
the unit of work, however long the history or busy the entity; what crosses periods is one row each.

History keeps these tables: update() takes new or late records, starts from the checkpoint of the earliest period
they touch and writes that period and later ones anew; a manifest, written last, names the folders that count.

Defined results: of several records for one entity and date the one loaded last counts (equal load times: the
greater values); a null or NaN attribute keeps its last known value, and a first known value after nulls is a
change; records without entity or date are ignored; empty input gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rideloom.common import need, written

PERIOD_DAYS = 14


@dataclass(frozen=True)
class Attribute:
    name: str
    same: Callable[[Column], Column] = lambda c: c  # values with equal results are the same value
    clean: Callable[[Column], Column] = lambda c: c


def blanks(c: Column) -> Column:
    """Outer blanks gone, inner runs of blanks (of any kind) one blank."""
    return F.trim(F.regexp_replace(c, r"[\s  -​ 　]+", " "))


def known_number(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


DRIVER = [Attribute("full_name", lambda c: F.lower(blanks(c)), blanks), Attribute("license_number"), Attribute("rating", lambda c: F.round(known_number(c), 2), known_number)]


def daily(snapshots: DataFrame, attributes: list[Attribute], *, entity: str, date: str, loaded: str, also: tuple[str, ...] = ()) -> DataFrame:
    """(entity, day, attributes..., also...): the record that counts for each entity and date."""
    s = need(snapshots, *dict.fromkeys([entity, date, loaded, *[a.name for a in attributes], *also]))
    s = s.where(F.col(entity).isNotNull() & F.col(date).isNotNull())
    row = F.struct(*[a.clean(F.col(a.name)).alias(a.name) for a in attributes], *[F.col(c) for c in also])
    s = s.groupBy(F.col(entity).alias("entity"), F.col(date).cast("date").alias("day")).agg(F.max(F.struct(F.col(loaded).alias("at"), row.alias("row"))).alias("x"))
    return s.select("entity", "day", "x.row.*")


def _period(day: Column, days: int) -> Column:
    return F.floor(F.unix_date(day) / days).cast("long")


def _latest(rows: DataFrame, attributes: list[Attribute], prefix: str, start: DataFrame | None) -> DataFrame:
    """(entity, period, period_no, <prefix>attribute...): last non-null values of earlier periods, of start before the first."""
    by = rows.groupBy("entity", "period").agg(*[F.max_by(a.name, F.when(F.col(a.name).isNotNull(), F.col("day"))).alias(a.name) for a in attributes])
    names = [a.name for a in attributes]
    by = by.select("entity", "period", *names, F.lit(False).alias("start"))
    if start is not None:
        by = by.unionByName(start.select("entity", F.lit(None).cast("long").alias("period"), *names, F.lit(True).alias("start")))
    order = Window.partitionBy("entity").orderBy(F.col("period").asc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    by = by.select("entity", "period", "start", F.row_number().over(order).alias("period_no"), *[F.last(n, ignorenulls=True).over(before).alias(f"{prefix}{n}") for n in names])
    return by.where(~F.col("start")).drop("start")


def patches(rows: DataFrame, attributes: list[Attribute], also: tuple[str, ...] = (), start: DataFrame | None = None) -> DataFrame:
    """(entity, period, day, first, attributes..., also...): changed attributes only, others null; an entity's first date always.

    rows have a period; start is the checkpoint before the first of them, if there is one.
    """
    r = rows.join(_latest(rows, attributes, "was_", start), ["entity", "period"])
    order = Window.partitionBy("entity", "period").orderBy("day")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    first = (F.col("period_no") == 1) & (F.row_number().over(order) == 1)
    changes = []
    for a in attributes:
        known = a.same(F.coalesce(F.last(a.name, ignorenulls=True).over(before), F.col(f"was_{a.name}")))
        now = a.same(F.col(a.name))
        changes.append(F.when(now.isNotNull() & (known.isNull() | (now != known)), F.col(a.name)).alias(a.name))
    r = r.select("entity", "period", "day", first.alias("first"), *changes, *also)
    changed = F.col("first")
    for a in attributes:
        changed = changed | F.col(a.name).isNotNull()
    return r.where(changed)


def checkpoint(deltas: DataFrame, attributes: list[Attribute], period: int, start: DataFrame | None = None) -> DataFrame:
    """(entity, attributes...): the state of every entity before a period, folded from the patches before it over start."""
    names = [a.name for a in attributes]
    d = deltas.where(F.col("period") < period).select("entity", "day", *names)
    if start is not None:
        d = d.unionByName(start.select("entity", F.lit(None).cast("date").alias("day"), *names))
    at = F.coalesce("day", F.lit("0001-01-01").cast("date"))
    return d.groupBy("entity").agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), at)).alias(n) for n in names])


def versions(deltas: DataFrame, attributes: list[Attribute], also: tuple[str, ...] = (), start: DataFrame | None = None) -> DataFrame:
    """(entity, attributes..., also..., valid_from, valid_to, is_current): patches folded over the state before their period.

    valid_to is the next version's first day, null while open.
    """
    firsts = deltas.groupBy("entity", "period").agg(F.min("day").alias("first_day"))
    firsts = firsts.select("entity", "period", F.lead("first_day").over(Window.partitionBy("entity").orderBy("period")).alias("later"))
    d = deltas.join(_latest(deltas, attributes, "known_", start), ["entity", "period"]).join(firsts, ["entity", "period"])
    order = Window.partitionBy("entity", "period").orderBy("day")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    folded = [F.coalesce(F.last(a.name, ignorenulls=True).over(upto), F.col(f"known_{a.name}")).alias(a.name) for a in attributes]
    d = d.select("entity", *folded, *also, F.col("day").alias("valid_from"), F.lead("day").over(order).alias("next"), "later")
    to = F.coalesce("next", "later")
    return d.select("entity", *[a.name for a in attributes], *also, "valid_from", to.alias("valid_to"), to.isNull().cast("int").alias("is_current"))


def by_period(rows: DataFrame, period_days: int) -> DataFrame:
    return rows.withColumn("period", _period(F.col("day"), period_days))


def _driver_days(snapshots: DataFrame) -> DataFrame:
    return daily(snapshots, DRIVER, entity="driver_id", date="snapshot_date", loaded="loaded_at", also=("total_trips", "loaded_at"))


def _as_dim_drivers(v: DataFrame) -> DataFrame:
    return v.select(F.xxhash64("entity", "valid_from").alias("driver_key"), F.col("entity").alias("driver_id"), "full_name", "license_number", F.round("rating", 2).alias("rating"), "total_trips", F.col("valid_from").cast("timestamp").alias("valid_from"), F.col("valid_to").cast("timestamp").alias("valid_to"), "is_current")


def driver_history(snapshots: DataFrame, period_days: int = PERIOD_DAYS) -> DataFrame:
    """dim_drivers from the daily extracts: (driver_key, driver_id, full_name, license_number, rating, total_trips, valid_from, valid_to, is_current).

    total_trips is that of the version's first day. The patches are written once and folded from there.
    """
    deltas = written(patches(by_period(_driver_days(snapshots), period_days), DRIVER, ("total_trips",)), "patches")
    return _as_dim_drivers(versions(deltas, DRIVER, ("total_trips",)))


class DriverHistory:
    """The stored history of drivers in a folder all executors see: records, patches and checkpoints by period.

    One writer at a time: a second one that read the same manifest finds the next one taken and fails.
    """

    def __init__(self, spark: SparkSession, path: str, period_days: int = PERIOD_DAYS) -> None:
        self.spark, self.path, self.period_days = spark, path.rstrip("/"), period_days

    def _fs(self, *parts: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def manifest(self) -> dict:
        """{"no", "folders": {period: folder}} of the last complete update; folders hold days, patches and checkpoint."""
        fs, path = self._fs("manifests")
        if not fs.exists(path):
            return {"no": 0, "folders": {}}
        last = max(int(f.getPath().getName()) for f in fs.listStatus(path))
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{last}").collect()[0][0])

    def _commit(self, no: int, folders: dict[str, str]) -> None:
        fs, path = self._fs("manifests", str(no))
        out = fs.create(path, False)  # fails if another writer made it
        out.write(bytearray(json.dumps({"no": no, "folders": folders}).encode()))
        out.close()

    def _read(self, folders: list[str], kind: str) -> DataFrame | None:
        return self.spark.read.parquet(*[f"{self.path}/{kind}/{f}" for f in folders]) if folders else None

    def update(self, snapshots: DataFrame) -> None:
        """Takes in records, new, late or loaded again; periods before the earliest touched one stay as they are."""
        new = by_period(_driver_days(snapshots), self.period_days)
        first = new.agg(F.min("period")).first()[0]
        if first is None:
            return
        now = self.manifest()
        folders = {int(p): f for p, f in now["folders"].items()}
        kept = {p: f for p, f in folders.items() if p < first}
        old = self._read([f for p, f in folders.items() if p >= first], "days")
        if old is not None:  # of old and new records for a date the one loaded last
            both = by_period(old, self.period_days).unionByName(new)
            values = [c for c in both.columns if c not in ("entity", "day", "period")]
            new = both.groupBy("entity", "day", "period").agg(F.max(F.struct("loaded_at", *[c for c in values if c != "loaded_at"])).alias("x")).select("entity", "day", "x.*", "period")
        start = None
        if kept:  # the nearest checkpoint, folded forward to the first touched period
            last = max(kept)
            start = checkpoint(self._read([kept[last]], "patches").withColumn("period", F.lit(last)), DRIVER, first, self._read([kept[last]], "checkpoints"))
        run = f"{now['no'] + 1}-{uuid.uuid4().hex[:8]}"
        new.write.partitionBy("period").parquet(f"{self.path}/days/{run}")
        days = self.spark.read.parquet(f"{self.path}/days/{run}")
        deltas = patches(days.withColumn("period", F.col("period").cast("long")), DRIVER, ("total_trips",), start)
        deltas.write.partitionBy("period").parquet(f"{self.path}/patches/{run}")
        periods = sorted(r[0] for r in days.select("period").distinct().collect())  # one a period of time
        changed = self.spark.read.schema(deltas.schema).parquet(f"{self.path}/patches/{run}")
        for p in periods:
            f = f"{run}/period={p}"
            checkpoint(changed, DRIVER, p, start).write.parquet(f"{self.path}/checkpoints/{f}")
            kept[p] = f
        # A period whose records changed nothing has no patches; an empty table stands for them.
        fs, _ = self._fs()
        for p in periods:
            if not fs.exists(self._fs("patches", kept[p])[1]):
                changed.where("false").drop("period").write.parquet(f"{self.path}/patches/{kept[p]}")
        self._commit(now["no"] + 1, {str(p): f for p, f in kept.items()})

    def patches(self) -> DataFrame | None:
        parts = [self._read([f], "patches").withColumn("period", F.lit(p).cast("long")) for p, f in sorted((int(p), f) for p, f in self.manifest()["folders"].items())]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def history(self) -> DataFrame | None:
        """The whole history in the shape of dim_drivers."""
        deltas = self.patches()
        return None if deltas is None else _as_dim_drivers(versions(deltas, DRIVER, ("total_trips",)))

    def state_at(self, day: date) -> DataFrame | None:
        """(entity, attributes...) on a day, from the nearest checkpoint and the patches since."""
        period = (day - date(1970, 1, 1)).days // self.period_days
        folders = {int(p): f for p, f in self.manifest()["folders"].items() if int(p) <= period}
        if not folders:
            return None
        last = max(folders)
        changed = self._read([folders[last]], "patches").where(F.col("day") <= F.lit(day)).withColumn("period", F.lit(last))
        return checkpoint(changed, DRIVER, last + 1, self._read([folders[last]], "checkpoints"))
