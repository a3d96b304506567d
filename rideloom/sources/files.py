"""Files in and out: checked writes, archives, manifests, exports. The event bus is a folder of files here; a cluster
with the connector uses the same functions on spark.readStream.format("kafka")."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rideloom.session import shared_dir

FORMATS = ("parquet", "json", "csv", "orc")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_checked(df: DataFrame, schema: Mapping[str, str], path: str, partition_by: Sequence[str] = (), rows_a_file: int = 1_000_000) -> None:
    """Rows that fit the types are written; a value that can't be cast drops the row."""
    fits = df
    for c, k in schema.items():
        fits = fits.where(F.col(c).isNull() | F.expr(f"try_cast(`{c}` AS {k})").isNotNull())
    fits.select(*[F.expr(f"try_cast(`{c}` AS {k})").alias(c) for c, k in schema.items()]).write.mode("overwrite").partitionBy(*partition_by).option("maxRecordsPerFile", rows_a_file).parquet(path)


def archive(df: DataFrame, ts: str, path: str) -> None:
    """Gzip JSON under year, month and day."""
    days = df.withColumns({"year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts)})
    days.write.mode("append").partitionBy("year", "month", "day").option("compression", "gzip").json(path)


def export(df: DataFrame, fmt: str, path: str) -> str:
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt}: one of {', '.join(FORMATS)}")
    w = df.write.mode("overwrite").format(fmt)
    (w.option("header", True) if fmt == "csv" else w).save(path)
    return path


def load(spark: SparkSession, fmt: str, path: str, schema=None) -> DataFrame:
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt}: one of {', '.join(FORMATS)}")
    r = spark.read.format(fmt)
    r = r.schema(schema) if schema is not None else r
    return (r.option("header", True) if fmt == "csv" else r).load(path)


class Manifest:
    """Loads each named input once: what is loaded is listed in a small table beside the data."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def loaded(self) -> set[str]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return set()
        return {r["name"] for r in self.spark.read.schema("name string, rows long").json(f"{self.path}/manifest").collect()}  # a line a file

    def load(self, name: str, df: DataFrame) -> bool:
        if name in self.loaded():
            return False
        where = f"{self.path}/data/part={name}"
        df.write.mode("overwrite").parquet(where)
        n = self.spark.read.parquet(where).count()
        self.spark.createDataFrame([(name, n)], "name string, rows long").coalesce(1).write.mode("append").json(f"{self.path}/manifest")
        return True

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/data")


class Ingest:
    """Named sources with a known format and schema; what is not registered, or comes in another format, is refused."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.known = spark, {}

    def register(self, name: str, fmt: str, schema) -> None:
        if fmt not in FORMATS:
            raise ValueError(f"format {fmt}: one of {', '.join(FORMATS)}")
        self.known[name] = (fmt, schema)

    def accepts(self, name: str, fmt: str) -> bool:
        return name in self.known and self.known[name][0] == fmt

    def run(self, name: str, fmt: str, path: str) -> DataFrame:
        if not self.accepts(name, fmt):
            raise ValueError(f"{name} as {fmt} is not registered")
        return load(self.spark, fmt, path, self.known[name][1])


def write_months(df: DataFrame, ts: str, kind: str, path: str) -> None:
    """A Parquet folder a month, <kind>_tripdata_<yyyy-MM>.parquet; rows without a time go to none."""
    months = sorted(r[0] for r in df.select(F.date_format(ts, "yyyy-MM")).distinct().dropna().collect())  # few months
    for m in months:
        df.where(F.date_format(ts, "yyyy-MM") == m).write.mode("overwrite").parquet(f"{path}/{kind}_tripdata_{m}.parquet")


def read_months(spark: SparkSession, path: str, kind: str = "*", months: str = "*") -> DataFrame:
    """Monthly files by a pattern of kinds and months; adds kind and month from the folder's name."""
    x = spark.read.option("mergeSchema", "true").parquet(f"{path}/{kind}_tripdata_{months}.parquet")
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([a-z]+)_tripdata_(\d{4}-\d{2})\.parquet/", 1)
    month = F.regexp_extract(F.col("_metadata.file_path"), r"([a-z]+)_tripdata_(\d{4}-\d{2})\.parquet/", 2)
    return x.withColumns({"kind": name, "month": month})


def generated(spark: SparkSession, template: str, n: int, mode: str = "synthetic", seed: int = 1, source: DataFrame | None = None) -> DataFrame:
    """Made events of a template (ride, location, payment, driver) from seeded hashes.

    synthetic: one a second; stress: all within a minute, a hundredth of the keys; replay: the first n rows of source by
    its first column, moved to follow each other by a second.
    """
    if mode == "replay":
        if source is None:
            raise ValueError("replay needs a source")
        first = source.columns[0]
        kept = source.orderBy(first).limit(n)
        return kept.withColumn("sent_at", F.timestamp_seconds(F.row_number().over(Window.orderBy(first)) - 1))  # n rows
    if mode not in ("synthetic", "stress"):
        raise ValueError(f"mode {mode}: synthetic, stress or replay")
    h = lambda k, m: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(m))
    of = lambda k, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (h(k, len(values)) + 1).cast("int"))
    keys = 5 if mode == "stress" else 500
    sent = F.timestamp_seconds(F.lit(1_700_000_000) + (h(9, 60) if mode == "stress" else F.col("id")))
    common = {"event_id": F.concat(F.lit(f"{template}-"), F.col("id").cast("string")), "sent_at": sent, "driver_id": h(3, keys)}
    templates = {
        "ride": {"rider_id": h(4, keys), "status": of(5, "requested", "started", "completed", "cancelled"), "distance_km": h(6, 3000) / 100.0, "fare": h(7, 9000) / 100.0},
        "location": {"latitude": (h(4, 180_000_001) - 90_000_000) / 1e6, "longitude": (h(5, 360_000_001) - 180_000_000) / 1e6, "speed_kmh": h(6, 1200) / 10.0},
        "payment": {"amount": h(4, 9000) / 100.0, "method": of(5, "card", "cash", "wallet"), "currency": of(6, "USD", "EUR")},
        "driver": {"rating": 3 + h(4, 200) / 100.0, "vehicle": of(5, "sedan", "van", "bike"), "active": h(6, 2) == 1},
    }
    if template not in templates:
        raise ValueError(f"template {template}: one of {', '.join(templates)}")
    return spark.range(n).select(*[c.alias(k) for k, c in (common | templates[template]).items()])


def synthetic_events(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """n made ride events from seeded hashes: the same rows on any cluster."""
    h = lambda k, m: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(m))
    kinds = F.array(*[F.lit(k) for k in ("ride", "location", "payment", "driver")])
    return spark.range(n).select(F.col("id").alias("event_id"), F.element_at(kinds, (h(1, 4) + 1).cast("int")).alias("kind"), (h(2, 10_000) / 100.0).alias("value"), h(3, 500).alias("user_id"))
