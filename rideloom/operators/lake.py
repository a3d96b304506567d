"""Snapshot tables on plain Parquet: every commit writes a new folder and then adds one line to a manifest.

The manifest line is what makes a commit visible; a failed write leaves unused files and no line. Old snapshots
stay readable, which gives time travel by version and by time.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key in order (e.g. of a merge source with repeated keys)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whole rows of the source replace those of the target with equal keys; others stay. Source keys are unique."""
    kept = target.join(source, list(keys), "left_anti")
    return kept.select(*target.columns).unionByName(source, allowMissingColumns=True)


class SnapshotTable:
    """A table of snapshots under a path shared by all executors."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _log(self) -> DataFrame | None:
        schema = "version int, at timestamp, operation string, paths array<string>, columns string, rows long"
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_log")
        fs = fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return self.spark.read.schema(schema).json(f"{self.path}/_log") if fs.exists(fs_path) else None

    def history(self) -> DataFrame:
        log = self._log()
        if log is None:
            raise ValueError("no snapshot")
        return log.select("version", "at", "operation", "rows", F.size("paths").alias("files"))

    def _head(self) -> dict | None:
        log = self._log()
        if log is None:
            return None
        row = log.orderBy(F.desc("version")).first()  # the manifest has a line a commit
        return row.asDict() if row else None

    def _commit(self, df: DataFrame, operation: str, keep: Sequence[str], at: str | None) -> int:
        head = self._head()
        version = (head["version"] if head else 0) + 1
        where = f"{self.path}/data/v{version}"
        df.write.mode("overwrite").parquet(where)
        rows = self.spark.read.parquet(*keep, where).count() if keep else self.spark.read.parquet(where).count()
        line = self.spark.range(1).select(F.lit(version).alias("version"), (F.lit(at).cast("timestamp") if at else F.current_timestamp()).alias("at"), F.lit(operation).alias("operation"), F.array(*[F.lit(p) for p in (*keep, where)]).alias("paths"), F.lit(json.dumps(df.columns)).alias("columns"), F.lit(rows).alias("rows"))
        line.coalesce(1).write.mode("append").json(f"{self.path}/_log")
        return version

    def append(self, df: DataFrame, at: str | None = None) -> int:
        head = self._head()
        return self._commit(df, "append", head["paths"] if head else [], at)

    def overwrite(self, df: DataFrame, at: str | None = None) -> int:
        return self._commit(df, "overwrite", [], at)

    def delete(self, condition: Column, at: str | None = None) -> int:
        return self._commit(self.read().where(~F.coalesce(condition, F.lit(False))), "delete", [], at)

    def merge(self, source: DataFrame, keys: Sequence[str], at: str | None = None) -> int:
        return self._commit(upsert(self.read(), source, keys), "merge", [], at)

    def add_column(self, name: str, kind: str, at: str | None = None) -> int:
        return self._commit(self.read().withColumn(name, F.lit(None).cast(kind)), "add_column", [], at)

    def read(self, version: int | None = None, as_of: str | None = None) -> DataFrame:
        log = self._log()
        if log is None:
            raise ValueError("no snapshot")
        if version is not None:
            log = log.where(F.col("version") == version)
        if as_of is not None:
            log = log.where(F.col("at") <= F.lit(as_of).cast("timestamp"))
        row = log.orderBy(F.desc("version")).first()
        if row is None:
            raise ValueError("no such snapshot")
        return self.spark.read.option("mergeSchema", "true").parquet(*row["paths"])
