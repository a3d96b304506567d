"""Session defaults for local runs; on a cluster the deployment's own settings stay."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(app: str = "rideloom", cores: int | str = "*", **conf: str) -> SparkSession:
    """A UTC session on this machine, with adaptive execution and Arrow transfer."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("RIDELOOM_DRIVER_MEMORY", "8g"),
        "spark.driver.host": "127.0.0.1",
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one on a local master.

    A cluster without the setting is an error: a machine-local folder would not be seen by its executors.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    path = f"file://{tempfile.mkdtemp(prefix='rideloom-')}"
    spark.conf.set("spark.checkpoint.dir", path)
    return path
