"""Session settings that every query relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "loomset", cpus: str | int = "*", **conf: object) -> SparkSession:
    """A local session with the settings that queries expect (UTC, AQE, ANSI)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", os.environ.get("LOOMSET_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables. Only Spark touches the path, so any store it reads will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def unused(frame: DataFrame, name: str) -> str:
    """The name, with `_` in front as often as it takes to be the name of no column of the frame."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under spark.checkpoint.dir, which must be set but for a local master (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="loomset-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(frame: DataFrame, name: str) -> DataFrame:
    """Writes a frame to a new folder under spark.checkpoint.dir and reads it again: a lost executor then costs no recomputation."""
    path = scratch_folder(frame.sparkSession, name)
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
