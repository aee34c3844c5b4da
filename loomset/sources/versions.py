"""Tables in versions: a new one is written beside the old ones, checked, and then named by one pointer file.

A reader resolves the pointer once, when it asks for the table, so that it sees one whole version whatever is written meanwhile. A version that was
never named (a writer died, a check failed) is invisible, and goes when prune() runs.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomset.sources import files

POINTER = "_current.json"


def _names_and_types(frame: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in frame.schema]


def current(spark: SparkSession, folder: str) -> dict:
    """version, rows, columns and digest of the version that readers get."""
    try:
        return json.loads(files.read_small(spark, f"{folder}/{POINTER}"))
    except FileNotFoundError:
        raise FileNotFoundError(f"{folder} has no version yet") from None


def read(spark: SparkSession, folder: str, verify: bool = False) -> DataFrame:
    """The current version. verify: compare its files with the digest taken when it was written."""
    now = current(spark, folder)
    path = f"{folder}/{now['version']}"
    if verify and files.digest(spark, path) != now["digest"]:
        raise ValueError(f"the files of {path} are not those that were written")
    return spark.read.parquet(path)


def write(frame: DataFrame, folder: str, same_schema: bool = True, check: Callable[[DataFrame], None] | None = None) -> dict:
    """Writes a new version and names it. same_schema: names and types must be those of the version before. check raises if the rows as written won't do."""
    spark = frame.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    path = f"{folder}/{version}"
    if same_schema and files.exists(spark, f"{folder}/{POINTER}"):
        before = _names_and_types(read(spark, folder))
        if before != _names_and_types(frame):
            raise ValueError(f"columns change from {before} to {_names_and_types(frame)}")
    try:
        frame.write.option("compression", "zstd").parquet(path)
        written = spark.read.schema(frame.schema).parquet(path)
        rows = written.count()
        if check:
            check(written)
    except Exception:
        files.remove(spark, path)
        raise
    told = {"version": version, "rows": rows, "columns": [list(x) for x in _names_and_types(frame)], "digest": files.digest(spark, path)}
    files.replace_small(spark, f"{folder}/{POINTER}", json.dumps(told))
    return told


def prune(spark: SparkSession, folder: str) -> list[str]:
    """Removes all versions but the current one; readers that still read one of them fail. Gives their names."""
    now = current(spark, folder)["version"]
    gone = [n for n in files.names_in(spark, folder) if n.startswith("v-") and n != now]
    for name in gone:
        files.remove(spark, f"{folder}/{name}")
    return gone
