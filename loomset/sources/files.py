"""Small files and file digests in any store that Spark reads."""

from __future__ import annotations

import uuid

from py4j.java_gateway import is_instance_of
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _place(spark: SparkSession, path: str) -> tuple:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, system = _place(spark, path)
    return system.exists(place)


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files and folders in a folder, in order; none if there is no such folder."""
    place, system = _place(spark, folder)
    return sorted(s.getPath().getName() for s in system.listStatus(place)) if system.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    place, system = _place(spark, path)
    system.delete(place, True)


def _bare(spark: SparkSession, path: str) -> tuple:
    """As _place(), but a local file system without checksum files: a file and its checksum are not replaced in one step."""
    place, system = _place(spark, path)
    local = is_instance_of(spark.sparkContext._gateway, system, "org.apache.hadoop.fs.LocalFileSystem")
    return place, system.getRawFileSystem() if local else system, local


def read_small(spark: SparkSession, path: str) -> str:
    """The text of a file of a few lines."""
    place, system, _ = _bare(spark, path)
    if not system.exists(place):
        raise FileNotFoundError(path)
    stream = system.open(place)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def replace_small(spark: SparkSession, path: str, text: str) -> None:
    """Puts a file of a few lines in the place of one that may be there. Readers see the old one or the new one, whole, at any moment."""
    jvm = spark.sparkContext._jvm
    place, system, local = _bare(spark, path)
    beside, _ = _place(spark, f"{path}.{uuid.uuid4().hex}")
    stream = system.create(beside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if local:  # one step here; FileContext would remove the old file first
        if not system.rename(beside, place):
            raise OSError(f"{path} could not be replaced")
        return
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(beside, place, overwrite)


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """name (below the folder), bytes and sha256 of each file, markers and hidden files aside. A file is hashed in the task that reads it, so it may have 2 GB at most."""
    place, system = _place(spark, folder)
    prefix = system.makeQualified(place).toString().rstrip("/") + "/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    # local paths are spelled file:/ or file:///
    name = F.substring_index(F.col("path"), "/" + prefix.rstrip("/").rsplit("/", 1)[1] + "/", -1) if "/" in prefix.rstrip("/") else F.col("path")
    return found.select(name.alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def digest(spark: SparkSession, folder: str) -> dict:
    """files, bytes and one sha256 over names and digests, in order of the names: a changed, added or lost byte or file changes it."""
    rows = digests(spark, folder).select("bytes", F.sha2(F.concat_ws(":", "name", "bytes", "sha256"), 256).alias("line"))
    one = rows.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("line"))), 256).alias("sha256")).first()  # a line a file
    return one.asDict()
