"""What the operators of this package share: intermediate tables and Arrow helpers."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from loomset.session import table as input_table
from loomset.session import unused as unused

#: Rows and bytes of an Arrow batch at most (a longer row is a batch of its own).
BATCH_ROWS, BATCH_BYTES = 2_000, 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. It must be set, but for a local master (tests), which gets a temporary one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="loomset-steps-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def keep(frame: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Writes a frame to the shared folder and reads it again: lost executors then cost no recomputation.

    Shuffle files of what led to it go as soon as the driver has collected the objects that stand for
    them, which is asked for here; a long job would otherwise hold the files of all its steps.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = frame.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(frame.schema).parquet(path) if not partition_by else spark.read.parquet(path)
    out.kept_at = path
    _kept.setdefault(spark.sparkContext.applicationId, []).append(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


#: Folders of the tables that this application keeps, in order.
_kept: dict[str, list[str]] = {}


def kept_so_far(spark: SparkSession) -> int:
    return len(_kept.get(spark.sparkContext.applicationId, []))


def discard_others(spark: SparkSession, since: int, *still: DataFrame) -> None:
    """Removes all tables kept since kept_so_far() gave that number, but for some. What was made of them must be kept, or no longer wanted."""
    mine = _kept.get(spark.sparkContext.applicationId, [])
    stay = {frame.kept_at for frame in still}
    for path in [p for p in mine[since:] if p not in stay]:
        _remove(spark, path)
        mine.remove(path)


def _remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard(frame: DataFrame) -> None:
    """Removes a kept table that no later step reads."""
    _remove(frame.sparkSession, frame.kept_at)
    mine = _kept.get(frame.sparkSession.sparkContext.applicationId, [])
    if frame.kept_at in mine:
        mine.remove(frame.kept_at)


def bound_batches(spark: SparkSession) -> None:
    """From here on the session's Arrow batches have a bound that suits long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    bound_batches(spark)
    return input_table(spark, sf_dir, name)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_map(frame: DataFrame, function: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """Applies a function of one Arrow batch to each batch of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from function(batch)

    return frame.mapInArrow(run, schema)


def task_partition() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def by_key(frame: DataFrame, key: str, order: list[str], function: Callable[[object, pa.Table], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """Applies a function to all rows of each key, in the given order.

    For keys whose groups are bounded by the way the key is made (shards of some megabytes, blocks of a
    group). Unlike applyInArrow, a partition with many small keys costs one Python call a key, no more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            ends = [*(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            at = 0
            for end in ends:
                if held and keys[at] != now:
                    yield from function(now, pa.Table.from_batches(held))
                    held = []
                now = keys[at]
                held.append(batch.slice(at, end - at))
                at = end
        if held:
            yield from function(now, pa.Table.from_batches(held))

    return frame.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
