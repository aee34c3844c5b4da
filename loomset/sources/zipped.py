"""The one CSV inside a zip archive, inflated by the task that reads the archive.

Spark reads the archive, so it may lie in any store; nothing touches the driver's disk. The member is inflated as a stream and leaves the task in batches of BATCH rows, cut
between records (quoted fields may hold line ends), so that a task holds the archive's bytes and one batch, however large the member is. A zip member can only be read
from its beginning: an archive is one task. Its bytes are 2 GB at most.
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomset.sources.tables import require_columns

BATCH = 2_000
csv.field_size_limit(1 << 30)


def _member(content: bytes) -> tuple[zipfile.ZipFile, list[str]]:
    archive = zipfile.ZipFile(io.BytesIO(content))
    return archive, [m for m in archive.namelist() if m.lower().endswith(".csv") and not m.startswith("__MACOSX/")]


def _records(content: bytes) -> Iterator[list[str]]:
    archive, members = _member(content)
    with archive, archive.open(members[0]) as stream:
        yield from csv.reader(io.TextIOWrapper(stream, "utf-8-sig", newline=""))


def _archive(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """All columns as text, empty ones '' rather than null, with the header's names. columns: those that must be there.

    An archive with no CSV or several, and a record with more fields than the header, are errors; fields that a record lacks are ''. Blank lines are no records.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                _, members = _member(content.as_py())
                header = next(_records(content.as_py()), []) if len(members) == 1 else []
                yield pa.RecordBatch.from_arrays([pa.array([len(members)], pa.int32()), pa.array([header], pa.list_(pa.string()))], ["members", "header"])

    found = _archive(spark, path).mapInArrow(look, "members int, header array<string>").collect()  # one archive's header
    if len(found) != 1:
        raise ValueError(f"{path} is {len(found)} archives, not one")
    members, header = found[0]
    if members != 1:
        raise ValueError(f"the archive holds {members} CSV files, not one")
    if len(set(header)) < len(header) or not header:
        raise ValueError("the header is empty or names a column twice")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(rows: list[list[str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(len(header))], header)

        for batch in batches:
            for content in batch.column("content"):
                held: list[list[str]] = []
                records = _records(content.as_py())
                next(records)
                for n, record in enumerate(records, 1):
                    if not record:
                        continue
                    if len(record) > len(header):
                        raise ValueError(f"record {n} has {len(record)} fields, the header {len(header)}")
                    held.append(record + [""] * (len(header) - len(record)))
                    if len(held) == BATCH:
                        yield table(held)
                        held = []
                if held:
                    yield table(held)

    schema = ", ".join(f"`{c}` string" for c in header)
    out = _archive(spark, path).mapInArrow(read, schema)
    return require_columns(out, columns) if columns else out
