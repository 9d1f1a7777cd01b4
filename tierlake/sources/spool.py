"""Between files of the driver and rows of the executors, a part at a time: neither side holds a whole file."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any, BinaryIO

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

from tierlake.plans.shared import shared_dir

#: Bytes or characters that the driver holds before it writes them as a file of the shared folder.
PART = 8 << 20
#: Bytes of a column, and rows, that are read at once.
BLOCK, ROWS = 1 << 20, 100
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _hadoop(spark: SparkSession, path: str) -> tuple[Any, Any]:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


class Spool:
    """Rows that the driver adds one by one, written as Parquet to the shared folder, a file for each PART of them."""

    def __init__(self, spark: SparkSession, schema: pa.Schema):
        self._spark, self._schema = spark, schema
        self._path = f"{shared_dir(spark)}/tierlake-spool-{uuid.uuid4().hex}"
        self._rows: list[tuple] = []
        self._size = self._files = 0

    def add(self, *row: Any) -> None:
        self._rows.append(row)
        self._size += 64 + sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if self._size >= PART:
            self._flush()

    def _flush(self) -> None:
        columns = zip(*self._rows) if self._rows else [()] * len(self._schema)
        table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self._schema)], schema=self._schema)
        handle, local = tempfile.mkstemp(suffix=".parquet")
        os.close(handle)
        pq.write_table(table, local, compression="zstd")
        fs, to = _hadoop(self._spark, f"{self._path}/part-{self._files:06}.parquet")
        fs.copyFromLocalFile(True, True, self._spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{local}"), to)
        self._rows, self._size, self._files = [], 0, self._files + 1

    def frame(self) -> DataFrame:
        if self._rows or not self._files:
            self._flush()
        return self._spark.read.parquet(self._path)

    def drop(self) -> None:
        """Deletes what was written; frames of it can't be read any more."""
        fs, at = _hadoop(self._spark, self._path)
        fs.delete(at, True)


@contextmanager
def _tidied(spark: SparkSession) -> Iterator[None]:
    """Jobs begun within drop their shuffle files when they end; else these stay until the driver happens to collect its garbage."""
    before = spark.conf.get(TIDY)
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(TIDY, before)


@contextmanager
def written(rows: DataFrame) -> Iterator[Iterator[BinaryIO]]:
    """``rows`` as open Parquet files in the order of the frame's partitions, which are gone afterwards."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/tierlake-parts-{uuid.uuid4().hex}"
    fs, at = _hadoop(spark, path)
    try:
        with _tidied(spark):
            rows.write.option("compression", "zstd").parquet(path)
        names = sorted(p for p in (s.getPath().getName() for s in fs.listStatus(at)) if p.startswith("part-"))

        def opened() -> Iterator[BinaryIO]:
            for name in names:
                fs_, part = _hadoop(spark, f"{path}/{name}")
                with tempfile.TemporaryDirectory() as folder:
                    local = f"{path.removeprefix('file://')}/{name}"
                    if not path.startswith(("file:", "/")):
                        local = f"{folder}/{name}"
                        fs_.copyToLocalFile(False, part, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{local}"), True)
                    with open(local, "rb") as f:
                        yield f
                fs_.delete(part, False)

        yield opened()
    finally:
        fs.delete(at, True)


def batches(part: BinaryIO) -> Iterator[pa.RecordBatch]:
    """The rows of an open Parquet file, ROWS at a time."""
    return pq.ParquetFile(part, buffer_size=BLOCK, pre_buffer=False).iter_batches(ROWS)


def texts(part: BinaryIO) -> Iterator[bytes]:
    """The texts of an open Parquet file of one column."""
    for batch in batches(part):
        yield from batch.column(0).cast(pa.binary()).to_pylist()
