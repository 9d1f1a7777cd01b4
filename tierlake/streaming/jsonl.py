"""Documents as a stream: JSON lines read as they arrive, decoded like a batch, written or handed on batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tierlake.meta import Catalog
from tierlake.operators import ids
from tierlake.sources import ingest


def read(spark: SparkSession, path: str, catalog: Catalog, files_each: int = 16) -> DataFrame:
    """An unbounded frame of documents from JSON lines files put into ``path``; at most ``files_each`` new files a batch.

    doc_id is the whole code of the content, which needs no other document; blank lines are left out, a bad one fails the
    stream.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_each).text(path)
    rows = lines.where("trim(value) <> ''").select(F.lit(None).cast("string").alias("doc_id"), F.lit(None).cast("bigint").alias("doc_pos"), F.col("value").alias("json"))
    return ingest.from_json_lines(rows, catalog).withColumn("doc_id", ids.code(catalog))


def convert(docs: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Hands each batch of documents to ``write`` (batch, number). ``once``: what is there now, then ends; ``checkpoint`` is a shared folder."""
    out = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def to_parquet(docs: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends the documents to Parquet in ``path``, each exactly once also after a restart."""
    out = docs.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out).start()


def counts(docs: DataFrame, values) -> DataFrame:
    """(value, freq): running counts of the items of an array column of streamed documents; use output mode complete or update."""
    return docs.select(F.explode(values).alias("value")).groupBy("value").agg(F.count("*").alias("freq"))
