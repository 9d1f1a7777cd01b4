"""Cutting lineage and sizing joins: the shared folder, checkpoints and checked broadcasts."""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import uuid
import zipfile
from importlib.util import find_spec
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Only where the setting is absent (unit tests, a single machine) a temporary folder is made for the session.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/").rpartition("/")[0]
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tierlake-")
    atexit.register(shutil.rmtree, made, True)
    sc.setCheckpointDir("file://" + made)
    return "file://" + made


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder; what follows reads it from there, also when executors are lost."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read from there, so that later filters and columns reach the scan."""
    path = f"{shared_dir(df.sparkSession)}/tierlake-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def sized(df: DataFrame, most_rows: int = 20_000) -> tuple[DataFrame, int]:
    """``df`` cut, with a broadcast hint if it has at most ``most_rows`` rows; larger ones are left to a shuffle join.

    The caller passes narrow rows, so that the bound on rows bounds the bytes. Returns the frame and its row count.
    """
    df = cut(df)
    n = df.count()
    return (F.broadcast(df) if n <= most_rows else df), n


def numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """``df``, cut, with ``name``: the place of each row in the order of ``by``, from 0 without gaps.

    Rows are sorted by range, and only one count a partition is added up, so no task holds the whole order.
    """
    lined = cut(df.sort(*by).withColumn("_at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = lined.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_start"))  # a row for each partition of the sort
    return lined.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + inside).drop("_part", "_at", "_start")


def shared_file(spark: SparkSession, name: str, content: bytes) -> str:
    """Writes ``content`` into the shared folder by Hadoop's file system, hands it to all executors, returns its name for ``SparkFiles.get``."""
    jvm = spark.sparkContext._jvm
    unique = f"{uuid.uuid4().hex}-{name}"
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{unique}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(path)
    try:
        for lo in range(0, len(content), 1 << 20):
            out.write(bytearray(content[lo : lo + (1 << 20)]))
    finally:
        out.close()
    spark.sparkContext.addFile(path.toString())
    return unique


#: Bits that ``likely`` keeps: 128 rows of 4 KB, whatever the number of keys.
KEY_BITS = 1 << 22


def likely(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows of ``df`` whose ``column`` may be among ``keys`` (a column of that name), none of those that are lost.

    The keys' hashes set bits in a map of fixed size (512 KB), which is broadcast, so that wide rows are dropped before
    they are shuffled to a join. With very many keys it lets all pass; the join that follows decides.
    """
    place = F.pmod(F.xxhash64(column), F.lit(KEY_BITS))
    marked = keys.select(place.alias("_p")).groupBy(F.floor(F.col("_p") / 32768).alias("_part")).agg(F.bitmap_construct_agg(F.col("_p") % 32768).alias("_bits"))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    placed = df.withColumn("_part", F.floor(place / 32768)).withColumn("_at", place % 32768)
    met = placed.join(F.broadcast(marked), "_part").where(F.expr("shiftleft(1, cast(_at % 8 as int))").bitwiseAND(byte) != 0)
    return met.select(*[F.col(f"`{c}`") for c in df.columns])


def ship(spark: SparkSession) -> None:
    """Hands this package to the Python workers if they can't import it by themselves; asked once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_tierlake_shipped", False):
        return
    if not all(sc.parallelize(["tierlake"], 1).map(find_spec).map(bool).collect()):
        root = Path(__file__).resolve().parent.parent
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(p.relative_to(root.parent)))
        name = shared_file(spark, "tierlake.zip", out.getvalue())
        sc.addPyFile(f"{shared_dir(spark)}/{name}")
    sc._tierlake_shipped = True
