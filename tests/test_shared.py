"""The shared folder, checked broadcasts and the filter before joins."""

from pyspark.sql import functions as F

from tierlake.plans import shared


def test_likely_loses_nothing(spark, monkeypatch):
    rows = spark.range(5000).select(F.col("id").alias("k"), F.lit("x").alias("_part2"))
    keys = spark.range(0, 5000, 7).select(F.col("id").alias("k"))
    for bits in (1 << 22, 1 << 15, 1 << 8):
        monkeypatch.setattr(shared, "KEY_BITS", bits)
        got = {r["k"] for r in shared.likely(rows, keys, "k").collect()}
        assert got >= set(range(0, 5000, 7)) and (bits < 1 << 20 or len(got) < 800)
    assert shared.likely(rows, keys.where("false"), "k").count() == 0 and shared.likely(rows, keys, "k").columns == rows.columns


def test_sized_hints_only_small_frames(spark):
    small, n = shared.sized(spark.range(10).toDF("k"), most_rows=10)
    large, m = shared.sized(spark.range(11).toDF("k"), most_rows=10)
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert (n, m) == (10, 11) and hinted(small) and not hinted(large)


def test_files_reach_the_workers(spark):
    name = shared.shared_file(spark, "thing", bytes(range(256)) * 5000)

    def size(batches):
        import pyarrow as pa
        from pyspark import SparkFiles

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(open(SparkFiles.get(name), "rb").read())])], ["n"])

    assert spark.range(1).mapInArrow(size, "n bigint").first()[0] == 256 * 5000
