"""Changes of a corpus as joins: documents added, layers replaced, documents removed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlake.meta import Catalog
from tierlake.operators import ids


def add(docs: DataFrame, new: DataFrame, catalog: Catalog) -> DataFrame:
    """``docs`` and the documents of ``new`` (doc_pos gives their order) after them, with ids by content."""
    last = docs.agg(F.max("doc_pos")).first()[0]
    placed = new.withColumn("doc_pos", F.col("doc_pos") + F.lit(0 if last is None else last + 1))
    return docs.unionByName(ids.assign(placed, catalog, docs.select("doc_id")), allowMissingColumns=True)


def update(docs: DataFrame, patch: DataFrame, catalog: Catalog, by: str = "doc_id") -> DataFrame:
    """``docs`` with the layers of ``patch`` (doc_id and some layers; null leaves a layer as it is); places stay.

    ``by`` is the column of both by which documents are told. Copies of a text whose prefixes are all taken share its whole code as
    doc_id; where there may be so many, ``by`` is doc_pos.

    Each changed document takes the shortest id that is free of all documents that aren't changed, its own old id included.
    Rows of ``patch`` that no document has change nothing.
    """
    names = [c for c in patch.columns if c in catalog]
    fresh = patch.select(by, *[F.col(n).alias(f"_new_{n}") for n in names])
    touched = docs.join(fresh, by)
    for n in names:
        touched = touched.withColumn(n, F.coalesce(f"_new_{n}", n)).drop(f"_new_{n}")
    kept = docs.join(patch.select(by), by, "left_anti").select(*docs.columns)
    return kept.unionByName(ids.assign(touched, catalog, kept.select("doc_id")))


def remove(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without those of ``gone`` (doc_id); ids that aren't there change nothing."""
    return docs.join(gone.select("doc_id").distinct(), "doc_id", "left_anti")


def reorder(docs: DataFrame, order: DataFrame) -> DataFrame:
    """``docs`` at the places that ``order`` (doc_id, pos) gives; documents that it doesn't name are gone from the order."""
    kept = docs.select(*[f"`{c}`" for c in docs.columns if c != "doc_pos"])
    return kept.join(order.select("doc_id", F.col("pos").cast("bigint").alias("doc_pos")), "doc_id")
