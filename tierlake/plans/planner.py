"""Search by inverted indexes: which documents can match, at most how many, and the search itself."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierlake.document import value_of
from tierlake.operators.layers import Layers
from tierlake.operators.predicates import And, In, Or, Query, Value_
from tierlake.plans.shared import stored


def create_index(docs: DataFrame, layers: Layers, name: str) -> DataFrame:
    """(value struct, doc_id, doc_pos): each distinct value of the layer in each document; LayerNotFoundError if it isn't declared."""
    return docs.select(F.explode(F.array_distinct(layers.data(name))).alias("value"), "doc_id", "doc_pos")


def _is(value: object) -> Column:
    """Field by field, since Parquet takes conditions on fields and not on structs."""
    r, link, text = value_of(value)
    return (F.col("value.r") == F.lit(r).cast("tinyint")) & (F.col("value.l") == link) & (F.col("value.t") == text)


def kept(index: DataFrame, name: str = "index") -> DataFrame:
    """The index written once, by value and within it by document; a lookup reads the row groups that can hold its value.

    Ranges of (value, doc_id) are cut by size, so a value that stands in every document is in many partitions.
    """
    return stored(index.repartitionByRange("value", "doc_id").sortWithinPartitions("value", "doc_id"), name)


def _hits(index: DataFrame, values: tuple) -> DataFrame:
    if not values:
        return index.where("false").select("doc_id")
    if len(values) == 1:
        return index.where(_is(values[0])).select("doc_id")
    return index.where(reduce(Column.__or__, map(_is, values))).select("doc_id").distinct()


def candidates(query: Query, indexes: Mapping[str, DataFrame]) -> DataFrame | None:
    """(doc_id) of the documents that can match, or None if no index helps: equality and sets, all of an Or, any of an And."""
    if isinstance(query, Value_) and query.layer in indexes:
        return _hits(indexes[query.layer], (query.value,))
    if isinstance(query, In) and query.layer in indexes:
        return _hits(indexes[query.layer], query.values)
    if isinstance(query, And):
        found = [c for q in query.queries if (c := candidates(q, indexes)) is not None]
        return reduce(lambda a, b: a.join(b, "doc_id", "left_semi"), found) if found else None
    if isinstance(query, Or):
        found = [candidates(q, indexes) for q in query.queries]
        if not found or any(c is None for c in found):
            return None
        return reduce(DataFrame.union, found).distinct()
    return None


def covered(query: Query, indexes: Mapping[str, DataFrame]) -> bool:
    """Whether the candidates are the result: equality and sets over indexed layers, and And and Or of these."""
    if isinstance(query, (Value_, In)):
        return query.layer in indexes
    return isinstance(query, (And, Or)) and bool(query.queries) and all(covered(q, indexes) for q in query.queries)


def search(docs: DataFrame, layers: Layers, query: Query, indexes: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """The documents that match; those that indexes rule out aren't looked at. Order by doc_pos where order matters.

    Where indexes answer the whole query, no layer of the documents is read for it.
    """
    indexes = indexes or {}
    able = candidates(query, indexes)
    if able is None:
        return docs.where(query.column(layers))
    docs = docs.join(able, "doc_id", "left_semi")
    return docs if covered(query, indexes) else docs.where(query.column(layers))


def estimate(docs: DataFrame, query: Query, indexes: Mapping[str, DataFrame]) -> int:
    """At most how many documents match, from indexes alone: an And by its least indexed part, the whole corpus without an index."""
    n = _estimate(query, indexes)
    return docs.count() if n is None else n


def _estimate(query: Query, indexes: Mapping[str, DataFrame]) -> int | None:
    if isinstance(query, And):
        parts = [n for q in query.queries if (n := _estimate(q, indexes)) is not None]
        return min(parts) if parts else None
    found = candidates(query, indexes)
    return None if found is None else found.count()


def refresh(index: DataFrame, touched: DataFrame, docs: DataFrame, layers: Layers, name: str) -> DataFrame:
    """The index after the documents of ``touched`` (doc_id) changed: their entries go, those of their new content in ``docs`` come."""
    kept = index.join(touched, "doc_id", "left_anti").select("value", "doc_id", "doc_pos")
    return kept.union(create_index(docs.join(touched, "doc_id", "left_semi"), layers, name))
