"""How often texts and values stand in a layer of a corpus."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierlake.errors import LayerNotFoundError
from tierlake.functions.values import literal
from tierlake.operators.layers import Layers, column


def by_python(condition: Callable[[Any], bool], is_value: bool = False) -> Callable[[Column], Column]:
    """A condition of plain Python on texts, or on values as None, text, link or (link, text); asked once for each distinct one."""

    @F.arrow_udf("boolean")
    def asked(x: pa.Array) -> pa.Array:
        items = x.to_pylist()
        if is_value:
            items = [(None, v["t"], v["l"], (v["l"], v["t"]))[v["r"]] for v in items]
        return pa.array([bool(condition(i)) for i in items], pa.bool_())

    return asked


def _condition(item: Column, condition: Any, is_value: bool) -> Column | None:
    if condition is None:
        return None
    if callable(condition):
        return condition(item)
    if isinstance(condition, (list, set, tuple)) and not (is_value and isinstance(condition, tuple)):
        wanted = [literal(c) if is_value else F.lit(c) for c in condition]
        return F.array_contains(F.array(*wanted), item) if wanted else F.lit(False)
    return item == (literal(condition) if is_value else F.lit(condition))


def text_freq(docs: DataFrame, layers: Layers, name: str, condition: Any = None, strict: bool = True) -> DataFrame:
    """(text, freq bigint): the pieces of the layer's text and how often they stand; a condition is a text, a list, or a function of a column.

    ``strict`` raises LayerNotFoundError if a document lacks the layer; else such documents count nothing. Counts are added
    up in the map tasks; the condition is asked of distinct pieces.
    """
    if strict:
        root = layers.catalog.root(name)
        if docs.where(column(name).isNull() | column(root).isNull()).limit(1).count():
            raise LayerNotFoundError(name)
    counted = docs.select(F.explode(layers.text(name)).alias("text")).groupBy("text").agg(F.count("*").alias("freq"))
    wanted = _condition(F.col("text"), condition, False)
    return counted if wanted is None else counted.where(wanted)


def val_freq(docs: DataFrame, layers: Layers, name: str, condition: Any = None) -> DataFrame:
    """(value struct, freq bigint): the values of the layer and how often they stand, nothing included; documents without it count nothing."""
    counted = docs.select(F.explode(layers.data(name)).alias("value")).groupBy("value").agg(F.count("*").alias("freq"))
    wanted = _condition(F.col("value"), condition, True)
    return counted if wanted is None else counted.where(wanted)
