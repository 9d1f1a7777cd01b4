"""Spark types and literals of values and units."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tierlake.document import value_of

#: A value: rank (0 nothing, 1 text, 2 link, 3 typed link), link and text; structs compare field by field, as values do.
VALUE = "struct<r:tinyint,l:bigint,t:string>"
#: A unit: start and end in the base layer and its value.
UNIT = f"struct<s:int,e:int,d:{VALUE}>"
UNITS = f"array<{UNIT}>"


def value_struct(r: Any, link: Any, text: Any) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_col(r).cast("tinyint").alias("r"), as_col(link).cast("bigint").alias("l"), as_col(text).cast("string").alias("t"))


def literal(x: Any) -> Column:
    """The struct of a literal value."""
    return value_struct(*value_of(x))


def from_columns(text: Column | None = None, link: Column | None = None) -> Column:
    """The value of nullable columns: nothing, text, link or typed link, as they are null or not."""
    t, n = text if text is not None else F.lit(None).cast("string"), link if link is not None else F.lit(None).cast("bigint")
    rank = F.when(n.isNull() & t.isNull(), 0).when(n.isNull(), 1).when(t.isNull(), 2).otherwise(3)
    return value_struct(rank, F.coalesce(n, F.lit(-1)), F.coalesce(t, F.lit("")))


def let(value: Column, use: Any) -> Column:
    """``use(value)`` with ``value`` evaluated once a row, also where ``use`` reads it in a lambda of its own."""
    return F.transform(F.array(value), use)[0]


def shown(v: Column) -> Column:
    """A value as text: the text, ->link, ->link:text, or null."""
    return F.when(v["r"] == 1, v["t"]).when(v["r"] == 2, F.concat(F.lit("->"), v["l"].cast("string"))).when(v["r"] == 3, F.concat(F.lit("->"), v["l"].cast("string"), F.lit(":"), v["t"]))
