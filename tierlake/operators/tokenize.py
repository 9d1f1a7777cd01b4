"""The simple tokenizer: runs of letters and digits, and every other character that isn't white space, by bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierlake.functions.arrays import running_sum
from tierlake.functions.values import literal

#: Every character falls into a run of word characters, one other character, or a run of white space.
PATTERN = r"[\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}\p{IsWhite_Space}]|\p{IsWhite_Space}+"
#: The same in classes that SQL engines share; differs where letters aren't alphabetic or spaces aren't ASCII.
SHARED = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]|\s+"


def _pieces(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _placed(pieces: Column, ends: Column, pattern: str) -> Column:
    placed = F.zip_with(pieces, ends, lambda t, e: F.struct((e - F.octet_length(t)).alias("s"), e.alias("e"), t.alias("token")))
    blank = r"^[\s\p{IsWhite_Space}]" if pattern == PATTERN else r"^\s"
    return F.filter(placed, lambda x: ~x["token"].rlike(blank))


def _ends(pieces: Column) -> Column:
    return running_sum(F.transform(pieces, lambda t: F.octet_length(t)))


def tokens(text: Column, pattern: str = PATTERN) -> Column:
    """array<struct<s, e, token>>: the tokens of a text with their bytes; null for null, empty for an empty text.

    As one expression it runs the pattern for the places and again for the tokens; ``tokenized`` runs it once.
    """
    pieces = _pieces(text, pattern)
    return _placed(pieces, _ends(pieces), pattern)


def tokenized(docs: DataFrame, text: str = "text", out: str = "tokens", pattern: str = PATTERN) -> DataFrame:
    """``docs`` with the column ``out`` of ``tokens``, in steps that each read the last one's column."""
    cut = docs.withColumn("_pieces", _pieces(F.col(text), pattern))
    placed = cut.withColumn("_ends", _ends(F.col("_pieces")))
    return placed.withColumn(out, _placed(F.col("_pieces"), F.col("_ends"), pattern)).drop("_pieces", "_ends")


def token_spans(text: Column, pattern: str = PATTERN) -> Column:
    """The tokens as the units of a span layer."""
    return F.transform(tokens(text, pattern), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), literal(None).alias("d")))
