"""The test tables as a corpus: documents with their annotations, and some layers made from their texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlake.functions.arrays import running_sum
from tierlake.functions.values import UNITS, from_columns, literal
from tierlake.meta import Catalog
from tierlake.operators.layers import Layers

# The tag set of the layer pos in the test data.
TAGS = ["NOUN", "VERB", "ADJ", "ADV", "DET", "PRON", "ADP", "PUNCT", "NUM", "PROPN", "AUX", "CCONJ", "SCONJ"]

CATALOG = Catalog.from_dict(
    {
        "text": {"type": "characters"},
        "words": {"type": "span", "base": "text"},
        "pos": {"type": "seq", "base": "words", "data": TAGS},
        "lemma": {"type": "seq", "base": "words", "data": "string"},
        "entities": {"type": "span", "base": "words", "data": "string"},
        "prev": {"type": "element", "base": "words", "data": "link", "target": "words"},
        "lines": {"type": "div", "base": "text"},
        "tens": {"type": "div", "base": "words"},
        "document": {"type": "div", "base": "text"},
        "lang": {"type": "seq", "base": "document", "data": "string"},
        "source": {"type": "seq", "base": "document", "data": "string"},
    }
)
#: Spans of the test data may reach past their text.
LAYERS = Layers(CATALOG, bounds="clip")
ANNOTATED = ("words", "pos", "lemma", "entities", "prev")


def annotated(annotations: DataFrame, names: Sequence[str] = ANNOTATED) -> DataFrame:
    """(doc_id, a column of units for each layer of ``names``): rows that are repeated whole count once; null for a layer without rows.

    Only rows of these layers leave the scan.
    """
    value = from_columns(F.col("datum"), F.col("link_to").cast("bigint"))
    unit = F.struct("ord", F.col("unit_from").alias("s"), F.col("unit_to").alias("e"), value.alias("d"))
    known = annotations.where(F.col("layer").isin(*names) & F.col("doc_id").isNotNull() & F.col("ord").isNotNull())
    sets = [F.collect_set(F.when(F.col("layer") == n, unit)).alias(n) for n in names]
    each = known.groupBy("doc_id").agg(*sets)
    units = lambda n: F.when(F.size(n) > 0, F.transform(F.array_sort(n), lambda u: F.struct(u["s"].alias("s"), u["e"].alias("e"), u["d"].alias("d"))))
    return each.select("doc_id", *[units(n).cast(UNITS).alias(n) for n in names])


def line_units(text: Column) -> Column:
    """The lines of a text as segments: where each starts, to where the next one does."""
    sizes = F.transform(F.split(text, "\n", -1), lambda x: (F.octet_length(x) + 1).cast("int"))
    ends = running_sum(sizes)
    return F.zip_with(sizes, ends, lambda n, e: F.struct((e - n).alias("s"), F.least(e, F.octet_length(text)).alias("e"), literal(None).alias("d"))).cast(UNITS)


def needed(*names: str) -> list[str]:
    """The annotated layers that the layers ``names`` are made of or stand on; all if none are named."""
    wanted = {x for n in names if n in CATALOG for x in CATALOG.chain(n)} if names else set(CATALOG)
    wanted |= {CATALOG[n].target for n in wanted if CATALOG[n].target}
    return [n for n in ANNOTATED if n in wanted]


def corpus(spark: SparkSession, d: str, *names: str) -> DataFrame:
    """All documents of the test data with the layers of CATALOG; doc_id as it stands, doc_pos the same.

    With ``names``, those annotated layers alone that these need; without any of them annotations aren't read.
    """
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("doc_id").alias("doc_pos"), "text", F.col("lang").alias("_lang"), F.col("source").alias("_source"), "url")
    some = needed(*names)
    if some:
        docs = docs.join(annotated(spark.read.parquet(f"{d}/annotations.parquet"), some), "doc_id", "left")
    one = lambda name: F.array(F.struct(F.lit(0).alias("s"), F.lit(1).alias("e"), from_columns(F.col(name)).alias("d"))).cast(UNITS)
    whole = F.when(F.col("text").isNotNull(), F.array(F.struct(F.lit(0).alias("s"), F.octet_length("text").alias("e"), literal(None).alias("d")))).cast(UNITS)
    extra = F.when(F.col("url").isNotNull(), F.create_map(F.lit("_url"), F.to_json(F.array("url")))).otherwise(F.expr("cast(map() as map<string,string>)"))
    made = [line_units(F.col("text")).alias("lines"), whole.alias("document"), one("_lang").alias("lang"), one("_source").alias("source"), extra.alias("_extra")]
    if "words" in some:
        n = F.size("words")
        starts = F.when(F.col("words").isNotNull(), F.sequence(F.lit(0), n - 1, F.lit(10)))
        made.append(F.transform(starts, lambda i: F.struct(i.alias("s"), F.least(i + 10, n).alias("e"), literal(None).alias("d"))).cast(UNITS).alias("tens"))
    return docs.select("doc_id", "doc_pos", "text", *some, *made)
