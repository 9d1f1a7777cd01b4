"""Identity of documents by content: the shortest free prefix, of 4 characters or more, of a Base64 SHA-256."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Mapping
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierlake.meta import Catalog
from tierlake.operators.layers import column
from tierlake.plans.shared import cut, sized

SHORTEST, LONGEST = 4, 44
#: Prefixes that a code has.
LENGTHS = LONGEST - SHORTEST + 1


def code_of(content: Mapping[str, Any], catalog: Catalog) -> str:
    """The whole code of a document: names and texts of its characters layers, sorted by name, a zero byte after each."""
    h = hashlib.sha256()
    for name in catalog.characters():
        if isinstance(content.get(name), str):
            h.update(name.encode() + b"\0" + content[name].encode() + b"\0")
    return base64.b64encode(h.digest()).decode()


def code(catalog: Catalog) -> Column:
    """``code_of`` as a column; documents without characters layers have the code of nothing."""
    zero = F.lit(bytearray(b"\0"))
    parts = [F.coalesce(F.concat(F.encode(F.lit(n), "UTF-8"), zero, F.encode(column(n), "UTF-8"), zero), F.lit(bytearray(b""))) for n in catalog.characters()]
    whole = F.concat(*parts) if parts else F.lit(bytearray(b""))
    return F.base64(F.unhex(F.sha2(whole, 256)))


def shortest_free(full: str, taken: set[str]) -> str:
    """The shortest prefix that isn't taken; the whole code if all are."""
    for n in range(SHORTEST, len(full)):
        if full[:n] not in taken:
            return full[:n]
    return full


def assign(docs: DataFrame, catalog: Catalog, existing: DataFrame | None = None) -> DataFrame:
    """``docs`` with doc_id as if each were added in the order of doc_pos, to a corpus that has the ids ``existing`` (doc_id).

    Ids only meet within their first four characters, so each such group is settled by itself, on narrow rows that are
    cut once: a document alone in its group has these four; where a group has one code alone, lengths follow from the rank
    of a copy; mixed groups are folded. Each copy of a code takes one of its prefixes, so from the LENGTHS-th on copies
    have the whole code: they are ranked no further (Spark keeps the least LENGTHS of a code in each task before it
    shuffles) and never folded, so a group that is folded holds LENGTHS rows for each of its distinct codes, whatever the
    number of copies. Only documents with more than four characters are joined back.
    """
    coded = docs.withColumn("_code", code(catalog))
    keys = cut(coded.select("doc_pos", "_code", F.left("_code", F.lit(SHORTEST)).alias("_head")))
    old = None if existing is None else existing.select(F.col("doc_id").alias("_code"), F.left("doc_id", F.lit(SHORTEST)).alias("_head"))
    heads = keys.groupBy("_head").agg(F.min("_code").alias("lo"), F.max("_code").alias("hi"), F.count("*").alias("n"))
    fresh = F.lit(True)
    if old is not None:
        heads = heads.join(old.select("_head").distinct().withColumn("old", F.lit(True)), "_head", "left")
        fresh = F.col("old").isNull()
    heads = heads.select("_head", ((F.col("lo") == F.col("hi")) & fresh).alias("_plain"), "n").where("not _plain or n > 1").drop("n")
    several = keys.join(heads, "_head")
    rank = F.row_number().over(Window.partitionBy("_code").orderBy("doc_pos"))
    ranked = cut(several.withColumn("_rank", rank).where(F.col("_rank") <= LENGTHS))
    simple = ranked.where("_plain").select("doc_pos", F.expr(f"left(_code, {SHORTEST - 1} + _rank)").alias("_id"))
    whole = several.join(ranked.select("doc_pos"), "doc_pos", "left_anti").select("doc_pos", F.col("_code").alias("_id"))

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        taken = set(group.loc[group["_old"], "_code"])
        new = group[~group["_old"]].sort_values("doc_pos")
        out = []
        for full in new["_code"]:
            out.append(shortest_free(full, taken))
            taken.add(out[-1])
        return pd.DataFrame({"doc_pos": new["doc_pos"], "_id": out})

    rows = ranked.where("not _plain").select("_head", F.col("doc_pos").cast("bigint").alias("doc_pos"), "_code", F.lit(False).alias("_old"))
    if old is not None:
        rows = rows.union(old.join(rows.select("_head").distinct(), "_head", "left_semi").distinct().select("_head", F.lit(-1).cast("bigint"), "_code", F.lit(True)))
    folded = rows.groupBy("_head").applyInPandas(fold, "doc_pos bigint, _id string")
    longer, _ = sized(simple.union(whole).union(folded))
    settled = coded.drop("doc_id").join(longer, "doc_pos", "left")
    return settled.withColumn("doc_id", F.coalesce("_id", F.left("_code", F.lit(SHORTEST)))).drop("_id", "_code")
