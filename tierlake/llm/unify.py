"""Problem 3: one consistent form for texts that look the same but differ in their characters.

Confusables skeleton: each text is decomposed, each character replaced by its prototype from the look-alike table
(widths, kinds of spaces, invisible marks, letters of other scripts), decomposed again; texts are grouped by equal
skeleton, each skeleton by its 128-bit hash.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierlake.llm import vec
from tierlake.llm.chars import forms, skeleton
from tierlake.plans.shared import cut

#: Up to so many pairs between two classes of exact copies are listed in full; beyond, one member stands for its class.
FULL_PAIRS = 64


def skeletons(texts: list[str]) -> list[np.ndarray]:
    """The skeleton of each text, as code points, all texts at once; those whose marks stand out of order one by one."""
    size, at, flat, rank = forms()
    cp, ends = vec.points(texts)
    n = size[cp]
    upto = np.cumsum(n)
    form = flat[np.repeat(at[cp] - (upto - n), n) + np.arange(int(upto[-1]))]
    cuts = upto[ends]  # each text's NUL stays one character
    out = np.split(form, cuts)[:-1]
    r = rank[form]
    wrong = np.flatnonzero((r[1:] > 0) & (r[:-1] > r[1:])) + 1
    for k in np.unique(np.searchsorted(cuts, wrong, "right")).tolist():
        out[k] = np.frombuffer((skeleton(texts[k]) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def forms_of(docs: DataFrame) -> DataFrame:
    """(doc_id, form string): the consistent form of each text, its skeleton put together again; null stays null, empty stays empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in vec.rows(batches):
            out = [unicodedata.normalize("NFC", f[:-1].tobytes().decode("utf-32-le", "surrogatepass")) for f in skeletons(texts)]
            null = batch.column(1).is_null().to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if n else x for n, x in zip(null, out)], pa.string())], ["doc_id", "form"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, form string")


def form_hashes(texts: list[str]) -> list[bytes | None]:
    """A 128-bit hash of each text's consistent form; None for blank texts."""
    return [None if not t or t.isspace() or len(f) < 2 else blake2b(f, digest_size=16).digest() for t, f in zip(texts, skeletons(texts))]


def form_classes(texts: list[str]) -> list[int | None]:
    """The first half of ``form_hashes``, as ``hashed`` gives it in form_a."""
    return [None if h is None else int.from_bytes(h[:8], "little", signed=True) for h in form_hashes(texts)]


def hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, form_a, form_b, exact): two halves of the hash of each text's consistent form, and a hash of the text itself.

    Blank texts (null, empty, white space or invisible marks alone) have no row. A doc_id that stands twice keeps both rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in vec.rows(batches):
            hashes = form_hashes(texts)
            seen = [k for k, h in enumerate(hashes) if h]
            both = np.frombuffer(b"".join(hashes[k] for k in seen), np.int64).reshape(-1, 2)
            exact = np.frombuffer(b"".join(blake2b(texts[k].encode("utf-8", "surrogatepass"), digest_size=8).digest() for k in seen), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(seen, pa.int64())), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(exact)], ["doc_id", "form_a", "form_b", "exact"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, form_a bigint, form_b bigint, exact bigint")


def variants(hashes: DataFrame) -> DataFrame:
    """(form_a, form_b, exact, head, copies): each distinct text among texts of equal form, its smallest doc_id and its count."""
    return hashes.groupBy("form_a", "form_b", "exact").agg(F.min("doc_id").alias("head"), F.count_distinct("doc_id").alias("copies"))


def ordered(a: str | Column, b: str | Column) -> list[Column]:
    return [F.least(a, b).alias("doc_id_a"), F.greatest(a, b).alias("doc_id_b")]


def spread(links: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of documents from links between classes of exact copies.

    links: (class_a, class_b, n_a, n_b, head_a, head_b); members: (class, doc_id). Two classes give all their pairs up to
    FULL_PAIRS; beyond, each member is paired with the other class's head, which with the membership still tells every pair.
    """
    a = members.select(F.col("class").alias("class_a"), F.col("doc_id").alias("a"))
    b = members.select(F.col("class").alias("class_b"), F.col("doc_id").alias("b"))
    few = F.col("n_a") * F.col("n_b") <= FULL_PAIRS
    many = links.where(~few)
    full = links.where(few).join(a, "class_a").join(b, "class_b").select(*ordered("a", "b"))
    to_head = many.join(a, "class_a").select(*ordered("a", "head_b")).union(many.join(b, "class_b").select(*ordered("head_a", "b")))
    return full.union(to_head.distinct()).where("doc_id_a < doc_id_b")


def copies(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs within classes: all with all where that is at most FULL_PAIRS, else each member with the head."""
    inside = members.select("class", "doc_id").join(sizes.where("n > 1"), "class")
    small = F.col("n") * (F.col("n") - 1) <= 2 * FULL_PAIRS
    few = inside.where(small)
    all_with_all = few.select("class", F.col("doc_id").alias("a")).join(few.select("class", F.col("doc_id").alias("b")), "class").where("a < b").select(*ordered("a", "b"))
    return all_with_all.union(inside.where(~small).where("doc_id <> head").select(*ordered("head", "doc_id")))


def lookalike_pairs(docs: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: documents whose texts have one consistent form but aren't the same characters.

    Blank texts take no part. Pairs of exact copies aren't listed; copies take part as ``spread`` says. An empty table
    gives no rows; repeated rows of one document count once.
    """
    hashes = cut(hashed(docs).distinct())
    kinds = variants(hashes)
    several = kinds.groupBy("form_a", "form_b").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    some = cut(kinds.join(several, ["form_a", "form_b"]).withColumn("class", F.xxhash64("form_a", "form_b", "exact")))
    left = some.select("form_a", "form_b", F.col("exact").alias("exact_a"), F.col("class").alias("class_a"), F.col("copies").alias("n_a"), F.col("head").alias("head_a"))
    right = some.select("form_a", "form_b", F.col("exact").alias("exact_b"), F.col("class").alias("class_b"), F.col("copies").alias("n_b"), F.col("head").alias("head_b"))
    links = left.join(right, ["form_a", "form_b"]).where("exact_a < exact_b").select("class_a", "class_b", "n_a", "n_b", "head_a", "head_b")
    members = hashes.join(some, ["form_a", "form_b", "exact"]).select("class", "doc_id")
    return spread(links, members)


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, group_id, n_texts): each non-blank document with the smallest doc_id among texts that look the same, and how many different texts these are."""
    hashes = cut(hashed(docs).distinct())
    per = variants(hashes).groupBy("form_a", "form_b").agg(F.min("head").alias("group_id"), F.count("*").alias("n_texts"))
    return hashes.join(per, ["form_a", "form_b"]).select("doc_id", "group_id", "n_texts")
