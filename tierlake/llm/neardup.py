"""Problem 7: near-duplicate texts, by a multi-index Hamming join of b-bit minhash signatures.

A signature has CHUNKS chunks of WIDTH symbols; each symbol holds the 16 lowest bits of the smallest hash of the text's
word runs under one of CHUNKS x WIDTH hash functions, so two signatures differ in about (1 - similarity) of their
symbols. By the pigeonhole principle two signatures with at most CHUNKS x (ERRORS + 1) - 1 differing symbols have a
chunk with at most ERRORS of them; each chunk is therefore entered under every choice of WIDTH - ERRORS symbols, and
pairs that meet anywhere are checked exactly on their runs of words.

Skew: texts of one consistent form are joined as one class first. Signatures are of whole texts, lines that many texts
share included, so that families of edited copies meet however large they are. Texts that have little but a site's
notices in common meet by chance too; the signatures of those that meet are compared before their texts are. Keys of many
texts are dealt into parts, and the signatures of two parts compared at a time, before any pair is written.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlake.llm import unify, vec
from tierlake.llm.shingles import folded, triple_sets, triples
from tierlake.plans.shared import cut, likely

CHUNKS, WIDTH, ERRORS = 20, 4, 1
#: Texts that meet are compared from so many equal symbols on; at similarity 0.5 fewer of 80 have a probability below 1e-5.
EQUAL = 20
#: Pairs that a task holds at once.
BLOCK = 1 << 20
#: Classes of a key from which on it is dealt into parts, and about how many classes a part has.
HOT, SPLIT = 256, 512

_K = CHUNKS * WIDTH
_XOR = (vec.mix(np.arange(1, _K + 1, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
_MUL = (vec.mix(np.arange(5001, 5001 + _K, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)
_CHOICES = list(combinations(range(WIDTH), WIDTH - ERRORS))
_KEYS = CHUNKS * len(_CHOICES)
_CHUNK_SALT = vec.mix(np.arange(9001, 9001 + _KEYS, dtype=np.uint64)).reshape(len(_CHOICES), CHUNKS)


def signatures(h: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the texts that have triples, their signatures as rows of 16-bit symbols)."""
    have, starts = np.unique(text, return_index=True)
    if not len(have):
        return have, np.zeros((0, _K), np.uint16)
    low = (h >> np.uint64(32)).astype(np.uint32)
    out = np.empty((_K, len(have)), np.uint16)
    for k in range(_K):
        x = (low ^ _XOR[k]) * _MUL[k]
        out[k] = np.minimum.reduceat(x ^ (x >> np.uint32(15)), starts).astype(np.uint16)
    return have, out.T


def keys_of(signature: np.ndarray) -> np.ndarray:
    """The keys of each signature (one row each): a hash of each chunk's symbols with each allowed choice of errors left out."""
    wide = signature.astype(np.uint64).reshape(len(signature), CHUNKS, WIDTH)
    out = np.empty((len(signature), CHUNKS, len(_CHOICES)), np.uint64)
    for c, choice in enumerate(_CHOICES):
        packed = np.zeros(wide.shape[:2], np.uint64)
        for k in choice:
            packed = (packed << np.uint64(16)) | wide[:, :, k]
        out[:, :, c] = packed + _CHUNK_SALT[c]
    return vec.mix(out.reshape(-1)).reshape(len(signature), _KEYS)


def signed(docs: DataFrame, size: int) -> DataFrame:
    """(class, signature): the signature of each distinct consistent form that has runs of ``size`` words, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for _, texts in vec.rows(batches):
            names, mine = [], []
            for name, t in zip(unify.form_classes(texts), texts):
                if name is not None and name not in done:
                    done.add(name)
                    names.append(name)
                    mine.append(t)
            if not mine:
                continue
            have, signature = signatures(*triples(*folded(mine), size), len(mine))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(names, np.int64)[have]), pa.array([x.tobytes() for x in signature], pa.binary())], ["class", "signature"])

    return docs.select("text").where("text <> ''").mapInArrow(run, "class bigint, signature binary").dropDuplicates(["class"])


def _unpacked(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    rows = column.to_pylist()
    return np.zeros((0, 1), kind) if not rows else np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def entries(marks: DataFrame) -> DataFrame:
    """(key, class): the entries in the index of each class of ``signed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                keys = keys_of(_unpacked(part.column(1), np.uint16))
                yield pa.RecordBatch.from_arrays([pa.array(vec.signed(keys.reshape(-1))), pa.array(np.repeat(np.asarray(part.column(0)), _KEYS))], ["key", "class"])

    return marks.select("class", "signature").mapInArrow(run, "key bigint, class bigint")


def alike(met: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs (a, b) of ``met`` whose signatures have EQUAL equal symbols or more, told by 4 bits of each symbol (other symbols look equal now and then, none that are equal differ)."""

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = (_unpacked(batch.column(1), np.uint16) & np.uint16(15)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([y.tobytes() for y in (x[:, ::2] << 4) | x[:, 1::2]], pa.binary())], ["class", "short"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _unpacked(batch.column(2), np.uint8) ^ _unpacked(batch.column(3), np.uint8)
                equal = (x >> 4 == 0).sum(1) + (x & 15 == 0).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(equal >= EQUAL))

    brief = marks.where("class is not null").mapInArrow(short, "class bigint, short binary")
    for side in "ab":
        met = met.join(brief.select(F.col("class").alias(side), F.col("short").alias(f"short_{side}")), side)
    return met.select("a", "b", "short_a", "short_b").mapInArrow(run, "a bigint, b bigint")


def meeting(index: DataFrame, marks: DataFrame) -> DataFrame:
    """(a, b), a < b: classes that have a key in common and signatures with EQUAL equal symbols or more.

    Entries come sorted by key and are paired key by key, so a task holds a batch and one key. A key of more than HOT classes
    isn't paired there; see ``hot_pairs``.
    """

    def pairs_of(key: np.ndarray, doc: np.ndarray) -> Iterator[np.ndarray]:
        left, edge, step = np.arange(len(key)), np.searchsorted(key, key, "right"), 1
        while len(left):
            left = left[left + step < edge[left]]
            for lo in range(0, len(left), BLOCK):
                part = left[lo : lo + BLOCK]
                both = np.stack([doc[part], doc[part + step]], 1)
                both.sort(1)
                yield both[both[:, 0] != both[:, 1]]
            step += 1

    def rows(key: np.ndarray | None, a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        nulls = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([nulls if key is None else pa.array(key), pa.array(a), nulls if b is None else pa.array(b)], ["key", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, doc = np.zeros(0, np.int64), np.zeros(0, np.int64)
        spilling: int | None = None  # the hot key whose entries are handed on as they come
        packed: list[np.ndarray] = []
        size = 0
        for batch in (*batches, None):
            if batch is not None:
                key, doc = np.append(key, np.asarray(batch.column(0))), np.append(doc, np.asarray(batch.column(1)))
            if spilling is not None:
                n = int(np.searchsorted(key, spilling, "right"))
                yield rows(key[:n], doc[:n], None)
                spilling = spilling if n == len(key) else None
                key, doc = key[n:], doc[n:]
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            if batch is None:
                last = len(key)
            elif len(key) - last > HOT:
                spilling, last = int(key[-1]), len(key)
            done, mine = key[:last], doc[:last]
            key, doc = key[last:], doc[last:]
            count = np.searchsorted(done, done, "right") - np.searchsorted(done, done)
            hot = count > HOT
            if hot.any():
                yield rows(done[hot], mine[hot], None)
                done, mine = done[~hot], mine[~hot]
            for both in pairs_of(done, mine):
                packed.append(both)
                size += len(both)
                if size >= BLOCK:
                    out = np.unique(np.concatenate(packed), axis=0)
                    packed, size = [], 0
                    yield rows(None, out[:, 0], out[:, 1])
        if packed:
            out = np.unique(np.concatenate(packed), axis=0)
            yield rows(None, out[:, 0], out[:, 1])

    sorted_ = index.select("key", "class").repartition("key").sortWithinPartitions("key")
    met = cut(sorted_.mapInArrow(run, "key bigint, a bigint, b bigint").distinct())
    near = alike(met.where("key is null").select("a", "b").distinct(), marks)
    hot = met.where("key is not null").select("key", F.col("a").alias("class"))
    return near.union(hot_pairs(hot, marks)).distinct() if hot.head(1) else near


def hot_pairs(hot: DataFrame, marks: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs within the keys of ``hot`` (key, class) whose signatures have EQUAL equal symbols or more.

    The classes of a key are dealt into parts of about SPLIT, and each pair of parts is one group: no group grows with the key,
    and only pairs that pass the comparison leave it.
    """
    parts = F.ceil(F.col("n") / SPLIT)
    sizes = hot.groupBy("key").agg(F.count("*").alias("n"))
    dealt = hot.join(sizes, "key").join(marks.select("class", "signature"), "class").withColumn("part", F.pmod(F.xxhash64("class"), parts))
    each = dealt.select("key", "class", "signature", "part", F.explode(F.sequence(F.lit(0).cast("bigint"), (parts - 1).cast("bigint"))).alias("other"))
    grouped = each.select("key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "class", "signature")

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches))
        name, part, sig = np.asarray(held.column("class")), np.asarray(held.column("part")), _unpacked(held.column("signature"), np.uint16)
        left, right = np.flatnonzero(part == key[1].as_py()), np.flatnonzero(part == key[2].as_py())
        out = []
        for lo in range(0, len(left), 64):
            rows = left[lo : lo + 64]
            i, j = np.nonzero((sig[rows][:, None, :] == sig[right][None]).sum(2, dtype=np.uint8) >= EQUAL)
            out.append(np.stack([name[rows[i]], name[right[j]]], 1))
        both = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        both.sort(1)
        both = np.unique(both[both[:, 0] != both[:, 1]], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    return grouped.groupBy("key", "lo", "hi").applyInArrow(run, "a bigint, b bigint")


def similar(pairs: DataFrame, docs: DataFrame, threshold: float, size: int) -> DataFrame:
    """(a, b, similarity) of the pairs whose distinct runs of ``size`` words have at least that Jaccard similarity; exact, on whole texts."""
    some = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = likely(docs.select("doc_id", "text"), some, "doc_id").join(some, "doc_id")  # a semi-join would be moved below the filter
    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                n = part.num_rows
                sets = triple_sets(part.column(2).to_pylist() + part.column(3).to_pylist(), size)
                score = np.zeros(n)
                for k in range(n):
                    x, y = sets[k], sets[n + k]
                    if len(x) and len(y):
                        either = len(np.unique(np.concatenate([x, y])))
                        score[k] = (len(x) + len(y) - either) / either
                yes = pa.array(score >= threshold)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score)], ["a", "b", "similarity"]).filter(yes)

    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint, similarity double").distinct()  # rows of a document that stand twice meet twice


def links(docs: DataFrame, threshold: float = 0.8, size: int = 5) -> tuple[DataFrame, DataFrame]:
    """(links between classes of one form: class_a, class_b, n_a, n_b, head_a, head_b, similarity; members: class, exact, doc_id, exact being a hash of the text itself)."""
    docs = docs.select("doc_id", "text")
    members = cut(unify.hashed(docs).select("doc_id", F.col("form_a").alias("class"), "exact").distinct())
    classes = members.groupBy("class").agg(F.min("doc_id").alias("head"), F.count_distinct("doc_id").alias("copies"))
    marks = cut(signed(docs, size))
    met = meeting(entries(marks), marks)
    for side in "ab":
        met = met.join(classes.select(F.col("class").alias(side), F.col("head").alias(f"head_{side}"), F.col("copies").alias(f"n_{side}")), side).withColumnRenamed(side, f"class_{side}")
    met = cut(met)
    close = similar(met.select(F.col("head_a").alias("a"), F.col("head_b").alias("b")), docs, threshold, size)
    return met.join(close.select(F.col("a").alias("head_a"), F.col("b").alias("head_b"), "similarity"), ["head_a", "head_b"]), members


def near_pairs(docs: DataFrame, threshold: float = 0.5, size: int = 3) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: documents of similarity ``threshold`` or more, and those of one consistent form.

    Similarity: distinct runs of ``size`` words that both hold, over those that either holds. Blank texts take no part;
    texts without such a run only pair within their form. Large classes of exact copies are listed as ``unify.spread`` says: within
    a class, each member with its head and, up to FULL_PAIRS pairs, all with all. Different texts, of one form or of two, are
    classes of their own there, so none of their links is left out.
    """
    found, members = links(docs, threshold, size)
    kinds = cut(members.groupBy("class", "exact").agg(F.min("doc_id").alias("head"), F.count_distinct("doc_id").alias("n")))
    kind = F.xxhash64("class", "exact")
    side = lambda x: kinds.select(F.col("class").alias(f"form_{x}"), kind.alias(f"class_{x}"), F.col("n").alias(f"n_{x}"), F.col("head").alias(f"head_{x}"), F.col("exact").alias(f"exact_{x}"))
    columns = ["class_a", "class_b", "n_a", "n_b", "head_a", "head_b"]
    apart = found.select(F.col("class_a").alias("form_a"), F.col("class_b").alias("form_b")).join(side("a"), "form_a").join(side("b"), "form_b")
    several = kinds.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select(F.col("class").alias("form_a"))
    within = side("a").join(several, "form_a").join(side("b").withColumnRenamed("form_b", "form_a"), "form_a").where("exact_a < exact_b")
    named = members.select(kind.alias("class"), "doc_id")
    pairs = unify.spread(cut(apart.select(columns).union(within.select(columns))), named)
    return pairs.union(unify.copies(named, kinds.select(kind.alias("class"), "head", "n"))).distinct()


def groups(docs: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """(doc_id, group_id, n_links): each non-blank document with the smallest doc_id of the chain of links it is in, and its number of linked texts."""
    found, members = links(docs, threshold, size)
    edges = cut(found.select("head_a", "head_b"))
    members = members.select("class", "doc_id").distinct()
    label = components(edges.toDF("a", "b"))
    degree = edges.select(F.explode(F.array("head_a", "head_b")).alias("head")).groupBy("head").agg(F.count("*").alias("n_links"))
    of = members.join(members.groupBy("class").agg(F.min("doc_id").alias("head")), "class")
    out = of.join(label.withColumnRenamed("node", "head"), "head", "left").join(degree, "head", "left")
    return out.select("doc_id", F.coalesce("label", "head").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of the connected component of each node of ``edges`` (a, b).

    Alternating large and small stars: each turn ties every node's larger neighbours to the smallest one and cuts the
    lineage, until nothing changes. Nothing but counts reaches the driver.
    """
    star = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        both = star.union(star.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(star).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        new = cut(small)
        same = new.count() == star.count() and not new.join(star, ["a", "b"], "left_anti").head(1)
        star = new
        if same:
            break
    return star.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node").union(star.select(F.col("b").alias("node"), F.col("b").alias("label")).join(star.select(F.col("a").alias("node")), "node", "left_anti").distinct())
