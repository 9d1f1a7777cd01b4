"""Problem 10: long exact spans shared between records, by compaction of a de Bruijn graph of sampled k-mers.

Nodes are k-mers that ``anchors`` samples (any shared run of SPAN characters holds a common one); edges join successive
ones of a text. Nodes of at least two different texts are kept; runs of them without a branch are joined with the counts
of their neighbours and compacted to one path each, so texts meet once a path, not once a k-mer. Where two texts meet,
their source coordinates are followed left and right over the texts themselves, which decides.

Skew: exact copies are one class, entered once a task. A path of more than HOT classes (a notice that a site repeats)
doesn't pair its classes; its places are entered again under the hashes of the SPAN - 10 characters around them, which
every shared run of SPAN characters over such a place has in common, and only those meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierlake.llm import vec
from tierlake.llm.anchors import K, SPAN, sampled, window_hashes
from tierlake.llm.unify import copies, spread
from tierlake.plans.shared import cut, likely

#: Classes of a path from which on its places are refined.
HOT = 200
#: Step of the places at which the text around a hot place is hashed; see ``refined``.
STEP = 10


def text_class(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def classes(docs: DataFrame) -> DataFrame:
    """(class, doc_id, n_chars) of each text of SPAN characters or more; the class is a hash of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in vec.rows(batches):
            at = [k for k, t in enumerate(texts) if len(t) >= SPAN]
            made = [[text_class(texts[k]) for k in at], [len(texts[k]) for k in at]]
            yield pa.RecordBatch.from_arrays([pa.array(made[0], pa.int64()), batch.column(0).take(pa.array(at, pa.int64())), pa.array(made[1], pa.int64())], ["class", "doc_id", "n_chars"])

    return docs.select("doc_id", "text").mapInArrow(run, "class bigint, doc_id bigint, n_chars bigint").distinct()


def nodes(docs: DataFrame) -> DataFrame:
    """(node, class, ord, pos, prev, next): the sampled k-mers of each class; prev and next hash the neighbour and its distance, null at an end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for _, texts in vec.rows(batches):
            mine, names = [], []
            for t in texts:
                if len(t) >= SPAN and (name := text_class(t)) not in done:
                    done.add(name)
                    mine.append(t)
                    names.append(name)
            if not mine:
                continue
            text, pos, h = sampled(mine)
            first = np.append(True, text[1:] != text[:-1])
            last = np.append(first[1:], True)
            gap = np.diff(pos, prepend=0).astype(np.uint64)
            before, after = np.append(h[:1], h[:-1]), np.append(h[1:], h[-1:])
            prev = vec.mix(before + gap)
            after_gap = np.append(gap[1:], gap[:1])
            nxt = vec.mix(after - after_gap)
            start = np.flatnonzero(first)
            ord_ = np.arange(len(h)) - np.repeat(start, np.diff(np.append(start, len(h))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(vec.signed(h)), pa.array(np.array(names, np.int64)[text]), pa.array(ord_.astype(np.int32)), pa.array(pos), pa.array(vec.signed(prev), mask=first), pa.array(vec.signed(nxt), mask=last)],
                ["node", "class", "ord", "pos", "prev", "next"],
            )

    return docs.select("text").where("text <> ''").mapInArrow(run, "node bigint, class bigint, ord int, pos bigint, prev bigint, next bigint")


def paths(docs: DataFrame) -> DataFrame:
    """(path, class, pos, span): the compacted runs of k-mers that stand in two or more different texts, wherever they stand.

    A node leads on without a branch if all its places have one next node and that node's places one previous node. As a
    run's members follow each other in every text that holds it, a text's k-mers in order, joined with the counts of
    their nodes, show where its runs begin.
    """
    places = nodes(docs)  # copies of a text in several tasks repeat its rows, which changes none of the tests below
    ends = [F.count("prev").alias("n_prev"), F.count("next").alias("n_next"), F.count("*").alias("n")]
    stats = places.groupBy("node").agg(F.min("class").alias("c0"), F.max("class").alias("c1"), F.min("prev").alias("p0"), F.max("prev").alias("p1"), F.min("next").alias("x0"), F.max("next").alias("x1"), *ends)
    repeated = stats.where("c0 <> c1").select("node", F.expr("p0 = p1 and n_prev = n").alias("one_in"), F.expr("x0 = x1 and n_next = n").alias("one_out"))
    kept = places.select("node", "class", "ord", "pos").join(repeated, "node").dropDuplicates(["class", "ord"])
    along = Window.partitionBy("class").orderBy("ord")
    follows = (F.lag("ord").over(along) == F.col("ord") - 1) & F.lag("one_out").over(along) & F.coalesce(F.col("one_in"), F.lit(False))
    begun = kept.withColumn("begins", ~F.coalesce(follows, F.lit(False)))
    run = begun.withColumn("run", F.sum(F.col("begins").cast("int")).over(along))
    return run.groupBy("class", "run").agg(F.min_by("node", "ord").alias("path"), F.min("pos").alias("pos"), (F.max("pos") + K - F.min("pos")).alias("span")).drop("run")


def refined(hot: DataFrame, members: DataFrame, docs: DataFrame) -> DataFrame:
    """(path, class, pos, span) of hot places, a path for each hash of SPAN - STEP characters over the k-mer at the place.

    A run of SPAN characters over a k-mer reaches l to its left and the rest to its right; with l rounded down to a
    multiple of STEP, the SPAN - STEP characters from there still lie within the run. So all l in steps suffice.
    """
    heads = members.groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    texts = hot.join(heads, "class").join(docs.select("doc_id", "text").dropDuplicates(["doc_id"]), "doc_id").select("class", "pos", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for name, pos, text in zip(*(c.to_pylist() for c in batch.columns)):
                for left in range(0, SPAN - K + 1, STEP):
                    lo, hi = pos - left, pos - left + SPAN - STEP
                    if lo >= 0 and hi <= len(text):
                        out.append((text_class(text[lo:hi]), name, pos))
            cols = list(zip(*out)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array([K] * len(out), pa.int64())], ["path", "class", "pos", "span"])

    return texts.mapInArrow(run, "path bigint, class bigint, pos bigint, span bigint").dropDuplicates(["path", "class"])


def follow(a: np.ndarray, b: np.ndarray, i: int, j: int) -> tuple[int, int]:
    """How far the equal run over places i of a and j of b reaches to the left of them, and from them to the right."""
    n = min(i, j)
    unlike = np.flatnonzero(a[i - n : i][::-1] != b[j - n : j][::-1])
    left = int(unlike[0]) if len(unlike) else n
    n = min(len(a) - i, len(b) - j)
    unlike = np.flatnonzero(a[i : i + n] != b[j : j + n])
    return left, int(unlike[0]) if len(unlike) else n


def shared_runs(text_a: str, text_b: str, at: list[tuple[int, int]], every: bool) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length) of equal runs of SPAN characters or more; without ``every``, one of them is enough."""
    a, b = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (text_a, text_b))
    found: list[tuple[int, int, int]] = []
    for i, j in at:
        if any(x <= i < x + n and i - x == j - y for x, y, n in found):
            continue
        left, right = follow(a, b, i, j)
        if left + right >= SPAN:
            found.append((i - left, j - left, left + right))
            if not every:
                return found
    if not found or every:  # periodic texts can meet at other places than those sampled
        ha, hb = window_hashes(a, SPAN), window_hashes(b, SPAN)
        for x, y in ((ha, hb), (hb, ha)):
            hit = np.flatnonzero(np.isin(x, y))
            if len(hit):
                edge = np.append(True, np.diff(hit) > 1)
                lo = hit[edge]
                hi = hit[np.append(edge[1:], True)] + SPAN
                found += [(int(s), -1, int(e - s)) if x is ha else (-1, int(s), int(e - s)) for s, e in zip(lo, hi)]
    return found


def meetings(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(class_a, class_b, at array<struct<i, j>>): classes that meet on a path, and where; and the members of classes."""
    docs = docs.select("doc_id", "text")
    members = cut(classes(docs))
    found = cut(paths(docs))
    count = found.groupBy("path").agg(F.count_distinct("class").alias("classes"))
    hot = cut(found.join(count.where(F.col("classes") > HOT), "path", "left_semi"))
    if hot.head(1):
        found = found.join(count.where(F.col("classes") <= HOT), "path", "left_semi").select("path", "class", "pos", "span").union(refined(hot.select("class", "pos").distinct(), members, docs))
    a = found.select("path", F.col("class").alias("class_a"), F.col("pos").alias("i"))
    b = found.select("path", F.col("class").alias("class_b"), F.col("pos").alias("j"))
    pairs = a.join(b, "path").where("class_a < class_b")
    return pairs.groupBy("class_a", "class_b").agg(F.collect_set(F.struct("i", "j")).alias("at")), members


def verified(docs: DataFrame, every: bool) -> tuple[DataFrame, DataFrame]:
    """(class_a, class_b, lo_a, lo_b, n) of equal runs of SPAN characters or more in texts of two classes; and the members.

    ``every``: all such runs of each pair; a run of which only one side is told has -1 for the other. Else one a pair.
    """
    pairs, members = meetings(docs)
    pairs, heads = cut(pairs), cut(members.groupBy("class").agg(F.min("doc_id").alias("doc_id")))
    both = pairs.select(F.col("class_a").alias("class")).union(pairs.select(F.col("class_b").alias("class"))).distinct()
    met = cut(heads.join(both, "class", "left_semi"))
    texts = likely(docs.select("doc_id", "text"), met, "doc_id").join(met, "doc_id").select("class", "text")
    a = texts.select(F.col("class").alias("class_a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("class").alias("class_b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ca, cb, at, ta, tb in zip(*(c.to_pylist() for c in batch.columns)):
                out += [(ca, cb, x, y, n) for x, y, n in shared_runs(ta, tb, [(p["i"], p["j"]) for p in at], every)]
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["class_a", "class_b", "lo_a", "lo_b", "n"])

    joined = pairs.join(a, "class_a").join(b, "class_b").select("class_a", "class_b", "at", "text_a", "text_b")
    return joined.mapInArrow(run, "class_a bigint, class_b bigint, lo_a bigint, lo_b bigint, n bigint").distinct(), members  # rows of a document that stand twice meet twice


def span_pairs(docs: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: documents whose texts hold an equal run of at least SPAN characters, copies included.

    Null, empty and shorter texts take no part. Large classes of exact copies are listed as ``unify.spread`` says.
    """
    runs, members = verified(docs, every=False)
    sizes = cut(members.groupBy("class").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")))
    a = sizes.select(F.col("class").alias("class_a"), F.col("head").alias("head_a"), F.col("n").alias("n_a"))
    b = sizes.select(F.col("class").alias("class_b"), F.col("head").alias("head_b"), F.col("n").alias("n_b"))
    links = cut(runs.select("class_a", "class_b").distinct().join(a, "class_a").join(b, "class_b"))
    return spread(links, members).union(copies(members, sizes))


def shared_shares(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, shared_chars): of each text of SPAN characters or more, how many of its characters lie in a run of at least SPAN that another document has too."""
    runs, members = verified(docs, every=True)
    runs = cut(runs)
    sides = runs.where("lo_a >= 0").select(F.col("class_a").alias("class"), F.col("lo_a").alias("lo"), (F.col("lo_a") + F.col("n")).alias("hi")).union(
        runs.where("lo_b >= 0").select(F.col("class_b").alias("class"), F.col("lo_b").alias("lo"), (F.col("lo_b") + F.col("n")).alias("hi"))
    ).distinct()
    before = Window.partitionBy("class").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("hi").over(before), F.lit(0))
    covered = sides.withColumn("new", F.greatest(F.lit(0), F.col("hi") - F.greatest("lo", reach))).groupBy("class").agg(F.sum("new").alias("covered"))
    sizes = members.groupBy("class").agg(F.count("*").alias("copies"))
    of = members.join(sizes, "class").join(covered, "class", "left")
    return of.select("doc_id", "n_chars", F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0))).alias("shared_chars"))
