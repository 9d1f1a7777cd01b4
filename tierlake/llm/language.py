"""Problem 5: the language of each document and of each of its segments, by multinomial naive Bayes.

Features are hashed character n-grams of the folded text. The log-probability matrix (languages by a fixed number of
buckets) is fitted on the driver on a bounded sample of labelled rows, sharpened by relabelling the sample's lines with
its own answers, since labels may be wrong, and broadcast; lines are scored in batches by sums over sparse rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlake.llm import vec
from tierlake.llm.quality import Counted, count, verdicts
from tierlake.llm.sitelines import own_text

#: n-grams of these lengths, each in so many buckets.
ORDERS, BUCKETS = (1, 2, 3), 1 << 15
#: About so many labelled documents of each language are sampled for the fit, by a hash of their id; the bound of what the driver holds.
SAMPLE = 250
#: Characters of the texts that are sampled, so that the sample is bounded in bytes too; all texts are labelled.
SAMPLE_CHARS = (100, 20_000)
ROUNDS = 3
#: Words from which on a whole line counts as written in its language.
LINE_WORDS = 12
#: Difference of mean log-probability per n-gram at which a language is e times as likely as another, for the confidence.
TEMPERATURE = 0.5


def features(fold: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, number of the line it is in) for lines at [lo, hi) of ``fold``; runs of non-letters count as one space."""
    size = hi - lo
    at = np.repeat(lo - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
    line = np.repeat(np.arange(len(lo)), size)
    c = fold[at].astype(np.uint64)
    c[(c >= 48) & (c < 58)] = 0
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0) | (line[1:] != line[:-1])
    c, line = c[keep], line[keep]
    buckets, lines = [], []
    h = np.zeros(len(c), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        m = len(c) - n + 1
        if m <= 0:
            break
        h = (h[:m] ^ (c[n - 1 :] + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if n in ORDERS:
            same = (line[:m] == line[n - 1 :]) & ((c[:m] != 0) | (n > 1))
            buckets.append((h[same] % np.uint64(BUCKETS)).astype(np.int64) + ORDERS.index(n) * BUCKETS)
            lines.append(line[:m][same])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(lines)


def counts(bucket: np.ndarray, line: np.ndarray, kind: np.ndarray, kinds: int) -> np.ndarray:
    """n-grams by language and bucket; ``kind`` is the language of each line, -1 for none."""
    of = kind[line]
    some = of >= 0
    size = len(ORDERS) * BUCKETS
    return np.bincount(of[some] * size + bucket[some], minlength=kinds * size).reshape(kinds, size).astype(np.float64)


def log_probabilities(n: np.ndarray) -> np.ndarray:
    """Languages by buckets, smoothed; each order is a multinomial of its own."""
    out = np.empty_like(n)
    for k in range(len(ORDERS)):
        part = slice(k * BUCKETS, (k + 1) * BUCKETS)
        total = n[:, part].sum(1, keepdims=True)
        out[:, part] = np.log((n[:, part] + 0.1) / (total + 0.1 * BUCKETS))
    return out.astype(np.float32)


def line_sums(matrix: np.ndarray, bucket: np.ndarray, line: np.ndarray, lines: int) -> np.ndarray:
    """The log-probabilities of each line's n-grams, summed, by language; ``line`` rises within each order."""
    out = np.zeros((lines, len(matrix)))
    if not len(line):
        return out
    starts = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
    for k, row in enumerate(matrix):
        np.add.at(out[:, k], line[starts], np.add.reduceat(row[bucket], starts))
    return out


def scores(matrix: np.ndarray, fold: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The mean log-probability per n-gram of each line in each language."""
    bucket, line = features(fold, lo, hi)
    return line_sums(matrix, bucket, line, len(lo)) / np.maximum(1, np.bincount(line, minlength=len(lo)))[:, None]


def confidence(score: np.ndarray) -> np.ndarray:
    """The share of the best language after a softmax; even shares if nothing tells the languages apart."""
    x = np.exp((score - score.max(1, keepdims=True)) / TEMPERATURE) if score.size else score
    return x.max(1) / x.sum(1) if score.size else np.zeros(len(score))


def fit_texts(texts: list[str], label: np.ndarray, kinds: int) -> np.ndarray:
    """The matrix for texts with the number of their labelled language."""
    parts = []
    for lo in range(0, len(texts), 200):
        c = count(texts[lo : lo + 200])
        use = c.line_words >= 4
        bucket, line = features(c.fold, c.line_start[use], c.line_end[use])
        parts.append((bucket, line, label[lo : lo + 200][c.line_text[use]]))
    kind = [p[2] for p in parts]
    for _ in range(ROUNDS):
        total = sum(counts(b, n, k, kinds) for (b, n, _), k in zip(parts, kind)) if parts else np.zeros((kinds, len(ORDERS) * BUCKETS))
        matrix = log_probabilities(total)
        kind = []
        for b, n, k in parts:
            kind.append(line_sums(matrix, b, n, len(k)).argmax(1))
    return matrix


def fit(docs: DataFrame, codes: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, matrix) from about SAMPLE documents of each language that ``codes`` (label, lang; fixed and small) names."""
    names = sorted(r[0] for r in codes.select("lang").where("lang is not null").distinct().collect())
    by_label = codes.dropDuplicates(["label"]).select("label", F.col("lang").alias("named"))
    labelled = docs.select("doc_id", F.col("lang").alias("label"), "text").where(F.length("text").between(*SAMPLE_CHARS)).join(F.broadcast(by_label), "label")
    sizes = labelled.groupBy("named").agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    rows = labelled.join(F.broadcast(sizes), "named").where(part < SAMPLE / F.col("n")).select("named", "text").orderBy(F.xxhash64("text")).limit(2 * SAMPLE * max(1, len(names))).collect()
    return names, fit_texts([r["text"] for r in rows], np.array([names.index(r["named"]) for r in rows], np.int64), max(1, len(names)))


def score_lines(c: Counted, matrix: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(indices of lines of ``least`` words or more, their scores)."""
    use = np.flatnonzero(c.line_tokens >= least)
    return use, scores(matrix, c.fold, c.line_start[use], c.line_end[use])


SEGMENTS = "doc_id bigint, first_line bigint, last_line bigint, lang string, confidence double"


def segments(docs: DataFrame, codes: DataFrame, least: int = LINE_WORDS) -> DataFrame:
    """(doc_id, first_line, last_line, lang, confidence): the segments of each running text, site lines taken out before lines are numbered (unless little else is left, see ``own_text``).

    A segment is a run of lines whose lines of at least ``least`` words are in one language; shorter lines go with the
    segment they follow. Texts that aren't running text, blank ones and those without such a line have no segment, nor has any text if ``codes`` names no language.
    """
    names, matrix = fit(docs, codes)
    if not names:
        return docs.sparkSession.createDataFrame([], SEGMENTS)
    shared = docs.sparkSession.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in vec.rows(batches):
            c = count(texts)
            running = verdicts(c)[0]
            use, score = score_lines(c, shared.value, least)
            sure = running[c.line_text[use]]
            use, score = use[sure], score[sure]
            best, trust = score.argmax(1) if len(score) else np.zeros(0, np.int64), confidence(score)
            text, number = c.line_text[use], c.line_number[use]
            new = np.ones(len(use), bool)
            new[1:] = (text[1:] != text[:-1]) | (best[1:] != best[:-1])
            at = np.flatnonzero(new)
            ends = np.append(at[1:], len(use))[: len(at)] - 1
            weight = c.line_chars[use].astype(float)
            mean = np.add.reduceat(trust * weight, at) / np.add.reduceat(weight, at) if len(at) else np.zeros(0)
            ids = batch.column(0).take(pa.array(text[at]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(number[at].astype(np.int64)), pa.array(number[ends].astype(np.int64)), pa.array([names[k] for k in best[at]], pa.string()), pa.array(mean)], ["doc_id", "first_line", "last_line", "lang", "confidence"])

    return own_text(docs.select("doc_id", "source", "text")).select("doc_id", "own").mapInArrow(run, SEGMENTS)


def documents(docs: DataFrame, codes: DataFrame) -> DataFrame:
    """(doc_id, lang, confidence): the language of most lines of each document that has segments, by their number of lines."""
    each = segments(docs, codes).groupBy("doc_id", "lang").agg(F.sum(F.expr("last_line - first_line + 1")).alias("n"), F.avg("confidence").alias("confidence"))
    return each.groupBy("doc_id").agg(F.max_by(F.struct("lang", "confidence"), F.struct("n", "confidence", "lang")).alias("x")).select("doc_id", "x.lang", "x.confidence")


def every_document(docs: DataFrame, codes: DataFrame) -> DataFrame:
    """(doc_id, lang, confidence): the language of each non-blank document, running text or not, told by the n-grams of all its lines (``own_text``).

    A text without a letter is in no language: null, with confidence 0. Repeated rows of a document give one.
    """
    names, matrix = fit(docs, codes)
    schema = "doc_id bigint, lang string, confidence double"
    if not names:
        return docs.sparkSession.createDataFrame([], schema)
    shared = docs.sparkSession.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in vec.rows(batches):
            c = count(texts)
            have, first = np.unique(c.line_text, return_index=True)
            lo, hi = c.line_start[first], c.line_end[np.append(first[1:], len(c.line_text))[: len(first)] - 1]
            bucket, text = features(c.fold, lo, hi)
            n = np.bincount(text, minlength=len(have))
            score = line_sums(shared.value, bucket, text, len(have)) / np.maximum(1, n)[:, None]
            best, trust = score.argmax(1), np.where(n > 0, confidence(score), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(have)), pa.array([names[k] if some else None for k, some in zip(best, n > 0)], pa.string()), pa.array(trust.astype(float))], ["doc_id", "lang", "confidence"])

    each = own_text(docs.select("doc_id", "source", "text")).select("doc_id", "own").mapInArrow(run, schema)
    return each.groupBy("doc_id").agg(F.max_by(F.struct("lang", "confidence"), F.struct("confidence", "lang")).alias("x")).select("doc_id", "x.lang", "x.confidence")


def relabelled(docs: DataFrame, codes: DataFrame) -> DataFrame:
    """(doc_id, lang): the languages of running texts whose label is missing, names none of them, or that are in several.

    A language counts if a whole line of LINE_WORDS words is in it. A label that ``codes`` doesn't list is missing.
    """
    named = docs.select("doc_id", F.col("lang").alias("label")).join(F.broadcast(codes.dropDuplicates(["label"]).select("label", F.col("lang").alias("named"))), "label", "left").select("doc_id", "named")
    found = segments(docs, codes).groupBy("doc_id").agg(F.collect_set("lang").alias("langs"))
    wrong = found.join(named, "doc_id").where("named is null or size(langs) > 1 or not array_contains(langs, named)")
    return wrong.select("doc_id", F.explode("langs").alias("lang")).distinct()
