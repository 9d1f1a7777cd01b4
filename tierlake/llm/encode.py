"""Problem 8: the whole corpus as token ids of a public byte-level BPE, by a lexicon of the corpus's frequent words.

Three steps: count the pre-tokens of all texts; compile the most frequent ones with their ids into a minimal acyclic
transducer (``lexicon``), handed to each executor as a file that its workers memory-map; walk all words of a batch
through it side by side and merge unseen ones exactly by the vocabulary's ranks.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlake.llm import vec
from tierlake.llm.chars import LETTER, NUMBER, OTHER, SPACE, classes
from tierlake.llm.lexicon import Lexicon, build
from tierlake.plans.shared import cut, shared_file

#: The vocabulary's file, if the setting ``tierlake.vocabulary`` of the session names no other.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Most words in the lexicon, and most bytes of one; bound the driver's table and the file that executors map (under 4 MB).
LEXICON_WORDS, LEXICON_BYTES = 16_000, 32
_END = 4
#: Words held in a worker before their counts are handed on.
_HELD = 100_000


def pretokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(UTF-8 bytes, start and length of each pre-token in them, number of pre-tokens of each text).

    The cuts are those of the vocabulary's pattern: 's 't 're 've 'm 'll 'd, then runs of letters, of numbers or of other
    characters, each with a space before it if there is one, then white space.
    """
    cp, ends = vec.points(texts)
    kind = classes()[cp]
    kind[ends] = _END
    n = len(kind)
    prev = np.empty_like(kind)
    prev[0], prev[1:] = _END, kind[:-1]
    start = kind != prev
    after = start & (kind != _END) & (kind != SPACE) & (prev == SPACE)  # what follows white space
    at = np.flatnonzero(after)
    joined = at[cp[at - 1] == 32]
    start[at - 1] = True
    start[joined] = False
    quote = np.flatnonzero((cp == 39) & start)
    quote = quote[(kind[np.minimum(quote + 1, n - 1)] == LETTER)]
    if len(quote):
        c1, c2 = cp[quote + 1], cp[np.minimum(quote + 2, n - 1)]
        short = quote[np.isin(c1, [115, 116, 109, 100])]
        pair = quote[((c1 == 114) & (c2 == 101)) | ((c1 == 118) & (c2 == 101)) | ((c1 == 108) & (c2 == 108))]
        for found, size in ((short, 2), (pair, 3)):
            start[found + 1] = False
            rest = found + size
            start[rest[kind[rest] == LETTER]] = True
    bounds = np.flatnonzero(start | (kind == _END))
    first = bounds[kind[bounds] != _END]
    data = np.frombuffer(("\0".join(texts) + "\0").encode("utf-8", "surrogatepass"), np.uint8)
    if len(data) == n:
        byte_bounds = bounds
    else:
        byte_bounds = np.flatnonzero((data & 0xC0) != 0x80)[bounds]
    size = np.diff(np.append(byte_bounds, len(data)))
    real = kind[bounds] != _END
    per_text = np.diff(np.searchsorted(first, ends), prepend=0)
    return data, byte_bounds[real], size[real], per_text


def distinct(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an occurrence of each distinct pre-token, the number of the distinct one for each pre-token)."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # runs between pre-tokens (the NULs after texts) get a hash of their own that isn't looked at
    edges = np.unique(np.concatenate([starts, starts + lens]))
    edges = edges[edges < len(data)]
    h = vec.run_hashes(data[edges[0] :], edges - edges[0])[np.searchsorted(edges, starts)]
    _, sample, which = np.unique(h, return_index=True, return_inverse=True)
    return sample, which


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, n bigint) over all texts: each pre-token and how often it stands; counted in the workers before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return made

        for _, texts in vec.rows(batches):
            data, starts, lens, _ = pretokens(texts)
            sample, which = distinct(data, starts, lens)
            raw = data.tobytes()
            for s, size, n in zip(starts[sample].tolist(), lens[sample].tolist(), np.bincount(which, minlength=len(sample)).tolist()):
                word = raw[s : s + size]
                held[word] = held.get(word, 0) + n
            if len(held) > _HELD:
                yield out()
        yield out()

    counted = docs.select("text").where("text <> ''").mapInArrow(count, "word binary, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


@lru_cache(4)
def _merger(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
    core = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
    return core.encode_single_piece


@lru_cache(4)
def _mapped(path: str) -> Lexicon:
    return Lexicon.mapped(path)


def encode_texts(texts: list[str], lexicon: Lexicon, merge) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all texts, number of ids of each, pre-tokens that the lexicon didn't have)."""
    data, starts, lens, per_text = pretokens(texts)
    sample, which = distinct(data, starts, lens)
    place = lexicon.places(data, starts[sample], lens[sample])
    unseen = np.flatnonzero(place < 0)
    at, size = lexicon.ends[place], lexicon.ends[place + 1] - lexicon.ends[place]
    flat = lexicon.flat
    if len(unseen):
        raw = data.tobytes()
        merged = [merge(raw[s : s + n]) for s, n in zip(starts[sample[unseen]].tolist(), lens[sample[unseen]].tolist())]
        size[unseen] = list(map(len, merged))
        at[unseen] = len(flat) + np.cumsum(size[unseen]) - size[unseen]
        flat = np.concatenate([flat, np.fromiter((i for m in merged for i in m), np.int32)])
    count = size[which]
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    ids = flat[np.repeat(at[which] - (ends - count), count) + np.arange(total)]
    upto = np.append(0, ends)
    token_ends = np.cumsum(per_text)
    per = np.diff(upto[np.append(0, token_ends)])
    return ids.astype(np.int32), per, unseen


def frequent_words(counts: DataFrame, most: int = LEXICON_WORDS) -> DataFrame:
    """(word): about ``most`` most frequent words of ``counts`` (word, n), the same however they are partitioned.

    Words are counted by frequency first (frequencies of 256 and more by their eight highest bits, so in at most 8,000
    classes); all words of the classes that fit are taken, and of the class that doesn't fit whole those whose hash is low enough
    to fill the rest. So the words alone reach the driver, not each task's own best.
    """
    bits = F.greatest(F.length(F.bin("n")) - 8, F.lit(0))
    rank = F.expr("shiftleft(shiftright(n, _bits), _bits)")
    ranked = counts.where((F.col("n") > 1) & (F.length("word") <= LEXICON_BYTES)).withColumn("_bits", bits).withColumn("rank", rank)
    classes = sorted(((r["rank"], r["words"]) for r in ranked.groupBy("rank").agg(F.count("*").alias("words")).collect()), reverse=True)
    room, least, share = most, 1 << 62, 0.0
    for n, words in classes:
        if words > room:
            least, share = n, room / words
            break
        room, least = room - words, n - 1
    place = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) / float(1 << 30)
    return ranked.where((F.col("rank") > least) | ((F.col("rank") == least) & (place < share))).select("word")


def compile_lexicon(docs: DataFrame, vocabulary: str = VOCABULARY, most: int = LEXICON_WORDS) -> str:
    """Counts the words of all texts and compiles the ``most`` frequent into a transducer; the name of the file that executors get."""
    words = sorted(bytes(r[0]) for r in frequent_words(cut(word_counts(docs)), most).collect())
    merge = _merger(vocabulary)
    return shared_file(docs.sparkSession, "lexicon", build(words, [tuple(merge(w)) for w in words]))


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, lexicon: str | None = None, ids: bool = True) -> DataFrame:
    """(doc_id, ids array<int>) of each row of ``docs``, or (doc_id, n_tokens) if not ``ids``.

    Ids are those of the vocabulary without special tokens; strings that look like special tokens are ordinary text.
    A null and an empty text give an empty list. Repeated rows give repeated results; other columns are ignored.
    """
    sc = docs.sparkSession.sparkContext
    vocabulary = docs.sparkSession.conf.get("tierlake.vocabulary", vocabulary)
    sc.addFile(vocabulary)
    ranks = Path(vocabulary).name
    name = lexicon or compile_lexicon(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, merge = _mapped(SparkFiles.get(name)), _merger(SparkFiles.get(ranks))
        for batch, texts in vec.rows(batches):
            got, per, _ = encode_texts(texts, table, merge)
            if ids:
                offsets = np.append(0, np.cumsum(per)).astype(np.int32)
                value = pa.ListArray.from_arrays(pa.array(offsets), pa.array(got))
            else:
                value = pa.array(per.astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), value], ["doc_id", "ids" if ids else "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>" if ids else "doc_id bigint, n_tokens bigint")
