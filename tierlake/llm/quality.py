"""Problem 1: statistics of each document's text, and whether it is running text.

All counts are made for many texts at once over arrays of code points; words are compared in the folded form of
``chars.folds``, so look-alike letters don't hide the common words. Statistics are of whole texts; for the verdict lines
that the source repeats are taken out first, unless little else is left.

The rule: a text is running if most of its characters are in lines of sentences, and nothing in it dominates by repetition
(a word, a run of two or three words, runs that stood before, lines, paragraphs). A line is of sentences by either of two
signs: words that carry grammar in one of some languages, or, in any language with case, the shape of sentences - its
paragraph begins with a capital and ends with a stop, small letters, short words among long ones, vowels among consonants,
few marks and digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tierlake.llm import vec
from tierlake.llm.chars import DROP, LETTER, LOWER, NUMBER, OTHER, SPACE, UPPER, VOWEL, classes, composed, folds, shapes
from tierlake.llm.sitelines import own_text
from tierlake.llm.words import COMMON

# Marks that end a sentence, quotes and brackets that may follow it included.
ENDS = ".!?…;:。！？؟।»”\"')"

#: A line is of sentences if it has at least WORDS words, COMMON_LEAST of them common, at most SYMBOLS of its characters are symbols and its words are of natural length; a shorter one if it ends like a sentence.
WORDS, COMMON_LEAST, COMMON_SHORT, SYMBOLS, WORD_LENGTH = 5, 0.2, 0.25, 0.15, 15
#: A text is running text if this share of its characters stands in such lines, unless lines that stood before make up more than the share after it.
RUNNING, SAME_LINES = 0.5, 0.6
#: Lines in the shape of sentences: words at least; digits, commas a word, words that begin with a capital and words with LONG_RUN consonants in a row at most; vowels among letters; of the words of such lines in a text so many are of three letters or fewer.
SHAPE_WORDS, SHAPE_DIGITS, SHAPE_COMMAS, SHAPE_CAPITALS, SHAPE_ODD, LONG_RUN = 4, 0.1, 0.3, 0.4, 0.12, 5
SHAPE_VOWELS, SHAPE_SHORT = (0.28, 0.7), 0.04
#: From so many words on: shares of the characters of words that the most dominant run of two or three words may make up, and that may lie in runs of five words that stood before.
GRAM_WORDS, TOP_2GRAM, TOP_3GRAM, SAME_GRAMS, GRAM = 40, 0.25, 0.2, 0.6, 5
#: Share of the words of a text that one uncommon word may make up, from so many words on.
TOP_WORD = ((40, 0.15), (15, 0.3))
#: From this code point on scripts have no list of common words; their lines count by their symbols and digits alone.
UNLISTED = 0x530


@lru_cache(None)
def common_hashes() -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the folded common words, sorted; the languages of each, a bit for each)."""
    table, _ = folds()
    out: dict[int, int] = {}
    for bit, words in enumerate(COMMON.values()):
        for word in words.split():
            f = table[[ord(ch) for ch in composed(word)]]
            h = int(vec.run_hashes(f[f != DROP], np.zeros(1, np.int64))[0])
            out[h] = out.get(h, 0) | 1 << bit
    hashes = sorted(out)
    return np.array(hashes, np.uint64), np.array([out[h] for h in hashes], np.uint16)


@dataclass
class Counted:
    """What ``count`` finds; fields named line_ are by line of at least one character that isn't white space, word_ by word."""

    n: int
    fold: np.ndarray
    line_text: np.ndarray
    line_number: np.ndarray
    line_start: np.ndarray
    line_end: np.ndarray
    line_words: np.ndarray
    line_tokens: np.ndarray
    line_common: np.ndarray
    line_chars: np.ndarray
    line_symbols: np.ndarray
    line_digits: np.ndarray
    line_stop: np.ndarray
    line_prose: np.ndarray
    word_text: np.ndarray
    word_hash: np.ndarray
    word_length: np.ndarray
    word_common: np.ndarray
    all_lines: np.ndarray


def _sums(flags: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(flags, dtype=np.int64))
    return total[hi] - total[lo]


def paragraphs(text: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The first line of each paragraph: lines of one text whose numbers follow each other."""
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (number[1:] != number[:-1] + 1)
    return np.flatnonzero(new)


def in_shape(cp, kind, inside, starts, word_length, text, number, lo, hi, w_lo, w_hi, clean, chars, digits, stop) -> np.ndarray:
    """Which lines are in the shape of sentences, whatever their language; arguments as in ``count``."""
    if not len(lo):
        return np.zeros(0, bool)
    shape, words = shapes()[cp], w_hi - w_lo
    letter = kind == LETTER
    vowels, letters = _sums((shape & VOWEL) > 0, lo, hi), _sums(letter, lo, hi)
    first = shape[starts]
    capital, small = (first & UPPER) > 0, (first & LOWER) > 0
    # consonants in a row, by word
    consonant = letter & ((shape & (UPPER | LOWER)) > 0) & ((shape & VOWEL) == 0)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], consonant, [False]]).astype(np.int8)))
    begin, size = edge[::2], edge[1::2] - edge[::2]
    odd = np.zeros(len(starts) + 1, bool)
    odd[np.searchsorted(starts, begin[size >= LONG_RUN], "right") - 1] = True
    per = lambda flags: _sums(flags, w_lo, w_hi)
    capitals, smalls, odds = per(capital), per(small), per(odd[:-1])
    commas = _sums((cp == 44) | (cp == 59), lo, hi)
    good = clean & (words >= SHAPE_WORDS) & (digits <= SHAPE_DIGITS * chars) & (commas <= SHAPE_COMMAS * words) & (capitals <= SHAPE_CAPITALS * words) & (smalls > 0) & (odds <= SHAPE_ODD * words)
    good &= (vowels >= SHAPE_VOWELS[0] * letters) & (vowels <= SHAPE_VOWELS[1] * letters)
    # its paragraph begins with a capital and ends with a stop
    at = paragraphs(text, number)
    of = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(lo))))
    last = np.append(at[1:], len(lo)) - 1
    begins = np.append(capital, False)[np.minimum(w_lo[at], len(starts))] & (words[at] > 0)
    good &= (begins & stop[last])[of]
    short = _sums(word_length <= 3, w_lo, w_hi)
    n = int(text[-1]) + 1
    enough = np.bincount(text, short * good, n) >= SHAPE_SHORT * np.bincount(text, words * good, n)
    return good & enough[text]


def count(texts: list[str]) -> Counted:
    """Counts the lines and words of all texts."""
    table, slow = folds()
    cp, ends = vec.points(texts)
    hard = np.unique(vec.owner(np.flatnonzero(slow[cp]), ends)).tolist()
    if hard:
        texts = list(texts)
        for k in hard:
            texts[k] = composed(texts[k])
        cp, ends = vec.points(texts)
    fold = table[cp]
    fold[ends] = 0
    keep = fold != DROP
    if not keep.all():
        ends = np.cumsum(keep)[ends] - 1
        cp, fold = cp[keep], fold[keep]
    kind = classes()[cp]
    brk = cp == 10
    brk[ends] = True
    kind[ends] = SPACE
    breaks = np.flatnonzero(brk)
    seen = kind != SPACE
    lo, hi = np.append(0, breaks[:-1] + 1), breaks
    chars = _sums(seen, lo, hi)
    real = chars > 0
    text_of_line = vec.owner(breaks, ends)
    first_line = np.append(0, np.cumsum(np.bincount(text_of_line, minlength=len(texts)))[:-1])
    number = np.arange(len(breaks)) - first_line[text_of_line] + 1
    lo, hi, chars = lo[real], hi[real], chars[real]

    inside = fold != 0
    starts = np.flatnonzero(inside & ~np.append(False, inside[:-1]))
    packed = np.flatnonzero(inside)
    at = np.searchsorted(packed, starts)
    word_hash = vec.run_hashes(fold[packed], at)
    word_length = np.diff(np.append(at, len(packed)))
    known, languages = common_hashes()
    place = np.minimum(np.searchsorted(known, word_hash), len(known) - 1)
    word_languages = np.where(known[place] == word_hash, languages[place], np.uint16(0))
    word_common = word_languages > 0
    w_lo, w_hi = np.searchsorted(starts, lo), np.searchsorted(starts, hi)
    token = seen & ~np.append(False, seen[:-1])
    symbols, digits = _sums(kind == OTHER, lo, hi), _sums(kind == NUMBER, lo, hi)
    words, tokens = w_hi - w_lo, _sums(token, lo, hi)
    # common words of one language, that which has most: lists of names meet some short word of another one
    common = np.zeros(len(lo), np.int64)
    for bit in range(len(COMMON)):
        np.maximum(common, _sums((word_languages >> bit) & 1, w_lo, w_hi), out=common)
    last_seen = np.flatnonzero(seen)
    end = last_seen[np.searchsorted(last_seen, hi) - 1] if len(last_seen) else np.zeros(0, np.int64)
    stop = np.isin(cp[end], np.array([ord(x) for x in ENDS], np.uint32))
    clean = (symbols <= SYMBOLS * chars) & (chars <= WORD_LENGTH * np.maximum(tokens, 1))
    share = common / np.maximum(words, 1)
    prose = clean & (((words >= WORDS) & (share >= COMMON_LEAST)) | ((words >= 2) & stop & (share >= COMMON_SHORT)))
    far = _sums(inside & (fold >= UNLISTED), lo, hi) > 0.5 * chars
    prose |= in_shape(cp, kind, inside, starts, word_length, text_of_line[real], number[real], lo, hi, w_lo, w_hi, clean, chars, digits, stop)
    prose |= far & (symbols <= SYMBOLS * chars) & (digits <= SYMBOLS * chars) & (chars >= 8)
    return Counted(len(texts), fold, text_of_line[real], number[real], lo, hi, words, tokens, common, chars, symbols, digits, stop, prose, vec.owner(starts, ends), word_hash, word_length, word_common, np.bincount(text_of_line, minlength=len(texts)))


def _by_text(c: Counted, values: np.ndarray) -> np.ndarray:
    return np.bincount(c.line_text, values, c.n)


def top_word(c: Counted) -> np.ndarray:
    """Of each text, the share of its words that its most frequent uncommon word makes up."""
    most = np.zeros(c.n)
    words = np.bincount(c.word_text, minlength=c.n)
    h, text = c.word_hash[~c.word_common], c.word_text[~c.word_common]
    if len(h):
        _, first, n = np.unique(vec.mix(h + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
        np.maximum.at(most, text[first], n)
    return most / np.maximum(words, 1)


def top_gram(c: Counted, size: int) -> np.ndarray:
    """Of each text, the share of its words' characters that lies in its most dominant run of ``size`` words that repeats."""
    n = len(c.word_hash) - size + 1
    out = np.zeros(c.n)
    if n <= 0:
        return out
    h, length = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    for k in range(size):
        h = (h ^ c.word_hash[k : n + k]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)
        length += c.word_length[k : n + k]
    same = c.word_text[:n] == c.word_text[size - 1 :]
    h, length, text = h[same], length[same], c.word_text[:n][same]
    _, first, times = np.unique(vec.mix(h + text.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), return_index=True, return_counts=True)
    again = times > 1
    np.maximum.at(out, text[first[again]], (times * length[first])[again])
    return np.minimum(1, out / np.maximum(1, np.bincount(c.word_text, c.word_length, c.n)))


def repeated_share(text: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Of each text, the share of ``weight`` in pieces that stood in it before."""
    again = np.ones(len(h), bool)
    _, first = np.unique(vec.mix(h + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    again[first] = False
    return np.bincount(text, weight * again, n) / np.maximum(1, np.bincount(text, weight, n))


def same_grams(c: Counted, size: int = GRAM) -> np.ndarray:
    """Of each text, the share of its words' characters that lies in runs of ``size`` words that stood in it before."""
    n = len(c.word_hash) - size + 1
    if n <= 0:
        return np.zeros(c.n)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = (h ^ c.word_hash[k : n + k]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)
    same = np.flatnonzero(c.word_text[:n] == c.word_text[size - 1 :])
    again = np.ones(len(same), bool)
    again[np.unique(vec.mix(h[same] + c.word_text[same].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), return_index=True)[1]] = False
    edge = np.zeros(len(c.word_hash) + 1, np.int64)
    np.add.at(edge, same[again], 1)
    np.add.at(edge, same[again] + size, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(c.word_text, c.word_length * covered, c.n) / np.maximum(1, np.bincount(c.word_text, c.word_length, c.n))


def paragraph_share(c: Counted) -> np.ndarray:
    """Of each text, the share of its characters in paragraphs that stood in it before."""
    at = paragraphs(c.line_text, c.line_number)
    if not len(at):
        return np.zeros(c.n)
    par = vec.run_hashes(line_hashes(c) >> np.uint64(20), at)
    return repeated_share(c.line_text[at], par, np.add.reduceat(c.line_chars, at), c.n)


def line_hashes(c: Counted) -> np.ndarray:
    """A hash of the words of each line."""
    starts = np.append(0, np.cumsum(c.line_words)[:-1])
    out = np.zeros(len(c.line_words), np.uint64)
    some = c.line_words > 0
    if some.any():
        out[some] = vec.run_hashes(c.word_hash >> np.uint64(20), starts[some])
    return out


def verdicts(c: Counted) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(running text or not, share of characters in lines of sentences, share of the top word, share of repeated lines) of each text."""
    chars = _by_text(c, c.line_chars)
    prose = _by_text(c, c.line_chars * c.line_prose) / np.maximum(chars, 1)
    word = top_word(c)
    again = repeated_share(c.line_text, line_hashes(c), c.line_chars, c.n)
    words = np.bincount(c.word_text, minlength=c.n)
    heap = np.any([(words >= n) & (word > share) for n, share in TOP_WORD], axis=0)
    heap |= (words >= GRAM_WORDS) & ((top_gram(c, 2) > TOP_2GRAM) | (top_gram(c, 3) > TOP_3GRAM) | (same_grams(c) > SAME_GRAMS))
    return (prose >= RUNNING) & ~heap & ~(again > SAME_LINES) & ~(paragraph_share(c) > SAME_LINES), prose, word, again


STATS = "doc_id bigint, n_lines int, n_words int, mean_word_length double, symbol_ratio double, digit_ratio double, stop_line_share double, common_word_share double, prose_share double, dup_line_share double, dup_paragraph_share double, top_word_share double, top_2gram_share double, top_3gram_share double, same_gram_share double, running boolean"


def statistics(docs: DataFrame) -> DataFrame:
    """The columns of STATS for each row of ``docs`` (doc_id, text, source).

    All are of the whole text but ``running``, which is the verdict on ``own_text``. Null, empty and blank texts have counts
    and shares of 0 and ``running`` null. Repeated rows give repeated results; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in vec.rows(batches):
            c = count(texts)
            running, prose, word, again = verdicts(c)
            own = [x or "" for x in batch.column(1).to_pylist()]
            apart = [k for k, (x, t) in enumerate(zip(own, texts)) if x != t]
            if apart:
                running[apart] = verdicts(count([own[k] for k in apart]))[0]
            lines, chars = np.bincount(c.line_text, minlength=c.n), _by_text(c, c.line_chars)
            words = np.bincount(c.word_text, minlength=c.n)
            per = lambda x: x / np.maximum(1, chars)
            cols = [
                batch.column(0), pa.array(lines.astype(np.int32)), pa.array(words.astype(np.int32)), pa.array(np.bincount(c.word_text, c.word_length, c.n) / np.maximum(1, words)),
                pa.array(per(_by_text(c, c.line_symbols))), pa.array(per(_by_text(c, c.line_digits))), pa.array(_by_text(c, c.line_stop) / np.maximum(1, lines)), pa.array(np.bincount(c.word_text, c.word_common, c.n) / np.maximum(1, words)),
                pa.array(prose), pa.array(again), pa.array(paragraph_share(c)), pa.array(word), pa.array(top_gram(c, 2)), pa.array(top_gram(c, 3)), pa.array(same_grams(c)), pa.array(running, mask=chars == 0),
            ]
            yield pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in STATS.split(", ")])

    return own_text(docs.select("doc_id", "source", "text")).select("doc_id", "own", "text").mapInArrow(run, STATS)


def not_running(docs: DataFrame) -> DataFrame:
    """(doc_id): documents that aren't running text for the most part, as ``statistics`` judges them; blank texts are never among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in vec.rows(batches):
            c = count(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["doc_id"]).filter(pa.array(~verdicts(c)[0] & (_by_text(c, c.line_chars) > 0)))

    return own_text(docs.select("doc_id", "source", "text")).select("doc_id", "own").mapInArrow(run, "doc_id bigint")
