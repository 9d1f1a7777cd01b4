"""Tables by code point: character classes, the consistent form of look-alikes, and the folding of words.

All are built from the Unicode database by rule, once for each Python worker.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

SIZE = 0x110000
#: Marks a code point that leaves no trace in a form.
DROP = np.uint32(0xFFFFFFFF)
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3

# The code points with Unicode's property White_Space.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# Basic letters and marks, and the letters and marks of other scripts that look like them, case kept; after the
# confusables of Unicode Technical Standard 39, without those that only resemble (o and zero, l and one, rn and m).
# Cyrillic, Greek, Armenian, Cherokee, Canadian syllabics, Coptic, Tifinagh and Lisu.
LOOK = {
    "A": "АΑᎪᗅꓮ", "B": "ВΒᏴᗷꓐ", "C": "СϹᏟⲤꓚ", "D": "Ꭰᗞᗪꓓ", "E": "ЕΕᎬⴹꓰ", "F": "Ϝᖴꓝ", "G": "ԌᏀᏳꓖ", "H": "НΗᎻᕼⲎꓧ", "I": "ІΙӀⲒꓲ", "J": "ЈͿᎫᒍꓙ",
    "K": "КΚᏦⲔꓗ", "L": "ᏞᒪⳐꓡ", "M": "МΜᎷᗰⲘꓟ", "N": "ΝⲚꓠ", "O": "ОΟՕⲞꓳ", "P": "РΡᏢᑭⲢꓑ", "Q": "Ԛⵕ", "R": "ᎡᏒᖇꓣ", "S": "ЅՏᏕᏚꓢ", "T": "ТΤᎢⲦꓔ",
    "U": "Սᑌꓴ", "V": "ѴᏙᐯⴸꓦ", "W": "ԜᎳᏔꓪ", "X": "ХΧⲬꓫⵝ", "Y": "УΥҮᎩᎽⲨꓬ", "Z": "ΖᏃꓜ",
    "a": "аαɑ", "b": "ЬᏏᖯ", "c": "сϲⲥ", "d": "ԁᏧᑯ", "e": "еҽ", "g": "ɡց", "h": "һհᏂ", "i": "іιıɩᎥ", "j": "јϳ", "l": "ӏ",
    "n": "ոռ", "o": "оοօⲟ", "p": "рρⲣ", "q": "ԛգզ", "s": "ѕ", "u": "υսʋ", "v": "νѵ", "w": "ԝѡա", "x": "х", "y": "уү",
    "-": "‐‑﹣", "·": "ꞏ⋅∙・ᐧ",
}
LOOKALIKES = {x: to for to, others in LOOK.items() for x in others}

#: Compatibility mappings that keep the look: widths, no-break forms, fonts, ligatures and other sequences.
KEEPS_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<font>", "<compat>"}
#: Format characters that are seen (they enclose digits).
SEEN_FORMATS = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
#: Invisible characters that aren't of category Cf.
INVISIBLE = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
#: Where the Unicode database has marks that are ordered by class.
MARKS = ((0x300, 0x3100), (0xA66F, 0xABEE), (0xFB1E, 0xFE30), (0x101FD, 0x11F43), (0x16AF0, 0x16FF2), (0x1BC9E, 0x1BC9F), (0x1D165, 0x1E94B))
#: Where the Unicode database has decompositions or invisible characters.
RANGES = ((0, 0x3400), (0xA000, 0xAC00), (0xF900, 0x10000), (0x10780, 0x107C0), (0x110B0, 0x110D0), (0x1BCA0, 0x1BCB0), (0x1D000, 0x1F300), (0x2F800, 0x2FA20), (0xE0000, 0xE0200))


@lru_cache(None)
def classes() -> np.ndarray:
    """OTHER, LETTER, NUMBER or SPACE of each code point, as the classes L, N and White_Space of regular expressions."""
    table = np.zeros(SIZE, np.uint8)
    for lo, hi in ((0, 0x323B0), (0xE0000, 0xE0200)):
        kinds = [unicodedata.category(chr(c))[0] for c in range(lo, hi)]
        table[lo:hi] = [LETTER if k == "L" else NUMBER if k == "N" else OTHER for k in kinds]
    table[WHITE] = SPACE
    return table


# The letters of Latin, Greek and Cyrillic script that stand for vowels, without their accents.
VOWELS = "aeiouyæœøıαεηιουωаеиоуыэюяєіў"
UPPER, LOWER, VOWEL = 1, 2, 4


@lru_cache(None)
def shapes() -> np.ndarray:
    """UPPER or LOWER of each letter that has case, and VOWEL of those in VOWELS; letters of other scripts have neither."""
    table = np.zeros(SIZE, np.uint8)
    for c in (*range(0x41, 0x530), *range(0x1E00, 0x2000)):
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind[0] == "L":
            table[c] = (UPPER if kind in ("Lu", "Lt") else LOWER if kind == "Ll" else 0) | (VOWEL if unicodedata.normalize("NFD", ch.lower())[0] in VOWELS else 0)
    return table


def _plain(ch: str) -> str:
    """``ch`` without width, font and kind of space; nothing if it is invisible."""
    c = ord(ch)
    if c in INVISIBLE or (unicodedata.category(ch) == "Cf" and c not in SEEN_FORMATS):
        return ""
    if unicodedata.category(ch) == "Zs":
        return " "
    how = unicodedata.decomposition(ch)
    if how.startswith("<"):
        kind, *parts = how.split()
        if kind not in KEEPS_LOOK:
            return ch
        out = "".join(map(_plain, (chr(int(p, 16)) for p in parts)))
        return ch if out[:1] == " " and len(out) > 1 else out
    return ch


def _seen(ch: str) -> str:
    """What ``ch`` looks like: by the table, or else without width and font."""
    return LOOKALIKES.get(ch) or "".join(LOOKALIKES.get(x, x) for x in unicodedata.normalize("NFD", _plain(ch)))


@lru_cache(1 << 16)
def _prototype(ch: str) -> str:
    """What ``ch`` becomes in a skeleton: decomposed, each character replaced by its prototype, decomposed again."""
    return unicodedata.normalize("NFD", "".join(map(_seen, unicodedata.normalize("NFD", ch))))


@lru_cache(None)
def forms() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of code points that each becomes, their place in the third, the code points, combining class of each)."""
    size, at, flat, rank = np.ones(SIZE, np.int64), np.arange(SIZE), [np.arange(SIZE, dtype=np.uint32)], np.zeros(SIZE, np.uint8)
    more: list[int] = []
    for lo, hi in (*RANGES, (0xAC00, 0xD7A4)):
        for c in range(lo, hi):
            if 0xD800 <= c < 0xE000:
                continue
            to = _prototype(chr(c))
            if to != chr(c):
                size[c], at[c] = len(to), SIZE + len(more)
                more += map(ord, to)
    for lo, hi in MARKS:
        rank[lo:hi] = [unicodedata.combining(chr(c)) for c in range(lo, hi)]
    return size, at, np.concatenate([*flat, np.array(more, np.uint32)]), rank


def skeleton(text: str) -> str:
    """The skeleton of one text: decomposed, replaced by prototypes, decomposed again. Texts that look the same have one skeleton."""
    return unicodedata.normalize("NFD", "".join(map(_prototype, unicodedata.normalize("NFD", text))))


def consistent(text: str) -> str:
    """The consistent form of one text: its skeleton with letters and accents put together."""
    return unicodedata.normalize("NFC", skeleton(text))


# Letters that are one letter to the folding of words, since case and look lead from one to the other.
FOLD_TOGETHER = ("aаα", "bвβ", "eеε", "zζ", "hнηһ", "iіι", "kкκ", "mмμ", "nvνѵ", "oοоօ", "pрρ", "cсϲ", "tтτ", "yuуυү", "xхχ", "sѕ", "jјϳ", "dԁ", "qԛ", "wԝ", "lӏ", "σς", "gɡ")


@lru_cache(None)
def folds() -> tuple[np.ndarray, np.ndarray]:
    """(0 for what parts words, DROP for what leaves no trace, else the folded letter or digit; whether a text needs composing first)."""
    together = {ch: group[0] for group in FOLD_TOGETHER for ch in group}
    kinds, slow = classes(), np.zeros(SIZE, bool)
    for lo, hi in MARKS:
        slow[lo:hi] = [unicodedata.category(chr(c))[0] == "M" for c in range(lo, hi)]
    slow[list(ligatures())] = True
    slow[0x1100:0x1200] = True  # letters that are put together to syllables
    table = np.zeros(SIZE, np.uint32)
    word = (kinds == LETTER) | (kinds == NUMBER)
    table[word] = np.flatnonzero(word)
    todo = {c for lo, hi in RANGES for c in range(lo, hi)} | set(range(0x10400, 0x10600)) | set(range(0x1E900, 0x1E944))
    for c in todo:
        if 0xD800 <= c < 0xE000:
            continue
        plain = chr(c) if chr(c) in LOOKALIKES else _plain(chr(c))
        if not plain:
            table[c], slow[c] = DROP, False
        elif word[c] and len(plain) == 1:
            if unicodedata.category(chr(c))[0] == "N" and unicodedata.category(plain) != "Nd":
                table[c] = 0
                continue
            base = _prototype(plain).lower()
            whole = unicodedata.normalize("NFC", "".join(together.get(x, x) for x in base))
            table[c] = ord(whole[0])
    return table, slow


@lru_cache(None)
def ligatures() -> dict[int, str]:
    """Characters that look like several, and these."""
    return {c: x for lo, hi in RANGES for c in range(lo, hi) if not 0xD800 <= c < 0xE000 and len(x := _plain(chr(c))) > 1}


def composed(text: str) -> str:
    """``text`` with sequences of letter and mark put together and ligatures taken apart, as ``folds`` expects it."""
    text = unicodedata.normalize("NFC", text)
    longer = ligatures()
    return "".join(longer.get(ord(ch), ch) for ch in text) if any(ord(ch) in longer for ch in set(text)) else text
