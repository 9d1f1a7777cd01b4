"""Encoding against the public libraries, the lexicon, and packing."""

import base64
import random
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tierlake.llm import encode, packing
from tierlake.llm.lexicon import Lexicon, build

if not Path(encode.VOCABULARY).exists():
    pytest.skip("no vocabularies here", allow_module_level=True)

# Fixed value: the pattern that splits text before the vocabulary's merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TEXTS = [
    "", " ", "  ", "a  b", "a \n b", "\n\n x", "it's we'll I'd 'tis ''s \"'s he'S they're've", "tab\t\tq ", "x'sup 'llama '", "日本語 テスト 👩‍🚀", "don't'", "a'", "l'l", "'r", "é é 1½²", "<|endoftext|> a", "a\0b", "\xa0x  y　", "x" * 5000, "ab" * 40_000, "नमस्ते मित्र",
    "hPRq/LHqz6WQzsicOoxlNXK27mXOmnLinG1Q3h6RHBhP0Os5xYo9lZHSeIEPdjTlTKu30Ic=", "the the the quick quick", "\r\n\r\n", "áb", "﻿bom",
]


@pytest.fixture(scope="module")
def right():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(encode.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def table(spark, texts):
    return spark.createDataFrame([(i, t, [1], 5) for i, t in enumerate(texts)], "doc_id bigint, text string, ids array<int>, n_tokens int")


def test_ids_are_those_of_the_libraries(spark, right):
    docs = table(spark, [*TEXTS, None])
    got = {r["doc_id"]: r["ids"] for r in encode.encode(docs).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == right(t), t[:40]
    assert got[len(TEXTS)] == [] and got[0] == []
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(encode.VOCABULARY.replace(".tiktoken", ".json"))
    other.encode_special_tokens = True
    assert [x.ids for x in other.encode_batch(TEXTS, add_special_tokens=False)] == [got[i] for i in range(len(TEXTS))]
    counts = {r["doc_id"]: r["n_tokens"] for r in encode.encode(docs, ids=False).collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    assert encode.encode(docs.where("false")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t'strevmldaZé9½-!日"), st.characters(exclude_categories=["Cs"])), max_size=25), min_size=1, max_size=6))
def test_any_text(texts):
    import tiktoken

    if not hasattr(test_any_text, "enc"):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(encode.VOCABULARY, "rb"))}
        test_any_text.enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    empty = Lexicon(np.frombuffer(build([], []), np.uint8))
    ids, per, _ = encode.encode_texts(texts, empty, encode._merger(encode.VOCABULARY))
    assert [x.tolist() for x in np.split(ids, np.cumsum(per)[:-1])] == [test_any_text.enc(t) for t in texts]


def test_lexicon_finds_its_words_and_no_others(tmp_path):
    rng = random.Random(2)
    words = sorted({bytes(rng.choice(b"abcd") for _ in range(rng.randrange(1, 9))) for _ in range(500)})
    ids = [tuple(rng.randrange(50_000) for _ in range(rng.randrange(1, 4))) for _ in words]
    (tmp_path / "lexicon").write_bytes(build(words, ids))
    lexicon = Lexicon.mapped(str(tmp_path / "lexicon"))
    assert isinstance(lexicon.keys.base, np.memmap) or isinstance(lexicon.keys, np.memmap)
    asked = words + [b"", b"abcdabcdabcdabcd", b"e", *(w + b"x" for w in words[:50]), *(w[:-1] for w in words[:50])]
    data = np.frombuffer(b"".join(asked) or b"\0", np.uint8)
    lens = np.array([len(w) for w in asked])
    place = lexicon.places(data, np.cumsum(lens) - lens, lens)
    for w, p in zip(asked, place.tolist()):
        assert (p >= 0) == (w in words and w != b"")
        if p >= 0:
            assert tuple(lexicon.flat[lexicon.ends[p] : lexicon.ends[p + 1]]) == ids[words.index(w)]
    # shared suffixes: words with the same endings have one tail
    tails = sorted(a + b"tion" for a in (b"na", b"sta", b"ra", b"po"))
    assert len(Lexicon(np.frombuffer(build(tails, [(1,)] * 4), np.uint8)).finals) < sum(map(len, tails)) // 2


def test_containers(spark):
    rng = random.Random(4)
    sizes = [rng.randrange(1, 900) for _ in range(700)] + [0, None, 2048, 2049, 5000, 4096]
    frame = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)], "doc_id bigint, n_tokens bigint, container string")
    for block in (50_000, 100):
        rows = packing.pack(frame, block=block).collect()
        fill, of = {}, {}
        for r in rows:
            fill[r["container"]] = fill.get(r["container"], 0) + r["size"]
            of.setdefault(r["doc_id"], []).append(r)
        assert max(fill.values()) <= 2048 and all(fill[r["container"]] == r["fill"] for r in rows)
        for i, n in enumerate(sizes):
            assert sum(r["size"] for r in of.get(i, [])) == (n or 0) and (len(of.get(i, [])) > 1) == ((n or 0) > 2048)
            assert sorted(r["piece"] for r in of.get(i, [])) == list(range(len(of.get(i, []))))
        assert len(fill) <= -(-sum(n or 0 for n in sizes) // 2048) + (1 if block > 1000 else 6)
    assert packing.pack(frame.where("false")).count() == 0


def instances(rng, n):
    """Sizes that best fit packs with room left: thirds of full bins, sizes between a fifth and a half, between a seventh and a half, and any."""
    thirds = []
    for _ in range(n // 3):
        a = rng.randrange(512, 1024)
        b = rng.randrange(512, min(1024, 2048 - a - 511))
        thirds += [a, b, 2048 - a - b]
    return {"thirds": thirds, "fifth": [rng.randrange(410, 1024) for _ in range(n)], "seventh": [rng.randrange(300, 920) for _ in range(n)], "any": [rng.randrange(1, 2049) for _ in range(n)], "equal": [700] * n, "small": [rng.randrange(1, 9) for _ in range(n)]}


def test_local_search_saves_bins():
    saved = {}
    for kind, sizes in instances(random.Random(5), 600).items():
        square = lambda bs: sum(sum(sizes[k] for k in b) ** 2 for b in bs)  # noqa: E731, B023
        first = packing.best_fit(sizes, 2048)
        for start in (first, [[k] for k in range(len(sizes))], [list(range(k, min(k + 2, len(sizes)))) for k in range(0, len(sizes), 2)] if max(sizes) <= 1024 else first):
            after = packing.local_search([list(b) for b in start], sizes, 2048)
            assert sorted(k for b in after for k in b) == list(range(len(sizes))) and all(sum(sizes[k] for k in b) <= 2048 for b in after)
            assert square(after) >= square(start) and len(after) <= len(first), kind
            shelf = packing._Shelf(after, sizes, 2048)
            for i in range(len(after)):
                if shelf.loose(i):
                    shelf.put(i)
            assert not any(shelf.best(i) for i in range(len(after)) if shelf.loose(i))
            if start is first:
                saved[kind] = len(first) - len(after)
    assert saved["thirds"] > 15 and saved["fifth"] > 4 and saved["seventh"] > 3 and min(saved.values()) >= 0
    assert packing.local_search([], [], 2048) == []


def test_a_lexicon_doesnt_depend_on_partitions(spark):
    rng = random.Random(3)
    counts = spark.createDataFrame([(f"w{i}".encode(), min(5, 1 + int(rng.paretovariate(0.8)))) for i in range(3000)] + [(b"x" * 40, 99), (b"often", 70_000)], "word binary, n bigint")
    got = [{bytes(r[0]) for r in encode.frequent_words(counts.repartition(k), 400).collect()} for k in (4, 64)]
    assert got[0] == got[1] and b"often" in got[0] and b"x" * 40 not in got[0] and 320 < len(got[0]) < 480
    assert encode.frequent_words(counts.where("false"), 400).count() == 0 and encode.frequent_words(counts, 5000).count() == counts.where("n > 1").count() - 1


def test_split_documents(spark, right):
    texts = ["word " * 3000, "short", None, "", "x y " * 1024, "x y " * 1030]
    docs = table(spark, texts)
    assert {r[0] for r in packing.split_documents(docs).collect()} == {i for i, t in enumerate(texts) if t and len(right(t)) > 2048}
