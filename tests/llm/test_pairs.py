"""Near-duplicates and shared spans against brute force."""

import random

import numpy as np
import pytest

from tierlake.llm import anchors, neardup, shingles, spans, unify
from tierlake.llm.chars import consistent

WORDS = [f"{a}{b}{c}" for a in "bdfklmnprst" for b in "aeiou" for c in "lmnrst"]


def table(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, class string, a int")


def corpus(seed, n):
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(15, 120))]
        texts.append(" ".join(words) + "\nTerms and contact of the site")
        for _ in range(rng.choice([0, 0, 1, 3])):
            w = list(words)
            for _ in range(rng.randrange(1, max(2, len(w) // 6))):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], [rng.choice(WORDS)], [w[k], rng.choice(WORDS)]])
            texts.append(rng.choice([" ".join(w).upper(), " ".join(w), " ".join(w).replace("o", "о")]) + "\nTerms and contact of the site")
    return texts + [texts[0], texts[0], None, "", " ", "two words", "two words", "two wоrds", "Two  words!", "!?", "!?"]


def near(texts, threshold, size):
    import re

    def grams(t):
        w = re.findall(r"[^\W_]+", consistent(t).lower())
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}

    sets = [grams(t) if t and t.strip() else None for t in texts]
    forms = [consistent(t or "") for t in texts]
    out = set()
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            x, y = sets[a], sets[b]
            if x is None or y is None:
                continue
            if forms[a] == forms[b] or (x and y and len(x & y) >= threshold * len(x | y)):
                out.add((a, b))
    return out


@pytest.mark.parametrize(("threshold", "size"), [(0.5, 3), (0.8, 5)])
def test_near_pairs_against_brute_force(spark, threshold, size):
    texts = corpus(11, 60)
    want = near(texts, threshold, size)
    got = {tuple(r) for r in neardup.near_pairs(table(spark, texts), threshold, size).collect()}
    assert not got - want and len(got & want) >= 0.99 * len(want) and len(want) > 10
    assert neardup.near_pairs(table(spark, texts).where("false")).count() == 0


@pytest.mark.parametrize(("threshold", "size"), [(0.5, 3), (0.8, 5)])
def test_near_copies_that_are_a_third_of_all(spark, threshold, size):
    rng = random.Random(14)
    make = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    lines = [make(12) for _ in range(30)]
    family = ["\n".join(lines)] + ["\n".join([*lines[:k], make(12), *lines[k + 1 :]]) for k in range(24) for _ in range(3)]
    notice = make(30)
    texts = family + [f"{make(8)}\n{notice}" for _ in range(60)] + [make(40) for _ in range(90)]
    want = near(texts, threshold, size)
    got = {tuple(r) for r in neardup.near_pairs(table(spark, texts), threshold, size).collect()}
    assert not got - want and len(got) >= 0.999 * len(want) and len(want) > len(family)


@pytest.mark.parametrize(("n", "hot"), [(40, 256), (80, 256), (400, 20)])
def test_documents_that_share_a_notice(spark, monkeypatch, n, hot):
    monkeypatch.setattr(neardup, "HOT", hot)
    monkeypatch.setattr(neardup, "SPLIT", 50)
    rng = random.Random(n)
    make = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    notice = make(60)
    texts = [f"{make(15)}\n{notice}" for _ in range(n)]
    got = {tuple(r) for r in neardup.near_pairs(table(spark, texts)).collect()}
    assert got == {(a, b) for a in range(n) for b in range(a + 1, n)}


def test_links_of_different_texts_in_large_classes(spark):
    words = " ".join(WORDS[:30])
    looks = [words.replace("o", "о"), words.replace("a", "а"), words.replace("e", "е")]
    texts = [words] * 100 + looks + [words + " more"] * 2 + [looks[0] + " more"]
    got = {tuple(r) for r in neardup.near_pairs(table(spark, texts)).collect()}
    want = near(texts, 0.5, 3)
    head = {t: texts.index(t) for t in texts}
    listed = {(a, b) for a, b in want if texts[a] == texts[b] == words and a == 0 or texts[a] != words or texts[b] != words and (texts.count(texts[b]) == 1 or a == 0 or b == head[texts[b]])}
    assert got == listed and {(100, 101), (101, 102), (100, 103), (100, 105), (102, 104)} <= got
    assert {tuple(r) for r in unify.lookalike_pairs(table(spark, texts)).collect()} <= got


def test_pigeonhole_guarantee():
    rng = np.random.default_rng(3)
    most = neardup.CHUNKS * (neardup.ERRORS + 1) - 1
    for _ in range(300):
        a = rng.integers(0, 1 << 16, neardup.CHUNKS * neardup.WIDTH).astype(np.uint16)
        b = a.copy()
        b[rng.permutation(len(a))[:most]] ^= 1
        x, y = neardup.keys_of(np.stack([a, b]))
        assert np.intersect1d(x, y).size


def test_signatures_estimate_similarity():
    texts = corpus(12, 30)[:60]
    h, text = shingles.triples(*shingles.folded(texts))
    have, sig = neardup.signatures(h, text, len(texts))
    sets = shingles.triple_sets(texts)
    gap = [abs((sig[i] == sig[j]).mean() - len(np.intersect1d(sets[have[i]], sets[have[j]])) / len(np.union1d(sets[have[i]], sets[have[j]]))) for i in range(len(have)) for j in range(i)]
    assert max(gap) < 0.25 and np.mean(gap) < 0.02


def test_groups(spark):
    texts = corpus(13, 30)
    docs = table(spark, texts)
    pairs = near(texts, 0.8, 5)
    label = list(range(len(texts)))
    for _ in range(len(texts)):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["doc_id"]: r["group_id"] for r in neardup.groups(docs).collect()}
    assert got == {i: label[i] for i, t in enumerate(texts) if t and t.strip()}


def test_components_of_a_long_chain(spark):
    n = 70
    order = random.Random(1).sample(range(n), n)
    edges = spark.createDataFrame(list(zip(order, order[1:])) + [(200, 201), (201, 200), (5, 5)], "a bigint, b bigint")
    got = {r["node"]: r["label"] for r in neardup.components(edges).collect()}
    assert got == {i: 0 for i in range(n)} | {200: 200, 201: 200}


def long_texts(seed):
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice("abcdefgh \né日") for _ in range(n))
    shared = [make(n) for n in (299, 300, 301, 450, 900)]
    texts = [make(rng.randrange(0, 800)) for _ in range(15)]
    for s in shared:
        for _ in range(3):
            texts.append(make(rng.randrange(0, 200)) + "<" + s + ">" + make(rng.randrange(0, 200)))
    edited = texts[-1][:400] + "#" + texts[-1][401:]
    return texts + [edited, texts[-1], texts[-1], "ab" * 400, "ba" * 250 + "x", "z" + "ab" * 149 + "y", "q" * 310, "q" * 299, "q" * 700, None, "", " " * 400]


def runs(texts, size):
    sets = [{t[i : i + size] for i in range(len(t) - size + 1)} if t else set() for t in texts]
    return {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if sets[a] & sets[b]}


@pytest.mark.parametrize("hot", [200, 2])
def test_spans_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(spans, "HOT", hot)
    texts = long_texts(21)
    assert {tuple(r) for r in spans.span_pairs(table(spark, texts)).collect()} == runs(texts, 300)
    assert spans.span_pairs(table(spark, texts).where("false")).count() == 0


def test_shared_shares_against_brute_force(spark):
    texts = long_texts(22)
    count = {}
    for t in texts:
        for s in {t[i : i + 300] for i in range(len(t or "") - 299)} if t else ():
            count[s] = count.get(s, 0) + 1
    want = {}
    for i, t in enumerate(texts):
        if t and len(t) >= 300:
            seen = np.zeros(len(t), bool)
            for k in range(len(t) - 299):
                if count[t[k : k + 300]] > 1:
                    seen[k : k + 300] = True
            want[i] = (len(t), int(seen.sum()))
    assert {r["doc_id"]: (r["n_chars"], r["shared_chars"]) for r in spans.shared_shares(table(spark, texts)).collect()} == want


def test_every_shared_run_holds_a_sampled_kmer():
    rng = random.Random(4)
    for alphabet in ("abcdefgh", "ab", "é日x"):
        s = "".join(rng.choice(alphabet) for _ in range(anchors.SPAN))
        a, b = (("".join(rng.choice(alphabet) for _ in range(rng.randrange(400))) + s + "".join(rng.choice(alphabet) for _ in range(rng.randrange(400)))) for _ in range(2))
        text, _, h = anchors.sampled([a, b])
        assert set(h[text == 0].tolist()) & set(h[text == 1].tolist())


def test_hashes_of_windows():
    h = anchors.window_hashes(np.frombuffer("abcabcabd".encode("utf-32-le"), np.uint32), 3)
    assert len(h) == 7 and h[0] == h[3] and len(set(h.tolist())) == 4 and len(anchors.window_hashes(np.zeros(2, np.uint32), 3)) == 0
    assert unify.FULL_PAIRS >= 1
