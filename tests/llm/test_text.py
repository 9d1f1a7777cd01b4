"""Consistent forms, site lines, quality and languages."""

import random
import unicodedata

import numpy as np
import pytest

from tierlake.llm import chars, language, quality, queries, sitelines, unify

COLUMNS = "doc_id bigint, text string, lang string, source string, form_a string, site string, label string, line string"


def table(spark, texts, source="s", lang="en", start=1):
    rows = [(start + i, t, lang, source, "x", "y", "z", "w") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS)


SAME = ["The long answer, naïve – yes!", "Тhе lоng аnswеr, naïve – yes!", "The lo​ng an­swer, naïve – yes!", "Ｔｈｅ long answer, naïve – yes!", "The\xa0long answer, naïve – yes!"]
OTHER = ["The long answer, naive – yes!", "the long answer, naïve – yes!", "The long answer, naïve –\nyes!", "The 1ong answer, naïve – yes!", "The long answers, naïve – yes!"]


def test_consistent_form():
    assert {chars.consistent(t) for t in SAME} == {chars.consistent(SAME[0])}
    assert chars.consistent(SAME[0]) not in {chars.consistent(t) for t in OTHER}
    assert chars.consistent("ﬁne ‑ x² ½ Ⅳ") == "fine - x² ½ IV" and chars.consistent("") == "" and chars.consistent("日本 नमस्ते") == unicodedata.normalize("NFC", "日本 नमस्ते")
    assert chars.consistent("ё") == "ë" and chars.consistent("‍﻿") == ""


def test_bulk_forms_are_those_of_single_texts():
    rng = random.Random(3)
    alphabet = [*"abc XyZ\n\t019éñÅ", "á", "о", "Ｗ", "​", "\xad", "ﬁ", "日", "한", "ᄒ", "ᅡ", "́", "\xa0", "🙂", "न", "्"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(400)] + ["", "\0", "plain"]
    assert ["".join(map(chr, f[:-1])) for f in unify.skeletons(texts)] == [chars.skeleton(t) for t in texts]


def test_lookalikes_of_many_scripts():
    for to, others in chars.LOOK.items():
        assert {chars.consistent(x) for x in others} == {to} and {chars.consistent(f"{x}\u0301") for x in others} == {chars.consistent(f"{to}\u0301")}
    assert chars.consistent("ı ց Ꭺ Ꮮ Ь") == "i g A L b" and sum(map(len, chars.LOOK.values())) < 200
    table, _ = chars.folds()
    assert all(table[ord(x)] == table[ord(to.lower())] for to, others in chars.LOOK.items() for x in others if to.isalpha())


def test_pairs_that_look_the_same(spark):
    texts = [*SAME, SAME[1], *OTHER, None, "", " \n", "​", "\xa0"]
    got = {tuple(r) for r in unify.lookalike_pairs(table(spark, texts)).collect()}
    ids = [1, 2, 3, 4, 5, 6]
    assert got == {(a, b) for a in ids for b in ids if a < b} - {(2, 6)}
    groups = {r["doc_id"]: (r["group_id"], r["n_texts"]) for r in unify.groups(table(spark, texts)).collect()}
    assert groups[6] == (1, 5) and groups[7] == (7, 1) and len(groups) == 11
    forms = {r["doc_id"]: r["form"] for r in unify.forms_of(table(spark, texts)).collect()}
    assert forms[12] is None and forms[13] == "" and forms[2] == forms[1]
    for part in (table(spark, []), table(spark, [None, ""])):
        assert unify.lookalike_pairs(part).count() == unify.groups(part).count() == 0


def test_large_classes_of_copies_are_tied_by_their_heads(spark):
    texts = [SAME[0]] * 40 + [SAME[1]] * 50
    got = {tuple(r) for r in unify.lookalike_pairs(table(spark, texts)).collect()}
    assert got == {(1, 41 + i) for i in range(50)} | {(1 + i, 41) for i in range(40)}


def site(rng):
    lines = ["Terms | Contact", "Share this page", "Sign up", "rare note"]
    docs = []
    for i in range(60):
        body = [f"Body {rng.random()}" for _ in range(rng.randrange(4))]
        for n, line in enumerate(lines):
            if rng.random() < (0.9, 0.5, 0.4, 0.1)[n]:
                body.insert(rng.randrange(len(body) + 1), rng.choice([line, f" {line}\t", line]))
        docs.append(rng.choice(["\n", "\n\n"]).join(body) if i % 20 else rng.choice([None, ""]))
    return docs


def test_repeated_lines_against_counts(spark):
    rng = random.Random(5)
    texts = site(rng)
    docs = table(spark, texts).union(table(spark, ["Only here\nx"] * 4, "few", start=200)).union(table(spark, ["Five\n\ny\nFive"] * 5, "five", start=300)).union(table(spark, ["No site"] * 9, None, start=400))
    rows = [(r["doc_id"], r["source"], r["text"]) for r in docs.collect()]
    want = set()
    for source in ("s", "few", "five"):
        own = [(i, t or "") for i, s, t in rows if s == source]
        count = {}
        for _, t in own:
            for line in {x.strip(" \t") for x in t.split("\n")} - {""}:
                count[line] = count.get(line, 0) + 1
        for i, t in own:
            want |= {(i, k + 1) for k, x in enumerate(t.split("\n")) if count.get(x.strip(" \t"), 0) >= max(5, 0.3 * len(own))}
    assert {tuple(r) for r in sitelines.repeated_lines(docs).collect()} == want and (300, 4) in want
    clean = {r["doc_id"]: r["text"] for r in sitelines.without_site_lines(docs).collect()}
    for i, _, t in rows:
        assert clean[i] == (t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k + 1) not in want)), i
    assert sitelines.repeated_lines(docs.where("false")).count() == 0 and set(docs.columns) == set(sitelines.without_site_lines(docs).columns)


def test_sequences_against_brute_force(spark):
    texts = site(random.Random(6))
    patterns, seqs = sitelines.mined(table(spark, texts), share=0.15)
    got = {tuple(r["pattern"]): r["support"] for r in patterns.collect()}
    own = [[y["line"] for y in r["seq"]] for r in seqs.collect()]

    def holds(seq, pattern):
        it = iter(seq)
        return all(x in it for x in pattern)

    lines = {x for s in own for x in s}
    support = lambda p: sum(holds(s, p) for s in own)
    every = [(a,) for a in lines] + [(a, b) for a in lines for b in lines] + [(a, b, c) for a in lines for b in lines for c in lines]
    often = {p: n for p in every if (n := support(p)) >= max(5, 0.15 * len(texts))}
    assert all(support(p) == n for p, n in got.items()) and max(map(len, got)) > 1
    for p, n in often.items():
        assert any(m == n and holds(q, p) for q, m in got.items()), p
    for p, n in got.items():
        assert all(support((*p, x)) < n for x in lines), p
    assert {x for p in got for x in p} == {p[0] for p in often if len(p) == 1}


PROSE = [
    "The harbour keeps its story after the winter, and nobody in the village can explain why it does. She wrote to us about that.",
    "Jede Brücke hat ihre Geschichte, aber niemand in diesem Dorf kennt sie noch. Wir haben das auf dem Markt gehört.",
    "Notes\nThe list below is short, so it is easy to read:\n* one\n* two\nAll of it was written by the people who live near the river.",
    "— Where are you from? he asked.\n— From the island, she said, and I will go back to it.",
    "this is a post about my cat and how she sleeps on the old chair :) @mira #cats",
    "Тhе hаrbour kеерs іtѕ story аfter thе wіntеr, and nobody іn the vіllage can еxplain why it doеs.",
    "日本語の文章です。これは普通の文で、リストではありません。",
]
JUNK = [
    "\n".join(f"* item {i} lamp" for i in range(12)),
    "\n".join(f"{i};lamp;{i * 7}.50;door" for i in range(12)),
    "\n".join("hPRq/LHqz6WQzsicOoxlNXK27mXOmnLinG1Q3h6RHBhP0Os5xYo9lZHSeIEPdjTlTKu30Ic=" for _ in range(5)),
    "\n".join(f"| lamp{i} | {i} | door |" for i in range(9)),
    "var a=function(b){return c[71]||{};};\n<div class=\"x y\"><span id=\"q\"></span></div>\n.a-34 { margin:36px; color:#e65cd3 }",
    "lamp table lamp river lamp lamp table stone river lamp lamp table lamp stone lamp river table lamp lamp lamp",
    "T¤e ha±b¿ur k¦eps i§s st¿ry a±ter t¬e w§nter, a¤d n¿bod¦ in ¬he v±lla§e c¤n exp¿ain ¦hy i¬ do±s.",
    "dbsfmfeiw ogqkrkbkotx kjgivvt wqditch kxkzogvnttxx jelhr wcbclke xpjny? hhr tml htgv hkvgmzq wolgkmyuo.",
    "\n".join(["Home page of the old museum and the river."] * 30),
]


def test_running_text_and_junk(spark):
    docs = table(spark, PROSE + JUNK + [None, "", " \n "])
    assert {r[0] for r in quality.not_running(docs).collect()} == set(range(len(PROSE) + 1, len(PROSE) + len(JUNK) + 1))
    stats = {r["doc_id"]: r for r in quality.statistics(docs).collect()}
    assert all(stats[len(PROSE) + len(JUNK) + k]["running"] is None for k in (1, 2, 3)) and stats[len(PROSE) + len(JUNK) + 1]["n_words"] == 0
    assert quality.statistics(docs.where("false")).count() == 0


def test_statistics_by_hand(spark):
    text = "The cat sat on the mat.\nred cat red cat\n\nred cat red cat\nx: 12%"
    r = quality.statistics(table(spark, [text])).first()
    words = ["The", "cat", "sat", "on", "the", "mat", "red", "cat", "red", "cat", "red", "cat", "red", "cat", "x", "12"]
    seen = len("".join(text.split()))
    assert (r["n_lines"], r["n_words"]) == (4, len(words)) and abs(r["mean_word_length"] - sum(map(len, words)) / len(words)) < 1e-9
    assert abs(r["symbol_ratio"] - 3 / seen) < 1e-9 and abs(r["digit_ratio"] - 2 / seen) < 1e-9 and r["stop_line_share"] == 0.25
    assert abs(r["common_word_share"] - 3 / 16) < 1e-9 and abs(r["dup_line_share"] - 12 / seen) < 1e-9 and abs(r["top_word_share"] - 5 / 16) < 1e-9
    assert r["dup_paragraph_share"] == 0 and abs(r["top_2gram_share"] - 4 * 6 / sum(map(len, words))) < 1e-9


LANGS = {
    "en": "the village keeps its story and nobody knows why the river is so high after the winter when she went there with us",
    "de": "das dorf behält seine geschichte und niemand weiß warum der fluss nach dem winter so hoch ist wenn wir dort sind",
    "fr": "le village garde son histoire et personne ne sait pourquoi la rivière est si haute après notre hiver quand nous y allons",
    "ru": "деревня хранит свою историю и никто не знает почему река так высока после зимы когда мы туда едем с ней",
}


def made(rng, lang, n):
    return " ".join(rng.choice(LANGS[lang].split()) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    rows, truth = [], {}
    codes = spark.createDataFrame([(x, x) for x in LANGS] + [("English", "en")], "label string, lang string")
    for i in range(240):
        lang = rng.choice(list(LANGS))
        lines = [made(rng, lang, 20) for _ in range(3)]
        other = rng.choice([x for x in LANGS if x != lang])
        case = rng.choice(["right", "right", "right", "right", "missing", "wrong", "mixed", "phrase"])
        label = {"missing": rng.choice([None, "xx", ""]), "wrong": other}.get(case, lang)
        langs = {lang}
        if case == "mixed":
            lines.insert(1, made(rng, other, 15))
            langs.add(other)
        if case == "phrase":
            lines.insert(1, made(rng, other, 6))
        rows.append((i, "\n".join(lines), label, "s", "x", "y", "z", "w"))
        if case in ("missing", "wrong", "mixed"):
            truth[i] = langs
    rows += [(900, None, None, "s", "x", "y", "z", "w"), (901, "", "en", "s", "x", "y", "z", "w"), (902, JUNK[0], None, "s", "x", "y", "z", "w")]
    return spark.createDataFrame(rows, COLUMNS), codes, truth


def test_languages_of_documents(labelled):
    docs, codes, truth = labelled
    got = {}
    for i, lang in language.relabelled(docs, codes).collect():
        got.setdefault(i, set()).add(lang)
    assert got == truth
    parts = language.segments(docs, codes).collect()
    assert all(0 < r["confidence"] <= 1 and r["first_line"] <= r["last_line"] for r in parts)
    assert {r["doc_id"] for r in language.documents(docs, codes).collect()} == set(range(240))
    assert language.relabelled(docs.where("false"), codes).count() == language.segments(docs, codes.where("false")).count() == 0


def test_held_out_accuracy():
    rng = random.Random(9)
    names = sorted(LANGS)
    texts = [made(rng, names[i % 4], 25) for i in range(200)]
    label = np.arange(200) % 4
    noisy = np.where(np.random.default_rng(1).random(160) < 0.15, (label[:160] + 1) % 4, label[:160])
    matrix = language.fit_texts(texts[:160], noisy, 4)
    c = quality.count(texts[160:])
    use, score = language.score_lines(c, matrix, 5)
    assert (score.argmax(1) == label[160:][c.line_text[use]]).all() and (language.confidence(score) > 0.5).all()


def test_copies_that_fill_their_source_are_judged_whole(labelled):
    docs, codes, _ = labelled
    spark = docs.sparkSession
    rng = random.Random(6)
    junk = "\n".join(f"{k};{k * 7};AX-{k};;|" for k in range(12))
    prose = "\n".join(made(rng, "de", 20) for _ in range(3))
    other = [(f"{made(rng, 'en', 25)}\nHome | Contact | Terms", "en") for _ in range(6)]
    rows = [(1000 + k, t, lang, "small", "", "", "", "") for k, (t, lang) in enumerate([(junk, None)] * 5 + [(prose, None)] * 5 + other)]
    some = docs.unionByName(spark.createDataFrame(rows, COLUMNS))
    assert {r[0] for r in quality.not_running(some).collect()} >= set(range(1000, 1005))
    assert {tuple(r) for r in language.relabelled(some, codes).where("doc_id >= 1000").collect()} == {(k, "de") for k in range(1005, 1010)}
    stats = {r["doc_id"]: r for r in quality.statistics(some).where("doc_id >= 1000").collect()}
    assert stats[1000]["n_lines"] == 12 and stats[1000]["running"] is False and stats[1005]["running"] and stats[1010]["n_lines"] == 2


def test_every_document_has_a_language(labelled, tmp_path):
    docs, codes, _ = labelled
    spark = docs.sparkSession
    more = {1000: (made(random.Random(3), "fr", 6), "fr"), 1001: ("\n".join(f"* {w}" for w in LANGS["de"].split()), "de"), 1002: ("12 | 34", None), 1003: (" \n", None)}
    docs.unionByName(spark.createDataFrame([(k, t, None, "s", "x", "y", "z", "w") for k, (t, _) in more.items()], COLUMNS)).write.parquet(f"{tmp_path}/documents.parquet")
    codes.write.parquet(f"{tmp_path}/lang_codes.parquet")
    rows = queries.queries()["p5_documents"](spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in rows) == [*range(240), 902, 1000, 1001, 1002]
    got = {r["doc_id"]: r for r in rows}
    assert all(got[k]["lang"] == more[k][1] for k in (1000, 1001, 1002)) and all(0 <= r["confidence"] <= 1 for r in rows)


def test_sequences_of_any_length(spark):
    notice = [f"Notice {k}" for k in range(9)]
    texts = ["\n".join(["x", *notice[:3], "y", *notice[3:], f"own {k}"]) for k in range(6)] + ["\n".join(notice[:4])] * 2
    patterns, _ = sitelines.mined(table(spark, texts), share=0.6)
    got = {len(r["pattern"]): r["support"] for r in patterns.collect()}
    assert got[11] == 6 and got[4] == 8 and patterns.count() <= 4  # of 2,047 sequences that are frequent


def test_many_lines_are_joined_by_source_and_salt(spark, monkeypatch):
    docs = table(spark, site(random.Random(7)))
    want = {tuple(r) for r in sitelines.repeated_lines(docs).collect()}
    monkeypatch.setattr(sitelines, "FEW", 1)
    assert {tuple(r) for r in sitelines.repeated_lines(docs).collect()} == want and len(want) > 50


def test_lines_keep_their_numbers(labelled):
    docs, codes, _ = labelled
    spark = docs.sparkSession
    rng = random.Random(2)
    texts = [f"Home | Contact\n\n{made(rng, 'en', 20)}\nShare this page\n{made(rng, 'de', 20)}" for _ in range(8)]
    some = docs.unionByName(table(spark, texts, "paper", start=2000))
    got = sorted((r["first_line"], r["last_line"], r["lang"]) for r in language.segments(some, codes).where("doc_id = 2000").collect())
    assert got == [(3, 3, "en"), (5, 5, "de")]


# One paragraph in each of some languages that no word list knows, by the tests' author.
ELSEWHERE = {
    "pl": "Wczoraj wieczorem poszedłem z siostrą do starego kina na rogu ulicy. Film był długi, ale nikt się nie nudził, bo aktorzy grali znakomicie. Po seansie rozmawialiśmy jeszcze godzinę o tym, co zobaczyliśmy.",
    "sv": "I går kväll gick jag till den gamla biografen vid hörnet tillsammans med min syster. Filmen var lång, men ingen blev uttråkad eftersom skådespelarna var mycket skickliga.",
    "fi": "Eilen illalla menin siskoni kanssa vanhaan elokuvateatteriin kadun kulmassa. Elokuva oli pitkä, mutta kukaan ei pitkästynyt, koska näyttelijät olivat erinomaisia.",
    "tr": "Dün akşam kız kardeşimle köşedeki eski sinemaya gittim. Film uzundu ama kimse sıkılmadı çünkü oyuncular çok iyiydi. Sonra gördüklerimiz hakkında bir saat daha konuştuk.",
    "uk": "Учора ввечері я пішов із сестрою до старого кінотеатру на розі вулиці. Фільм був довгий, але ніхто не нудьгував, бо актори грали чудово.",
    "cs": "Včera večer jsem šel se sestrou do starého kina na rohu ulice. Film byl dlouhý, ale nikdo se nenudil, protože herci hráli výborně.",
    "hu": "Tegnap este a nővéremmel elmentünk a sarkon álló régi moziba. A film hosszú volt, de senki sem unatkozott, mert a színészek kitűnően játszottak.",
    "vi": "Tối qua tôi cùng em gái đi xem phim ở rạp cũ góc phố. Bộ phim rất dài nhưng không ai thấy chán vì các diễn viên diễn rất hay.",
}
NOWHERE = {
    "a phrase again and again": "the quick baker of our small town sells very good bread today. " * 30,
    "paragraphs again and again": "It was the end of the long day for us all,\nand we went home by the river.\n\n" * 12,
    "enumerated": "Jabłka, gruszki, śliwki, wiśnie, czereśnie, morele, brzoskwinie, banany.\nMleko, ser, masło, jajka, chleb, bułki, kiełbasa, szynka.",
    "random letters": "Edvggokst fon wymyhd kljzhdqu lyzjkrbsscfh xlypoiv ah nvbieqib dmhoryz jubavzzyik.\nVgqepj jdh mtz dmucsfuqtaa hp dvivztfk tvbsm bgyfwau.",
    "words": "Sosna kamień okno drzewo rzeka miasto książka lampa stół krzesło dywan obraz zegar półka",
}


def test_running_text_in_any_language():
    running, prose, _, _ = quality.verdicts(quality.count([*ELSEWHERE.values(), *NOWHERE.values()]))
    assert dict(zip([*ELSEWHERE, *NOWHERE], running.tolist())) == dict.fromkeys(ELSEWHERE, True) | dict.fromkeys(NOWHERE, False)
    wrapped = "\n".join(ELSEWHERE["pl"][i : i + 70] for i in range(0, len(ELSEWHERE["pl"]), 70))
    assert quality.verdicts(quality.count([wrapped]))[0][0] and quality.verdicts(quality.count(["", "x"]))[0].tolist() == [False, False]
