"""Every operator over nulls in any column, repeated rows, very long and odd texts, ties and empty tables."""

import pytest

from tierlake.llm import encode, language, neardup, packing, quality, sitelines, spans, unify

OPERATORS = {
    "stats": quality.statistics,
    "not_running": quality.not_running,
    "pairs": unify.lookalike_pairs,
    "forms": unify.forms_of,
    "groups": unify.groups,
    "lines": sitelines.repeated_lines,
    "sequences": lambda d: sitelines.mined(d)[0],
    "clean": sitelines.without_site_lines,
    "segments": lambda d: language.segments(d, codes(d)),
    "documents": lambda d: language.documents(d, codes(d)),
    "relabelled": lambda d: language.relabelled(d, codes(d)),
    "near": neardup.near_pairs,
    "near_groups": neardup.groups,
    "ids": encode.encode,
    "containers": packing.containers,
    "split": packing.split_documents,
    "spans": spans.span_pairs,
    "shares": spans.shared_shares,
}


def codes(d):
    return d.sparkSession.createDataFrame([("en", "en"), ("de", "de"), (None, "fr"), ("x", None)], "label string, lang string")


@pytest.fixture(scope="module")
def odd(spark):
    long = "The harbour keeps its story after the winter and nobody knows why. " * 3000
    texts = [None, "", " ", "\n\n\n", "\0", "a", "word", long, long, long.upper(), "x" * 100_000, "́́", "​", "🙂" * 400, "日本語 " * 200, "a\r\nb\r\nc", "ab " * 500, "<|endoftext|>", "\t|\t|\n" * 50]
    rows = [(i, t, l, s, i, "q") for i, t in enumerate(texts) for l, s in (("en", "s"),)]
    rows += [(7, long, "en", "s", 7, "q"), (None, long, None, None, None, None), (None, None, None, None, None, None), (40, "Same line\nother", "de", None, None, "q"), (41, long, None, "", None, "q")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, class bigint, a string")


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_tables(odd, name):
    if name in ("ids", "containers", "split"):
        from pathlib import Path

        if not Path(encode.VOCABULARY).exists():
            pytest.skip("no vocabularies here")
    rows = OPERATORS[name](odd).collect()
    if name in ("pairs", "near", "spans"):
        assert all(r[0] < r[1] for r in rows) and len(set(rows)) == len(rows)
    if name in ("near", "spans"):
        assert {(7, 8), (7, 41), (8, 41)} <= {tuple(r) for r in rows}
    if name in ("ids", "stats", "forms", "clean"):
        assert len(rows) == odd.count()
    assert OPERATORS[name](odd.where("false")).count() == 0
    assert OPERATORS[name](odd.where("text is null")).count() == (odd.where("text is null").count() if name in ("ids", "stats", "forms", "clean") else 0)
