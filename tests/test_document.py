"""The layer algebra in Python on a document worked out by hand, and its compiled columns against it."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tierlake.document import NOTHING, Document, units_of, value_of, wire_of
from tierlake.errors import IndexingError, LayerNotFoundError, ModelError
from tierlake.meta import Catalog, LayerDesc, LayerType
from tierlake.operators.layers import Layers
from tierlake.sources import ingest

BASIC = Catalog.from_dict(
    {
        "text": {"type": "characters"},
        "words": {"type": "span", "base": "text"},
        "pos": {"type": "seq", "base": "words", "data": "string"},
        "is_noun": {"type": "element", "base": "words", "data": "string"},
        "parts": {"type": "div", "base": "words"},
        "chars": {"type": "div", "base": "text"},
        "ents": {"type": "span", "base": "words", "data": "string"},
        "prev": {"type": "element", "base": "words", "data": "link", "target": "words"},
    }
)
#: Bytes: Zoë 0-4, paints 5-11, old 12-15, boats 16-21, ! 21-22.
DOC = {
    "text": "Zoë paints old boats!",
    "words": [[0, 4], [5, 11], [12, 15], [16, 21], [21, 22]],
    "pos": ["N", "V", "A", "N", "P"],
    "is_noun": [[0, "name"], [3, "thing"]],
    "parts": [0, 3],
    "chars": [0, 12],
    "ents": [[0, 1, "who"], [2, 4, "what"]],
    "prev": [[1, 0], [3, 2]],
}


def test_values_rise_by_kind():
    assert sorted(map(value_of, [(1, "a"), 3, "b", None, "a", 1, (0, "z")])) == list(map(value_of, [None, "a", "b", 1, 3, (0, "z"), (1, "a")]))


def test_layer_algebra():
    d = Document(BASIC, DOC)
    where = [tuple(x) for x in DOC["words"]]
    assert d.text("words") == ["Zoë", "paints", "old", "boats", "!"] == d.text("pos")
    assert d.indexes("words", "words") == list(zip(range(5), range(1, 6))) and d.indexes("pos", "text") == where
    assert d.data("words") == [NOTHING] * 5 and d.data("prev") == [value_of(0), value_of(2)]
    assert d.data("is_noun") == [value_of("name"), value_of("thing")] and d.text("is_noun") == ["Zoë", "boats"]
    assert [d.indexes("is_noun", t) for t in ("is_noun", "words", "text")] == [[(0, 1), (1, 2)], [(0, 1), (3, 4)], [where[0], where[3]]]
    assert d.indexes("parts", "words") == [(0, 3), (3, 5)]
    assert d.indexes("parts", "text") == [(0, 16), (16, 21)] and d.indexes("parts", "text", "full") == [(0, 16), (16, 22)]
    assert d.indexes("chars", "text") == [(0, 12), (12, 22)]
    assert d.indexes_data("ents", "text") == [(0, 4, value_of("who")), (12, 21, value_of("what"))] and d.text("ents") == ["Zoë", "old boats"]
    assert d.length("text") == 22 and d.length("pos") == 5
    assert d.indexes("text", "text")[-1] == (21, 22)


def test_errors_of_documents():
    d = Document(BASIC, {"text": "é"})
    with pytest.raises(LayerNotFoundError):
        d.indexes("words", "text")
    with pytest.raises(IndexingError):
        d.indexes("text", "words")
    with pytest.raises(ModelError):
        Document(BASIC, {"absent": []})
    with pytest.raises(ModelError):
        Document(BASIC, {"text": "x", "words": [1]})
    with pytest.raises(IndexingError):
        Document(BASIC, {"text": "é", "words": [[0, 1]]}).text("words")
    with pytest.raises(IndexingError):
        Document(BASIC, {"text": "ab", "words": [[0, 40]]}).text("words")


def test_shapes_read_back():
    for kind, raw in (
        (LayerType.seq, ["a", "b"]), (LayerType.seq, [1, 2]), (LayerType.seq, [[1, "x"]]), (LayerType.seq, ["a", None]), (LayerType.div, [0, 5]), (LayerType.div, [[0, "x"], [4, "y"]]),
        (LayerType.element, [[1, 2]]), (LayerType.element, [[1, 2, "t"]]), (LayerType.span, [[0, 4]]), (LayerType.span, [[0, 4, 2]]), (LayerType.span, [[0, 4, "x"]]), (LayerType.span, [[0, 4, 2, "x"]]), (LayerType.span, []),
    ):
        assert wire_of(kind, units_of(kind, raw, 9)) == raw
    for kind, raw in ((LayerType.seq, [[1, 2]]), (LayerType.span, [1]), (LayerType.span, [[1, "x"]]), (LayerType.div, ["x"]), (LayerType.div, [5, 1]), (LayerType.element, [-1]), (LayerType.span, "x"), (LayerType.span, [["x", 1]])):
        with pytest.raises(ModelError):
            units_of(kind, raw, 9)


def test_catalog():
    assert BASIC.root("is_noun") == "text" and BASIC.depth("pos") == 2 and BASIC.chain("ents") == ["ents", "words", "text"]
    with pytest.raises(ModelError):
        Catalog({"a": LayerDesc(LayerType.seq, "b"), "b": LayerDesc(LayerType.seq, "a")}).chain("a")
    with pytest.raises(ModelError):
        BASIC.with_layer("x", LayerDesc(LayerType.span))
    with pytest.raises(ModelError):
        BASIC.with_layer("x", LayerDesc(LayerType.characters, "text"))
    desc = LayerDesc.from_dict({"type": "Span", "base": "text", "data": "Link", "colour": 1})
    assert desc.data == "link" and desc.to_dict() == {"type": "span", "base": "text", "data": "link", "meta": {"colour": 1}}


texts = st.text(st.sampled_from("ab é日\n"), min_size=1, max_size=12)


@st.composite
def documents(draw):
    text = draw(texts)
    cuts = [0]
    for ch in text:
        cuts.append(cuts[-1] + len(ch.encode()))
    n = draw(st.integers(1, 5))
    words = [sorted(draw(st.tuples(st.sampled_from(cuts), st.sampled_from(cuts)))) for _ in range(n)]
    doc = {"text": text, "words": [list(w) for w in words]}
    if draw(st.booleans()):
        doc["pos"] = [draw(st.sampled_from(["DT", "NN", "é"])) for _ in range(draw(st.integers(0, n + 1)))]
    if draw(st.booleans()):
        doc["parts"] = sorted(draw(st.sets(st.integers(0, n - 1), min_size=0, max_size=3)))
    if draw(st.booleans()):
        a = draw(st.integers(0, n - 1))
        doc["ents"] = [[a, draw(st.integers(a + 1, n)), draw(st.sampled_from(["X", "Y"]))]]
    if draw(st.booleans()):
        doc["prev"] = [[draw(st.integers(0, n - 1)), draw(st.integers(0, n - 1))]]
    return doc


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(documents(), min_size=1, max_size=12))
def test_columns_give_what_documents_give(spark, docs):
    frame = ingest.from_objects(spark, [(str(i), d) for i, d in enumerate(docs)], BASIC)
    for tail in ("reference", "full"):
        layers = Layers(BASIC, div_tail=tail)
        names = ["words", "pos", "parts", "ents", "prev"]
        cols = [f(n).alias(f"{n}_{k}") for n in names for k, f in (("text", layers.text), ("idx", lambda n: layers.indexes(n, "text")), ("data", layers.data), ("both", lambda n: layers.indexes_data(n, "text")), ("self", lambda n: layers.indexes(n, n)), ("len", layers.length))]
        for row in frame.select("doc_pos", *cols).collect():
            d = Document(BASIC, docs[row["doc_pos"]])
            for n in names:
                if n not in d:
                    assert row[f"{n}_text"] is None and row[f"{n}_idx"] is None and row[f"{n}_data"] is None and row[f"{n}_len"] is None
                    continue
                assert row[f"{n}_text"] == d.text(n, tail)
                assert [tuple(x) for x in row[f"{n}_idx"]] == d.indexes(n, "text", tail)
                assert [tuple(x) for x in row[f"{n}_data"]] == d.data(n)
                assert [(x["s"], x["e"], tuple(x["d"])) for x in row[f"{n}_both"]] == d.indexes_data(n, "text", tail)
                assert [tuple(x) for x in row[f"{n}_self"]] == d.indexes(n, n) and row[f"{n}_len"] == d.length(n)


def test_a_unit_past_the_text_is_an_error_or_clipped(spark):
    frame = ingest.from_objects(spark, [("a", {"text": "abc", "words": [[0, 2], [2, 9]]})], BASIC)
    assert frame.select(Layers(BASIC, bounds="clip").text("words")).first()[0] == ["ab", "c"]
    with pytest.raises(Exception, match="reaches past"):
        frame.select(Layers(BASIC).text("words")).collect()
