"""The search algebra: menus worked out by hand, and compiled columns against evaluation in Python on made-up documents."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests.test_document import BASIC, documents
from tierlake.corpus import Corpus
from tierlake.document import Document
from tierlake.errors import LayerNotFoundError, ModelError
from tierlake.operators import frequency
from tierlake.operators.layers import Layers
from tierlake.operators.predicates import And, Exists, GreaterThan, GreaterThanEqual, In, LessThan, LessThanEqual, Not, NotIn, Or, QueryBuilder, Regex, Text, TextNot, TextRegex, Value_, ValueNot, from_dict
from tierlake.plans import planner
from tierlake.sources import ingest

MENU = {
    "text": {"type": "characters"},
    "items": {"type": "span", "base": "text"},
    "kind": {"type": "seq", "base": "items", "data": ["dish", "drink", "side"]},
    "course": {"type": "seq", "base": "items", "data": "string"},
    "price": {"type": "element", "base": "items", "data": "link"},
}
MENUS = [
    {"text": "leek soup, rye bread, cider", "items": [[0, 9], [11, 20], [22, 27]], "kind": ["dish", "side", "drink"], "course": ["first", "first", "any"], "price": [[0, 7], [2, 3]]},
    {"text": "baked trout, cider", "items": [[0, 11], [13, 18]], "kind": ["dish", "drink"], "course": ["second", "any"]},
    {"text": "closed", "items": []},
]


@pytest.fixture(scope="module")
def menus(spark):
    corpus = Corpus(spark, MENU)
    corpus.add_docs(MENUS)
    return corpus


def found(corpus, *asked, **conditions):
    """The numbers of the menus that match."""
    return [corpus.order.index(i) for i in corpus.search_ids(*asked, **conditions)]


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ({"kind": "side"}, [0]),
        ({"kind": ["side", "drink"]}, [0, 1]),
        ({"course": {"$in": ["second", "third"]}}, [1]),
        ({"course": {"$nin": ["first", "any"]}}, [1]),
        ({"course": {"$regex": "^s"}}, [1]),
        ({"items": {"$text_regex": "t$"}}, [1]),
        ({"items": {"$text": "rye bread"}}, [0]),
        ({"items": {"$text_ne": "cider"}}, [0, 1]),
        ({"kind": "drink", "course": "second"}, [1]),
        ({"price": {"$gte": 7}}, [0]),
        ({"price": {"$lt": 3}}, []),
        ({"$and": {"kind": "dish", "course": "first"}}, [0]),
        ({"$and": [{"kind": "dish"}, {"$not": {"kind": "side"}}]}, [1]),
        ({"$or": [{"kind": "side"}, {"course": "second"}]}, [0, 1]),
        ({"$or": {"kind": "side", "course": "second"}}, [0, 1]),
        ({"$not": [{"kind": "dish"}]}, [2]),
        ({"$exists": "price"}, [0]),
        ({"$exists": "kind", "course": "second"}, [1]),
        ({"$not": {"$exists": "kind"}}, [2]),
        ({"price": {"$exists": True}}, [0]),
        ({"price": {"$exists": False}}, [1, 2]),
        ({"$and": []}, [0, 1, 2]),
    ],
)
def test_dict_queries(menus, query, want):
    assert found(menus, query) == want


def test_conditions_by_layer(menus):
    assert found(menus, items="cider", kind="side") == [0] and found(menus, items="water") == []
    with pytest.raises(ModelError):
        menus.search_ids({"kind": "side"}, items="cider")


def test_wrong_queries_are_refused_when_built():
    for wrong in ({"pos": {"$no": 1}}, {"pos": {"$gt": 1, "$lt": 2}}, {"$nor": []}, {"$exists": 1}, {"pos": {"$regex": "("}}, {"pos": {"$regex": "(?=a)b"}}, {"pos": {"$regex": r"(a)\1"}}, {"pos": 1.5}):
        with pytest.raises(ModelError):
            from_dict(wrong)


leaves = st.one_of(
    st.builds(lambda k, l, t: k(l, t), st.sampled_from([Text, TextNot]), st.sampled_from(["text", "words", "pos", "ents"]), st.sampled_from(["a", "ab", "é", ""])),
    st.builds(lambda k, l, v: k(l, v), st.sampled_from([Value_, ValueNot, LessThan, LessThanEqual, GreaterThan, GreaterThanEqual]), st.sampled_from(["text", "words", "pos", "ents", "prev"]), st.sampled_from([None, "DT", "X", "é", 0, 1, (1, "x")])),
    st.builds(lambda k, l, v: k(l, tuple(v)), st.sampled_from([In, NotIn]), st.sampled_from(["pos", "ents", "prev", "text"]), st.lists(st.sampled_from(["DT", "NN", "X", 1]), max_size=2)),
    st.builds(lambda k, l, p: k(l, p), st.sampled_from([Regex, TextRegex]), st.sampled_from(["pos", "words", "ents"]), st.sampled_from(["^D", "a|é", "b$"])),
    st.builds(Exists, st.sampled_from(["pos", "ents", "text"])),
)
queries = st.recursive(leaves, lambda q: st.one_of(st.builds(Not, q), st.builds(lambda x: And(tuple(x)), st.lists(q, max_size=3)), st.builds(lambda x: Or(tuple(x)), st.lists(q, max_size=3))), max_leaves=6)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(documents(), min_size=1, max_size=10), st.lists(queries, min_size=4, max_size=8))
def test_columns_and_indexes_agree_with_documents(spark, docs, asked):
    frame = ingest.from_objects(spark, [(str(i), d) for i, d in enumerate(docs)], BASIC)
    layers = Layers(BASIC)
    index = {n: planner.create_index(frame, layers, n) for n in ("pos", "ents")}
    got = frame.select("doc_pos", *[q.column(layers).alias(f"q{i}") for i, q in enumerate(asked)]).collect()
    for i, q in enumerate(asked):
        want = {k for k, d in enumerate(docs) if q.matches(Document(BASIC, d))}
        assert {r["doc_pos"] for r in got if r[f"q{i}"]} == want, q
    by_index = {r[0] for r in planner.search(frame, layers, asked[0], index).select("doc_pos").collect()}
    assert by_index == {r["doc_pos"] for r in got if r["q0"]}


def test_indexes_follow_changes(spark):
    corpus = Corpus(spark, {n: MENU[n] for n in ("text", "items", "course")})
    both = [{n: m[n] for n in ("text", "items", "course") if n in m} for m in MENUS]
    first, second, _ = corpus.add_docs(both)
    late = {"course": "second"}
    assert corpus.search_ids(late) == [second] and corpus.estimate_query_count(late) == 3
    corpus.create_index("course")
    assert corpus.has_index("course") and corpus.search_ids(late) == [second]
    assert corpus.estimate_query_count(late) == 1 and corpus.estimate_query_count({"course": "none"}) == 0 and corpus.estimate_query_count({"items": {"$text": "cider"}}) == 3
    assert corpus.search_ids({"course": "any", "items": {"$text": "baked trout"}}) == [second]
    corpus.remove_doc(second)
    assert corpus.search_ids(late) == []
    third = corpus.add_doc({"text": "tart", "items": [[0, 4]], "course": ["second"]})
    assert corpus.search_ids(late) == [third]
    corpus.update_doc(first, {"course": ["first", "second", "any"]})
    assert corpus.search_ids(late) == [first, third]
    kept = corpus.get_index("course")
    corpus.drop_index("course")
    assert not corpus.has_index("course") and corpus.search_ids(late) == [first, third]
    corpus.set_index("course", kept)
    assert corpus.search_ids(late) == [first, third] and planner.covered(from_dict(late), corpus.indexes) and not planner.covered(from_dict({"$not": late}), corpus.indexes)
    with pytest.raises(LayerNotFoundError):
        corpus.create_index("absent")


def test_plans_of_many_changes_are_cut(spark, monkeypatch):
    monkeypatch.setattr("tierlake.corpus.CUT_EVERY", 2)
    corpus = Corpus(spark, {"text": {"type": "characters"}})
    made = [corpus.add_doc({"text": x}) for x in "abc"]
    assert corpus.order == made and corpus.docs._jdf.queryExecution().logical().toString().count("Union") <= 1
    assert [i for i, _ in corpus] == made and [d["text"] for _, d in corpus] == ["a", "b", "c"]


def test_builder_has_every_condition(menus):
    b = QueryBuilder().text("items", "cider").text_not("items", "x").value("kind", "side").value_not("kind", "side").less_than("course", "g").less_than_equal("course", "any").greater_than("course", "b").greater_than_equal("price", 7)
    b = b.in_("kind", ["side"]).not_in("kind", ["side"]).regex("course", "^f").text_regex("items", "^rye").and_([]).or_([Exists("kind")]).not_(Value_("kind", "x")).exists("price")
    assert found(menus, b.build()) == [0] and b.build().reads() == {"items", "kind", "course", "price"}


def test_frequencies(menus, spark):
    assert {r["text"]: r["freq"] for r in menus.text_freq("items").collect()} == {"leek soup": 1, "rye bread": 1, "cider": 2, "baked trout": 1}
    values = lambda c=None: {r["value"]["t"]: r["freq"] for r in menus.val_freq("course", c).collect()}
    assert values() == {"first": 2, "any": 2, "second": 1} and values(["second", "any"]) == {"second": 1, "any": 2} and values("first") == {"first": 2}
    assert values(frequency.by_python(lambda v: v > "b", True)) == {"first": 2, "second": 1}
    assert {r["text"] for r in menus.text_freq("items", frequency.by_python(lambda t: " " in t)).collect()} == {"leek soup", "rye bread", "baked trout"}
    with pytest.raises(LayerNotFoundError):
        menus.text_freq("course")
    bare = Corpus(spark, MENU)
    bare.add_docs([{"text": "x"}])
    assert bare.text_freq("items", strict=False).count() == 0 and bare.val_freq("kind").count() == 0
