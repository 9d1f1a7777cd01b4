"""Shredding of nested records and changes of layer descriptions, against walks in plain Python and by cases."""

import json

import pytest

from tierlake.operators import drift, shred


def records(spark, contents):
    return spark.createDataFrame([(i, c, "x") for i, c in enumerate(contents)], "rec_id bigint, content string, node string")


def walked(rec, content):
    try:
        whole = json.loads(content)
    except (ValueError, TypeError):
        return set()
    out = set()
    text = lambda x: x if isinstance(x, str) else json.dumps(x)

    def walk(x, parent):
        if isinstance(x, dict):
            if x.get("note_id") is not None:
                out.add((rec, parent, text(x["note_id"])))
                parent = text(x["note_id"])
            for v in x.values():
                walk(v, parent)
        elif isinstance(x, list):
            for v in x:
                walk(v, parent)
        elif isinstance(x, str) and x.lstrip()[:1] in ("{", "["):
            try:
                walk(json.loads(x), parent)
            except ValueError:
                pass

    for key, value in whole.items() if isinstance(whole, dict) else ():
        if key == "_meta":
            items = value.items() if isinstance(value, dict) else [(v.get("name"), v) for v in value or []]
            for name, desc in items:
                if desc.get("base"):
                    out.add((rec, text(desc["base"]), name))
                walk(desc, name)
        elif not key.startswith("_"):
            walk(value, key)
    return out


CONTENTS = [
    json.dumps({"_meta": {"text": {"type": "characters", "base": ""}, "words": {"type": "span", "base": "text", "meta": {"notes": [{"note_id": 1, "sub": [{"note_id": "2"}]}]}}}, "_order": ["a"], "a": {"text": "x", "n": [{"note_id": 3, "more": json.dumps([{"note_id": 4, "in": json.dumps({"deep": {"note_id": 5.5}})}])}]}}),
    json.dumps({"_meta": [{"name": "w", "base": "text"}, {"name": "text", "base": None}], "k": {"note_id": "top", "x": {"y": {"note_id": True}}}, "m": {"z": [[[{"note_id": None, "q": {"note_id": 0}}]]]}}),
    '{"a": {"note_id": 1}, "b"', None, "", "[1, 2]", "3", "NaN", "[" * 100_000, "{}", json.dumps({"a": {"t": "[not json", "u": "{}", "note_id": "é"}, "b": {"w": [[0, 4], [5, 7]], "s": "[1,2]"}}),
]


def test_links_are_those_of_a_walk(spark):
    got = {tuple(r) for r in shred.links(records(spark, CONTENTS + CONTENTS[:1])).collect()}
    assert got == set().union(*(walked(i, c) for i, c in enumerate(CONTENTS + CONTENTS[:1]) if c is None or len(c) < 10_000))
    assert shred.links(records(spark, [None]).where("false")).count() == 0


DEEP = 20_000


def test_records_nested_deeper_than_the_stack(spark):
    deep = '{"k": ' + "[" * DEEP + '{"note_id": 1}' + "]" * DEEP + "}"
    flat = '{"k": ' + "[" * DEEP + '1, null, ["x"]' + "]" * DEEP + "}"
    bad = [deep[:-1], deep + "]", deep.replace("1", "01"), deep.replace('"note_id"', "note_id")]
    assert {tuple(r) for r in shred.links(records(spark, [deep, flat, *bad])).collect()} == {(0, "k", "1")}
    held = shred.shred(records(spark, [flat])).where("label = 'k'").first()["scalar"]
    assert held == "[" * DEEP + '1, null, ["x"]' + "]" * DEEP
    inside = json.dumps({"t": deep})
    assert {tuple(r) for r in shred.links(records(spark, [inside])).collect()} == {(0, "t", "1")}


@pytest.mark.parametrize("text", [*filter(None, CONTENTS[:2]), CONTENTS[-1], "[]", "{}", " [1 , {\"a\" : [ ] , \"a\": {} }] ", "3", '"x"', "true", "1e5", "[-0.5E+2]"])
def test_the_deep_parser_reads_what_the_other_reads(text):
    assert shred.parsed_deep(text) == json.loads(text)


@pytest.mark.parametrize("text", ["", " ", "[", "]", "{", "[1,]", "[,1]", "[1 2]", '{"a"}', '{"a":}', '{"a":1,}', "{1:2}", '{"a":1 "b":2}', "[1]]", "1 2", "01", "+1", "1.", "nul", "NaN", "'a'", '"a', '"\t"', "[}", "{]", ":", ","])
def test_the_deep_parser_refuses_what_is_no_json(text):
    with pytest.raises(ValueError):
        shred.parsed_deep(text)


def test_tables_keep_the_way_to_the_parent(spark):
    content = json.dumps({"_meta": {"words": {"type": "span", "base": "text", "notes": [{"note_id": 1, "by": "ann", "body": "x"}]}}, "d": {"n": {"note_id": 2, "by": {"user": "bob"}, "marks": [{"layer": "pos", "at": [3]}], "re": [{"note_id": 3, "body": None}]}}})
    got = {n: [r.asDict() for r in t.drop("rec_id").collect()] for n, t in shred.tables(records(spark, [content])).items()}
    words, doc = got["layers"][0], got["documents"][0]
    notes = {r["note_id"]: r for r in got["notes"]}
    assert len(got["layers"]) == 1 and words["name"] == "words" and words["base"] == "text" and doc["doc_key"] == "d"
    assert notes["1"]["parent"] == words["node"] and notes["2"]["parent"] == doc["node"] and notes["3"]["parent"] == notes["2"]["node"] and notes["1"]["body"] == "x"
    assert {(r["note"], r["author"]) for r in got["authors"]} == {(notes["1"]["node"], "ann"), (notes["2"]["node"], "bob")}
    assert [(r["note"], r["layer"], r["at"]) for r in got["marks"]] == [(notes["2"]["node"], "pos", "[3]")]


def test_links_of_the_test_data(spark, small):
    table = spark.read.parquet(f"{small}/raw_records.parquet")
    got = {tuple(r) for r in shred.links(table).collect()}
    assert got == set().union(*(walked(r["rec_id"], r["content"]) for r in table.select("rec_id", "content").collect()))


def test_nodes_hold_the_whole_record(spark):
    content = json.dumps({"a": [{"b": 1}, "x", [2, 3]], "c": {"d": None, "e": [True, 1.5]}})
    rows = {r["node"]: r for r in shred.shred(records(spark, [content])).collect()}

    def built(n):
        r = rows[n]
        below = sorted((x for x in rows.values() if x["parent"] == n), key=lambda x: x["ordinal"])
        if r["kind"] == "object":
            return {x["label"]: built(x["node"]) for x in below}
        return [built(x["node"]) for x in below] if r["kind"] == "array" else r["scalar"]

    assert built(0) == {"a": [{"b": "1"}, "x", "[2, 3]"], "c": {"d": None, "e": "[true, 1.5]"}}
    notes = shred.entities(shred.shred(records(spark, CONTENTS[:1])), ["note_id", "more", "absent"]).where("note_id is not null").collect()
    assert {r["note_id"] for r in notes} == {"1", "2", "3", "4", "5.5"} and all(r["absent"] is None for r in notes)


def header(layers, **other):
    return json.dumps({"_meta": layers, **other})


BASE = {"text": {"type": "characters"}, "words": {"type": "span", "base": "text"}, "pos": {"type": "seq", "base": "words", "data": ["A", "B"]}}


def changed(spark, *headers):
    files = spark.createDataFrame([(i, 1, i, h, "y") for i, h in enumerate(headers)], "file_id bigint, series_id bigint, seq_no int, header string, layer string")
    return {tuple(r) for r in drift.changes(files).collect()}


@pytest.mark.parametrize(
    ("new", "want"),
    [
        ({**BASE, "words": {"type": "Span", "base": "text", "data": "", "target": None, "note": 1}}, set()),
        ([{"name": n, **d} for n, d in BASE.items()], set()),
        ({k: BASE[k] for k in ("text", "words")}, {("pos", "layer", "removed")}),
        ({**BASE, "x": {"type": "div", "base": "text"}}, {("x", "layer", "added")}),
        ({"text": BASE["text"], "tokens": BASE["words"], "pos": {**BASE["pos"], "base": "tokens"}}, {("tokens", "layer", "renamed")}),
        ({"text": BASE["text"], "tokens": {**BASE["words"], "type": "div"}, "pos": {**BASE["pos"], "base": "tokens"}}, {("words", "layer", "removed"), ("tokens", "layer", "added"), ("pos", "base", "changed")}),
        ({**BASE, "pos": {"type": "seq", "base": "words", "data": "String"}}, {("pos", "data", "retyped")}),
        ({**BASE, "pos": {"type": "seq", "base": "words", "data": ["B", "A"]}}, {("pos", "data", "changed")}),
        ({**BASE, "pos": {"type": "seq", "base": "words"}}, {("pos", "data", "removed")}),
        ({**BASE, "words": {"type": "span", "base": "text", "data": "link", "target": "text"}}, {("words", "data", "added"), ("words", "target", "added")}),
        ({**BASE, "words": {"type": "seq", "base": "pos"}}, {("words", "type", "changed"), ("words", "base", "changed")}),
        ({n: {{"type": "layerType", "base": "on"}.get(k, k): v for k, v in d.items()} for n, d in BASE.items()}, {("*", "type", "renamed"), ("*", "base", "renamed")}),
    ],
)
def test_changes(spark, new, want):
    assert {x[1:] for x in changed(spark, header(BASE), header(new, more=1))} == want


def test_order_copies_and_broken_files(spark):
    rows = [(5, 1, 1, header(BASE)), (9, 1, 2, header({})), (7, 1, 2, header({**BASE, "a": {"type": "div", "base": "text"}})), (7, 1, 2, header({**BASE, "a": {"type": "div", "base": "text"}})), (8, 1, 10_000, header(BASE)), (3, 2, 1, None), (4, 2, 2, "{"), (6, 2, 3, header({"text": {"type": "characters"}})), (1, None, 1, header(BASE)), (2, 1, None, header({}))]
    files = spark.createDataFrame(rows, "file_id bigint, series_id bigint, seq_no int, header string")
    want = {(7, "a", "layer", "added"), (8, "a", "layer", "removed"), (6, "text", "layer", "added")}
    assert {tuple(r) for r in drift.changes(files).collect()} == want
    assert {tuple(r) for r in drift.preceding(files, group=1).collect()} == {tuple(r) for r in drift.preceding(files).collect()} == {(7, 5), (8, 7), (4, 3), (6, 4)}
    assert drift.changes(files.where("false")).count() == 0


def test_rescued_values_are_kept_and_replayed(spark):
    odd = {"a": {"layer_type": "Div", "base": 3, "colour": "red", "data_type": ["x"]}, "b": {"type": "seq", "base": "a", "data": [1, 2]}}
    files = spark.createDataFrame([(1, header(odd))], "file_id bigint, header string")
    raw = {r["layer"]: r for r in drift.ingest(files).collect()}
    assert raw["a"]["type"] is None and raw["a"]["rescued"] == {"layer_type": '"Div"', "base": "3", "colour": '"red"', "data_type": '["x"]'}
    got = {r["layer"]: r for r in drift.consistent(files).collect()}
    assert (got["a"]["type"], got["a"]["base"], got["a"]["data"]) == ("div", None, '["x"]') and got["a"]["rescued"] == {"base": "3", "colour": '"red"'}
    assert got["b"]["data"] is None and got["b"]["rescued"] == {"data": "[1, 2]"} and got["a"]["spelt"]["type"] == "layer_type"
