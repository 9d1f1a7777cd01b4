"""Identity, changes, formats, rendering, streams and the tokenizer."""

import io
import json
import random

import pytest
from pyspark.sql import functions as F

from tierlake.corpus import Corpus
from tierlake.document import Document
from tierlake.errors import DocumentNotFoundError, FormatError, ModelError
from tierlake.functions.arrays import ascending, deltas, running_sum
from tierlake.meta import Catalog
from tierlake.operators import ids, mutate, tokenize
from tierlake.operators.render import paragraph, render, table
from tierlake.sources import binary, cbor, files, ingest
from tierlake.streaming import channel, jsonl

# Ids and the layout of YAML are those of corpora written elsewhere; the ids follow from the texts.
META = {"text": {"type": "characters"}, "words": {"type": "span", "base": "text"}, "pos": {"type": "seq", "base": "words", "data": "string"}}
FIRST = {"text": "This is a document.", "words": [[0, 4], [5, 7], [8, 9], [10, 18], [18, 19]], "pos": ["DT", "VBZ", "DT", "NN", "."]}
SECOND = {"text": "Colorless green ideas sleep furiously.", "words": [[0, 8], [9, 16], [17, 22], [23, 30], [31, 40]], "pos": ["JJ", "JJ", "NNS", "VBZ", "RB"]}
YAML = """_meta:
    pos:
        type: seq
        base: words
        data: string
    text:
        type: characters
    words:
        type: span
        base: text
Kjco:
    pos: ["DT","VBZ","DT","NN","."]
    text: This is a document.
    words: [[0,4],[5,7],[8,9],[10,18],[18,19]]
9wpe:
    pos: ["JJ","JJ","NNS","VBZ","RB"]
    text: Colorless green ideas sleep furiously.
    words: [[0,8],[9,16],[17,22],[23,30],[31,40]]
"""


@pytest.fixture()
def basic(spark):
    corpus = Corpus(spark, META)
    assert corpus.add_docs([FIRST, SECOND]) == ["Kjco", "9wpe"]
    return corpus


def test_ids_by_content():
    known = {"text": "This is a document."}
    for extra, want in (({}, "Kjco"), ({"fileid": "doc1"}, "fexV"), ({"author": "John Doe"}, "wiDv")):
        assert ids.code_of(known | extra, Catalog.from_dict({n: {"type": "characters"} for n in known | extra}))[:4] == want
    one = Catalog.from_dict({"text": {"type": "characters"}})
    for text, want in (("This is an example", "ecWc"), ("The quick brown fox jumps over the lazy dog.", "/KOa"), ("Foobar", "aeW7"), ("hopeless for tmr :(", "dkJv"), ("This is an updated document.", "JHEz")):
        assert ids.code_of({"text": text}, one)[:4] == want


def test_ids_in_bulk_are_those_of_one_by_one(spark):
    rng = random.Random(1)
    texts = [rng.choice(["a", "b", "", None, *"cdefgh"]) for _ in range(120)] + ["same"] * 50
    one = Catalog.from_dict({"text": {"type": "characters"}})
    docs = spark.createDataFrame([(None, i, t) for i, t in enumerate(texts)], "doc_id string, doc_pos bigint, text string")
    taken = {"Kjco", ids.code_of({"text": "a"}, one)[:4]}
    old = spark.createDataFrame([(x,) for x in taken], "doc_id string")
    for existing, start in ((None, set()), (old, set(taken))):
        want = []
        for t in texts:
            want.append(ids.shortest_free(ids.code_of({"text": t}, one), start))
            start.add(want[-1])
        got = {r["doc_pos"]: r["doc_id"] for r in ids.assign(docs, one, existing).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_distinct_codes_that_share_a_head_are_folded(spark, monkeypatch):
    monkeypatch.setattr(ids, "code", lambda catalog: F.col("text"))
    one = Catalog.from_dict({"text": {"type": "characters"}})
    docs = spark.createDataFrame([(None, i, t) for i, t in enumerate(["abcdX" + "y" * 39, "abcdZ" + "y" * 39, "abcdX" + "y" * 39])], "doc_id string, doc_pos bigint, text string")
    assert {r["doc_pos"]: r["doc_id"] for r in ids.assign(docs, one).collect()} == {0: "abcd", 1: "abcdZ", 2: "abcdX"}


def test_ids_where_half_of_all_texts_are_null(spark, monkeypatch):
    monkeypatch.setattr(ids, "code", lambda catalog: F.coalesce(F.col("text"), F.lit("null" + "-" * 40)))
    texts = [None] * 300 + ["null" + "+" * 40] * 2 + [f"{i:04}" + "x" * 40 for i in range(300)]
    random.Random(2).shuffle(texts)
    one, want, taken = Catalog.from_dict({"text": {"type": "characters"}}), [], set()
    for t in texts:
        want.append(ids.shortest_free(t or "null" + "-" * 40, taken))
        taken.add(want[-1])
    docs = spark.createDataFrame([(None, i, t) for i, t in enumerate(texts)], "doc_id string, doc_pos bigint, text string")
    got = ids.assign(docs, one)
    assert [r["doc_id"] for r in got.orderBy("doc_pos").select("doc_id").collect()] == want


def test_documents_change(basic):
    assert basic.order == ["Kjco", "9wpe"] and basic.get_doc_by_id("Kjco").text("words")[0] == "This"
    assert basic.update_doc("Kjco", {"text": "This is an updated document."}) == "JHEz" and basic.order == ["JHEz", "9wpe"]
    assert basic.update_doc("JHEz", {"_note": {"a": None}}) == "JHEz" and basic.get_doc_by_id("JHEz")["_note"] == {"a": None}
    with pytest.raises(DocumentNotFoundError):
        basic.get_doc_by_id("Kjco")
    with pytest.raises(DocumentNotFoundError):
        basic.update_doc("Kjco", {"text": "x"})
    with pytest.raises(ModelError):
        basic.add_doc({"absent": "x"})
    basic.remove_doc("absent")
    basic.remove_doc("JHEz")
    assert basic.order == ["9wpe"]
    basic.build_layer("author").type("characters").add()
    assert basic.build_doc().layer("text", "x").layer("author", "y").add() in basic.order
    basic.order = list(reversed(basic.order))
    assert basic.order[1] == "9wpe" and basic.info()["documents"] == 2


def test_bulk_changes(spark, basic):
    docs = basic.docs
    patch = spark.createDataFrame([("Kjco", "This is an updated document."), ("none", "x")], "doc_id string, text string")
    new = mutate.update(docs, patch, basic.catalog)
    assert [r[0] for r in new.orderBy("doc_pos").select("doc_id").collect()] == ["JHEz", "9wpe"]
    more = mutate.add(docs, ingest.from_objects(spark, [(None, FIRST)], basic.catalog), basic.catalog)
    assert [r[0] for r in more.orderBy("doc_pos").select("doc_id").collect()][:2] == ["Kjco", "9wpe"] and more.where("length(doc_id) = 5").count() == 1
    assert mutate.remove(docs, patch.select("doc_id")).count() == 1


def test_yaml_and_json_as_written_before(basic, spark):
    pytest.importorskip("yaml")
    assert basic.to_yaml_str() == YAML
    assert json.loads(basic.to_json_str()) == {"_meta": META, "Kjco": FIRST, "9wpe": SECOND}
    for text, kind in ((YAML, "yaml"), (basic.to_json_str(), "json")):
        back = Corpus.read_string(spark, text, kind)
        assert back.order == ["Kjco", "9wpe"] and back.to_yaml_str() == YAML
    head = Corpus.read_string(spark, YAML, header_only=True)
    assert head.order == [] and set(head.catalog) == set(META)
    assert Corpus.read_string(spark, YAML.replace("Kjco:", "_order: ['9wpe', 'Kjco']\nKjco:")).order == ["9wpe", "Kjco"]
    wrong = YAML.replace("Kjco", "Kjcx")
    with pytest.raises(FormatError):
        Corpus.read_string(spark, wrong)
    assert Corpus.read_string(spark, wrong, ignore_id_errors=True).order == ["Kjco", "9wpe"]
    odd = Corpus.read_string(spark, "_meta:\n  text:\n    type: characters\naeW7:\n  text: Foobar\n  _created: 08.09.2016 00:29\n  _newpar: null\n  _day: 2016-09-08")
    assert dict(odd.get_doc_by_id("aeW7")) == {"text": "Foobar", "_created": "08.09.2016 00:29", "_newpar": None, "_day": "2016-09-08"}
    for bad in ("{", "[1]", "_meta: {x: {type: what}}"):
        with pytest.raises((FormatError, ModelError)):
            Corpus.read_string(spark, bad, "json" if bad[0] != "_" else "yaml")


def test_texts_survive_yaml(spark):
    pytest.importorskip("yaml")
    corpus = Corpus(spark, {"text": {"type": "characters"}})
    texts = ["a\nb\n", "- x", "a: b", "yes", "12", "", " x", "日本 é ​", 'q"uote', "tab\tx", "# c", "x #y", " ", "a:"]
    corpus.add_docs([{"text": t} for t in texts])
    back = Corpus.read_string(spark, corpus.to_yaml_str())
    assert [r[0] for r in back.docs.orderBy("doc_pos").select("text").collect()] == texts


def test_files_of_every_format(spark, basic, tmp_path):
    pytest.importorskip("yaml")
    assert [files.guess_format(x) for x in ("a.json", "a.jsonl.gz", "b.yml", "x", "a.tcf", "a.cuac", str(tmp_path))] == ["json", "jsonl", "yaml", "yaml", "binary", "binary", "store"]
    basic.create_index("pos")
    for name in ("c.json", "c.yaml", "c.cuac", "store"):
        basic.write(str(tmp_path / name))
        back = Corpus.read(spark, str(tmp_path / name))
        assert back.order == ["Kjco", "9wpe"] and back.to_yaml_str() == YAML, name
    assert Corpus.read(spark, str(tmp_path / "store")).search_ids(pos="RB") == ["9wpe"]
    basic.write(str(tmp_path / "lines.jsonl"))
    lines = Corpus.read(spark, str(tmp_path / "lines.jsonl"), kind="jsonl", catalog=basic.catalog)
    assert sorted(lines.order) == ["9wpe", "Kjco"]
    with pytest.raises(FormatError):
        files.read_file(spark, str(tmp_path / "lines.jsonl"), "jsonl")
    import gzip

    with gzip.open(tmp_path / "z.yaml.gz", "wt") as f:
        f.write(YAML)
    assert Corpus.read(spark, str(tmp_path / "z.yaml.gz")).order == ["Kjco", "9wpe"]
    assert Corpus.read_url(spark, f"file://{tmp_path}/z.yaml.gz").order == ["Kjco", "9wpe"]
    (tmp_path / "many").mkdir()
    for i, d in enumerate((FIRST, SECOND)):
        (tmp_path / "many" / f"{i}.json").write_text(json.dumps({"_meta": META, ["Kjco", "9wpe"][i]: d}))
    catalog, docs = files.read_many(spark, str(tmp_path / "many"))
    assert {r[0] for r in docs.select("doc_id").collect()} == {"Kjco", "9wpe"} and set(catalog) == set(META)


def test_many_files_keep_their_order_and_every_document(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"f{i:02}.json").write_text(json.dumps({"_meta": {"text": {"type": "characters"}}, **{f"{k}": {"text": f"{i} {k}"} for k in range(3)}}))
    _, docs = files.read_many(spark, str(tmp_path), ignore_id_errors=True)
    rows = docs.orderBy("doc_pos").collect()
    assert [r["text"] for r in rows] == [f"{i} {k}" for i in range(40) for k in range(3)] and len({r["doc_pos"] for r in rows}) == 120


def test_binary_format():
    meta = {"text": {"type": "characters"}}
    catalog = Catalog.from_dict(meta)
    out = io.BytesIO()
    binary.write(iter([Document(catalog, {"text": "Test string"})]), catalog, out)
    raw = out.getvalue()
    assert raw[:12] == b"TEANGA\0\1\0\0\0\x17" and raw[12:35] == cbor.dumps(meta) and raw[35:] == b"\0\0\0\x0bTest string"
    rich = Catalog.from_dict({**meta, "w": {"type": "span", "base": "text"}, "t": {"type": "seq", "base": "w", "data": ["a", "b"]}, "s": {"type": "seq", "base": "w", "data": "string"}, "d": {"type": "div", "base": "text"}, "l": {"type": "element", "base": "w", "data": "link"}, "x": {"type": "span", "base": "w", "data": "link"}, "y": {"type": "seq", "base": "w", "data": "link"}})
    docs = [
        {"text": "ab cd é", "w": [[0, 2], [3, 5]], "t": ["b", "a"], "s": ["x", "x"], "d": [0, 3], "l": [[1, 0]], "x": [[1, 2, 70000, "k"], [0, 1, 3, "k"]], "y": [1, 0]},
        {"text": "", "w": [], "s": ["x", "é" * 200, "x"], "l": [[0, 5, "t"]], "y": [[4, "q"]]},
        {"s": ["x"], "w": [[5, 2], [1, 1]], "d": [[0, "p"], [4, "q"]], "x": [[0, 1, "p"]]},
    ]
    out = io.BytesIO()
    binary.write((Document(rich, d) for d in docs), rich, out)
    catalog, back = binary.read(io.BytesIO(out.getvalue()))
    assert list(back) == docs and catalog.to_dict() == rich.to_dict()
    for wrong in (b"NOTHING AT ALL", raw[:6] + b"\0\2" + raw[8:], raw[:35] + b"\1" + raw[36:], raw[:-3]):
        with pytest.raises(FormatError):
            list(binary.read(io.BytesIO(wrong))[1])
    for values in ([], [0, 0], [1], [5, 1, 300], [65535, 1], [1 << 20] * 9, [(1 << 31) - 1, 0], list(range(100))):
        assert binary.Reader(io.BytesIO(binary.pack_numbers(values))).numbers() == values
    for n in (0, 127, 128, 16383, 16384, 1 << 21, (1 << 28) - 1):
        assert binary.Reader(io.BytesIO(binary.varint(n))).varint() == n
    for value in (None, True, -5, 3.5, "é" * 300, [1, [2]], {"a": {"b": []}}, 1 << 40):
        assert cbor.loads(cbor.dumps(value)) == value
    assert [binary.loads(binary.dumps(Document(rich, d)), rich).wire() for d in docs] == docs
    for wrong in (b"", binary.dumps(Document(rich, docs[0]))[:-2]):
        with pytest.raises(FormatError):
            binary.loads(wrong, rich)
    with pytest.raises(FormatError):
        binary.pack_layer(rich["t"], [(0, 1, (1, -1, "zz"))], binary.Dictionary())


def test_rendering(spark):
    catalog = Catalog.from_dict({**META, "lemma": META["pos"], "ents": {"type": "span", "base": "words", "data": "string"}})
    doc = Document(catalog, {"text": "The quick fox jumps", "words": [[0, 3], [4, 9], [10, 13], [14, 19]], "pos": ["det", "adj", "noun", "verb"], "lemma": ["the", "quick", "fox", "jump"], "ents": [[2, 3, "X"]]})
    want = "=== Ewyz ===\ntext: The quick fox jumps\n\nwords: The quick fox  jumps\nlemma: the quick fox  jump\npos  : det adj   noun verb\n\nents: fox/X\n"
    assert render("Ewyz", doc) == want
    assert paragraph("t", "aa  bb\ncc", 8) == ["t: aa bb", "   cc"] and paragraph("t", "", 8) == ["t: "] and paragraph("t", "longword x", 2) == ["t: longword", "   x"]
    assert table({"w": ["aaa", "bbb"], "xy": ["1"]}, 8) == ["w : aaa", "xy: 1", "", "w : bbb", "xy:", ""] and table({"w": []}, 9) == ["w:", ""]
    assert table({"w": ["日本", "e\u0301", "x"], "p": ["N", "long", "V"]}, 80) == ["w: 日本 e\u0301    x", "p: N    long V", ""]
    over = Document(catalog, {"text": "ab cd", "words": [[0, 2], [3, 5]], "pos": ["N", "V", "X"], "lemma": ["ab"]})
    assert render("i", over).splitlines()[3:] == ["words: ab cd", "lemma: ab", "pos  : N  V"]
    assert render("i", Document(catalog, {"pos": ["N"], "_x": 1})) == "=== i ===\n\npos:\n"


def test_tokens_by_bytes(spark):
    texts = ["It's 3 née, ok!", "", None, " \n\t", "日本 x y"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tokenize.tokens(F.col("t")).alias("x")).orderBy("i").collect()
    for t, row in zip(texts, got):
        if t is None:
            assert row["x"] is None
            continue
        assert all(t.encode()[x["s"] : x["e"]].decode() == x["token"] for x in row["x"])
    assert [x["token"] for x in got[0]["x"]] == ["It", "'", "s", "3", "née", ",", "ok", "!"] and got[1]["x"] == [] == got[3]["x"] and [x["token"] for x in got[4]["x"]] == ["日本", "x", "y"]
    sums = spark.createDataFrame([([1, 2, 3],), ([],), (None,), ([5],)], "a array<int>").select(running_sum("a"), ascending(F.col("a")), deltas(F.col("a"))).collect()
    assert [r[0] for r in sums] == [[1, 3, 6], [], None, [5]] and [r[1] for r in sums][:2] == [True, True] and sums[0][2] == [1, 1, 1]


def test_streams_give_what_batches_give(spark, basic, tmp_path):
    files.write_jsonl(basic.docs, basic.catalog, str(tmp_path / "in"))
    stream = jsonl.read(spark, str(tmp_path / "in"), basic.catalog)
    jsonl.to_parquet(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {r[0][:4] for r in spark.read.parquet(str(tmp_path / "out")).select("doc_id").collect()} == {"Kjco", "9wpe"}
    seen = []
    jsonl.convert(jsonl.read(spark, str(tmp_path / "in"), basic.catalog), lambda b, n: seen.extend(r["text"] for r in b.collect()), str(tmp_path / "cp2")).awaitTermination()
    assert sorted(seen) == sorted([FIRST["text"], SECOND["text"]])


def test_channel():
    catalog = Catalog.from_dict(META)

    def produce(sender):
        sender.set_meta(catalog)
        assert [sender.add_doc(FIRST), sender.add_doc(SECOND)] == ["Kjco", "9wpe"]

    assert channel.pipe(produce, lambda got: [(i, d["text"][:4]) for i, d in got]) == [("Kjco", "This"), ("9wpe", "Colo")]
    with pytest.raises(channel.ChannelClosed):
        channel.pipe(lambda s: None, list)
    with pytest.raises(ZeroDivisionError):
        channel.pipe(lambda s: 1 / 0, list)


def test_an_empty_corpus(spark):
    empty = Corpus(spark, META)
    assert empty.order == [] and empty.search_ids(pos="x") == [] and empty.val_freq("pos").count() == 0 and empty.show() == "" and json.loads(empty.to_json_str()) == {"_meta": META}
