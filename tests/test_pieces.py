"""Files of one piece, read and written a part at a time."""

import gzip
import io
import json
import os
import re
import time
import tracemalloc

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.test_corpus import FIRST, META, SECOND, YAML
from tierlake import queries
from tierlake.corpus import Corpus
from tierlake.errors import FormatError
from tierlake.operators import ids
from tierlake.sources import binary, files, spool

TEXT = {"text": {"type": "characters"}}


@pytest.fixture()
def pieces(monkeypatch):
    """Pieces so small that every member is cut."""
    monkeypatch.setattr(files, "PIECE", 7)
    monkeypatch.setattr(files, "CHUNK", 1)
    monkeypatch.setattr(spool, "PART", 100)


@pytest.fixture()
def unread(monkeypatch):
    """The driver neither parses a file whole nor makes frames of its documents."""

    def never(*_, **__):
        raise AssertionError("the driver holds a whole file")

    monkeypatch.setattr(files, "parse", lambda text, kind, parse=files.parse: never() if len(text) > 400 else parse(text, kind))
    monkeypatch.setattr(files, "_whole", never)


@pytest.mark.parametrize("text", ['{"a":1}', ' {\n"a" : [1, {"b": "}\\"\\\\"}] ,\r\n"é\\u00e9\\ud83d\\ude00":null,"n":-12.5e3,"t":true,"a":"x"} \n', "{}", '{"_meta":{},"x":{"text":"' + "y" * 99 + '"}}'])
def test_members_of_json_are_those_of_a_whole_parse(pieces, text):
    got = list(files.json_members(io.StringIO(text)))
    assert {k: v for k, _, v in got} == json.loads(text)
    assert all(json.loads(raw) == v for _, raw, v in got)


@pytest.mark.parametrize("text", ["", "{", "[1]", '{"a"}', '{"a":}', '{"a":1,}', '{"a":1} x', "{'a':1}", '{"a":"x', '{"a":tru}', '{"a":1 "b":2}', '{1:2}'])
def test_broken_json_is_refused(pieces, text):
    with pytest.raises(FormatError):
        list(files.json_members(io.StringIO(text)))


def test_a_broken_document_is_refused_before_the_file_ends(monkeypatch):
    monkeypatch.setattr(files, "PIECE", 100)
    source = io.StringIO('{"a":{x' + " " * 10_000)
    with pytest.raises(FormatError):
        list(files.json_members(source))
    assert source.tell() < 1000


@pytest.mark.parametrize("name", ["c.json", "c.yaml", "c.cuac"])
def test_files_in_pieces(spark, tmp_path, pieces, unread, name):
    corpus = Corpus(spark, META)
    corpus.add_docs([FIRST, SECOND, *[{"text": f"text {i}\n: é"} for i in range(40)]])
    corpus.write(path := str(tmp_path / name))
    if name != "c.cuac":
        assert open(path, encoding="utf-8").read() == (corpus.to_json_str() if name == "c.json" else corpus.to_yaml_str())
    assert Corpus.read(spark, path).to_json_str() == corpus.to_json_str()


@pytest.mark.parametrize("name", ["c.json", "c.yaml", "c.cuac"])
def test_copies_of_one_id_are_all_read(spark, tmp_path, name):
    corpus = Corpus(spark, TEXT)
    n = ids.LENGTHS + 20
    docs = spark.range(n).select(F.lit(None).cast("string").alias("doc_id"), F.col("id").alias("doc_pos"), F.lit("same").alias("text"), F.expr("cast(map() as map<string,string>)").alias("_extra"))
    corpus.docs = ids.assign(docs, corpus.catalog).select("doc_id", "doc_pos", "text", "_extra")
    corpus.write(path := str(tmp_path / name))
    back = Corpus.read(spark, path)
    assert back.docs.count() == n and back.order == corpus.order


def test_yaml_that_cannot_be_cut_is_read_whole(spark, pieces):
    docs = YAML.split("Kjco:")[1]
    for text in (YAML.replace("Kjco:", "# note\nKjco:"), "---\n" + YAML, YAML.replace("text: This is a document.", 'text: "This is\na document."'), YAML.replace("_meta:", "_meta: &m").replace("words: [[0,4]", "_x: *m\n    words: [[0,4]"), "{_meta: {text: {type: characters}, words: {type: span, base: text}, pos: {type: seq, base: words, data: string}},\nKjco: {text: This is a document.}, 9wpe: {text: Colorless green ideas sleep furiously.}}"):
        assert Corpus.read_string(spark, text).order == ["Kjco", "9wpe"], text
    with pytest.raises(FormatError):
        Corpus.read_string(spark, YAML + "...\n" + "Kjco:" + docs)


def test_a_header_is_read_without_documents(spark, monkeypatch, pieces):
    for text, kind in ((YAML + "x" * 5000, "yaml"), (json.dumps({"_meta": META}).rstrip("}") + "}}," + "x" * 5000, "json")):
        source = io.StringIO(text)
        catalog, docs = files.read_open(spark, source, kind, header_only=True)
        assert set(catalog) == set(META) and docs.count() == 0 and source.tell() < 2000


def test_a_text_too_long_for_the_binary_format_is_a_format_error(spark, tmp_path):
    corpus = Corpus(spark, TEXT)
    corpus.add_docs([{"text": "x" * 70_000}])
    with pytest.raises(FormatError):
        corpus.write(str(tmp_path / "c.cuac"))
    assert binary.Reader(io.BytesIO(b"")).more() is None


def test_a_pipe_is_not_gathered_on_the_driver(spark, small, monkeypatch):
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *_, **__: pytest.fail("documents are gathered"))
    assert queries.queries()["channel_pipe"](spark, small).count() == spark.read.parquet(f"{small}/documents.parquet").count()


def test_texts_are_shuffled_once_before_they_are_sorted(spark, small):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = queries._tagged(spark, small)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"Exchange *\nInput \[\d+\]: \[[^\]]*\btext#", plan)) == 1


def test_shuffles_are_dropped_before_parts_are_read(spark):
    held = lambda: {x for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}
    rows, before, kept = spark.range(1000).selectExpr("cast(id as string) as x").orderBy("x"), held(), spark.conf.get(spool.TIDY)
    with spool.written(rows) as parts:
        ends = time.time() + 10
        while held() - before and time.time() < ends:
            time.sleep(0.1)
        assert not held() - before
        assert [x for part in parts for x in spool.texts(part)] == sorted(str(i).encode() for i in range(1000))
    assert spark.conf.get(spool.TIDY) == kept


@pytest.mark.parametrize("name", ["file_json", "file_yaml", "file_binary", "file_gzip", "file_url"])
def test_a_file_is_dropped_once_it_is_read(spark, small, tmp_path, monkeypatch, name):
    monkeypatch.setattr(queries, "_local", lambda *_: str(tmp_path))
    docs = queries.queries()[name](spark, small)
    assert not list(tmp_path.iterdir())
    assert docs.count() == spark.read.parquet(f"{small}/documents.parquet").count()


def test_a_file_is_dropped_once_its_header_is_read(spark, small, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "_local", lambda *_: str(tmp_path))
    assert queries.queries()["yaml_header"](spark, small).count() == len(queries._TAGGED) and not list(tmp_path.iterdir())


def test_parts_of_the_binary_format_are_packed(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(binary, "batches", lambda part: seen.append(pq.ParquetFile(part).metadata.row_group(0).column(0).compression) or spool.batches(part))
    corpus = Corpus(spark, META)
    corpus.add_docs([FIRST, SECOND])
    corpus.write(str(tmp_path / "c.cuac"))
    assert set(seen) == {"ZSTD"}


def test_a_url_of_json_is_read_without_a_copy(spark, tmp_path, monkeypatch):
    corpus = Corpus(spark, META)
    corpus.add_docs([FIRST, SECOND])
    for name in ("c.json", "c.json.gz"):
        path = tmp_path / name
        raw = corpus.to_json_str().encode()
        path.write_bytes(gzip.compress(raw) if name.endswith(".gz") else raw)
        monkeypatch.setattr(files.shutil, "copyfileobj", lambda *_: pytest.fail("the file is copied"))
        assert Corpus.read_url(spark, f"file://{path}").to_json_str() == corpus.to_json_str()


@pytest.mark.parametrize("name", ["c.json", "c.cuac"])
def test_the_driver_holds_a_small_part_of_a_file(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(files, "PIECE", 1 << 18)
    monkeypatch.setattr(spool, "PART", 1 << 18)
    n = 2000
    docs = spark.range(n).select(F.lit(None).cast("string").alias("doc_id"), F.col("id").alias("doc_pos"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 160).alias("text"), F.expr("cast(map() as map<string,string>)").alias("_extra"))
    corpus = Corpus(spark, TEXT)
    corpus.docs = ids.assign(docs, corpus.catalog).select("doc_id", "doc_pos", "text", "_extra")
    tracemalloc.start()
    try:
        corpus.write(path := str(tmp_path / name))
        back = Corpus.read(spark, path)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert back.docs.count() == n
    assert peak < os.path.getsize(path) / 3
