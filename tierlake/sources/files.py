"""Corpora in files: JSON, JSON lines, YAML and Parquet stores; formats are told by suffix, gzip is read in passing.

Readers give (catalog, documents). Documents keep the order of the file, or that of ``_order`` where there is one; their
ids are made from their content, and must agree with the file's as far as both go.
"""

from __future__ import annotations

import gzip
import io
import json
import os
import re
import shutil
import tempfile
import urllib.request
from collections.abc import Callable, Iterator, Mapping
from typing import Any, TextIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tierlake.document import to_json
from tierlake.errors import FormatError
from tierlake.meta import Catalog, LayerType
from tierlake.operators import ids
from tierlake.plans.shared import numbered, stored
from tierlake.sources import ingest
from tierlake.sources.spool import Spool, texts, written

# The format of each suffix; others are YAML.
SUFFIXES = {".json": "json", ".jsonl": "jsonl", ".yaml": "yaml", ".yml": "yaml", ".cuac": "binary", ".tcf": "binary"}


#: Documents that one file of ``read_many`` may hold; places count up by so many from file to file.
MOST_IN_FILE = 1 << 32


def guess_format(path: str) -> str:
    """The format of a file by its suffix, that before .gz where there is one; a folder is a store."""
    if os.path.isdir(path):
        return "store"
    name = path[:-3] if path.endswith(".gz") else path
    return SUFFIXES.get(os.path.splitext(name)[1].lower(), "yaml")


def _yaml(text: str, read: Callable[[Any, Any], Any]) -> Any:
    """What ``read`` makes of the package yaml and a loader over a text; dates and the like stay text."""
    try:
        import yaml
    except ImportError:
        raise FormatError("reading YAML needs the package yaml") from None

    class Loader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
        def construct_mapping(self, node, deep=False):
            # keys are names and ids: text as it stands, also where it looks like a number
            return dict(self.pairs(node))

        def pairs(self, node):
            return [(k.value if isinstance(k, yaml.ScalarNode) else self.construct_object(k, True), self.construct_object(v, True)) for k, v in node.value]

    Loader.add_constructor("tag:yaml.org,2002:map", lambda loader, node: loader.construct_mapping(node, True))
    Loader.yaml_implicit_resolvers = {k: [(tag, x) for tag, x in v if not tag.endswith((":timestamp", ":merge"))] for k, v in Loader.yaml_implicit_resolvers.items()}
    loader = None
    try:
        loader = Loader(text)
        return read(yaml, loader)
    except yaml.YAMLError as e:
        raise FormatError(str(e)) from None
    finally:
        if loader is not None:
            loader.dispose()


def yaml_value(text: str) -> Any:
    """The value of a YAML text; dates and the like stay text."""
    return _yaml(text, lambda _, loader: loader.get_single_data())


def yaml_pairs(text: str) -> list[tuple[Any, Any]]:
    """The members of a YAML text that is one mapping, those of one name all of them."""

    def read(yaml: Any, loader: Any) -> list[tuple[Any, Any]]:
        node = loader.get_single_node()
        if not isinstance(node, yaml.MappingNode):
            raise FormatError("a corpus is an object of _meta and documents")
        return loader.pairs(node)

    return _yaml(text, read)


def parse(text: str, kind: str) -> dict[str, Any]:
    """A whole corpus file as one object."""
    if kind == "json":
        try:
            value = json.loads(text)
        except ValueError as e:
            raise FormatError(str(e)) from None
    else:
        value = yaml_value(text)
    if not isinstance(value, dict):
        raise FormatError("a corpus is an object of _meta and documents")
    return value


def with_ids(docs: DataFrame, catalog: Catalog, check: bool = True) -> DataFrame:
    """Documents with ids made from their content; ``check`` raises FormatError where a given doc_id and the new one differ in what both have."""
    named = stored(docs.withColumn("_given", F.col("doc_id")), "read")  # decoded once, for all that follows
    out = ids.assign(named, catalog)
    if check:
        n = F.least(F.length("_given"), F.length("doc_id"))
        wrong = out.where(F.expr("_given is not null") & (F.left("_given", n) != F.left("doc_id", n))).select("_given", "doc_id").head()
        if wrong:
            raise FormatError(f"document {wrong[0]} fails the check of its id: its content gives {wrong[1]}")
    return out.drop("_given")


_LINES = pa.schema([("doc_id", pa.string()), ("doc_pos", pa.int64()), ("json", pa.string())])
_SPECIAL = ("_meta", "_order")
#: Characters of a file that are read at once, and characters of YAML that are parsed at once.
PIECE, CHUNK = 1 << 22, 1 << 18
_SPACE = re.compile(r"[ \t\n\r]*")
#: A line of YAML that begins a member of the outermost mapping.
_KEY = re.compile(r"""([A-Za-z0-9+/_][\w+/=.-]*|"(?:[^"\\]|\\.)*"|'(?:[^']|'')*') *:(?=[ \t\r\n]|$)""")


def json_members(source: TextIO) -> Iterator[tuple[str, str, Any]]:
    """(name, value as it stands, value) of the members of the one object in an open JSON file, of which a piece and a member are held."""
    decode, buf, at, ended = json.JSONDecoder().raw_decode, "", 0, False

    def fill() -> None:
        nonlocal buf, at, ended
        got = source.read(max(PIECE, len(buf) - at))
        buf, at, ended = buf[at:] + got, 0, not got

    def sign() -> str:
        """The next character that is no space, "" at the end."""
        nonlocal at
        while (at := _SPACE.match(buf, at).end()) == len(buf) and not ended:
            fill()
        return buf[at : at + 1]

    def value() -> tuple[Any, str]:
        nonlocal at
        sign()
        while True:
            try:
                out, end = decode(buf, at)
                if end < len(buf) or ended:
                    raw, at = buf[at:end], end
                    return out, raw
            except ValueError as e:
                # what the end of the piece may have cut is tried again with more
                if ended or (e.pos < len(buf) - 16 and not e.msg.startswith("Unterminated string")):
                    raise FormatError(str(e)) from None
            fill()

    def wanted(signs: str) -> str:
        nonlocal at
        got = sign()
        if not got or got not in signs:
            raise FormatError(f"{got or 'the end'} where one of {signs} is due")
        at += 1
        return got

    if sign() != "{":
        raise FormatError("a corpus is an object of _meta and documents")
    wanted("{")
    if sign() == "}":
        wanted("}")
    else:
        while True:
            if sign() != '"':
                raise FormatError("the name of a member is a text")
            name = value()[0]
            wanted(":")
            out, raw = value()
            yield name, raw, out
            if wanted(",}") == "}":
                break
    if sign():
        raise FormatError("there is more after the corpus")


def _json_lines(spark: SparkSession, source: TextIO, header_only: bool) -> tuple[dict[str, Any], Spool, DataFrame | None]:
    """What is no document, what was spooled, and the documents as rows (doc_id, doc_pos, json); those of one name are all kept."""
    head, spool, n = {}, Spool(spark, _LINES), 0
    for name, raw, value in json_members(source):
        if name in _SPECIAL:
            head[name] = value
            if header_only and name == "_meta":
                break
        elif not header_only:
            spool.add(name, n, "{}" if value is None else raw)
            n += 1
    return head, spool, None if header_only else spool.frame()


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, doc_pos, json, wrong) of chunks of YAML; wrong: why a chunk can't be read by itself."""
    for batch in batches:
        for first, text in zip(*(c.to_pylist() for c in batch.columns)):
            try:
                pairs = yaml_pairs(text)
                if not all(isinstance(k, str) and k not in _SPECIAL for k, _ in pairs):
                    raise FormatError("a name that stands elsewhere")
                rows = [(k, first + i, to_json({} if v is None else v), None) for i, (k, v) in enumerate(pairs)]
            except Exception as e:  # noqa: BLE001
                rows = [(None, first, None, str(e) or type(e).__name__)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.string()))], ["doc_id", "doc_pos", "json", "wrong"])


def _yaml_lines(spark: SparkSession, source: TextIO, header_only: bool) -> tuple[dict[str, Any], Spool, DataFrame | None] | None:
    """The same of YAML, cut before lines that begin a member and parsed on the executors; None if the file can't be cut so.

    A cut within a text or a list that goes on leaves one open and an alias without its anchor is unknown, so such chunks
    fail; marks of documents, directives and other lines without indent aren't cut at all.
    """
    head: dict[str, Any] = {}
    spool, lines, special, size, first, n, began = Spool(spark, pa.schema([("first", pa.int64()), ("text", pa.string())])), [], None, 0, 0, 0, False

    def end() -> None:
        nonlocal lines, size, first
        if special:
            head[special] = parse("".join(lines), "yaml")[special]
        elif began and not header_only:
            spool.add(first, "".join(lines))
        lines, size, first = [], 0, n

    try:
        for line in source:
            if line[0] not in " \t\r\n#" and not (began and re.match(r"-\s", line)):
                key = _KEY.match(line)
                if not key and (began or line.strip() != "---"):
                    return None
                if key:
                    name = key[1].strip("\"'")
                    if special or name in _SPECIAL or size >= CHUNK or not began:
                        end()
                        if header_only and special == "_meta":
                            return head, spool, None
                        special = name if name in _SPECIAL else None
                    n, began = n + (special is None), True
            if not (header_only and special is None):
                lines.append(line)
                size += len(line)
        end()
    except (FormatError, KeyError):
        return None
    if not began:
        return None
    if header_only:
        return head, spool, None
    rows = stored(spool.frame().select("first", "text").mapInArrow(_parsed, "doc_id string, doc_pos bigint, json string, wrong string"), "yaml")
    return None if rows.where("wrong is not null").head() else (head, spool, rows.select("doc_id", "doc_pos", "json"))


def _whole(spark: SparkSession, text: str, header_only: bool) -> tuple[dict[str, Any], Spool, DataFrame | None]:
    """The same of YAML that can't be cut: the driver parses it whole."""
    pairs, spool = yaml_pairs(text), Spool(spark, _LINES)
    for i, (k, v) in enumerate((k, v) for k, v in pairs if k not in _SPECIAL and not header_only):
        spool.add(k, i, to_json({} if v is None else v))
    return {k: v for k, v in pairs if k in _SPECIAL}, spool, None if header_only else spool.frame()


def read_open(spark: SparkSession, source: TextIO, kind: str = "yaml", header_only: bool = False, ignore_id_errors: bool = False, catalog: Catalog | None = None) -> tuple[Catalog, DataFrame]:
    """A corpus from an open JSON or YAML file. The driver reads it once, a piece at a time, and hands documents on through the shared folder.

    With ``header_only`` it reads no further than ``_meta``. YAML that can't be cut at its members is read whole.
    """
    found = (_json_lines if kind == "json" else _yaml_lines)(spark, source, header_only)
    if found is None:
        source.seek(0)
        found = _whole(spark, source.read(), header_only)
    head, spool, lines = found
    catalog = Catalog.from_dict(head["_meta"]) if head.get("_meta") is not None else catalog or Catalog()
    if lines is None:
        spool.drop()
        return catalog, spark.createDataFrame([], StructType.fromDDL(ingest.schema(catalog)))
    docs = with_ids(ingest.from_json_lines(lines, catalog), catalog, not ignore_id_errors)
    spool.drop()
    if head.get("_order") is not None:
        places = Spool(spark, pa.schema([("doc_id", pa.string()), ("doc_pos", pa.int64())]))
        for i, x in enumerate(head["_order"]):
            places.add(x, i)
        # documents of one name take its mentions in turn
        turn = lambda df: df.withColumn("_turn", F.row_number().over(Window.partitionBy("doc_id").orderBy("doc_pos")))
        moved = turn(docs.select("doc_id", "doc_pos")).join(turn(places.frame()).withColumnRenamed("doc_pos", "_to"), ["doc_id", "_turn"]).select("doc_pos", "_to")
        docs = docs.join(moved, "doc_pos").withColumn("doc_pos", F.col("_to"))
    return catalog, docs.select("doc_id", "doc_pos", *[f"`{n}`" for n in catalog], "_extra")


def read_string(spark: SparkSession, text: str, kind: str = "yaml", header_only: bool = False, ignore_id_errors: bool = False, catalog: Catalog | None = None) -> tuple[Catalog, DataFrame]:
    """A corpus from a JSON or YAML text."""
    return read_open(spark, io.StringIO(text), kind, header_only, ignore_id_errors, catalog)


def read_file(spark: SparkSession, path: str, kind: str | None = None, header_only: bool = False, ignore_id_errors: bool = False, catalog: Catalog | None = None) -> tuple[Catalog, DataFrame]:
    """A corpus from one JSON or YAML file that the driver reads through, or from a JSON lines file or store."""
    kind = kind or guess_format(path)
    if kind == "store":
        return read_store(spark, path)[:2]
    if kind == "jsonl":
        if catalog is None:
            raise FormatError("JSON lines hold no descriptions of layers; give a catalog")
        return catalog, read_jsonl(spark, path, catalog)
    if kind == "binary":
        from tierlake.sources import binary

        return binary.read_file(spark, path)
    with gzip.open(path, "rt", encoding="utf-8") if path.endswith(".gz") else open(path, encoding="utf-8") as f:
        return read_open(spark, f, kind, header_only, ignore_id_errors, catalog)


def read_url(spark: SparkSession, url: str, **options: Any) -> tuple[Catalog, DataFrame]:
    """A YAML (or by suffix other) corpus from http, https or file."""
    kind = options.pop("kind", None) or {"json": "json"}.get(guess_format(url), "yaml")
    with tempfile.TemporaryFile() as kept, urllib.request.urlopen(url) as source:  # noqa: S310
        if kind != "json":  # YAML may have to be read again
            shutil.copyfileobj(source, kept, PIECE)
            kept.seek(0)
            source = kept
        with gzip.open(source, "rt", encoding="utf-8") if url.endswith(".gz") else io.TextIOWrapper(source, "utf-8") as text:
            return read_open(spark, text, kind, **options)


def read_many(spark: SparkSession, path: str, kind: str = "json", ignore_id_errors: bool = False) -> tuple[Catalog, DataFrame]:
    """One corpus from a folder or pattern of JSON or YAML files with equal ``_meta``, each decoded whole on an executor.

    Documents are in the order of their files' names and, within one, of the file.
    """
    whole = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())

    def objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pairs = [(k, i, to_json(v), file) for i, (k, v) in enumerate(parse(text, kind).items()) if k != "_order"]
                cols = list(zip(*pairs)) if pairs else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string()))], ["doc_id", "n", "json", "file"])

    each = whole.mapInArrow(objects, "doc_id string, n bigint, json string, file string")
    metas = each.where("doc_id = '_meta'").select("json").distinct().limit(2).collect()
    if len(metas) != 1:
        raise FormatError("the files need one and the same _meta")
    catalog = Catalog.from_dict(json.loads(metas[0][0]))
    sizes = each.where("doc_id <> '_meta'").groupBy("file").agg(F.count("*").alias("docs"), F.max("n").alias("last"))
    files = numbered(sizes, ["file"], "place").select("file", (F.col("place") * MOST_IN_FILE).alias("start"), F.assert_true(F.col("last") < MOST_IN_FILE, "a file has too many documents").alias("fits"))
    placed = each.where("doc_id <> '_meta'").join(files.where("fits is null"), "file").select("doc_id", (F.col("start") + F.col("n")).alias("doc_pos"), "json")
    return catalog, with_ids(ingest.from_json_lines(placed, catalog), catalog, not ignore_id_errors)


def read_jsonl(spark: SparkSession, path: str, catalog: Catalog) -> DataFrame:
    """Documents from JSON lines, one a line, in file order, gzip by suffix; ids are made from content and nothing is checked."""
    lines = spark.read.text(path).where("trim(value) <> ''").select(F.lit(None).cast("string").alias("doc_id"), F.monotonically_increasing_id().alias("doc_pos"), F.col("value").alias("json"))
    return with_ids(ingest.from_json_lines(lines, catalog), catalog, check=False)


def write_jsonl(docs: DataFrame, catalog: Catalog, path: str) -> None:
    """Documents as JSON lines, one file a partition; ids and descriptions aren't written."""
    ingest.to_json_lines(docs, catalog).select("json").write.mode("overwrite").text(path)


def _members(docs: DataFrame, catalog: Catalog, form: Callable[[str, dict[str, Any]], str]) -> DataFrame:
    """All documents in order as one text column; sorted first, so that the texts are made once."""
    return ingest.to_json_lines(docs.orderBy("doc_pos"), catalog, form).select("json")


def _json_member(doc_id: str, wire: dict[str, Any]) -> str:
    return to_json(doc_id) + ":" + to_json(wire)


def write_json(docs: DataFrame, catalog: Catalog, out: Any) -> None:
    """The corpus as one JSON object, ``_meta`` first, layers sorted by name, fetched partition by partition."""
    out.write('{"_meta":' + to_json(catalog.to_dict()))
    for r in _members(docs, catalog, _json_member).toLocalIterator():
        out.write("," + r[0])
    out.write("}")


def write_json_file(docs: DataFrame, catalog: Catalog, path: str) -> None:
    """What ``write_json`` writes, made on the executors and put together by the driver."""
    with open(path, "wb") as out, written(_members(docs, catalog, _json_member)) as parts:
        out.write(('{"_meta":' + to_json(catalog.to_dict())).encode())
        for part in parts:
            out.writelines(b"," + text for text in texts(part))
        out.write(b"}")


_PLAIN = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
# Words that YAML takes for something else than text.
_WORDS = {"", "~", "null", "true", "false", "yes", "no", "on", "off", "y", "n"}


def yaml_scalar(text: str) -> str:
    """A text as a YAML scalar on one line: plain where that reads back as it is, else in double quotes."""
    plain = text[:1] in _PLAIN and text == text.strip() and text.isprintable() and text.lower() not in _WORDS and ": " not in text and " #" not in text and not text.endswith(":")
    return text if plain else json.dumps(text, ensure_ascii=False)


def _yaml_header(catalog: Catalog) -> Iterator[str]:
    yield "_meta:\n"
    for name, desc in catalog.to_dict(with_meta=False).items():
        yield f"    {name}:\n"
        for key in ("type", "base", "data", "link_types", "target", "default"):
            if key in desc:
                value = desc[key]
                if key == "data" and isinstance(value, list):
                    yield "        data:\n" + "".join(f"        - {yaml_scalar(v)}\n" for v in value)
                else:
                    yield f"        {key}: {yaml_scalar(value) if isinstance(value, str) else to_json(value)}\n"


def _yaml_member(catalog: Catalog) -> Callable[[str, dict[str, Any]], str]:
    def member(doc_id: str, wire: dict[str, Any]) -> str:
        lines = [f"{doc_id}:" if wire else f"{doc_id}: {{}}"]
        for name, value in wire.items():
            is_text = isinstance(value, str) and not name.startswith("_") and catalog[name].layer_type is LayerType.characters
            lines.append(f"    {name}: {yaml_scalar(value) if is_text else to_json(value)}")
        return "\n".join(lines)

    return member


def write_yaml(docs: DataFrame, catalog: Catalog, out: Any) -> None:
    """The corpus as YAML: four spaces a level, texts as scalars, other layers as JSON on one line, names sorted."""
    for line in _yaml_header(catalog):
        out.write(line)
    for r in _members(docs, catalog, _yaml_member(catalog)).toLocalIterator():
        out.write(r[0] + "\n")


def write_yaml_file(docs: DataFrame, catalog: Catalog, path: str) -> None:
    """What ``write_yaml`` writes, made on the executors and put together by the driver."""
    with open(path, "wb") as out, written(_members(docs, catalog, _yaml_member(catalog))) as parts:
        out.writelines(line.encode() for line in _yaml_header(catalog))
        for part in parts:
            out.writelines(text + b"\n" for text in texts(part))


def write_store(docs: DataFrame, catalog: Catalog, path: str, indexes: Mapping[str, DataFrame] | None = None) -> None:
    """The corpus as a folder: Parquet of the documents by id, the catalog beside it, and its indexes by value; the catalog is written last.

    Sorted so, a lookup of an id or a value reads the row groups whose statistics let it.
    """
    spark = docs.sparkSession
    docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.mode("overwrite").parquet(f"{path}/docs")
    for name, index in (indexes or {}).items():
        index.repartition("value").sortWithinPartitions("value").write.mode("overwrite").parquet(f"{path}/indexes/{name}")
    meta = to_json({"meta": catalog.to_dict(), "indexes": sorted(indexes or {})})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def read_store(spark: SparkSession, path: str) -> tuple[Catalog, DataFrame, dict[str, DataFrame]]:
    """What ``write_store`` wrote."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    catalog = Catalog.from_dict(meta["meta"])
    return catalog, spark.read.parquet(f"{path}/docs"), {n: spark.read.parquet(f"{path}/indexes/{n}") for n in meta["indexes"]}
