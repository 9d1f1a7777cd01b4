"""The queries of the core operators, each over the whole test tables."""

from __future__ import annotations

import gzip
import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlake import cli
from tierlake.corpus import Corpus
from tierlake.demo import CATALOG, LAYERS, corpus
from tierlake.functions.arrays import ascending, deltas
from tierlake.functions.values import UNITS, from_columns, shown
from tierlake.operators import drift, frequency, ids, mutate, shred, tokenize
from tierlake.operators.predicates import And, Exists, GreaterThan, GreaterThanEqual, In, LessThan, LessThanEqual, Not, NotIn, Or, Query, QueryBuilder, Regex, Text, TextNot, TextRegex, Value_, ValueNot, from_dict
from tierlake.operators.render import render
from tierlake.plans import planner
from tierlake.plans.shared import cut, numbered, shared_dir
from tierlake.sources import binary, files, ingest
from tierlake.sources.spool import Spool
from tierlake.streaming import channel, jsonl

Run = Callable[[SparkSession, str], DataFrame]


def _table(name: str) -> Run:
    return lambda spark, d: spark.read.parquet(f"{d}/{name}.parquet")


_RECORDS, _FILES, _DOCS, _UPDATES = _table("raw_records"), _table("layer_files"), _table("documents"), _table("doc_updates")


def _pieces(name: str) -> Run:
    def run(s: SparkSession, d: str) -> DataFrame:
        return corpus(s, d, name).select("doc_id", F.posexplode(LAYERS.text(name)).alias("ord", "piece")).select("doc_id", F.col("ord").cast("bigint").alias("ord"), "piece")

    return run


def _positions(name: str, target: str) -> Run:
    def run(s: SparkSession, d: str) -> DataFrame:
        each = corpus(s, d, name).select("doc_id", F.posexplode(LAYERS.indexes(name, target)).alias("ord", "x"))
        return each.select("doc_id", *[F.col(c).cast("bigint").alias(a) for c, a in (("ord", "ord"), ("x.s", "s"), ("x.e", "e"))])

    return run


def _search(query: Query) -> Run:
    return lambda s, d: planner.search(corpus(s, d, "text", *query.reads()), LAYERS, query).select("doc_id")


def _indexes_data(s: SparkSession, d: str) -> DataFrame:
    each = corpus(s, d, "pos").select("doc_id", F.posexplode(LAYERS.indexes_data("pos", "text")).alias("ord", "x"))
    return each.select("doc_id", *[F.col(c).cast("bigint").alias(a) for c, a in (("ord", "ord"), ("x.s", "s"), ("x.e", "e"))], shown(F.col("x.d")).alias("value"))


def _layer_len(s: SparkSession, d: str) -> DataFrame:
    sizes = F.create_map(*[x for n in CATALOG for x in (F.lit(n), LAYERS.length(n))])
    return corpus(s, d).select("doc_id", F.explode(sizes).alias("layer", "n")).where("n is not null").select("doc_id", "layer", F.col("n").cast("bigint").alias("n"))


def _text_corpus(s: SparkSession, d: str) -> DataFrame:
    return _DOCS(s, d).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("doc_id").alias("doc_pos"), "text")


_TEXT_ONLY = type(CATALOG)({"text": CATALOG["text"]})


def _ids(s: SparkSession, d: str) -> DataFrame:
    return ids.assign(_text_corpus(s, d), _TEXT_ONLY).select(F.col("doc_pos").alias("doc_id"), F.col("doc_id").alias("id"))


def _index(s: SparkSession, d: str, name: str) -> DataFrame:
    return planner.kept(planner.create_index(corpus(s, d, name), LAYERS, name), name)


_BY_INDEX = And((Value_("pos", "NUM"), Or((In("lemma", ("winter", "river")), Value_("pos", "PRON")))))


def _index_search(s: SparkSession, d: str) -> DataFrame:
    return planner.search(corpus(s, d, "text"), LAYERS, _BY_INDEX, {n: _index(s, d, n) for n in ("pos", "lemma")}).select("doc_id")


def _estimates(s: SparkSession, d: str) -> DataFrame:
    docs, index = corpus(s, d, "text"), {"pos": _index(s, d, "pos")}
    asked = {"value": Value_("pos", "NUM"), "and": And((Value_("pos", "NUM"), In("pos", ("DET", "NOUN")))), "or": Or((Value_("pos", "NUM"), Value_("pos", "det"))), "none": Value_("pos", "absent"), "no index": Text("words", "x")}
    return s.createDataFrame([(k, planner.estimate(docs, q, index)) for k, q in asked.items()], "query string, n bigint")


def _latest(s: SparkSession, d: str) -> DataFrame:
    """(doc_id, op, layer, payload) of the latest change of each document."""
    newest = F.max_by(F.struct("op", "layer", "payload"), F.struct("occurred_at", "upd_id", "received_at")).alias("x")
    return _UPDATES(s, d).groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(newest).select("doc_id", "x.*")


def _removed(s: SparkSession, d: str) -> DataFrame:
    return mutate.remove(_text_corpus(s, d), _latest(s, d).where("op = 'remove'")).select(F.col("doc_pos").alias("doc_id"), "text")


def _changes(updates: DataFrame) -> DataFrame:
    """(doc_id, a column of payloads for each layer of _CHANGED): the latest change of each layer of a document after its last removal."""
    at = F.struct("occurred_at", "upd_id", "received_at")
    gone = updates.where("op = 'remove'").groupBy("doc_id").agg(F.max(at).alias("gone"))
    live = updates.where("op <> 'remove' and payload is not null").withColumn("at", at).join(gone, "doc_id", "left").where("gone is null or at > gone")
    return live.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(*[F.max_by(F.when(F.col("layer") == n, F.col("payload")), F.when(F.col("layer") == n, F.col("at"))).alias(n) for n in _CHANGED])


#: Layers whose payloads state whole layers; those of spans (words, entities) are texts without positions, which make no units.
_CHANGED = ("text", "pos", "lemma", "_notes")


def _seq_units(payload: str) -> Column:
    return F.transform(F.from_json(payload, "array<string>"), lambda x, i: F.struct(i.alias("s"), (i + 1).alias("e"), from_columns(x).alias("d"))).cast(UNITS)


def _named(s: SparkSession, d: str) -> DataFrame:
    """The documents of the corpus with ids by content and the layers of _CHANGED; no change touches the others."""
    named = ids.assign(_text_corpus(s, d), _TEXT_ONLY).select("doc_pos", "doc_id")
    return corpus(s, d, "pos", "lemma").select("doc_pos", "text", "pos", "lemma", "_extra").join(named, "doc_pos")


def _changed(docs: DataFrame) -> list[Column]:
    """The layers of _CHANGED as plain text, values parted by |, those without one as ~."""
    values = lambda n: F.array_join(F.transform(n, lambda u: shown(u["d"])), "|", "~").alias(n)
    return [F.col("text"), values("pos"), values("lemma"), F.try_element_at("_extra", F.lit("_notes")).alias("notes")]


def _updated(s: SparkSession, d: str) -> DataFrame:
    """The documents with the layers of ``_changes`` put in; ids follow the new texts."""
    docs = cut(_named(s, d))
    raw = _changes(_UPDATES(s, d)).withColumnRenamed("doc_id", "key")
    keyed = docs.select("doc_pos", F.col("doc_pos").cast("string").alias("key"))
    patch = cut(raw.join(keyed, "key").select("doc_pos", F.expr("get_json_object(concat('[', text, ']'), '$[0]')").alias("text"), _seq_units("pos").alias("pos"), _seq_units("lemma").alias("lemma"), "_notes"))
    noted = docs.join(patch.select("doc_pos", "_notes"), "doc_pos", "left")
    noted = noted.withColumn("_extra", F.when(F.col("_notes").isNull(), F.col("_extra")).otherwise(F.map_concat(F.map_filter("_extra", lambda k, _: k != "_notes"), F.create_map(F.lit("_notes"), F.col("_notes"))))).drop("_notes")
    new = mutate.update(noted, patch.drop("_notes"), CATALOG, "doc_pos")
    return new.select(F.col("doc_pos").alias("doc_id"), F.col("doc_id").alias("id"), *_changed(new))


def _added(s: SparkSession, d: str) -> DataFrame:
    """The records of doc_updates that add a layer of _CHANGED, as documents of that layer after those of the corpus."""
    each = _UPDATES(s, d).where(F.expr("op = 'add'") & F.col("layer").isin(*_CHANGED)).groupBy("upd_id").agg(F.min(F.struct("layer", "payload")).alias("x"))
    of = lambda n: F.when(F.col("x.layer") == n, F.col("x.payload"))
    raw = each.select("upd_id", *[of(n).alias(n) for n in _CHANGED])
    extra = F.when(F.col("_notes").isNotNull(), F.create_map(F.lit("_notes"), F.col("_notes"))).otherwise(F.expr("cast(map() as map<string,string>)"))
    new = raw.select(F.lit(None).cast("string").alias("doc_id"), F.col("upd_id").alias("doc_pos"), F.expr("get_json_object(concat('[', text, ']'), '$[0]')").alias("text"), _seq_units("pos").alias("pos"), _seq_units("lemma").alias("lemma"), extra.alias("_extra"))
    both = mutate.add(cut(_named(s, d)), new, CATALOG)
    return both.select("doc_pos", F.col("doc_id").alias("id"), *_changed(both))


def _tokens(s: SparkSession, d: str) -> DataFrame:
    each = tokenize.tokenized(_DOCS(s, d).select("doc_id", "text"), pattern=tokenize.SHARED).select("doc_id", F.posexplode("tokens").alias("ord", "x"))
    return each.select("doc_id", *[F.col(c).cast("bigint").alias(a) for c, a in (("ord", "ord"), ("x.s", "s"), ("x.e", "e"))], "x.token")


def _info(s: SparkSession, d: str) -> DataFrame:
    docs = corpus(s, d)
    return docs.agg(F.count("*").alias("documents"), *[F.count(F.col(n)).alias(f"with_{n}") for n in CATALOG])


def _folder(s: SparkSession, name: str) -> str:
    return f"{shared_dir(s)}/tierlake-{name}-{uuid.uuid4().hex}"


def _words_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_pos", F.posexplode_outer(LAYERS.text("entities")).alias("ord", "piece"), F.size("words").alias("n_words"), F.get(F.map_values("_extra"), F.lit(0)).alias("url")).select(F.col("doc_pos").alias("doc_id"), F.col("ord").cast("bigint").alias("ord"), "piece", F.when(F.col("n_words") >= 0, F.col("n_words")).cast("bigint").alias("n_words"), "url")


def _wired(s: SparkSession, d: str) -> DataFrame:
    """Documents through their wire form and back."""
    docs = corpus(s, d).withColumn("doc_id", F.col("doc_id").cast("string"))
    return _words_of(ingest.from_json_lines(ingest.to_json_lines(docs, CATALOG), CATALOG))


def _stored(s: SparkSession, d: str) -> DataFrame:
    """Documents through a store and back."""
    path = _folder(s, "store")
    files.write_store(corpus(s, d), CATALOG, path, {"pos": planner.create_index(corpus(s, d), LAYERS, "pos")})
    return _words_of(files.read_store(s, path)[1])


def _streamed(s: SparkSession, d: str) -> DataFrame:
    """Documents written as JSON lines, read as a stream into Parquet, and read again; by content, as ids and places aren't written."""
    path = _folder(s, "stream")
    ingest.to_json_lines(corpus(s, d).withColumn("doc_id", F.col("doc_id").cast("string")), CATALOG).select("json").write.text(f"{path}/in")
    jsonl.to_parquet(jsonl.read(s, f"{path}/in", CATALOG), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return s.read.parquet(f"{path}/out").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), F.when(F.col("words").isNotNull(), F.size("words")).cast("bigint").alias("n_words"))


def _linked(s: SparkSession, d: str) -> DataFrame:
    each = corpus(s, d, "prev").select("doc_id", F.posexplode(F.arrays_zip(LAYERS.text("prev").alias("word"), LAYERS.linked_text("prev").alias("linked"))).alias("ord", "x"))
    return each.select("doc_id", F.col("ord").cast("bigint").alias("ord"), "x.word", "x.linked")


_TAGGED = type(CATALOG)({n: CATALOG[n] for n in ("text", "words", "pos", "lemma", "entities")})


def _tagged(s: SparkSession, d: str) -> DataFrame:
    """The documents with the layers of _TAGGED and ids by content, joined by the key that their layers are, so that texts aren't shuffled again."""
    named = ids.assign(_text_corpus(s, d), _TEXT_ONLY).select(F.col("doc_pos").alias("doc_id"), F.col("doc_id").alias("id"))
    return corpus(s, d, "pos", "lemma", "entities").join(named, "doc_id").select(F.col("id").alias("doc_id"), "doc_pos", *_TAGGED, F.expr("cast(map() as map<string,string>)").alias("_extra"))


#: The same for the binary format, whose values of a layer are of one kind and of an enumeration its members alone.
_LOOSE = type(CATALOG)({**_TAGGED, "pos": replace(CATALOG["pos"], data="string")})


def _loose(s: SparkSession, d: str) -> DataFrame:
    """``_tagged`` with ~ for units without a value."""
    filled = lambda u: F.struct(u["s"].alias("s"), u["e"].alias("e"), from_columns(F.coalesce(shown(u["d"]), F.lit("~"))).alias("d"))
    return _tagged(s, d).select("doc_id", "doc_pos", "text", "words", *[F.transform(n, filled).cast(UNITS).alias(n) for n in ("pos", "lemma", "entities")], "_extra")


def _shown(s: SparkSession, d: str) -> DataFrame:
    """The first document in plain letters that has every layer of _TAGGED, whole words alone, as text, a row a line."""
    plain = corpus(s, d, "pos", "lemma", "entities").where("entities is not null and pos is not null and lemma is not null and octet_length(text) = length(text) and element_at(words, -1).e <= length(text)")
    row = plain.orderBy("doc_pos").head()
    text = render(str(row["doc_id"]), ingest.document_of({**row.asDict(recursive=True), "_extra": {}}, _TAGGED), 1 << 20) if row else None
    return s.createDataFrame([] if text is None else list(enumerate(text.split("\n"))), "n bigint, line string")


def _local(s: SparkSession, name: str) -> str:
    """A new folder within the shared one, as a path of this machine; formats of one file are written by the driver."""
    path = _folder(s, name)
    if not path.startswith(("file:", "/")):
        raise ValueError("the formats of one file need a shared folder that the driver can open")
    path = path.removeprefix("file://")
    os.makedirs(path)
    return path


def _contents(docs: DataFrame) -> DataFrame:
    """Documents by content, as files may order them otherwise."""
    return docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), F.when(F.col("words").isNotNull(), F.size("words")).cast("bigint").alias("n_words"), F.array_join(F.transform("pos", lambda u: shown(u["d"])), "|", "~").alias("tags"))


def _through(name: str) -> Run:
    """The corpus written to a file of its own and read back, ids checked."""

    def run(s: SparkSession, d: str) -> DataFrame:
        path = f"{_local(s, 'file')}/{name}"
        (Corpus(s, _LOOSE, _loose(s, d)) if name.endswith(".cuac") else Corpus(s, _TAGGED, _tagged(s, d))).write(path.removesuffix(".gz"))
        if name.endswith(".gz"):
            with open(path.removesuffix(".gz"), "rb") as plain, gzip.open(path, "wb") as packed:
                shutil.copyfileobj(plain, packed)
            os.remove(path.removesuffix(".gz"))
        docs = Corpus.read(s, path).docs
        os.remove(path)
        return _contents(docs)

    return run


def _by_url(s: SparkSession, d: str) -> DataFrame:
    path = f"{_local(s, 'url')}/corpus.json"
    Corpus(s, _TAGGED, _tagged(s, d)).write(path)
    docs = Corpus.read_url(s, f"file://{path}").docs
    os.remove(path)
    return _contents(docs)


def _many(s: SparkSession, d: str) -> DataFrame:
    """The corpus as a file of JSON for each of 16 parts, read as one."""
    path, docs = _local(s, "many"), cut(_tagged(s, d))
    for part in range(16):
        Corpus(s, _TAGGED, docs.where(F.col("doc_pos") % 16 == part)).write(f"{path}/{part:02}.json")
    return _contents(files.read_many(s, path, ignore_id_errors=True)[1]).select("hash", "n_words", "tags")


def _commands(s: SparkSession, d: str) -> DataFrame:
    """The corpus through the commands load and convert."""
    path = _local(s, "cli")
    Corpus(s, _LOOSE, _loose(s, d)).write(f"{path}/a.json")
    cli.main(["load", f"{path}/a.json", f"{path}/store"])
    os.remove(f"{path}/a.json")
    cli.main(["convert", f"{path}/store", f"{path}/b.cuac"])
    shutil.rmtree(f"{path}/store")
    cli.main(["convert", f"{path}/b.cuac", f"{path}/c.json"])
    os.remove(f"{path}/b.cuac")
    return _contents(Corpus.read(s, f"{path}/c.json").docs)


def _packed(s: SparkSession, d: str) -> DataFrame:
    """Each document in binary form and back, by itself."""
    columns = ingest.arrow_schema(_LOOSE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                raw = binary.dumps(ingest.document_of(row, _LOOSE))
                rows.append(ingest.row_of(binary.loads(raw, _LOOSE), row["doc_id"], row["doc_pos"]))
            yield pa.RecordBatch.from_pylist(rows, columns)

    return _contents(_loose(s, d).mapInArrow(run, ingest.schema(_LOOSE)))


def _piped(s: SparkSession, d: str) -> DataFrame:
    """The texts through a channel of documents, which names them by content."""

    def produce(sender: channel.Sender) -> None:
        sender.set_meta(_TEXT_ONLY)
        for r in _DOCS(s, d).orderBy("doc_id").select("text").toLocalIterator():
            sender.add_doc({} if r["text"] is None else {"text": r["text"]})

    def consume(receiver: channel.Receiver) -> DataFrame:
        spool = Spool(s, pa.schema([("id", pa.string()), ("text", pa.string())]))
        for i, doc in receiver:
            spool.add(i, doc.get("text"))
        return spool.frame()

    return channel.pipe(produce, consume).select("id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))


def _described(s: SparkSession, d: str) -> DataFrame:
    """The layers of a corpus declared one by one, and the catalog that its store gives back."""
    made = Corpus(s)
    for name in sorted(CATALOG, key=CATALOG.depth):
        desc = CATALOG[name]
        made.build_layer(name).type(desc.layer_type.value).base(desc.base).data(list(desc.data) if isinstance(desc.data, tuple) else desc.data).target(desc.target).add()
    path = _folder(s, "meta")
    made.write(path, "store")
    back = Corpus.read(s, path, kind="store").catalog
    rows = [(n, x.layer_type.value, x.base, x.data if isinstance(x.data, str) else None if x.data is None else ",".join(x.data), x.target, back.depth(n)) for n, x in back.items()]
    return s.createDataFrame(rows, "layer string, type string, base string, data string, target string, depth bigint")


def _header(s: SparkSession, d: str) -> DataFrame:
    """The layers of the header of a YAML file, whose documents aren't read."""
    path = f"{_local(s, 'header')}/corpus.yaml"
    Corpus(s, _TAGGED, _tagged(s, d)).write(path)
    head = Corpus.read(s, path, header_only=True)
    os.remove(path)
    return s.createDataFrame([(n, x.layer_type.value, x.base, head.docs.count()) for n, x in head.catalog.items()], "layer string, type string, base string, documents bigint")


def _reordered(s: SparkSession, d: str) -> DataFrame:
    """The documents with an url in reverse order."""
    docs = _text_corpus(s, d)
    order = _DOCS(s, d).where("url is not null").select(F.col("doc_id").cast("string").alias("doc_id"), (-F.col("doc_id")).alias("pos"))
    return numbered(mutate.reorder(docs, order), ["doc_pos"], "n").select("n", F.col("doc_id").cast("bigint").alias("doc_id"))


def _maintained(s: SparkSession, d: str) -> DataFrame:
    """The index of pos after the documents that were removed last are gone."""
    docs = corpus(s, d, "pos").withColumn("doc_id", F.col("doc_id").cast("string"))
    gone = _latest(s, d).where("op = 'remove' and doc_id is not null").select("doc_id").distinct()
    index = planner.refresh(planner.kept(planner.create_index(docs, LAYERS, "pos")), gone, mutate.remove(docs, gone), LAYERS, "pos")
    return index.select(shown(F.col("value")).alias("value"), F.col("doc_id").cast("bigint").alias("doc_id"))


def _installed(s: SparkSession, d: str) -> DataFrame:
    """A search by an index that was made, dropped and installed again."""
    made = Corpus(s, CATALOG, corpus(s, d, "lemma"))
    made.create_index("lemma")
    index = made.get_index("lemma")
    made.drop_index("lemma")
    if made.has_index("lemma"):
        raise ValueError("the index is still there")
    made.set_index("lemma", index)
    return made.search({"lemma": ["winter", "river"]}).select("doc_id")


_BUILT = QueryBuilder().exists("entities").value_not("pos", "X").or_([Text("words", "the"), In("pos", ("NUM",))]).build()
_ASKED = from_dict({"$or": [{"pos": "NUM"}, {"$not": {"$exists": "entities"}}], "words": {"$text_ne": "the"}, "lemma": {"$regex": "^w"}})


def _ranked(s: SparkSession, d: str) -> DataFrame:
    """The places of the documents that match, in order."""
    query = from_dict({"pos": ["NUM", "PRON"], "$exists": "entities"})
    hits = planner.search(corpus(s, d, *query.reads()), LAYERS, query)
    return numbered(hits.select("doc_id", "doc_pos"), ["doc_pos"], "n").select("n", "doc_id")


def _steps(s: SparkSession, d: str) -> DataFrame:
    """The starts of words as differences, and whether they rise."""
    starts = corpus(s, d, "words").where("words is not null").select("doc_id", F.transform("words", lambda u: u["s"]).alias("at"))
    return starts.select("doc_id", F.array_join(deltas(F.col("at")).cast("array<string>"), ",").alias("steps"), ascending(F.col("at")).alias("rises"))


def _value_counts(name: str) -> Run:
    return lambda s, d: frequency.val_freq(corpus(s, d, name), LAYERS, name).select(shown(F.col("value")).alias("value"), "freq")


def _postings(s: SparkSession, d: str) -> DataFrame:
    return planner.create_index(corpus(s, d, "pos"), LAYERS, "pos").select(shown(F.col("value")).alias("value"), "doc_id")


SEARCHES: dict[str, Query] = {
    "q_text": Text("words", "the"),
    "q_text_not": TextNot("words", "the"),
    "q_text_characters": Not(TextNot("text", "")),
    "q_value": Value_("pos", "NUM"),
    "q_value_not": ValueNot("entities", "ORG"),
    "q_lt": LessThan("lemma", "b"),
    "q_lte": LessThanEqual("entities", "LOC"),
    "q_gt": GreaterThan("lemma", "z"),
    "q_gte": GreaterThanEqual("prev", 300),
    "q_in": In("pos", ("NUM", "num")),
    "q_nin": NotIn("entities", ("ORG", "PER")),
    "q_regex": Regex("lemma", "^w.*r$"),
    "q_text_regex": TextRegex("entities", "^[KL]"),
    "q_and": And((Value_("pos", "NUM"), Text("words", "the"))),
    "q_or": Or((Value_("entities", "PER"), Value_("lemma", "river"))),
    "q_not": Not(Value_("pos", "NUM")),
    "q_exists": Exists("entities"),
    "q_exists_extra": Exists("_url"),
    "q_characters_none": And((ValueNot("text", "x"), Not(Value_("text", "x")))),
    "q_missing_layer": And((Not(ValueNot("lemma", "x")), Exists("text"))),
    "q_empty": And((And(()), Not(Or(())), Not(In("pos", ())))),
}


def queries() -> dict[str, Run]:
    return {
        "scan_docs": lambda s, d: corpus(s, d, "text").select("doc_id", "text"),
        "doc_by_id": lambda s, d: (lambda docs: docs.join(F.broadcast(docs.agg(F.min("doc_id").alias("doc_id"))), "doc_id").select("doc_id", "text"))(_DOCS(s, d)),
        "doc_ids_greedy": _ids,
        "doc_keys": lambda s, d: corpus(s, d).select("doc_id", F.explode(LAYERS.present(list(CATALOG))).alias("layer")),
        "layer_text_words": _pieces("words"),
        "layer_text_seq": _pieces("pos"),
        "layer_text_phrase": _pieces("entities"),
        "layer_text_element": _pieces("prev"),
        "layer_text_div": _pieces("lines"),
        "layer_text_document": _pieces("lang"),
        "indexes_self": _positions("words", "words"),
        "indexes_direct": _positions("entities", "words"),
        "indexes_seq": _positions("pos", "words"),
        "indexes_transitive_span": _positions("entities", "text"),
        "indexes_element": _positions("prev", "text"),
        "indexes_div": _positions("lines", "text"),
        "indexes_div_tail": _positions("tens", "text"),
        "indexes_characters": lambda s, d: corpus(s, d, "text").select("doc_id", LAYERS.indexes("text", "text").alias("x")).where("x is not null").select("doc_id", F.size("x").cast("bigint").alias("n"), F.try_element_at("x", F.lit(-1))["e"].cast("bigint").alias("last")),
        "indexes_data": _indexes_data,
        "layer_len": _layer_len,
        **{name: _search(q) for name, q in SEARCHES.items()},
        "text_freq": lambda s, d: frequency.text_freq(corpus(s, d, "words"), LAYERS, "words", strict=False),
        "text_freq_in": lambda s, d: frequency.text_freq(corpus(s, d, "words"), LAYERS, "words", ["the", "a", "der", "le"], strict=False),
        "text_freq_where": lambda s, d: frequency.text_freq(corpus(s, d, "words"), LAYERS, "words", lambda c: c.contains("i"), strict=False),
        "val_freq": _value_counts("pos"),
        "val_freq_link": _value_counts("prev"),
        "index_postings": _postings,
        "index_search": _index_search,
        "estimate_count": _estimates,
        "add_docs": _added,
        "update_doc": _updated,
        "remove_doc": _removed,
        "tokenize": _tokens,
        "corpus_info": _info,
        "json_roundtrip": _wired,
        "store_roundtrip": _stored,
        "stream_roundtrip": _streamed,
        "link_resolve": _linked,
        "show_doc": _shown,
        "list_ids": lambda s, d: numbered(_text_corpus(s, d), ["doc_pos"], "n").select("n", F.col("doc_id").cast("bigint").alias("doc_id")),
        "set_order": _reordered,
        "layer_descriptions": _described,
        "yaml_header": _header,
        "file_json": _through("corpus.json"),
        "file_yaml": _through("corpus.yaml"),
        "file_binary": _through("corpus.cuac"),
        "file_gzip": _through("corpus.json.gz"),
        "file_url": _by_url,
        "file_many": _many,
        "cli_load_convert": _commands,
        "binary_documents": _packed,
        "channel_pipe": _piped,
        "query_builder": _search(_BUILT),
        "query_dict": _search(_ASKED),
        "search_order": _ranked,
        "index_refresh": _maintained,
        "index_installed": _installed,
        "text_freq_python": lambda s, d: frequency.text_freq(corpus(s, d, "words"), LAYERS, "words", frequency.by_python(lambda w: w.endswith("s")), strict=False),
        "val_freq_in": lambda s, d: frequency.val_freq(corpus(s, d, "pos"), LAYERS, "pos", ["NUM", "DET"]).select(shown(F.col("value")).alias("value"), "freq"),
        "val_freq_where": lambda s, d: frequency.val_freq(corpus(s, d, "pos"), LAYERS, "pos", lambda v: v["t"].startswith("A")).select(shown(F.col("value")).alias("value"), "freq"),
        "array_deltas": _steps,
        "p2_found": lambda s, d: shred.links(_RECORDS(s, d)),
        "p2_nodes": lambda s, d: shred.shred(_RECORDS(s, d)),
        **{f"p2_{n}": (lambda n: lambda s, d: shred.tables(_RECORDS(s, d))[n])(n) for n in ("layers", "documents", "notes", "authors", "marks")},
        "p6_found": lambda s, d: drift.changes(_FILES(s, d)),
        "p6_layers": lambda s, d: drift.consistent(_FILES(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    from tierlake.oracle import SQL

    return dict(SQL)
