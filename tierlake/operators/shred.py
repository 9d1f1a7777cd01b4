"""Problem 2: deeply nested records as flat tables that keep the link from child to parent.

Adjacency shredding: each record becomes rows of node, parent, label, ordinal and scalar; entities are object nodes
joined with their scalar children and pivoted; what an entity hangs on is found by joining the ancestors of its node.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlake.plans.shared import cut

NODES = "rec_id bigint, node int, parent int, label string, ordinal int, kind string, scalar string, up array<int>"
_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int32())]
_NAMES = [f.split()[0] for f in NODES.split(", ")]


def _refuse(name: str) -> None:
    raise ValueError(name)


_TOKEN = re.compile(r'[ \t\n\r]*(?:([\[\]{},:])|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?)|(")|(true|false|null))')
_WORDS = {"true": True, "false": False, "null": None}


def _tokens(text: str) -> Iterator[tuple[str, object]]:
    """(mark or "value", value) of each token of a JSON text."""
    at, end = 0, len(text.rstrip(" \t\n\r"))
    while at < end:
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"no JSON at {at}")
        at = m.end()
        mark, number, quote, word = m.groups()
        if mark:
            yield mark, None
        elif quote:
            value, at = scanstring(text, at, True)
            yield "value", value
        else:
            yield "value", _WORDS[word] if word else json.loads(number)


def parsed_deep(text: str) -> object:
    """The value of a JSON text of any depth: open arrays and objects are on a list, not on the call stack."""
    open_: list[tuple[object, object]] = []  # containers, and the key that waits for a value
    top: list[object] = []
    here: object = top
    key: object = None
    expect = "value"  # value, first (value or ]), key, firstkey (key or }), colon, more (comma or end), end

    def put(value: object) -> None:
        if isinstance(here, dict):
            here[key] = value
        else:
            here.append(value)

    for mark, value in _tokens(text):
        if mark in "[{" and expect in ("value", "first"):
            made: object = [] if mark == "[" else {}
            put(made)
            open_.append((here, key))
            here, expect = made, "first" if mark == "[" else "firstkey"
        elif mark == "value" and expect in ("value", "first"):
            put(value)
            expect = "more" if open_ else "end"
        elif mark == "value" and expect in ("key", "firstkey") and isinstance(value, str):
            key, expect = value, "colon"
        elif mark == ":" and expect == "colon":
            expect = "value"
        elif mark == "," and expect == "more":
            expect = "key" if isinstance(here, dict) else "value"
        elif (mark == "]" and isinstance(here, list) and expect in ("first", "more") or mark == "}" and isinstance(here, dict) and expect in ("firstkey", "more")) and open_:
            here, key = open_.pop()
            expect = "more" if open_ else "end"
        else:
            raise ValueError(f"{mark} where JSON has none")
    if expect != "end":
        raise ValueError("the JSON text ends early")
    return top[0]


def parsed(text: str | None) -> object:
    """The value of a JSON text of any depth; raises ValueError if it isn't valid JSON (NaN and Infinity aren't)."""
    try:
        return json.loads(text or "", parse_constant=_refuse)
    except RecursionError:
        return parsed_deep(text)


def embedded(value: object) -> object:
    """What a string holds if it is the JSON text of an object or array, else None."""
    if isinstance(value, str) and value.lstrip()[:1] in ("{", "["):
        try:
            inner = parsed(value)
        except ValueError:
            return None
        return inner if isinstance(inner, (dict, list)) else None
    return None


def written(value: object) -> str | None:
    """A scalar as text: strings as they are, null as null, all else as JSON."""
    if value is None or isinstance(value, str):
        return value
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        out, todo = [], [value]  # arrays alone are this deep here: objects are nodes
        while todo:
            x = todo.pop()
            if isinstance(x, list):
                parts = [", "] * max(0, 2 * len(x) - 1)
                parts[::2] = [_Item(v) for v in x]
                todo += reversed(["[", *parts, "]"])
            elif isinstance(x, _Item):
                todo.append(x.value if isinstance(x.value, list) else json.dumps(x.value, ensure_ascii=False))
            else:
                out.append(x)
        return "".join(out)


class _Item:
    """A value that ``written`` has yet to write, so that it isn't taken for a piece of JSON."""

    def __init__(self, value: object):
        self.value = value


class _Objects:
    """Which arrays and strings of a value hold objects at any depth, found in one walk, and what strings hold."""

    def __init__(self, value: object):
        self.inner: dict[int, object] = {}
        self.holding: set[int] = set()
        walked, todo = [], [value]
        while todo:
            x = todo.pop()
            below = list(x.values()) if isinstance(x, dict) else x if isinstance(x, list) else ()
            if isinstance(x, str) and (inner := embedded(x)) is not None:
                self.inner[id(x)], below = inner, [inner]
            if isinstance(x, dict) or below:
                walked.append((x, below))
                todo += below
        for x, below in reversed(walked):
            if isinstance(x, dict) or any(id(y) in self.holding for y in below):
                self.holding.add(id(x))

    def of(self, x: object) -> object:
        """``x``, or what it holds if it is a string that holds objects."""
        return self.inner[id(x)] if isinstance(x, str) and id(x) in self.inner and id(x) in self.holding else x


def shred_one(value: object) -> Iterator[tuple]:
    """(node, parent, label, ordinal, kind, scalar, up) of each node of one record, in document order, the root being node 0.

    kind: object, array, scalar. An array without objects in it is one scalar node that holds its JSON; a string that holds
    JSON text with objects is that object or array. ``up``: the object nodes above, the nearest last, and the arrays
    that may be a document or a layer (those under a key of the record or of an object in it).
    """
    objects = _Objects(value)
    todo: list[tuple] = [(value, None, None, 0, ())]
    n = 0
    while todo:
        x, parent, label, ordinal, up = todo.pop()
        x = objects.of(x)
        node, n = n, n + 1
        if isinstance(x, dict):
            yield node, parent, label, ordinal, "object", None, up
            below = (*up, node)
            todo += reversed([(v, node, k, i, below) for i, (k, v) in enumerate(x.items())])
        elif isinstance(x, list) and id(x) in objects.holding:
            yield node, parent, label, ordinal, "array", None, up
            below = (*up, node) if label is not None and len(up) <= 2 else up
            todo += reversed([(v, node, None, i, below) for i, v in enumerate(x)])
        else:
            yield node, parent, label, ordinal, "scalar", written(x), up


def shred(records: DataFrame, key: str = "rec_id", content: str = "content") -> DataFrame:
    """The adjacency table (NODES) of the JSON texts in ``content``.

    Null, empty and invalid texts have no nodes. A record that stands twice under one key is shredded twice; other columns
    are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            cells = 0
            for rec, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    value = parsed(text)
                except ValueError:
                    continue
                for node in shred_one(value):
                    rows.append((rec, *node))
                    cells += 8 + len(node[-1])
                    if cells > 500_000:
                        yield made(rows)
                        rows, cells = [], 0
            yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [()] * len(_KINDS)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _KINDS)], _NAMES)

    return records.select(F.col(key).cast("bigint"), F.col(content).cast("string")).mapInArrow(run, NODES)


def entities(nodes: DataFrame, fields: list[str]) -> DataFrame:
    """One row for each object: rec_id, node, parent, label, up, and the scalar children ``fields`` as text, null where it has none.

    Object nodes are joined with their scalar children by (rec_id, parent), and the children pivoted.
    """
    objects = nodes.where("kind = 'object'").select("rec_id", "node", "parent", "label", "up")
    child = nodes.where(F.expr("kind = 'scalar'") & F.col("label").isin(fields) & F.col("scalar").isNotNull())
    values = child.groupBy("rec_id", F.col("parent").alias("node")).pivot("label", fields).agg(F.first("scalar"))
    return objects.join(values, ["rec_id", "node"], "left")


def holders(objects: DataFrame, nodes: DataFrame) -> DataFrame:
    """(rec_id, node, holder, base, is_layer): the documents (keys of the record) and the layers (members of ``_meta``) that aren't scalars."""
    meta = nodes.where("parent = 0 and label = '_meta'").select("rec_id", F.col("node").alias("parent"), (F.col("kind") == "array").alias("listed"))
    # layers and documents that are arrays hold notes too
    members = nodes.where("kind <> 'scalar'").join(meta, ["rec_id", "parent"]).join(objects.select("rec_id", "node", "name", "base"), ["rec_id", "node"], "left")
    layers = members.select("rec_id", "node", F.when(F.col("listed"), F.col("name")).otherwise(F.col("label")).alias("holder"), "base", F.lit(True).alias("is_layer"))
    top = nodes.where("parent = 0 and label is not null and not startswith(label, '_') and kind <> 'scalar'").select("rec_id", "node", F.col("label").alias("holder"), F.lit(None).cast("string").alias("base"), F.lit(False).alias("is_layer"))
    return layers.union(top).where("holder is not null")


def layer_links(held: DataFrame) -> DataFrame:
    """(rec_id, parent_id, child_id): the base of each layer of ``_meta`` that has one, and the layer."""
    return held.where("is_layer and base <> ''").select("rec_id", F.col("base").alias("parent_id"), F.col("holder").alias("child_id"))


def note_links(objects: DataFrame, held: DataFrame) -> DataFrame:
    """(rec_id, parent_id, child_id): each note and the nearest note around it, or else the document or layer that holds it."""
    notes = objects.where("note_id is not null").select("rec_id", "node", "up", F.col("note_id").alias("id"))
    above = notes.select("rec_id", "node", F.posexplode("up").alias("depth", "over"))
    around = notes.select("rec_id", F.col("node").alias("over"), F.col("id").alias("name"), F.lit(1).alias("near"))
    holding = held.select("rec_id", F.col("node").alias("over"), F.col("holder").alias("name"), F.lit(0).alias("near"))
    # a note that is itself the document or layer hangs on that document or layer
    itself = notes.join(holding.select("rec_id", F.col("over").alias("node"), "name"), ["rec_id", "node"]).select("rec_id", "node", F.lit(-1).alias("depth"), "name", F.lit(0).alias("near"))
    named = above.join(around.union(holding), ["rec_id", "over"]).select("rec_id", "node", "depth", "name", "near").union(itself)
    nearest = named.groupBy("rec_id", "node").agg(F.max_by("name", F.struct("near", "depth")).alias("parent_id"))
    return notes.join(nearest, ["rec_id", "node"]).select("rec_id", "parent_id", F.col("id").alias("child_id"))


#: The scalar children that tell what an object is.
NAMES = ["note_id", "name", "base"]


def links(records: DataFrame) -> DataFrame:
    """(rec_id, parent_id, child_id): ``layer_links`` and ``note_links`` of records (rec_id, content); see ``shred`` for null and invalid ones.

    All come from one table of entities, the objects joined with their scalar children and pivoted.
    """
    nodes = shred(records).withColumn("scalar", F.when(F.col("label").isin(NAMES), F.col("scalar")))
    nodes = cut(nodes.where("kind <> 'scalar' or scalar is not null"))  # shredded once, without the texts
    objects = cut(entities(nodes, NAMES))
    held = holders(objects, nodes)
    return layer_links(held).union(note_links(objects, held)).distinct()


def tables(records: DataFrame) -> dict[str, DataFrame]:
    """The records as flat tables, each with the key (rec_id, node) and that of its parent.

    layers: name, type, base, data, target of each layer of ``_meta``. documents: the key of each document. notes: note_id, body, by,
    and parent, the node of the nearest note, document or layer around it. authors: who wrote a note, as text or as an object
    with ``user``. marks: the objects of each note's ``marks``, with layer, at and the note.
    """
    fields = ["note_id", "name", "type", "base", "data", "target", "body", "by", "user", "layer", "at"]
    nodes = cut(shred(records))
    objects = cut(entities(nodes, fields))
    meta = nodes.where("parent = 0 and label = '_meta'").select("rec_id", F.col("node").alias("parent"), (F.col("kind") == "array").alias("listed"))
    layers = objects.join(meta, ["rec_id", "parent"]).select("rec_id", "node", F.when(F.col("listed"), F.col("name")).otherwise(F.col("label")).alias("name"), "type", "base", "data", "target")
    documents = nodes.where("parent = 0 and label is not null and not startswith(label, '_') and kind <> 'scalar'").select("rec_id", "node", F.col("label").alias("doc_key"))
    notes = objects.where("note_id is not null").select("rec_id", "node", "up", "note_id", "body", "by")
    held = layers.select("rec_id", F.col("node").alias("parent")).union(documents.select("rec_id", F.col("node").alias("parent"))).union(notes.select("rec_id", F.col("node").alias("parent")))
    nearest = notes.select("rec_id", "node", F.explode("up").alias("parent")).join(held.distinct(), ["rec_id", "parent"]).groupBy("rec_id", "node").agg(F.max("parent").alias("parent"))
    notes = notes.drop("up").join(nearest, ["rec_id", "node"], "left")
    of_note = notes.select("rec_id", F.col("node").alias("note"))
    named = objects.where("label = 'by' and user is not null").select("rec_id", F.col("parent").alias("note"), F.col("user").alias("author")).join(of_note, ["rec_id", "note"])
    authors = notes.where("by is not null").select("rec_id", F.col("node").alias("note"), F.col("by").alias("author")).union(named)
    lists = nodes.where("label = 'marks'").select("rec_id", F.col("node").alias("parent"), F.col("parent").alias("note"))
    marks = objects.join(lists, ["rec_id", "parent"]).join(of_note, ["rec_id", "note"]).select("rec_id", "node", "note", "layer", "at")
    return {"layers": layers, "documents": documents, "notes": notes, "authors": authors, "marks": marks}
