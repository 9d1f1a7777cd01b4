"""Documents in wire form to rows of canonical units and back, in Arrow batches on the executors."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tierlake.document import Document, to_json
from tierlake.errors import FormatError
from tierlake.functions.values import UNITS
from tierlake.meta import Catalog, LayerType

_VALUE = pa.struct([("r", pa.int8()), ("l", pa.int64()), ("t", pa.string())])
_UNITS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("d", _VALUE)]))
#: Documents that a batch holds at once.
BATCH = 500


def schema(catalog: Catalog) -> str:
    """The columns of documents: doc_id, doc_pos, a column for each layer, and undeclared ``_`` layers as JSON in ``_extra``."""
    layers = [f"`{n}` {'string' if d.layer_type is LayerType.characters else UNITS}" for n, d in catalog.items()]
    return ", ".join(["doc_id string", "doc_pos bigint", *layers, "_extra map<string,string>"])


def row_of(doc: Document, doc_id: str | None, pos: int) -> dict[str, Any]:
    """One document as a row of ``schema``."""
    out: dict[str, Any] = {"doc_id": doc_id, "doc_pos": pos}
    for name, desc in doc.catalog.items():
        x = doc.get(name)
        if desc.layer_type is not LayerType.characters and x is not None:
            x = [{"s": s, "e": e, "d": {"r": v[0], "l": v[1], "t": v[2]}} for s, e, v in x]
        out[name] = x
    out["_extra"] = [(n, to_json(doc[n])) for n in doc if n.startswith("_")]
    return out


def document_of(row: Mapping[str, Any], catalog: Catalog) -> Document:
    """The document of a row, the inverse of ``row_of``."""
    content: dict[str, Any] = {}
    for name, desc in catalog.items():
        x = row[name]
        if x is not None:
            content[name] = x if desc.layer_type is LayerType.characters else [(u["s"], u["e"], (u["d"]["r"], u["d"]["l"], u["d"]["t"])) for u in x]
    extra = row["_extra"]
    for name, text in extra.items() if isinstance(extra, Mapping) else extra or ():
        content[name] = json.loads(text)
    return Document(catalog, content)


def arrow_schema(catalog: Catalog) -> pa.Schema:
    layers = [(n, pa.string() if d.layer_type is LayerType.characters else _UNITS) for n, d in catalog.items()]
    return pa.schema([("doc_id", pa.string()), ("doc_pos", pa.int64()), *layers, ("_extra", pa.map_(pa.string(), pa.string()))])


def from_objects(spark: SparkSession, docs: list[tuple[str | None, Mapping[str, Any]]], catalog: Catalog, first: int = 0) -> DataFrame:
    """Documents from a list on the driver (id or None, content), for small corpora and tests."""
    rows = [row_of(Document(catalog, c), i, first + k) for k, (i, c) in enumerate(docs)]
    for r in rows:
        r["_extra"] = dict(r["_extra"])
    return spark.createDataFrame(rows, StructType.fromDDL(schema(catalog)))


def from_json_lines(lines: DataFrame, catalog: Catalog) -> DataFrame:
    """Documents from rows (doc_id string, doc_pos bigint, json string), decoded in batches on the executors.

    Null and blank lines are left out; a line that isn't a JSON object or doesn't fit the catalog fails the job with its
    place.
    """
    columns = arrow_schema(catalog)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                rows = []
                for doc_id, pos, text in zip(*(c.to_pylist() for c in batch.slice(lo, BATCH).columns)):
                    if not text or text.isspace():
                        continue
                    try:
                        content = json.loads(text)
                    except ValueError as e:
                        raise FormatError(f"document {doc_id or pos}: {e}") from None
                    if not isinstance(content, dict):
                        raise FormatError(f"document {doc_id or pos} is no object")
                    rows.append(row_of(Document(catalog, content), doc_id, pos))
                yield pa.RecordBatch.from_pylist(rows, columns)

    return lines.select("doc_id", "doc_pos", "json").mapInArrow(run, schema(catalog))


def to_json_lines(docs: DataFrame, catalog: Catalog, form: Callable[[str, dict[str, Any]], str] = lambda _, wire: to_json(wire)) -> DataFrame:
    """(doc_id, doc_pos, json) of documents, names of layers sorted, the inverse of ``from_json_lines``; ``form`` writes (id, wire form) otherwise."""
    names = list(catalog)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                rows = batch.slice(lo, BATCH).to_pylist()
                out = [form(r["doc_id"], document_of(r, catalog).wire()) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([r["doc_id"] for r in rows], pa.string()), pa.array([r["doc_pos"] for r in rows], pa.int64()), pa.array(out, pa.string())], ["doc_id", "doc_pos", "json"])

    return docs.select(F.col("doc_id").cast("string"), "doc_pos", *[F.col(f"`{n}`") for n in names], "_extra").mapInArrow(run, "doc_id string, doc_pos bigint, json string")
