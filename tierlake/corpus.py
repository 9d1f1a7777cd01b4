"""A corpus: a catalog of layers, documents as a DataFrame, and inverted indexes."""

from __future__ import annotations

import io
from collections.abc import Iterator, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tierlake.document import Document
from tierlake.errors import DocumentNotFoundError, LayerNotFoundError, ModelError
from tierlake.meta import Catalog, LayerBuilder, LayerDesc
from tierlake.operators import frequency, ids, mutate
from tierlake.operators.layers import Layers
from tierlake.operators.predicates import Query, from_dict, from_kwargs
from tierlake.operators.render import render
from tierlake.plans import planner
from tierlake.plans.shared import cut
from tierlake.sources import files, ingest


#: Changes after which the plans of a corpus are cut.
CUT_EVERY = 16


class DocumentBuilder:
    """``corpus.build_doc().layer("text", "...").add()``."""

    def __init__(self, corpus: Corpus):
        self._corpus, self._content = corpus, {}

    def layer(self, name: str, value: Any) -> DocumentBuilder:
        self._content[name] = value
        return self

    def add(self) -> str:
        return self._corpus.add_doc(self._content)


class Corpus:
    """Methods that change a corpus replace its frames by new ones; nothing is changed in place, and reads stay lazy.

    Each call that changes documents runs jobs of its own and adds to the plan, which is cut every CUT_EVERY calls: they are
    for editing by hand. ``operators.mutate`` changes any number of documents in one go.
    """

    def __init__(self, spark: SparkSession, catalog: Catalog | Mapping[str, Any] | None = None, docs: DataFrame | None = None, indexes: Mapping[str, DataFrame] | None = None):
        self.spark = spark
        self.catalog = catalog if isinstance(catalog, Catalog) else Catalog.from_dict(catalog or {})
        self.docs = docs if docs is not None else spark.createDataFrame([], StructType.fromDDL(ingest.schema(self.catalog)))
        self.indexes: dict[str, DataFrame] = dict(indexes or {})
        self._changes = 0

    # reading and writing

    @classmethod
    def read(cls, spark: SparkSession, path: str, **options: Any) -> Corpus:
        """From a file or store of any format; see ``files.read_file``."""
        if (options.get("kind") or files.guess_format(path)) == "store":
            return cls(spark, *files.read_store(spark, path))
        return cls(spark, *files.read_file(spark, path, **options))

    @classmethod
    def read_string(cls, spark: SparkSession, text: str, kind: str = "yaml", **options: Any) -> Corpus:
        return cls(spark, *files.read_string(spark, text, kind, **options))

    @classmethod
    def read_url(cls, spark: SparkSession, url: str, **options: Any) -> Corpus:
        return cls(spark, *files.read_url(spark, url, **options))

    def write(self, path: str, kind: str | None = None) -> None:
        """To a file or store; without ``kind`` by suffix, a path without one is a store."""
        kind = kind or (files.guess_format(path) if "." in path.rsplit("/", 1)[-1] else "store")
        if kind == "store":
            files.write_store(self.docs, self.catalog, path, self.indexes)
        elif kind == "jsonl":
            files.write_jsonl(self.docs, self.catalog, path)
        elif kind == "binary":
            from tierlake.sources import binary

            binary.write_file(self.docs, self.catalog, path)
        else:
            (files.write_json_file if kind == "json" else files.write_yaml_file)(self.docs, self.catalog, path)

    def to_json(self, out: Any) -> None:
        files.write_json(self.docs, self.catalog, out)

    def to_yaml(self, out: Any) -> None:
        files.write_yaml(self.docs, self.catalog, out)

    def to_json_str(self) -> str:
        self.to_json(out := io.StringIO())
        return out.getvalue()

    def to_yaml_str(self) -> str:
        self.to_yaml(out := io.StringIO())
        return out.getvalue()

    # layers

    @property
    def meta(self) -> dict[str, LayerDesc]:
        return dict(self.catalog)

    @meta.setter
    def meta(self, value: Mapping[str, Any]) -> None:
        new = value if isinstance(value, Catalog) else Catalog({n: d if isinstance(d, LayerDesc) else LayerDesc.from_dict(d) for n, d in value.items()})
        self.catalog = new
        self._fit()

    def add_layer_meta(self, name: str, layer_type: str = "characters", base: str | None = None, data: Any = None, link_types: list[str] | None = None, target: str | None = None, default: Any = None, meta: Mapping[str, Any] | None = None) -> None:
        """Declares a layer; documents that are there have none of it."""
        self.set_layer(name, LayerDesc.from_dict({"type": layer_type, "base": base, "data": data, "link_types": link_types, "target": target, "default": default, "meta": dict(meta or {})}))

    def set_layer(self, name: str, desc: LayerDesc) -> None:
        self.catalog = self.catalog.with_layer(name, desc)
        self._fit()

    def build_layer(self, name: str) -> LayerBuilder:
        return LayerBuilder(self, name)

    def _fit(self) -> None:
        """Gives the documents a column for each declared layer."""
        want = StructType.fromDDL(ingest.schema(self.catalog))
        have = set(self.docs.columns)
        self.docs = self.docs.select(*[F.col(f"`{f.name}`") if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in want])

    @property
    def layers(self) -> Layers:
        return Layers(self.catalog)

    # documents

    @property
    def order(self) -> list[str]:
        return [r[0] for r in self.docs.select("doc_id", "doc_pos").orderBy("doc_pos").select("doc_id").collect()]

    @order.setter
    def order(self, value: list[str]) -> None:
        places = self.spark.createDataFrame([(x, i) for i, x in enumerate(value)], "doc_id string, pos bigint")
        self.docs = mutate.reorder(self.docs, places)
        self._fit()

    get_docs = property(lambda self: self.order)

    def __iter__(self) -> Iterator[tuple[str, Document]]:
        """(id, document) of all documents in order, fetched partition by partition."""
        for r in self.docs.orderBy("doc_pos").toLocalIterator():
            yield r["doc_id"], ingest.document_of(r.asDict(recursive=True), self.catalog)

    def build_doc(self) -> DocumentBuilder:
        return DocumentBuilder(self)

    def _changed(self, docs: DataFrame, touched: list[str]) -> None:
        self.docs = docs
        self._changes += 1
        if self._changes % CUT_EVERY == 0:
            self.docs = docs = cut(docs)
            self.indexes = {n: cut(i) for n, i in self.indexes.items()}
        if self.indexes:
            frame = self.spark.createDataFrame([(x,) for x in touched], "doc_id string")
            self.indexes = {n: planner.refresh(i, frame, docs, self.layers, n) for n, i in self.indexes.items()}

    def add_doc(self, content: Mapping[str, Any]) -> str:
        return self.add_docs([content])[0]

    def add_docs(self, contents: list[Mapping[str, Any]]) -> list[str]:
        """Adds documents in order; their ids. Undeclared layers and wrong shapes are ModelErrors, and nothing is added."""
        made = [Document(self.catalog, c) for c in contents]
        codes = [ids.code_of(d, self.catalog) for d in made]
        heads = sorted({c[: ids.SHORTEST] for c in codes})
        taken = {r[0] for r in self.docs.where(F.left("doc_id", F.lit(ids.SHORTEST)).isin(heads)).select("doc_id").collect()}
        last = self.docs.agg(F.max("doc_pos")).first()[0]
        first, out = 0 if last is None else last + 1, []
        for full in codes:
            out.append(ids.shortest_free(full, taken))
            taken.add(out[-1])
        new = ingest.from_objects(self.spark, list(zip(out, made)), self.catalog, first)
        self._changed(self.docs.unionByName(new), out)
        return out

    def _row(self, doc_id: str):
        row = self.docs.where(F.col("doc_id") == doc_id).head()
        if row is None:
            raise DocumentNotFoundError(doc_id)
        return row

    def get_doc_by_id(self, doc_id: str) -> Document:
        return ingest.document_of(self._row(doc_id).asDict(recursive=True), self.catalog)

    def update_doc(self, doc_id: str, content: Mapping[str, Any]) -> str:
        """Replaces the given layers of a document, which keeps its place; its id, which changes with its texts."""
        row = self._row(doc_id)
        doc = ingest.document_of(row.asDict(recursive=True), self.catalog).with_layers(content)
        full = ids.code_of(doc, self.catalog)
        taken = {r[0] for r in self.docs.where(F.col("doc_id").startswith(full[: ids.SHORTEST])).select("doc_id").collect()} - {doc_id}
        new_id = ids.shortest_free(full, taken)
        new = ingest.from_objects(self.spark, [(new_id, doc)], self.catalog, row["doc_pos"])
        self._changed(self.docs.where(F.col("doc_id") != doc_id).unionByName(new), [doc_id, new_id])
        return new_id

    def remove_doc(self, doc_id: str) -> None:
        """Removes a document; an id that isn't there changes nothing."""
        self._changed(self.docs.where(F.col("doc_id") != doc_id), [doc_id])

    # search, counts, indexes

    def query(self, query: Query | Mapping[str, Any] | None = None, **conditions: Any) -> Query:
        if query is None:
            return from_kwargs(self.layers, **conditions)
        if conditions:
            raise ModelError("give a query or conditions by layer, not both")
        return query if isinstance(query, Query) else from_dict(query)

    def search(self, query: Query | Mapping[str, Any] | None = None, **conditions: Any) -> DataFrame:
        """The matching documents; by index where that helps."""
        return planner.search(self.docs, Layers(self.catalog, bounds="clip"), self.query(query, **conditions), self.indexes)

    def search_ids(self, query: Query | Mapping[str, Any] | None = None, **conditions: Any) -> list[str]:
        return [r[0] for r in self.search(query, **conditions).select("doc_id", "doc_pos").orderBy("doc_pos").collect()]

    def estimate_query_count(self, query: Query | Mapping[str, Any] | None = None, **conditions: Any) -> int:
        return planner.estimate(self.docs, self.query(query, **conditions), self.indexes)

    def text_freq(self, layer: str, condition: Any = None, strict: bool = True) -> DataFrame:
        return frequency.text_freq(self.docs, self.layers, layer, condition, strict)

    def val_freq(self, layer: str, condition: Any = None) -> DataFrame:
        return frequency.val_freq(self.docs, self.layers, layer, condition)

    def create_index(self, layer: str) -> None:
        if layer not in self.catalog:
            raise LayerNotFoundError(layer)
        self.indexes[layer] = planner.kept(planner.create_index(self.docs, self.layers, layer))

    def drop_index(self, layer: str) -> None:
        self.indexes.pop(layer, None)

    def has_index(self, layer: str) -> bool:
        return layer in self.indexes

    def get_index(self, layer: str) -> DataFrame | None:
        return self.indexes.get(layer)

    def set_index(self, layer: str, index: DataFrame) -> None:
        """Installs an index made before: (value, doc_id, doc_pos)."""
        self.indexes[layer] = index

    def info(self) -> dict[str, Any]:
        return {"layers": len(self.catalog), "documents": self.docs.count(), "layer_names": sorted(self.catalog)}

    def show(self, doc_id: str | None = None, width: int = 80) -> str:
        """One document, or all in order, as aligned text."""
        if doc_id is not None:
            return render(doc_id, self.get_doc_by_id(doc_id), width)
        return "\n".join(render(i, doc, width) for i, doc in self)
