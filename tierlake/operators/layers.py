"""The layer algebra as columns: positions, text and data of a layer, resolved through its bases within each row.

A layer over another is a positional join of the two; both are arrays of one row, so nothing is shuffled. A document
without the layer has null, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tierlake.errors import IndexingError, LayerNotFoundError
from tierlake.functions.values import let, literal
from tierlake.meta import Catalog, LayerType


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


class Layers:
    """Columns over documents whose layers ``catalog`` describes.

    div_tail: "reference" ends the last segment of a div layer over a further base with its first base unit, "full" with
    the base's end. bounds: "error" raises where a unit reaches past the text, "clip" ends it there.
    """

    def __init__(self, catalog: Catalog, div_tail: str = "reference", bounds: str = "error"):
        self.catalog, self.div_tail, self.bounds = catalog, div_tail, bounds

    def _spans(self, name: str, target: str) -> Column:
        """An array of structs with s and e; further fields may follow."""
        desc = self.catalog[name]
        kind, own = desc.layer_type, column(name)
        if target == name:
            n = F.octet_length(own) if kind is LayerType.characters else F.size(own)
            numbers = F.when(n == 0, F.expr("cast(array() as array<int>)")).otherwise(F.sequence(F.lit(0), n - 1))
            return F.when(own.isNotNull(), F.transform(numbers, lambda i: F.struct(i.alias("s"), (i + 1).alias("e"))))
        if kind is LayerType.characters or not desc.base:
            raise IndexingError(f"{target} can't be reached from {name}")
        self.catalog.reach(name, target)
        if kind is LayerType.seq:
            return F.when(own.isNotNull(), self._spans(desc.base, target))
        if target == desc.base:
            return own

        def across(below: Column) -> Column:
            start = lambda x: F.element_at(below, x["s"] + 1)["s"]
            if kind is LayerType.span:
                return F.transform(own, lambda x: F.struct(start(x).alias("s"), F.element_at(below, x["e"])["e"].alias("e")))
            if kind is LayerType.element:
                return F.transform(own, lambda x: F.struct(start(x).alias("s"), F.element_at(below, x["s"] + 1)["e"].alias("e")))
            tail = lambda x: F.element_at(below, x["s"] + 1)["e"] if self.div_tail == "reference" else F.element_at(below, -1)["e"]
            return F.transform(own, lambda x, i: F.struct(start(x).alias("s"), F.when(i == F.size(own) - 1, tail(x)).otherwise(F.element_at(below, x["e"] + 1)["s"]).alias("e")))

        return let(self._spans(desc.base, target), across)

    def indexes(self, name: str, target: str) -> Column:
        """array<struct<s, e>>: where each unit lies in ``target``; bytes where that is a characters layer."""
        found = self._spans(name, target)
        return F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))

    def text(self, name: str) -> Column:
        """array<string>: the text under each unit, cut by bytes; the whole text of a characters layer."""
        root = self.catalog.root(name)
        whole = column(root)
        if self.catalog[root].layer_type is not LayerType.characters:
            raise LayerNotFoundError(f"{name} stands on no characters layer")
        if root == name:
            return F.when(whole.isNotNull(), F.array(whole))
        spans = self._spans(name, root)

        def cut(raw: Column) -> Column:
            piece = lambda x: F.decode(F.substring(raw, x["s"] + 1, x["e"] - x["s"]), "UTF-8")
            if self.bounds == "clip":
                return F.transform(spans, piece)
            beyond = lambda x: F.raise_error(F.format_string("unit (%d, %d) reaches past the text", x["s"], x["e"]))
            return F.transform(spans, lambda x: F.when(x["e"] > F.octet_length(raw), beyond(x).cast("string")).otherwise(piece(x)))

        return F.when(whole.isNotNull(), let(F.encode(whole, "UTF-8"), cut))

    def data(self, name: str) -> Column:
        """array<value>: the value of each unit; nothing for each byte of a characters layer."""
        own = column(name)
        if self.catalog[name].layer_type is LayerType.characters:
            return F.when(own.isNotNull(), F.array_repeat(literal(None), F.octet_length(own)))
        return own["d"]

    def indexes_data(self, name: str, target: str) -> Column:
        """array<struct<s, e, d>>: positions and values side by side, as long as the shorter."""
        where, what = self.indexes(name, target), self.data(name)

        def zipped(w: Column) -> Column:
            n = F.least(F.size(w), F.size(what))
            return F.zip_with(F.slice(w, F.lit(1), n), F.slice(what, F.lit(1), n), lambda x, d: F.struct(x["s"].alias("s"), x["e"].alias("e"), d.alias("d")))

        return F.when(what.isNotNull(), let(where, zipped))

    def length(self, name: str) -> Column:
        """Number of units; bytes of a characters layer; null where the document lacks it."""
        own = column(name)
        return F.when(own.isNotNull(), F.octet_length(own) if self.catalog[name].layer_type is LayerType.characters else F.size(own))

    def linked_text(self, name: str) -> Column:
        """array<string>: the text of the unit of the target layer that each unit links to; null where it links to none."""
        target = self.catalog[name].target or self.catalog[name].base
        own = column(name)
        return let(self.text(target), lambda t: F.transform(own, lambda x: F.when(x["d"]["r"] >= 2, F.try_element_at(t, (x["d"]["l"] + 1).cast("int")))))

    def present(self, names: list[str]) -> Column:
        """array<string>: which of the layers the document has, in that order."""
        return F.array_compact(F.array(*[F.when(column(n).isNotNull(), F.lit(n)) for n in names]))
