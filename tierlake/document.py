"""One document in plain Python: decoding of layer values, and the layer algebra, for the driver and for tests.

A unit is (start, end, value) with positions in the base layer; a value is (rank, link, text) whose order is that of
values: nothing, texts, links, typed links.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from tierlake.errors import IndexingError, LayerNotFoundError, ModelError
from tierlake.meta import Catalog, LayerType

Value = tuple[int, int, str]
Unit = tuple[int, int, Value]
NOTHING: Value = (0, -1, "")


def value_of(x: Any) -> Value:
    """A value from a literal: None, text, link, or (link, text); a value stays as it is."""
    if x is None:
        return NOTHING
    if isinstance(x, str):
        return (1, -1, x)
    if isinstance(x, int) and not isinstance(x, bool) and x >= 0:
        return (2, x, "")
    if isinstance(x, (tuple, list)) and len(x) == 3 and x[0] in (0, 1, 2, 3) and isinstance(x[2], str):
        return tuple(x)
    if isinstance(x, (tuple, list)) and len(x) == 2 and isinstance(x[0], int) and isinstance(x[1], str):
        return (3, x[0], x[1])
    raise ModelError(f"{x!r} is no value of a layer")


def literal_of(v: Value) -> Any:
    """None, text, link or (link, text) of a value."""
    return (None, v[2], v[1], (v[1], v[2]))[v[0]]


def _position(x: Any) -> int:
    if isinstance(x, bool) or not isinstance(x, int) or not 0 <= x < 1 << 31:
        raise ModelError(f"{x!r} is no position")
    return x


def units_of(kind: LayerType, raw: Any, base_length: int | None) -> list[Unit]:
    """Units from the wire form, an array whose items are positions, texts or tuples of them; what they mean depends on the type. In a seq
    layer null is a unit without a value.

    ``base_length`` ends the last segment of a div layer; unknown, that segment ends where it starts.
    """
    if not isinstance(raw, list):
        raise ModelError(f"a {kind.value} layer is an array, not {type(raw).__name__}")
    out: list[Unit] = []
    for i, item in enumerate(raw):
        parts = [] if item is None and kind is LayerType.seq else item if isinstance(item, list) else [item]
        numbers = [_position(x) for x in parts if not isinstance(x, str)]
        texts = [x for x in parts if isinstance(x, str)]
        if len(texts) > 1 or (texts and parts[-1] is not texts[0]) or (not parts and item is not None) or len(numbers) > 3:
            raise ModelError(f"{item!r} is no unit")
        need = {LayerType.seq: 0, LayerType.div: 1, LayerType.element: 1, LayerType.span: 2}[kind]
        if len(numbers) == 3 and kind is not LayerType.span:  # the third number of a triple is a link in every type
            where, link = numbers[:2], numbers[2]
        elif need <= len(numbers) <= need + 1:
            where, link = numbers[:need], numbers[need] if len(numbers) > need else None
        else:
            raise ModelError(f"{item!r} is no unit of a {kind.value} layer")
        value = value_of((link, texts[0]) if texts and link is not None else texts[0] if texts else link)
        if kind is LayerType.seq:
            out.append((i, i + 1, value))
        elif kind is LayerType.span:
            out.append((where[0], where[1], value))
        else:
            out.append((where[0], where[0] + 1, value))
    if kind is LayerType.div:
        starts = [u[0] for u in out]
        if starts != sorted(starts):
            raise ModelError("the segments of a div layer rise")
        ends = [*starts[1:], max(base_length if base_length is not None else 0, starts[-1])] if out else []
        out = [(s, e, v) for (s, _, v), e in zip(out, ends)]
    return out


def wire_of(kind: LayerType, units: list[Unit]) -> list:
    """The wire form of units, the inverse of ``units_of``."""
    out: list[Any] = []
    for s, e, v in units:
        where = [] if kind is LayerType.seq else [s, e] if kind is LayerType.span else [s]
        tail = [[], [v[2]], [v[1]], [v[1], v[2]]][v[0]]
        whole = where + tail
        out.append(whole[0] if len(whole) == 1 else whole if whole else None)
    return out


class Document(Mapping[str, Any]):
    """The layers of one document by name: text of characters layers, units of others, any JSON value of ``_`` layers."""

    def __init__(self, catalog: Catalog, content: Mapping[str, Any]):
        self.catalog = catalog
        self._layers: dict[str, Any] = {}
        for name in content:
            if not name.startswith("_") and name not in catalog:
                raise ModelError(f"layer {name} isn't declared")
        for name in sorted((n for n in content if not n.startswith("_")), key=catalog.depth):
            self._set(name, content[name])
        for name in content:
            if name.startswith("_"):
                self._layers[name] = content[name]

    def _set(self, name: str, raw: Any) -> None:
        desc = self.catalog[name]
        if desc.layer_type is LayerType.characters:
            if not isinstance(raw, str):
                raise ModelError(f"layer {name} is text")
            self._layers[name] = raw
            return
        base = self._layers.get(desc.base) if desc.base else None
        length = None if base is None else len(base.encode()) if isinstance(base, str) else len(base)
        if isinstance(raw, list) and raw and all(isinstance(x, tuple) and len(x) == 3 and isinstance(x[2], tuple) for x in raw):
            self._layers[name] = list(raw)
            return
        self._layers[name] = units_of(desc.layer_type, [list(x) if isinstance(x, tuple) else x for x in raw] if isinstance(raw, (list, tuple)) else raw, length)

    def __getitem__(self, name: str) -> Any:
        return self._layers[name]

    def __iter__(self):
        return iter(self._layers)

    def __len__(self) -> int:
        return len(self._layers)

    def with_layers(self, content: Mapping[str, Any]) -> Document:
        """This document with some layers replaced or added."""
        return Document(self.catalog, {**self._layers, **content})

    def wire(self) -> dict[str, Any]:
        """The wire form of all layers, names sorted."""
        out = {}
        for name in sorted(self._layers):
            x = self._layers[name]
            out[name] = x if name.startswith("_") or isinstance(x, str) else wire_of(self.catalog[name].layer_type, x)
        return out

    def length(self, name: str) -> int:
        """Number of units; bytes of a characters layer; 0 of a ``_`` layer."""
        x = self._layers[name]
        return 0 if name.startswith("_") else len(x.encode()) if isinstance(x, str) else len(x)

    def characters(self, name: str) -> str | None:
        x = self._layers.get(name)
        return x if isinstance(x, str) and not name.startswith("_") else None

    def data(self, name: str) -> list[Value] | None:
        """The value of each unit; None if the document or the catalog lacks the layer."""
        if name not in self._layers:
            return None
        if name.startswith("_"):
            return []
        x = self._layers[name]
        return [NOTHING] * len(x.encode()) if isinstance(x, str) else [u[2] for u in x]

    def indexes(self, name: str, target: str, div_tail: str = "reference") -> list[tuple[int, int]]:
        """The (start, end) in ``target`` of each unit; bytes where the target is a characters layer.

        The last segment of a div layer over a further base ends with its first base unit (div_tail="reference") or with
        the base's end ("full").
        """
        if name not in self._layers:
            raise LayerNotFoundError(name)
        if target == name:
            return [(i, i + 1) for i in range(self.length(name))]
        desc = self.catalog[name]
        if desc.layer_type is LayerType.characters or not desc.base:
            raise IndexingError(f"{target} can't be reached from {name}")
        units, kind = self._layers[name], desc.layer_type
        if kind is LayerType.seq:
            return self.indexes(desc.base, target, div_tail)
        if target == desc.base:
            return [(s, e) for s, e, _ in units]
        below = self.indexes(desc.base, target, div_tail)
        out = []
        for k, (s, e, _) in enumerate(units):
            last = kind is LayerType.div and k + 1 == len(units)
            if e < 1 or s >= len(below) or (kind is LayerType.span and e > len(below)):
                raise IndexingError(f"unit ({s}, {e}) of {name} is outside {desc.base}")
            if kind is LayerType.span:
                out.append((below[s][0], below[e - 1][1]))
            elif kind is LayerType.element:
                out.append(below[s])
            elif last:
                out.append((below[s][0], below[s][1] if div_tail == "reference" else below[-1][1]))
            else:
                out.append((below[s][0], below[e][0]))
        return out

    def indexes_data(self, name: str, target: str, div_tail: str = "reference") -> list[tuple[int, int, Value]]:
        """``indexes`` and ``data`` side by side, as long as the shorter."""
        return [(s, e, v) for (s, e), v in zip(self.indexes(name, target, div_tail), self.data(name) or [])]

    def text(self, name: str, div_tail: str = "reference") -> list[str]:
        """The text under each unit; the whole text of a characters layer."""
        root = self.catalog.root(name)
        whole = self.characters(root)
        if whole is None:
            raise LayerNotFoundError(root)
        if root == name:
            return [whole]
        raw, out = whole.encode(), []
        for s, e in self.indexes(name, root, div_tail):
            if e > len(raw):
                raise IndexingError(f"({s}, {e}) is outside a text of {len(raw)} bytes")
            try:
                out.append(raw[s:e].decode())
            except UnicodeDecodeError:
                raise IndexingError(f"({s}, {e}) cuts a character") from None
        return out


def to_json(value: Any) -> str:
    """JSON without spaces, as the writers use it."""
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
