"""Layer descriptions and the catalog of a corpus: what its layers are and what they are based on."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field, replace
from enum import Enum
from typing import Any

from tierlake.errors import IndexingError, LayerNotFoundError, ModelError


class LayerType(str, Enum):
    """How the units of a layer refer to those of its base."""

    characters = "characters"
    seq = "seq"
    div = "div"
    element = "element"
    span = "span"

    @classmethod
    def of(cls, name: str | LayerType) -> LayerType:
        try:
            return cls(str(getattr(name, "value", name)).lower())
        except ValueError:
            raise ModelError(f"unknown layer type {name!r}") from None


#: A data type: "string", "link", or the values of an enumeration.
DataType = str | tuple[str, ...]


def data_type(value: Any) -> DataType | None:
    """A data type from its wire form: a list of words, the word link in any case, any other word as string, or None."""
    if value is None or isinstance(value, tuple):
        return value
    if isinstance(value, list) and all(isinstance(x, str) for x in value):
        return tuple(value)
    if isinstance(value, str):
        return "link" if value.lower() == "link" else "string"
    raise ModelError(f"unknown data type {value!r}")


@dataclass(frozen=True)
class LayerDesc:
    """One layer: its type, its base, its data, and what is only kept (link types, target, default, further keys)."""

    layer_type: LayerType
    base: str | None = None
    data: DataType | None = None
    link_types: tuple[str, ...] | None = None
    target: str | None = None
    default: Any = None
    meta: Mapping[str, Any] = field(default_factory=dict)

    @classmethod
    def from_dict(cls, desc: Mapping[str, Any]) -> LayerDesc:
        """From the wire form; keys that aren't known are kept in ``meta``."""
        known = dict(desc)
        if "type" not in known:
            raise ModelError("a layer description needs a type")
        kind, base, data = LayerType.of(known.pop("type")), known.pop("base", None), data_type(known.pop("data", None))
        links, target, default = known.pop("link_types", None), known.pop("target", None), known.pop("default", None)
        meta = {**(known.pop("meta", None) or {}), **known}
        return cls(kind, base or None, data, tuple(links) if links else None, target or None, default, meta)

    def to_dict(self, with_meta: bool = True) -> dict[str, Any]:
        """The wire form, absent fields left out."""
        data = list(self.data) if isinstance(self.data, tuple) else self.data
        out = {"type": self.layer_type.value, "base": self.base, "data": data, "link_types": list(self.link_types) if self.link_types else None, "target": self.target, "default": self.default}
        if with_meta and self.meta:
            out["meta"] = dict(self.meta)
        return {k: v for k, v in out.items() if v is not None}


class Catalog(Mapping[str, LayerDesc]):
    """The layer descriptions of a corpus by name; changes give a new catalog."""

    def __init__(self, layers: Mapping[str, LayerDesc] | None = None):
        self._layers = dict(layers or {})

    @classmethod
    def from_dict(cls, meta: Mapping[str, Any]) -> Catalog:
        return cls({name: LayerDesc.from_dict(d) for name, d in meta.items()})

    def to_dict(self, with_meta: bool = True) -> dict[str, Any]:
        """Wire form, names sorted."""
        return {name: self._layers[name].to_dict(with_meta) for name in sorted(self._layers)}

    def __getitem__(self, name: str) -> LayerDesc:
        try:
            return self._layers[name]
        except KeyError:
            raise LayerNotFoundError(name) from None

    def __contains__(self, name: object) -> bool:
        return name in self._layers

    def __iter__(self) -> Iterator[str]:
        return iter(self._layers)

    def __len__(self) -> int:
        return len(self._layers)

    def with_layer(self, name: str, desc: LayerDesc, strict: bool = True) -> Catalog:
        """This catalog and one layer more, or another description of one; ``strict`` demands a base of all but characters."""
        if name.startswith("_"):
            raise ModelError(f"{name}: names of layers don't start with an underscore")
        if strict and desc.layer_type is LayerType.characters and desc.base:
            raise ModelError(f"{name}: a characters layer has no base")
        if strict and desc.layer_type is not LayerType.characters and not desc.base:
            raise ModelError(f"{name}: a {desc.layer_type.value} layer needs a base")
        return Catalog({**self._layers, name: desc})

    def without(self, name: str) -> Catalog:
        return Catalog({k: v for k, v in self._layers.items() if k != name})

    def renamed_base(self, name: str, base: str) -> Catalog:
        return Catalog({**self._layers, name: replace(self[name], base=base)})

    def chain(self, name: str) -> list[str]:
        """The layer, its base, the base's base and so on; a cycle or an undeclared base is an error."""
        out = [name]
        while base := self[out[-1]].base:
            if base in out:
                raise ModelError(f"layers {', '.join(out)} are based on each other")
            out.append(base)
        return out

    def root(self, name: str) -> str:
        return self.chain(name)[-1]

    def depth(self, name: str) -> int:
        """0 of a layer without a base (or that isn't declared), else 1 more than its base's."""
        depth, seen = 0, {name}
        while name in self._layers and (base := self._layers[name].base):
            if base in seen:
                raise ModelError(f"layer {base} is based on itself")
            seen.add(base)
            name, depth = base, depth + 1
        return depth

    def characters(self) -> list[str]:
        return sorted(n for n, d in self._layers.items() if d.layer_type is LayerType.characters)

    def reach(self, name: str, target: str) -> None:
        """Raises unless ``target`` is the layer or one that it stands on."""
        if target not in self.chain(name):
            raise IndexingError(f"{target} can't be reached from {name}")


class LayerBuilder:
    """``corpus.build_layer(name).type("span").base("text").add()``; characters unless said otherwise."""

    def __init__(self, corpus: Any, name: str):
        self._corpus, self._name = corpus, name
        self._parts: dict[str, Any] = {"type": "characters"}

    def _with(self, key: str, value: Any) -> LayerBuilder:
        self._parts[key] = value
        return self

    def type(self, value: str | LayerType) -> LayerBuilder:
        return self._with("type", value)

    def base(self, value: str) -> LayerBuilder:
        return self._with("base", value)

    def data(self, value: Any) -> LayerBuilder:
        return self._with("data", value)

    def link_types(self, value: list[str]) -> LayerBuilder:
        return self._with("link_types", value)

    def target(self, value: str) -> LayerBuilder:
        return self._with("target", value)

    def default(self, value: Any) -> LayerBuilder:
        return self._with("default", value)

    def meta(self, key: str, value: Any) -> LayerBuilder:
        self._parts.setdefault("meta", {})[key] = value
        return self

    def add(self) -> None:
        self._corpus.set_layer(self._name, LayerDesc.from_dict(self._parts))
