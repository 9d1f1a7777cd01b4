"""The search algebra: 16 predicates over documents, compiled to one boolean column.

Every condition on a layer holds if some unit of it meets it, negative ones too ("some unit is not v"). A document
without the layer meets no condition on it, so each is made total before ``Not`` turns it round.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tierlake.document import Document, Value, value_of
from tierlake.errors import ModelError, TierlakeError
from tierlake.functions.values import literal
from tierlake.operators.layers import Layers, column

#: Constructs that regular languages lack: look-around, back-references, atomic groups and possessive quantifiers.
_NOT_REGULAR = re.compile(r"\(\?(?:[=!>]|<[=!])|(?<!\\)(?:\\\\)*\\[1-9]|[*+?}]\+")


def checked(pattern: str) -> str:
    """The pattern for Spark, named groups rewritten; one that isn't regular or can't be compiled is a ModelError when the query is built."""
    if _NOT_REGULAR.search(pattern):
        raise ModelError(f"look-around and back-references aren't supported: {pattern!r}")
    try:
        re.compile(re.sub(r"\\[pP](\{[^}]*\}|\w)|\\[zZ]", "x", pattern))
    except re.error as e:
        raise ModelError(f"{pattern!r} is no pattern: {e}") from None
    return pattern.replace("(?P<", "(?<")


class Query:
    """A condition on documents. ``column`` compiles it, ``matches`` evaluates it on one document in Python."""

    def column(self, layers: Layers) -> Column:
        return F.coalesce(self._some(layers), F.lit(False))

    def _some(self, layers: Layers) -> Column:
        raise NotImplementedError

    def matches(self, doc: Document) -> bool:
        raise NotImplementedError

    def reads(self) -> set[str]:
        """The layers that the condition looks at."""
        parts = getattr(self, "queries", None) or ([self.query] if hasattr(self, "query") else [])
        return {self.layer} if hasattr(self, "layer") else set().union(*(q.reads() for q in parts))

    def __and__(self, other: Query) -> Query:
        return And((self, other))

    def __or__(self, other: Query) -> Query:
        return Or((self, other))

    def __invert__(self) -> Query:
        return Not(self)

    @staticmethod
    def from_dict(query: Mapping[str, Any]) -> Query:
        return from_dict(query)


@dataclass(frozen=True)
class _OnText(Query):
    layer: str
    text: str

    def __post_init__(self):
        object.__setattr__(self, "text", self._checked(self.text))

    def _checked(self, text: str) -> str:
        return text

    def _pieces(self, doc: Document) -> list[str]:
        try:
            return doc.text(self.layer)
        except TierlakeError:
            return []


@dataclass(frozen=True)
class _OnData(Query):
    layer: str
    value: Any

    def __post_init__(self):
        object.__setattr__(self, "value", value_of(self.value))

    def _values(self, doc: Document) -> list[Value]:
        return doc.data(self.layer) or []


class Text(_OnText):
    """Some piece of the layer's text is the text."""

    def _some(self, layers):
        return F.array_contains(layers.text(self.layer), self.text)

    def matches(self, doc):
        return self.text in self._pieces(doc)


class TextNot(_OnText):
    """Some piece of the layer's text isn't the text."""

    def _some(self, layers):
        return F.size(F.array_remove(layers.text(self.layer), self.text)) > 0

    def matches(self, doc):
        return any(x != self.text for x in self._pieces(doc))


class TextRegex(_OnText):
    """The pattern is found in some piece of the layer's text."""

    def _checked(self, text):
        return checked(text)

    def _some(self, layers):
        return F.exists(layers.text(self.layer), lambda t: t.rlike(self.text))

    def matches(self, doc):
        return any(re.search(self.text.replace("(?<", "(?P<"), x) for x in self._pieces(doc))


class Regex(_OnText):
    """The pattern is found in some value of the layer that is text."""

    def _checked(self, text):
        return checked(text)

    def _some(self, layers):
        return F.exists(layers.data(self.layer), lambda d: (d["r"] == 1) & d["t"].rlike(self.text))

    def matches(self, doc):
        return any(v[0] == 1 and re.search(self.text.replace("(?<", "(?P<"), v[2]) for v in doc.data(self.layer) or [])


class Value_(_OnData):
    """Some value of the layer is the value."""

    def _some(self, layers):
        return F.array_contains(layers.data(self.layer), literal(self.value))

    def matches(self, doc):
        return self.value in self._values(doc)


class ValueNot(_OnData):
    """Some value of the layer isn't the value."""

    def _some(self, layers):
        return F.size(F.array_remove(layers.data(self.layer), literal(self.value))) > 0

    def matches(self, doc):
        return any(v != self.value for v in self._values(doc))


class LessThan(_OnData):
    """Some value is less: nothing < texts < links < typed links."""

    def _some(self, layers):
        return F.array_min(layers.data(self.layer)) < literal(self.value)

    def matches(self, doc):
        return any(v < self.value for v in self._values(doc))


class LessThanEqual(_OnData):
    """Some value is less or equal."""

    def _some(self, layers):
        return F.array_min(layers.data(self.layer)) <= literal(self.value)

    def matches(self, doc):
        return any(v <= self.value for v in self._values(doc))


class GreaterThan(_OnData):
    """Some value is greater."""

    def _some(self, layers):
        return F.array_max(layers.data(self.layer)) > literal(self.value)

    def matches(self, doc):
        return any(v > self.value for v in self._values(doc))


class GreaterThanEqual(_OnData):
    """Some value is greater or equal."""

    def _some(self, layers):
        return F.array_max(layers.data(self.layer)) >= literal(self.value)

    def matches(self, doc):
        return any(v >= self.value for v in self._values(doc))


@dataclass(frozen=True)
class _OnSet(Query):
    layer: str
    values: tuple = field(default_factory=tuple)

    def __post_init__(self):
        object.__setattr__(self, "values", tuple(sorted({value_of(v) for v in self.values})))

    def _array(self) -> Column:
        return F.array(*[literal(v) for v in self.values])


class In(_OnSet):
    """Some value is among the values; never for no values."""

    def _some(self, layers):
        return F.arrays_overlap(layers.data(self.layer), self._array()) if self.values else F.lit(False)

    def matches(self, doc):
        return any(v in self.values for v in doc.data(self.layer) or [])


class NotIn(_OnSet):
    """Some value isn't among the values."""

    def _some(self, layers):
        data = layers.data(self.layer)
        return F.size(F.array_except(data, self._array())) > 0 if self.values else F.size(data) > 0

    def matches(self, doc):
        return any(v not in self.values for v in doc.data(self.layer) or [])


@dataclass(frozen=True)
class Exists(Query):
    """The document has the layer; names with an underscore look among the undeclared layers."""

    layer: str

    def _some(self, layers):
        if self.layer.startswith("_"):
            return F.map_contains_key(F.col("_extra"), self.layer)
        layers.catalog[self.layer]
        return column(self.layer).isNotNull()

    def matches(self, doc):
        return self.layer in doc


@dataclass(frozen=True)
class And(Query):
    """All conditions hold; true for none."""

    queries: tuple[Query, ...] = ()

    def __post_init__(self):
        object.__setattr__(self, "queries", tuple(self.queries))

    def column(self, layers):
        return reduce(Column.__and__, [q.column(layers) for q in self.queries], F.lit(True))

    def matches(self, doc):
        return all(q.matches(doc) for q in self.queries)


@dataclass(frozen=True)
class Or(Query):
    """Some condition holds; false for none."""

    queries: tuple[Query, ...] = ()

    def __post_init__(self):
        object.__setattr__(self, "queries", tuple(self.queries))

    def column(self, layers):
        return reduce(Column.__or__, [q.column(layers) for q in self.queries], F.lit(False))

    def matches(self, doc):
        return any(q.matches(doc) for q in self.queries)


@dataclass(frozen=True)
class Not(Query):
    """The condition doesn't hold."""

    query: Query

    def column(self, layers):
        return ~self.query.column(layers)

    def matches(self, doc):
        return not self.query.matches(doc)


class QueryBuilder:
    """Collects conditions that must all hold: ``QueryBuilder().value("pos", "VERB").text("words", "ideas").build()``."""

    def __init__(self):
        self._queries: list[Query] = []

    def _add(self, query: Query) -> QueryBuilder:
        self._queries.append(query)
        return self

    def text(self, layer: str, text: str) -> QueryBuilder:
        return self._add(Text(layer, text))

    def text_not(self, layer: str, text: str) -> QueryBuilder:
        return self._add(TextNot(layer, text))

    def value(self, layer: str, value: Any) -> QueryBuilder:
        return self._add(Value_(layer, value))

    def value_not(self, layer: str, value: Any) -> QueryBuilder:
        return self._add(ValueNot(layer, value))

    def less_than(self, layer: str, value: Any) -> QueryBuilder:
        return self._add(LessThan(layer, value))

    def less_than_equal(self, layer: str, value: Any) -> QueryBuilder:
        return self._add(LessThanEqual(layer, value))

    def greater_than(self, layer: str, value: Any) -> QueryBuilder:
        return self._add(GreaterThan(layer, value))

    def greater_than_equal(self, layer: str, value: Any) -> QueryBuilder:
        return self._add(GreaterThanEqual(layer, value))

    def in_(self, layer: str, values: Any) -> QueryBuilder:
        return self._add(In(layer, tuple(values)))

    def not_in(self, layer: str, values: Any) -> QueryBuilder:
        return self._add(NotIn(layer, tuple(values)))

    def regex(self, layer: str, pattern: str) -> QueryBuilder:
        return self._add(Regex(layer, pattern))

    def text_regex(self, layer: str, pattern: str) -> QueryBuilder:
        return self._add(TextRegex(layer, pattern))

    def and_(self, queries: list[Query]) -> QueryBuilder:
        return self._add(And(tuple(queries)))

    def or_(self, queries: list[Query]) -> QueryBuilder:
        return self._add(Or(tuple(queries)))

    def not_(self, query: Query) -> QueryBuilder:
        return self._add(Not(query))

    def exists(self, layer: str) -> QueryBuilder:
        return self._add(Exists(layer))

    def build(self) -> Query:
        return And(tuple(self._queries))


# The operators of the query language over dicts.
OPERATORS = {"$text": Text, "$text_ne": TextNot, "$eq": Value_, "$ne": ValueNot, "$lt": LessThan, "$lte": LessThanEqual, "$gt": GreaterThan, "$gte": GreaterThanEqual, "$in": In, "$nin": NotIn, "$regex": Regex, "$text_regex": TextRegex}


def _condition(layer: str, bound: Any) -> Query:
    if isinstance(bound, Mapping):
        if len(bound) != 1:
            raise ModelError(f"{layer}: one operator, not {len(bound)}")
        op, arg = next(iter(bound.items()))
        if op == "$exists":
            return Exists(layer) if arg is not False else Not(Exists(layer))
        if op not in OPERATORS:
            raise ModelError(f"{layer}: unknown operator {op}")
        kind = OPERATORS[op]
        if issubclass(kind, _OnSet):
            return kind(layer, tuple(tuple(x) if isinstance(x, list) else x for x in arg))
        return kind(layer, tuple(arg) if isinstance(arg, list) and issubclass(kind, _OnData) else arg)
    if isinstance(bound, (list, set)):
        return In(layer, tuple(bound))
    return Value_(layer, bound)


def from_dict(query: Mapping[str, Any]) -> Query:
    """A query from a dict: layers with a value, a list of values or one operator; $exists with a layer, $and, $or, $not at any depth.

    $and and $or take a list of queries or one map; $not takes a query or a list, of which it uses the first.
    """
    if not isinstance(query, Mapping):
        raise ModelError(f"{query!r} is no query")
    out: list[Query] = []
    for key, arg in query.items():
        if key in ("$and", "$or"):
            parts = [from_dict(q) for q in arg] if isinstance(arg, (list, tuple)) else [from_dict({k: v}) for k, v in arg.items()]
            out.append((And if key == "$and" else Or)(tuple(parts)))
        elif key == "$not":
            if isinstance(arg, (list, tuple)):
                if not arg:
                    raise ModelError("$not needs a query")
                arg = arg[0]
            out.append(Not(from_dict(arg)))
        elif key == "$exists":
            if not isinstance(arg, str):
                raise ModelError("$exists takes the name of a layer")
            out.append(Exists(arg))
        elif key.startswith("$"):
            raise ModelError(f"unknown operator {key}")
        else:
            out.append(_condition(key, arg))
    return out[0] if len(out) == 1 else And(tuple(out))


def from_kwargs(layers: Layers, **conditions: Any) -> Query:
    """Like ``from_dict``; a text for a layer without data is compared with the layer's text."""
    out = []
    for name, bound in conditions.items():
        plain = isinstance(bound, str) and not layers.catalog[name].data
        out.append(Text(name, bound) if plain else _condition(name, bound))
    return out[0] if len(out) == 1 else And(tuple(out))
