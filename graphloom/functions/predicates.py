"""The predicate algebra: field references that become Columns over a kind's frame.

Three-valued logic is SQL's. A few predicates are no filters but searches (vector and full text) and
may only stand in the top conjunction; ``Predicate`` carries those beside its Column.
"""

from __future__ import annotations

import datetime as dt
import functools
import re
from collections.abc import Callable, Sequence
from contextvars import ContextVar
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError, UnsupportedPredicateError
from ..temporal import instant

BINDINGS: ContextVar[dict[str, Any] | None] = ContextVar("bindings", default=None)


@dataclass(frozen=True)
class Param:
    """A value given when a prepared query runs: a scalar, or the whole list of ``in_``."""

    name: str


def param(name: str) -> Param:
    if not re.fullmatch(r"[A-Za-z_]\w*", name) or name.startswith("__"):
        raise QueryError(f"not a parameter name: {name}")
    return Param(name)


def bound(value: Any) -> Any:
    if not isinstance(value, Param):
        return value
    given = BINDINGS.get()
    if given is None or value.name not in given:
        raise QueryError(f"no value for parameter {value.name}")
    return given[value.name]


@dataclass(frozen=True)
class Search:
    kind: str  # vector or fulltext
    field: str
    query: Any
    k: int
    metric: str = "cosine"
    min_score: float | None = None
    mode: str = "websearch"
    language: str | None = None


class Predicate:
    def __init__(self, column: Column | None, searches: tuple[Search, ...] = ()) -> None:
        self.column, self.searches = column, searches

    def and_(self, other: Predicate) -> Predicate:
        columns = [c for c in (self.column, other.column) if c is not None]
        return Predicate(functools.reduce(lambda a, b: a & b, columns) if columns else None, self.searches + other.searches)

    def or_(self, other: Predicate) -> Predicate:
        return Predicate(self._plain() | other._plain())

    def not_(self) -> Predicate:
        return Predicate(~self._plain())

    def _plain(self) -> Column:
        if self.searches or self.column is None:
            raise UnsupportedPredicateError("vector and full-text predicates can't stand under or/not")
        return self.column

    __and__, __or__, __invert__ = and_, or_, not_


def escape_like(text: str) -> str:
    return re.sub(r"([\\%_])", r"\\\1", text)


def pointer(path: str | Sequence[str | int]) -> list[str]:
    """Steps of an RFC 6901 pointer ("/a/b~1c") or of a sequence of keys."""
    if not isinstance(path, str):
        return [str(p) for p in path]
    if path == "":
        return []
    if not path.startswith("/") or re.search(r"~(?![01])", path):
        raise QueryError(f"not a JSON pointer: {path}")
    return [p.replace("~1", "/").replace("~0", "~") for p in path[1:].split("/")]


def variant_at(column: Column, steps: Sequence[str]) -> Column:
    """What a variant has at the steps; digits are an index of an array or a key of an object."""
    for s in steps:
        member = F.try_variant_get(column, "$['" + s.replace("\\", "\\\\").replace("'", "\\'") + "']", "variant")
        column = F.coalesce(F.try_variant_get(column, f"$[{int(s)}]", "variant"), member) if s.isdecimal() and len(s) < 10 else member
    return column


def _sql_type(value: Any) -> str:
    if isinstance(value, bool):
        return "boolean"
    return "double" if isinstance(value, (int, float)) else "timestamp" if isinstance(value, dt.datetime) else "string"


class Field:
    """A property or row column of a node or edge."""

    def __init__(self, column: Column, kind: T.DataType, name: str) -> None:
        self.column, self.kind, self.name = column, kind, name

    # Values
    def _scalar(self) -> None:
        if isinstance(self.kind, (T.ArrayType, T.StructType, T.MapType)):
            raise UnsupportedPredicateError(f"{self.name} is {self.kind.simpleString()}")

    def _lit(self, value: Any) -> Column:
        value = bound(value)
        if isinstance(self.kind, (T.TimestampType, T.TimestampNTZType)) and isinstance(value, str):
            value = instant(value)
        return F.lit(value)

    def _as(self, value: Any) -> Column:
        """The column; of a variant what is a scalar of the value's type in it."""
        return F.try_variant_get(self.column, "$", _sql_type(bound(value))) if isinstance(self.kind, T.VariantType) else self.column

    def _compare(self, value: Any, how: Callable[[Column, Column], Column]) -> Predicate:
        self._scalar()
        return Predicate(how(self._as(value), self._lit(value)))

    def eq(self, v: Any) -> Predicate:
        return self._compare(v, lambda a, b: a == b)

    def neq(self, v: Any) -> Predicate:
        return self._compare(v, lambda a, b: a != b)

    def gt(self, v: Any) -> Predicate:
        return self._compare(v, lambda a, b: a > b)

    def gte(self, v: Any) -> Predicate:
        return self._compare(v, lambda a, b: a >= b)

    def lt(self, v: Any) -> Predicate:
        return self._compare(v, lambda a, b: a < b)

    def lte(self, v: Any) -> Predicate:
        return self._compare(v, lambda a, b: a <= b)

    def between(self, low: Any, high: Any) -> Predicate:
        return self.gte(low) & self.lte(high)

    def _listed(self, values: Any) -> list[Any]:
        self._scalar()
        values = bound(values)
        values = [bound(v) for v in (values if isinstance(values, (list, tuple, set, frozenset)) else [values])]
        if len({_sql_type(v) for v in values if v is not None}) > 1:
            raise QueryError(f"values of several types for {self.name}")
        if isinstance(self.kind, (T.TimestampType, T.TimestampNTZType)):
            values = [instant(v) if isinstance(v, str) else v for v in values]
        return values

    def in_(self, values: Any) -> Predicate:
        values = self._listed(values)
        return Predicate(self._as(values[0]).isin(values) if values else F.lit(False))

    def not_in(self, values: Any) -> Predicate:
        values = self._listed(values)
        return Predicate(~self._as(values[0]).isin(values) if values else F.lit(True))

    def is_null(self) -> Predicate:
        return Predicate(F.try_variant_get(self.column, "$", "string").isNull() if isinstance(self.kind, T.VariantType) else self.column.isNull())

    def is_not_null(self) -> Predicate:
        return ~self.is_null()

    # Strings
    def _lower(self, value: Any) -> tuple[Column, Column]:
        if not isinstance(self.kind, (T.StringType, T.VariantType)):
            raise UnsupportedPredicateError(f"{self.name} is {self.kind.simpleString()}, not a string")
        return F.lower(self._as("")), F.lower(F.lit(bound(value)))

    def contains(self, value: Any) -> Predicate:
        """Strings: a part of it, case ignored. Arrays: an element (None: false)."""
        if isinstance(self.kind, T.ArrayType):
            value = bound(value)
            return Predicate(F.lit(False) if value is None else F.array_contains(self.column, self._element(value)))
        a, b = self._lower(value)
        return Predicate(a.contains(b))

    def starts_with(self, value: Any) -> Predicate:
        a, b = self._lower(value)
        return Predicate(a.startswith(b))

    def ends_with(self, value: Any) -> Predicate:
        a, b = self._lower(value)
        return Predicate(a.endswith(b))

    def like(self, pattern: Any) -> Predicate:
        self._lower(pattern)
        return Predicate(self._as("").like(bound(pattern)))

    def ilike(self, pattern: Any) -> Predicate:
        self._lower(pattern)
        return Predicate(self._as("").ilike(bound(pattern)))

    # Arrays
    def _array(self) -> T.DataType:
        if not isinstance(self.kind, T.ArrayType):
            raise UnsupportedPredicateError(f"{self.name} is {self.kind.simpleString()}, not an array")
        return self.kind.elementType

    def _element(self, value: Any) -> Column:
        return F.lit(value).cast(self._array())

    def contains_all(self, values: Any) -> Predicate:
        parts = [F.array_contains(self.column, self._element(v)) for v in bound(values)]
        return Predicate(functools.reduce(lambda a, b: a & b, parts) if parts else F.lit(True))

    def contains_any(self, values: Any) -> Predicate:
        values = list(bound(values))
        return Predicate(F.arrays_overlap(self.column, F.array(*[self._element(v) for v in values])) if values else F.lit(False))

    def is_empty(self) -> Predicate:
        self._array()
        return Predicate(self.column.isNull() | (F.array_size(self.column) == 0))

    def is_not_empty(self) -> Predicate:
        self._array()
        return Predicate(self.column.isNotNull() & (F.array_size(self.column) > 0))

    def _length(self, n: int, how: Callable[[Column, Column], Column]) -> Predicate:
        self._array()
        return Predicate(how(F.array_size(self.column), F.lit(bound(n))))

    def length_eq(self, n: int) -> Predicate:
        return self._length(n, lambda a, b: a == b)

    def length_gt(self, n: int) -> Predicate:
        return self._length(n, lambda a, b: a > b)

    def length_gte(self, n: int) -> Predicate:
        return self._length(n, lambda a, b: a >= b)

    def length_lt(self, n: int) -> Predicate:
        return self._length(n, lambda a, b: a < b)

    def length_lte(self, n: int) -> Predicate:
        return self._length(n, lambda a, b: a <= b)

    # Objects
    def _at(self, steps: Sequence[str]) -> tuple[Column, T.DataType]:
        column, kind = self.column, self.kind
        for i, s in enumerate(steps):
            if isinstance(kind, T.VariantType):
                return variant_at(column, steps[i:]), kind
            if isinstance(kind, T.StructType):
                if s not in kind.fieldNames():
                    raise QueryError(f"{self.name} has no field {s}")
                column, kind = column.getField(s), kind[s].dataType
            elif isinstance(kind, T.MapType):
                column, kind = F.try_element_at(column, F.lit(s)), kind.valueType
            elif isinstance(kind, T.ArrayType) and s.isdigit():
                column, kind = F.get(column, F.lit(int(s))), kind.elementType
            else:
                raise UnsupportedPredicateError(f"{self.name} has nothing at {s}")
        return column, kind

    def get(self, *keys: str) -> Field:
        column, kind = self._at([str(k) for k in keys])
        return Field(column, kind, f"{self.name}/{'/'.join(map(str, keys))}")

    def field(self, path: str | Sequence[str | int]) -> Field:
        return self.get(*pointer(path))

    def has_key(self, key: str) -> Predicate:
        return self.has_path([key])

    def has_path(self, path: str | Sequence[str | int]) -> Predicate:
        """Whether there is anything at the path; a JSON null is."""
        return Predicate(self._at(pointer(path))[0].isNotNull())

    def path_equals(self, path: str | Sequence[str | int], value: Any) -> Predicate:
        column, kind = self._at(pointer(path))
        if isinstance(kind, T.VariantType):
            column = F.try_variant_get(column, "$", _sql_type(bound(value)))
        elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
            raise UnsupportedPredicateError("path_equals compares scalars")
        return Predicate(column == F.lit(bound(value)))

    def path_contains(self, path: str | Sequence[str | int], value: Any) -> Predicate:
        column, kind = self._at(pointer(path))
        if isinstance(kind, T.VariantType):
            column = F.try_variant_get(column, "$", f"array<{_sql_type(bound(value))}>")
        return Predicate(F.array_contains(column, F.lit(bound(value))))

    def path_is_null(self, path: str | Sequence[str | int]) -> Predicate:
        """Nothing there, or a JSON null; never unknown."""
        column, kind = self._at(pointer(path))
        return Predicate(column.isNull() | F.is_variant_null(column) if isinstance(kind, T.VariantType) else column.isNull())

    def path_is_not_null(self, path: str | Sequence[str | int]) -> Predicate:
        return ~self.path_is_null(path)

    # Subqueries: one column of another query
    def _subquery(self, frame: DataFrame) -> Column:
        self._scalar()
        if len(frame.columns) != 1:
            raise QueryError("a subquery has exactly one column")
        kind = frame.schema[0].dataType
        number = lambda t: isinstance(t, T.NumericType)
        if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)) or (type(kind) is not type(self.kind) and not (number(kind) and number(self.kind))):
            raise QueryError(f"{self.name} can't be compared with {kind.simpleString()}")
        return self.column.isin(frame)

    def in_subquery(self, query: Any) -> Predicate:
        return Predicate(self._subquery(query.to_df()))

    def not_in_subquery(self, query: Any) -> Predicate:
        return Predicate(~self._subquery(query.to_df()))

    # Searches
    def similar_to(self, vector: Sequence[float], k: int, metric: str | None = None, min_score: float | None = None) -> Predicate:
        return Predicate(None, (Search("vector", self.name, [float(x) for x in vector], k, metric or "", min_score),))


def exists(query: Any) -> Predicate:
    """Whether an (uncorrelated) query has any row."""
    return Predicate(query.to_df().exists())


def not_exists(query: Any) -> Predicate:
    return Predicate(~query.to_df().exists())


class FullText:
    def matches(self, query: str, k: int, mode: str = "websearch", min_score: float | None = None, language: str | None = None) -> Predicate:
        return Predicate(None, (Search("fulltext", "", query, k, "", min_score, mode, language),))


ROW_FIELDS = {
    "id": T.StringType(), "kind": T.StringType(), "version": T.IntegerType(), "valid_from": T.TimestampType(), "valid_to": T.TimestampType(),
    "created_at": T.TimestampType(), "updated_at": T.TimestampType(), "deleted_at": T.TimestampType(),
}


class Ref:
    """Fields of a node or edge by attribute; a property that shares a row column's name is ``prop(name)``."""

    def __init__(self, schema: T.StructType, prefix: str = "") -> None:
        self._schema, self._prefix = schema, prefix

    def prop(self, name: str) -> Field:
        if name not in self._schema.fieldNames():
            raise QueryError(f"no property {name}")
        return Field(F.col(f"{self._prefix}p__{name}"), self._schema[name].dataType, name)

    @property
    def fulltext(self) -> FullText:
        return FullText()

    def __getattr__(self, name: str) -> Field:
        if name in ROW_FIELDS or name in ("from_id", "from_kind", "to_id", "to_kind"):
            return Field(F.col(f"{self._prefix}{name}"), ROW_FIELDS.get(name, T.StringType()), name)
        return self.prop(name)
