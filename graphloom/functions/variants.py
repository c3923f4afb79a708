"""Changes within JSON values (variants), as Columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError

_MEMBERS = "map<string,variant>"


def _members(doc: Column) -> Column:
    """The members of an object; none where the value is null or no object."""
    return F.coalesce(doc.try_cast(_MEMBERS), F.create_map().cast(_MEMBERS))


def _without(members: Column, name: str) -> Column:
    return F.map_filter(members, lambda k, _: k != name)


def set_path(doc: Column, path: Sequence[str], value: Column) -> Column:
    """The variant with ``value`` (any type) at a path of member names. What is no object on the way becomes one; a null value is a JSON null."""
    if not path:
        raise QueryError("a path has one name at least")
    own, name = _members(doc), path[0]
    if len(path) > 1:
        inner = set_path(F.try_element_at(own, F.lit(name)), path[1:], value)
    else:
        inner = F.coalesce(value.cast("variant"), F.parse_json(F.lit("null")))
    return F.to_variant_object(F.map_concat(_without(own, name), F.create_map(F.lit(name), inner)))


def unset_path(doc: Column, path: Sequence[str]) -> Column:
    """The variant without the member at a path; as it is where there is none."""
    if not path:
        raise QueryError("a path has one name at least")
    own, name = _members(doc), path[0]
    if len(path) == 1:
        changed = F.to_variant_object(_without(own, name))
    else:
        inner = unset_path(F.try_element_at(own, F.lit(name)), path[1:])
        changed = F.to_variant_object(F.map_concat(_without(own, name), F.create_map(F.lit(name), inner)))
    return F.when(F.map_contains_key(own, name), changed).otherwise(doc)
