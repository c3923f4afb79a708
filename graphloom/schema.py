"""Schema versions: diffs with severities, extensions at run time, deprecation and removal of kinds."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import types as T

from .errors import SchemaMismatchError, ValidationError
from .model import EdgeKind, GraphDef, NodeKind
from .store import GraphStore

SAFE, WARNING, BREAKING = "safe", "warning", "breaking"


@dataclass(frozen=True)
class Change:
    severity: str
    what: str
    name: str
    detail: str = ""


def diff(old: GraphDef, new: GraphDef) -> list[Change]:
    """What changed between two definitions, and how bad that is for stored data."""
    out: list[Change] = []
    for what, a, b in (("node", old.nodes, new.nodes), ("edge", old.edges, new.edges)):
        for k in sorted(a.keys() - b.keys()):
            out.append(Change(BREAKING, what, k, "removed"))
        for k in sorted(b.keys() - a.keys()):
            out.append(Change(SAFE, what, k, "added"))
        for k in sorted(a.keys() & b.keys()):
            x, y = ({f.name: f for f in s.schema} for s in (a[k], b[k]))
            for f in sorted(x.keys() - y.keys()):
                out.append(Change(BREAKING, what, k, f"property {f} removed"))
            for f in sorted(y.keys() - x.keys()):
                out.append(Change(SAFE if y[f].nullable else BREAKING, what, k, f"property {f} added"))
            for f in sorted(x.keys() & y.keys()):
                if x[f].dataType != y[f].dataType:
                    wider = isinstance(x[f].dataType, T.NumericType) and isinstance(y[f].dataType, T.DoubleType)
                    out.append(Change(WARNING if wider else BREAKING, what, k, f"property {f}: {x[f].dataType.simpleString()} to {y[f].dataType.simpleString()}"))
            if what == "node":
                for u in b[k].unique:
                    if u not in a[k].unique:
                        out.append(Change(WARNING, what, k, f"unique {u.name} added"))
                for u in a[k].unique:
                    if u not in b[k].unique:
                        out.append(Change(SAFE, what, k, f"unique {u.name} removed"))
                if a[k].on_delete != b[k].on_delete:
                    out.append(Change(WARNING, what, k, f"on_delete: {b[k].on_delete}"))
            else:
                for side in ("from_kinds", "to_kinds"):
                    if lost := sorted(set(getattr(a[k], side)) - set(getattr(b[k], side))):
                        out.append(Change(BREAKING, what, k, f"{side} without {lost}"))
                if a[k].cardinality != b[k].cardinality:
                    out.append(Change(SAFE if b[k].cardinality == "many" else WARNING, what, k, f"cardinality: {b[k].cardinality}"))
    for r in sorted(set(old.ontology.relations) ^ set(new.ontology.relations)):
        out.append(Change(WARNING, "ontology", " ".join(r), "added" if r in new.ontology.relations else "removed"))
    return out


@dataclass
class Versions:
    """Definitions by version number, one of them active."""

    all: dict[int, GraphDef]
    active: int

    @classmethod
    def start(cls, graph: GraphDef) -> Versions:
        return cls({1: graph}, 1)

    def ensure(self, graph: GraphDef, allow_breaking: bool = False) -> list[Change]:
        """Makes the definition the active one: a new version if it differs; breaking changes need leave."""
        changes = diff(self.all[self.active], graph)
        if self.all[self.active].digest() == graph.digest():
            return []
        if not allow_breaking and any(c.severity == BREAKING for c in changes):
            raise SchemaMismatchError("; ".join(f"{c.what} {c.name}: {c.detail}" for c in changes if c.severity == BREAKING))
        self.active = max(self.all) + 1
        self.all[self.active] = graph
        return changes

    def rollback(self, version: int) -> GraphDef:
        if version not in self.all:
            raise SchemaMismatchError(f"no version {version}")
        self.active = version
        return self.all[version]


_TYPES = {"string": T.StringType(), "number": T.DoubleType(), "boolean": T.BooleanType(), "enum": T.StringType(), "date": T.TimestampType()}


def _type(p: dict[str, Any]) -> T.DataType:
    kind = p.get("type")
    if kind == "array":
        return T.ArrayType(_type(p["items"]))
    if kind == "object":
        return T.StructType([T.StructField(n, _type(q)) for n, q in p["properties"].items()])
    if kind not in _TYPES:
        raise ValidationError(f"property type {kind}")
    return _TYPES[kind]


def extend(graph: GraphDef, extension: dict[str, Any]) -> GraphDef:
    """The graph with the kinds of a JSON extension: {"nodes": {name: {"properties": {...}}}, "edges": {name: {"from", "to", "properties"}}, "ontology": [[a, meta, b]]}."""
    schema = lambda d: T.StructType([T.StructField(n, _type(p)) for n, p in d.get("properties", {}).items()])
    nodes = {k: NodeKind(k, schema(d), annotations=d.get("annotations", {})) for k, d in extension.get("nodes", {}).items()}
    edges = {k: EdgeKind(k, tuple(d["from"]), tuple(d["to"]), schema(d), d.get("cardinality", "many"), annotations=d.get("annotations", {})) for k, d in extension.get("edges", {}).items()}
    if taken := sorted((nodes.keys() & graph.nodes.keys()) | (edges.keys() & graph.edges.keys())):
        raise ValidationError(f"kinds {taken} are there already")
    return GraphDef(graph.name, [*graph.nodes.values(), *nodes.values()], [*graph.edges.values(), *edges.values()], [*graph.ontology.relations, *map(tuple, extension.get("ontology", []))], graph.fold_identity)


def deprecate(graph: GraphDef, kinds: list[str], value: bool = True) -> GraphDef:
    mark = lambda k: replace(k, deprecated=value) if k.name in kinds else k
    return GraphDef(graph.name, map(mark, graph.nodes.values()), map(mark, graph.edges.values()), graph.ontology.relations, graph.fold_identity)


def remove_kinds(store: GraphStore, kinds: list[str]) -> GraphStore:
    """The store without these kinds, their frames, and edge kinds that would lose an end altogether."""
    g, gone = store.graph, set(kinds)
    edges = []
    for e in g.edges.values():
        ends = [tuple(k for k in side if k not in gone) for side in (e.from_kinds, e.to_kinds)]
        if e.name in gone or not all(ends):
            gone.add(e.name)
        else:
            edges.append(replace(e, from_kinds=ends[0], to_kinds=ends[1]))
    graph = GraphDef(g.name, [k for k in g.nodes.values() if k.name not in gone], edges, [r for r in g.ontology.relations if not {r[0], r[2]} & gone], g.fold_identity)
    return GraphStore(store.spark, graph, {k: f for k, f in store.frames.items() if k not in gone}, {k: f for k, f in store.edge_frames.items() if k not in gone}, store.coordinate)
