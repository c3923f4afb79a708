"""Graph definitions: node and edge kinds, their schemas and constraints, and the ontology between kinds.

All of this is as large as the schema, not the data, so closures are plain dictionaries on the driver.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

from .errors import OntologyError, UnknownKindError, ValidationError

META_EDGES = (
    "subClassOf", "broader", "narrower", "relatedTo", "equivalentTo", "sameAs", "differentFrom", "disjointWith", "partOf", "hasPart", "inverseOf", "implies",
)
SYMMETRIC = {"relatedTo", "equivalentTo", "sameAs", "differentFrom", "disjointWith", "inverseOf"}
CARDINALITIES = ("many", "one", "unique", "oneActive")
ENDPOINT_EXISTENCE = ("notDeleted", "currentlyValid", "ever")


@dataclass(frozen=True)
class Unique:
    name: str
    fields: tuple[str, ...]
    scope: str = "kind"  # or kindWithSubClasses
    collation: str = "binary"  # or caseInsensitive
    where_not_null: tuple[str, ...] = ()


@dataclass(frozen=True)
class NodeKind:
    name: str
    schema: T.StructType
    unique: tuple[Unique, ...] = ()
    on_delete: str = "restrict"  # cascade and disconnect delete the edges too
    searchable: tuple[str, ...] = ()
    embeddings: Mapping[str, str] = field(default_factory=dict)  # field: default metric
    annotations: Mapping[str, Any] = field(default_factory=dict)
    deprecated: bool = False
    language: str = "simple"  # of searchable properties


@dataclass(frozen=True)
class EdgeKind:
    name: str
    from_kinds: tuple[str, ...]
    to_kinds: tuple[str, ...]
    schema: T.StructType = T.StructType()
    cardinality: str = "many"
    endpoint_existence: str = "notDeleted"
    annotations: Mapping[str, Any] = field(default_factory=dict)
    deprecated: bool = False


_ATOMS = {
    "string": T.StringType(), "double": T.DoubleType(), "float": T.FloatType(), "int": T.IntegerType(), "bigint": T.LongType(), "long": T.LongType(),
    "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "date": T.DateType(), "variant": T.VariantType(),
}


def _parts(text: str) -> list[str]:
    """What commas outside of angle brackets part."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [p.strip() for p in out if p.strip()]


def data_type(text: str) -> T.DataType:
    """A type from DDL such as ``array<struct<a: int>>``, without a session."""
    text = text.strip()
    name, _, inner = text.partition("<")
    inner = inner[:-1]
    if name == "array":
        return T.ArrayType(data_type(inner))
    if name == "map":
        return T.MapType(*map(data_type, _parts(inner)))
    if name == "struct":
        return T.StructType([T.StructField(n.strip(), data_type(t)) for n, t in (p.split(":", 1) for p in _parts(inner))])
    if text not in _ATOMS:
        raise ValidationError(f"type {text}")
    return _ATOMS[text]


def struct(ddl: str) -> T.StructType:
    """Schema of properties from DDL, such as ``"name string, tags array<string>"``."""
    return T.StructType([T.StructField(n, data_type(t)) for n, t in (p.split(None, 1) for p in _parts(ddl))])


def closure(pairs: Iterable[tuple[str, str]]) -> dict[str, set[str]]:
    """What each name reaches over one or more pairs."""
    out: dict[str, set[str]] = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    moved = True
    while moved:
        moved = False
        for a, known in out.items():
            more = set().union(*(out.get(b, set()) for b in known)) - known
            if more:
                known |= more
                moved = True
    return out


def inverted(relation: Mapping[str, set[str]]) -> dict[str, set[str]]:
    out: dict[str, set[str]] = {}
    for a, bs in relation.items():
        for b in bs:
            out.setdefault(b, set()).add(a)
    return out


class Ontology:
    """Closures over the meta edges between kinds. Ends may be kinds of the graph or external IRIs."""

    def __init__(self, relations: Iterable[tuple[str, str, str]], nodes: Iterable[str], edges: Iterable[str]) -> None:
        self.relations = tuple(relations)
        self.nodes, self.edges = frozenset(nodes), frozenset(edges)
        by: dict[str, list[tuple[str, str]]] = {m: [] for m in META_EDGES}
        for a, meta, b in self.relations:
            if meta not in by:
                raise OntologyError(f"unknown meta edge {meta}")
            by[meta].append((a, b))
        self._validate(by)
        both = lambda m: [*by[m], *((b, a) for a, b in by[m])]
        self.ancestors = closure(by["subClassOf"])
        self.descendants = inverted(self.ancestors)
        self.broader = closure([*by["broader"], *((b, a) for a, b in by["narrower"])])
        self.narrower = inverted(self.broader)
        self.equivalents = {a: s - {a} for a, s in closure([*both("equivalentTo"), *both("sameAs")]).items()}
        self.related = closure_of_one(both("relatedTo"))
        self.wholes = closure([*by["partOf"], *((b, a) for a, b in by["hasPart"])])
        self.parts = inverted(self.wholes)
        self.implied = closure(by["implies"])
        self.implying = inverted(self.implied)
        self.inverse = {a: b for a, b in both("inverseOf")}
        self.different = closure_of_one(both("differentFrom"))
        spread: set[tuple[str, str]] = set()
        for a, b in by["disjointWith"]:
            for x in self._extent(a):
                for y in self._extent(b):
                    if x != y:
                        spread |= {(x, y), (y, x)}
        self.disjoint = closure_of_one(spread)
        for kind, others in self.disjoint.items():
            for other in others:
                common = (self.expand_sub_classes(kind) & self.expand_sub_classes(other)) - {kind, other}
                if common or other in self.ancestors.get(kind, ()):
                    raise OntologyError(f"{kind} and {other} are disjoint, and {sorted(common) or kind} would be both")

    def _extent(self, kind: str) -> set[str]:
        same = {kind} | self.equivalents.get(kind, set())
        return set().union(*(self.expand_sub_classes(k) for k in same))

    def _validate(self, by: dict[str, list[tuple[str, str]]]) -> None:
        if len(set(self.relations)) != len(self.relations):
            raise OntologyError("a relation is declared twice")
        for meta in ("subClassOf", "broader", "partOf", "implies"):
            loops = [a for a, known in closure(by[meta]).items() if a in known]
            if loops:
                raise OntologyError(f"{meta} has a cycle through {sorted(loops)}")
        inverses: dict[str, set[str]] = {}
        for a, b in by["inverseOf"]:
            inverses.setdefault(a, set()).add(b)
            inverses.setdefault(b, set()).add(a)
        if many := [a for a, s in inverses.items() if len(s) > 1]:
            raise OntologyError(f"{sorted(many)} have more than one inverse")
        for meta in ("implies", "inverseOf"):
            for pair in by[meta]:
                if unknown := [x for x in pair if x not in self.edges]:
                    raise OntologyError(f"{meta} names unknown edge kinds {unknown}")

    # Subclasses
    def expand_sub_classes(self, kind: str) -> set[str]:
        return {kind} | self.descendants.get(kind, set())

    def is_sub_class_of(self, a: str, b: str) -> bool:
        return a == b or b in self.ancestors.get(a, ())

    def sub_class_component(self, kind: str) -> set[str]:
        """All kinds tied to this one by subclass relations in any direction."""
        pairs = [(a, b) for a, s in self.ancestors.items() for b in s]
        return {kind} | closure([*pairs, *((b, a) for a, b in pairs)]).get(kind, set())

    # Concepts
    def is_narrower_than(self, a: str, b: str) -> bool:
        return b in self.broader.get(a, ())

    def is_broader_than(self, a: str, b: str) -> bool:
        return a in self.broader.get(b, ())

    def expand_narrower(self, kind: str) -> set[str]:
        return {kind} | self.narrower.get(kind, set())

    def expand_broader(self, kind: str) -> set[str]:
        return {kind} | self.broader.get(kind, set())

    # Equivalence
    def are_equivalent(self, a: str, b: str) -> bool:
        return a == b or b in self.equivalents.get(a, ())

    def resolve_iri(self, iri: str) -> str | None:
        """The kind of this graph that is the IRI's equivalent, the first by name."""
        return min((k for k in {iri} | self.equivalents.get(iri, set()) if k in self.nodes), default=None)

    def are_disjoint(self, a: str, b: str) -> bool:
        return b in self.disjoint.get(a, ())

    def disjoint_pairs(self) -> list[tuple[str, str]]:
        return sorted((a, b) for a, s in self.disjoint.items() for b in s if a < b)

    # Parts
    def is_part_of(self, a: str, b: str) -> bool:
        return b in self.wholes.get(a, ())

    # Edges
    def expand_implying_edges(self, kind: str) -> set[str]:
        return {kind} | self.implying.get(kind, set())

    def is_assignable_to(self, kind: str, target: str) -> bool:
        return self.is_sub_class_of(kind, target)

    def is_assignable_to_any(self, kind: str, targets: Iterable[str]) -> bool:
        return any(self.is_assignable_to(kind, t) for t in targets)


def closure_of_one(pairs: Iterable[tuple[str, str]]) -> dict[str, set[str]]:
    """Pairs as a dictionary, without transitive ones."""
    out: dict[str, set[str]] = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    return out


class GraphDef:
    """A graph: its kinds by name and the ontology between them."""

    def __init__(self, name: str, nodes: Iterable[NodeKind], edges: Iterable[EdgeKind], ontology: Iterable[tuple[str, str, str]] = (), fold_identity: bool = False) -> None:
        self.name, self.fold_identity = name, fold_identity
        self.nodes = {k.name: k for k in nodes}
        self.edges = {k.name: k for k in edges}
        self.ontology = Ontology(ontology, self.nodes, self.edges)
        for e in self.edges.values():
            if e.cardinality not in CARDINALITIES or e.endpoint_existence not in ENDPOINT_EXISTENCE:
                raise ValidationError(f"edge kind {e.name}: {e.cardinality}, {e.endpoint_existence}")
            for k in (*e.from_kinds, *e.to_kinds):
                self.node(k)
        for a, meta, b in self.ontology.relations:
            if meta == "implies":
                one, two = self.edges[a], self.edges[b]
                for own, other in ((one.from_kinds, two.from_kinds), (one.to_kinds, two.to_kinds)):
                    if not all(self.ontology.is_assignable_to_any(k, other) for k in own):
                        raise OntologyError(f"{a} implies {b}, but its ends {own} aren't {other}")

    def node(self, kind: str) -> NodeKind:
        if kind not in self.nodes:
            raise UnknownKindError(f"no node kind {kind}")
        return self.nodes[kind]

    def edge(self, kind: str) -> EdgeKind:
        if kind not in self.edges:
            raise UnknownKindError(f"no edge kind {kind}")
        return self.edges[kind]

    def node_kinds(self, kind: str, sub_classes: bool = False) -> list[str]:
        self.node(kind)
        return sorted(k for k in self.ontology.expand_sub_classes(kind) if k in self.nodes) if sub_classes else [kind]

    def expand_edges(self, kinds: Iterable[str], expand: str) -> tuple[list[str], list[str]]:
        """Edge kinds to follow as given, and those to follow against their direction."""
        if expand not in ("none", "implying", "inverse", "all"):
            raise ValidationError(f"expand: {expand}")
        direct, back = set(kinds), set()
        for k in direct:
            self.edge(k)
        if expand in ("implying", "all"):
            direct = set().union(*(self.ontology.expand_implying_edges(k) for k in direct))
        if expand in ("inverse", "all"):
            back = {self.ontology.inverse[k] for k in direct if k in self.ontology.inverse}
        return sorted(direct), sorted(back)

    def document(self) -> dict:
        """The schema as JSON-ready data, in a canonical order."""
        return {
            "name": self.name,
            "nodes": {n: {"schema": k.schema.jsonValue(), "unique": [u.__dict__ for u in k.unique], "onDelete": k.on_delete, "searchable": list(k.searchable), "language": k.language, "embeddings": dict(k.embeddings), "annotations": dict(k.annotations), "deprecated": k.deprecated} for n, k in sorted(self.nodes.items())},
            "edges": {n: {"from": sorted(k.from_kinds), "to": sorted(k.to_kinds), "schema": k.schema.jsonValue(), "cardinality": k.cardinality, "endpointExistence": k.endpoint_existence, "annotations": dict(k.annotations), "deprecated": k.deprecated} for n, k in sorted(self.edges.items())},
            "ontology": sorted(self.ontology.relations),
        }

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(self.document(), sort_keys=True, default=list).encode()).hexdigest()
