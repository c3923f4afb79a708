import pytest
from hypothesis import given
from hypothesis import strategies as st

from graphloom.errors import OntologyError, UnknownKindError, ValidationError
from graphloom.model import EdgeKind, GraphDef, NodeKind, Ontology, closure, inverted, struct


def graph(relations=(), edges=None):
    nodes = [NodeKind(n, struct("name string")) for n in ("Thing", "Person", "Student", "Company", "Place")]
    edges = edges or [EdgeKind("knows", ("Person",), ("Person",)), EdgeKind("friend", ("Person",), ("Person",)), EdgeKind("knownBy", ("Person",), ("Person",))]
    return GraphDef("g", nodes, edges, relations)


def test_closures():
    g = graph([("Student", "subClassOf", "Person"), ("Person", "subClassOf", "Thing"), ("friend", "implies", "knows"), ("knows", "inverseOf", "knownBy"), ("Person", "disjointWith", "Company"), ("Person", "equivalentTo", "ex:Person"), ("a", "broader", "b"), ("c", "narrower", "a"), ("wheel", "partOf", "car"), ("city", "hasPart", "car")])
    o = g.ontology
    assert o.expand_sub_classes("Thing") == {"Thing", "Person", "Student"} and o.is_sub_class_of("Student", "Thing") and not o.is_sub_class_of("Thing", "Student")
    assert o.sub_class_component("Student") == {"Thing", "Person", "Student"}
    assert o.are_disjoint("Student", "Company") and o.are_disjoint("Company", "ex:Person") and not o.are_disjoint("Thing", "Company")
    assert o.resolve_iri("ex:Person") == "Person" and o.are_equivalent("ex:Person", "Person")
    assert o.is_narrower_than("a", "b") and o.is_broader_than("b", "a") and o.expand_broader("a") == {"a", "b", "c"}
    assert o.is_part_of("wheel", "city") and o.parts["city"] == {"car", "wheel"}
    assert g.expand_edges(["knows"], "implying") == (["friend", "knows"], []) and g.expand_edges(["knows"], "inverse") == (["knows"], ["knownBy"])
    assert g.expand_edges(["knows"], "all") == (["friend", "knows"], ["knownBy"]) and o.is_assignable_to_any("Student", ["Place", "Person"])


@pytest.mark.parametrize("relations", [
    [("Person", "subClassOf", "Thing"), ("Thing", "subClassOf", "Person")], [("knows", "inverseOf", "friend"), ("knows", "inverseOf", "knownBy")], [("Person", "likes", "Thing")],
    [("Person", "subClassOf", "Thing")] * 2, [("Student", "subClassOf", "Person"), ("Student", "subClassOf", "Company"), ("Person", "disjointWith", "Company")], [("knows", "implies", "nothing")],
])
def test_bad_ontologies(relations):
    with pytest.raises(OntologyError):
        graph(relations)


def test_bad_kinds():
    with pytest.raises(UnknownKindError):
        graph(edges=[EdgeKind("e", ("Nobody",), ("Person",))])
    with pytest.raises(ValidationError):
        graph(edges=[EdgeKind("e", ("Person",), ("Person",), cardinality="two")])
    with pytest.raises(OntologyError):
        graph([("at", "implies", "knows")], [EdgeKind("knows", ("Person",), ("Person",)), EdgeKind("at", ("Place",), ("Person",))])


names = st.sampled_from("abcdefg")


@given(st.lists(st.tuples(names, names), max_size=15))
def test_closure_laws(pairs):
    c = closure(pairs)
    assert all(b in c[a] for a, b in pairs)
    assert all(z in c[a] for a, known in c.items() for b in known for z in c.get(b, ()))
    assert {(a, b) for a, s in c.items() for b in s} == {(a, b) for b, s in inverted(c).items() for a in s}


def test_unknown_meta_edge():
    with pytest.raises(OntologyError):
        Ontology([("a", "nope", "b")], [], [])


def test_types():
    assert struct("a array<struct<x: int, y: map<string, double>>>, b variant").simpleString() == "struct<a:array<struct<x:int,y:map<string,double>>>,b:variant>"
    with pytest.raises(ValidationError):
        struct("a money")
