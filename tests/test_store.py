import datetime as dt

import pytest
from pyspark.sql import functions as F

from graphloom.errors import CardinalityError, CursorError, DisjointnessError, EndpointError, IdentityContradiction, ImportConflictError, InvalidEdgeWeightError, QueryError, RestrictedDeleteError, TemporalError, UniquenessError, UnsupportedPredicateError, ValidationError
from graphloom.functions.predicates import param, pointer
from graphloom.model import EdgeKind, GraphDef, NodeKind, Unique, struct
from graphloom.operators import merge as mg
from graphloom.operators import writes as wr
from graphloom.operators.algorithms import Algorithms
from graphloom.operators.identity import SCHEMA as ASSERTIONS
from graphloom.operators.identity import Identity
from graphloom.operators.provenance import Provenance
from graphloom.operators.search import StoreSearch
from graphloom.plans.query import avg, compose, count, count_edges, decode_cursor, limited, ordered_by, sum_
from graphloom.profiler import Hooks, Profiler
from graphloom.schema import Versions, deprecate, diff, extend, remove_kinds
from graphloom.sources import interchange
from graphloom.store import GraphStore
from graphloom.temporal import Coordinate, instant

NOW = dt.datetime(2024, 6, 1)


def definition(**how):
    return GraphDef(
        "people",
        [
            NodeKind("Person", struct("name string, age double, email string, active boolean"), (Unique("email", ("email",), collation="caseInsensitive", where_not_null=("email",)),), how.get("on_delete", "restrict")),
            NodeKind("Company", struct("name string, industry string")), NodeKind("Product", struct("name string, price double, category string, stock boolean, rating double")),
            NodeKind("Document", struct("title string, published timestamp, tags array<string>, scores array<double>, meta variant"), searchable=("title",)),
        ],
        [EdgeKind("knows", ("Person",), ("Person",), struct("since string, weight double")), EdgeKind("worksAt", ("Person",), ("Company",), struct("role string, salary double"), how.get("cardinality", "many"))],
        [("Person", "disjointWith", "Company"), *how.get("ontology", [])], how.get("fold", False),
    )


@pytest.fixture(scope="session")
def people(spark):
    person = [("hana", "Hana Ito", 41.0, "hana@mill.test", True), ("ivo", "Ivo Marek", 22.0, "ivo@mill.test", None), ("jun", "Jun Park", None, None, False), ("kira", "Kira Voss", 57.0, "kira@quay.test", True), ("lars", "Lars Holm", 33.0, None, True), ("mona", "Mona Reyes", 22.0, "mona@quay.test", False)]
    knows = [("k1", "hana", "kira", 4.0), ("k2", "hana", "ivo", 1.5), ("k3", "ivo", "lars", 1.0), ("k4", "lars", "kira", 0.5), ("k5", "kira", "mona", 2.0), ("k6", "mona", "jun", 1.0), ("k7", "ivo", "hana", 1.0)]
    works = [("c1", "hana", "mill", "carpenter", 31.0, None), ("c2", "kira", "quay", "pilot", 44.0, None), ("c3", "kira", "mill", "clerk", 12.0, dt.datetime(2022, 3, 1))]
    docs = [("log", "Harbour log", ["tide", "wind", "tide"], [0.5, 7.0], '{"keeper": "kira", "signed": null, "seal": {"wax": false}, "pages": [3, 5, 8], "7": 1}'), ("bill", "Bill of timber, harbour dues", [], None, '{"keeper": "hana"}'), ("song", "Quiet tide", None, [], None)]
    nodes = {
        "Person": spark.createDataFrame(person, "id string, name string, age double, email string, active boolean"),
        "Company": spark.createDataFrame([("mill", "Saw mill", "timber", None), ("quay", "Quay pilots", "harbour", dt.datetime(2021, 7, 1))], "id string, name string, industry string, valid_to timestamp"),
        "Product": spark.createDataFrame([("lamp", "Lamp", 45.0, "light", True, 3.5), ("bulb", "Bulb", 3.0, "light", True, None), ("rope", "Rope", 12.5, "deck", False, 4.75), ("bell", "Bell", 80.0, "deck", True, 4.25), ("oar", "Oar", 60.0, "deck", None, None)], "id string, name string, price double, category string, stock boolean, rating double"),
        "Document": spark.createDataFrame(docs, "id string, title string, tags array<string>, scores array<double>, m string").withColumn("meta", F.parse_json("m")).drop("m"),
    }
    edges = {"knows": spark.createDataFrame(knows, "id string, from_id string, to_id string, weight double"), "worksAt": spark.createDataFrame(works, "id string, from_id string, to_id string, role string, salary double, valid_to timestamp")}
    return GraphStore(spark, definition(), nodes, edges, Coordinate(now=NOW))


def ids(q):
    return sorted(r["id"] for r in q.select({"id": (q.start[1], "id")}).execute())


def doc(people, fn):
    return ids(people.query().from_("Document", "d").where_node("d", fn))


def test_nulls_follow_sql(people):
    q = people.query().from_("Person", "p")
    assert ids(q.where_node("p", lambda n: n.email.neq("ivo@mill.test"))) == ["hana", "kira", "mona"]
    assert ids(q.where_node("p", lambda n: n.email.contains("MILL").not_())) == ["kira", "mona"]
    assert ids(q.where_node("p", lambda n: n.email.is_null())) == ["jun", "lars"]
    none = people.query().from_("Person", "x").select({"e": ("x", "email")})
    assert ids(q.where_node("p", lambda n: n.name.not_in_subquery(none))) == []


def test_json_null_and_absent_differ(people):
    assert doc(people, lambda n: n.meta.has_key("signed")) == ["log"]
    assert doc(people, lambda n: n.meta.path_is_null("/signed")) == ["bill", "log", "song"]
    assert doc(people, lambda n: n.meta.path_is_not_null("/keeper")) == ["bill", "log"]
    assert doc(people, lambda n: n.meta.path_equals("/seal/wax", False)) == ["log"] and doc(people, lambda n: n.meta.path_contains("/pages", 5)) == ["log"]
    assert doc(people, lambda n: n.meta.get("keeper").eq("hana")) == ["bill"] and doc(people, lambda n: n.meta.get("keeper").in_(["hana", "x"])) == ["bill"]
    assert doc(people, lambda n: n.meta.get("keeper").contains("IR")) == ["log"] and doc(people, lambda n: n.meta.get("keeper").like("%na")) == ["bill"]
    assert doc(people, lambda n: n.meta.has_path("/pages/1")) == ["log"] and doc(people, lambda n: n.meta.has_path("/7")) == ["log"] and doc(people, lambda n: n.meta.has_path("/pages/9")) == []
    assert pointer("/a~1b/~0c") == ["a/b", "~c"] and pointer("") == []
    with pytest.raises(QueryError):
        pointer("a/b")


def test_arrays(people):
    assert doc(people, lambda n: n.tags.is_empty()) == ["bill", "song"] and doc(people, lambda n: n.tags.is_not_empty()) == ["log"]
    assert doc(people, lambda n: n.tags.length_lt(5)) == ["bill", "log"] and doc(people, lambda n: n.tags.contains_all([])) == ["bill", "log", "song"]
    assert doc(people, lambda n: n.tags.contains(None)) == [] and doc(people, lambda n: n.scores.contains(7)) == ["log"]


def test_refusals(people):
    q = people.query().from_("Document", "d")
    for fn, kind in ((lambda n: n.tags.eq("a"), UnsupportedPredicateError), (lambda n: n.nothing.eq(1), QueryError), (lambda n: n.fulltext.matches("x", 3).not_(), UnsupportedPredicateError), (lambda n: n.title.in_(["a", 1]), QueryError), (lambda n: n.scores.starts_with("x"), UnsupportedPredicateError)):
        with pytest.raises(kind):
            q.where_node("d", fn).to_df()
    with pytest.raises(QueryError):
        people.query().from_("Person", "p").traverse("knows", "e").to("Person", "p")
    with pytest.raises(QueryError):
        people.query().from_("Person", "p").traverse("knows", "e").recursive().to("Person", "q").traverse("knows", "f").to("Person", "r")
    with pytest.raises(QueryError):
        people.query().from_("Person", "p").traverse("knows", "e").recursive(max_hops=2000)
    with pytest.raises(QueryError):
        people.query().from_("Person", "p").where_node("p", lambda n: n.name.eq(param("x"))).to_df()
    with pytest.raises(QueryError):
        param("not a name")


def test_optional_hop_keeps_sources(people):
    q = people.query().from_("Person", "p").optional_traverse("worksAt", "w").to("Company", "c").where_node("c", lambda n: n.industry.eq("timber"))
    rows = {(r["p"], r["c"]) for r in q.select({"p": ("p", "id"), "c": ("c", "id")}).execute()}
    assert rows == {("hana", "mill"), ("ivo", None), ("jun", None), ("kira", None), ("lars", None), ("mona", None)}
    whole = [r for r in q.execute() if r["p"]["id"] == "jun"][0]
    assert whole["c"] is None and whole["p"]["name"] == "Jun Park"


def test_count_edges_and_targets_differ(people):
    q = people.view("includeEnded").at(Coordinate("asOf", dt.datetime(2022, 1, 1), None, NOW)).query().from_("Person", "p").traverse("worksAt", "w").to("Company", "c").group_by_node("p")
    assert dict(map(tuple, q.aggregate({"p": ("p", "id"), "n": count_edges("w")}).execute())) == {"hana": 1, "kira": 2}
    assert dict(map(tuple, q.aggregate({"p": ("p", "id"), "n": count("c")}).execute())) == {"hana": 1, "kira": 1}


def test_aggregates_ignore_nulls(people):
    q = people.query().from_("Product", "p").group_by("p", "category").aggregate({"c": ("p", "category"), "n": count("p"), "rated": count("p", "rating"), "mean": avg("p", "rating"), "sum": sum_("p", "price")})
    assert {tuple(r) for r in q.execute()} == {("light", 2, 1, 3.5, 48.0), ("deck", 3, 2, 4.5, 152.5)}


def test_temporal(people):
    assert people.find_edges("worksAt").count() == 2 and people.view("includeEnded").find_edges("worksAt").count() == 3
    assert people.as_of("2022-02-28T23:59:59.999Z").find_edges("worksAt").count() == 3 and people.as_of("2022-03-01T00:00:00.000Z").find_edges("worksAt").count() == 2
    for bad in (lambda: people.as_of("2024-01-01"), lambda: Coordinate("asOf"), lambda: Coordinate("current", NOW), lambda: people.view("never"), lambda: people.as_of_recorded(3)):
        with pytest.raises(TemporalError):
            bad()
    assert instant(dt.datetime(2024, 1, 1, 2, tzinfo=dt.timezone(dt.timedelta(hours=2)))) == dt.datetime(2024, 1, 1)


def test_pages_cover_everything_once(people):
    for how in (("age", "asc", None), ("age", "desc", None), ("email", "asc", "first"), ("active", "desc", "last")):
        q = people.query().from_("Person", "p").select({"id": ("p", "id")}).order_by("p", how[0], how[1], how[2])
        whole, seen, after = [r["id"] for r in q.order_by("p", "id").execute()], [], None
        while True:
            page = q.paginate(first=2, after=after)
            seen += [r.id for r in page.data]
            after = page.end_cursor
            if not page.has_next:
                break
        assert seen == whole
        back = q.paginate(last=2, before=after)
        assert [r.id for r in back.data] == whole[max(0, len(whole) - 3) : -1]
    with pytest.raises(CursorError):
        q.paginate(first=2, after="???")
    with pytest.raises(CursorError):
        decode_cursor(after, ["other"])
    with pytest.raises(QueryError):
        people.query().from_("Person", "p").paginate()


def test_fragments_streams_and_sets(people):
    top = compose(ordered_by("p", "age", "desc"), limited(2))
    q = people.query().from_("Person", "p").where_node("p", lambda n: n.age.is_not_null()).select({"id": ("p", "id")})
    assert [r["id"] for r in q.pipe(top).stream()] == ["kira", "hana"]
    by_age = people.query().from_("Person", "p").select({"id": ("p", "id")}).order_by("p", "age")
    assert [r["id"] for r in by_age.stream(2)] == [r["id"] for r in by_age.stream()] == ["ivo", "mona", "lars", "hana", "kira", "jun"]
    assert [r["id"] for r in by_age.offset(1).limit(3).stream(2)] == ["mona", "lars", "hana"]
    with pytest.raises(QueryError):
        by_age.stream(0)
    assert q.union(q).to_df().count() == 5 and q.union_all(q).to_df().count() == 10 and q.except_(q).to_df().count() == 0
    with pytest.raises(QueryError):
        q.union(q).order_by("nothing").to_df()


def test_paths(people):
    a = Algorithms(people)
    path = lambda df: [r["id"] for r in df.orderBy("position").collect()]
    assert path(a.shortest_path(("Person", "hana"), ("Person", "jun"), ["knows"])) == ["hana", "kira", "mona", "jun"]
    assert path(a.weighted_shortest_path(("Person", "hana"), ("Person", "jun"), ["knows"], "weight")) == ["hana", "ivo", "lars", "kira", "mona", "jun"]
    assert path(a.shortest_path(("Person", "jun"), ("Person", "hana"), ["knows"])) == [] and path(a.shortest_path(("Person", "jun"), ("Person", "jun"), ["knows"])) == ["jun"]
    assert [(r["id"], r["depth"]) for r in a.reachable("Person", "hana", ["knows"], max_hops=2).collect()] == [("hana", 0), ("ivo", 1), ("kira", 1), ("lars", 2), ("mona", 2)]
    assert {r["id"]: r["degree"] for r in a.degree(["knows"]).collect()} == {"hana": 3, "ivo": 3, "jun": 1, "kira": 3, "lars": 2, "mona": 2}
    with pytest.raises(InvalidEdgeWeightError):
        a.weighted_shortest_path(("Person", "hana"), ("Company", "mill"), ["knows", "worksAt"], "salary")


def test_ranks_sum_to_one(people):
    a = Algorithms(people)
    for how in ({"direction": "both"}, {"direction": "out"}, {"every": 2}):
        assert abs(sum(r["score"] for r in a.page_rank(["knows"], damping=0.5, tolerance=1e-5, **how).collect()) - 1) < 1e-9
    # However many rounds go into one job.
    one, five = ({r["id"]: r["score"] for r in a.page_rank(["knows"], direction="both", damping=0.3, tolerance=1e-6, every=n).collect()} for n in (3, 6))
    assert one.keys() == five.keys() and all(abs(one[k] - five[k]) < 1e-5 for k in one)
    parts = a.weakly_connected_components(["knows"], ["Person"]).collect()
    assert {r["component_id"] for r in parts} == {"hana"} and {r["size"] for r in parts} == {6}
    assert a.weakly_connected_components(["knows"], []).count() == 0


def test_search(people):
    s = StoreSearch(people)
    assert [r["id"] for r in s.fulltext("Document", "harbour").collect()] == ["log", "bill"]
    q = people.query().from_("Document", "d").where_node("d", lambda n: n.fulltext.matches("harbour -log", 5)).select({"id": ("d", "id")})
    assert [r["id"] for r in q.execute()] == ["bill"]
    with pytest.raises(QueryError):
        s.vector("Document", "title", [1.0])


def test_writes_are_checked(people, spark):
    new = lambda *rows: spark.createDataFrame(rows, "id string, name string, email string")
    assert wr.create(people, "Person", new(("f", "Fay", "f@x"))).nodes(["Person"]).count() == 7
    with pytest.raises(UniquenessError):
        wr.create(people, "Person", new(("f", "Fay", "HANA@mill.test")))
    with pytest.raises(ValidationError):
        wr.create(people, "Person", new(("ivo", "Ivo", "i@x")))
    with pytest.raises(DisjointnessError):
        wr.create(people, "Person", new(("mill", "M", "m@x")))
    with pytest.raises(EndpointError):
        wr.create_edges(people, "knows", spark.createDataFrame([("k9", "hana", "nobody")], "id string, from_id string, to_id string"))
    with pytest.raises(RestrictedDeleteError):
        wr.delete(people, "Person", spark.createDataFrame([("hana",)], "id string"))
    strict = GraphStore(spark, definition(cardinality="one", on_delete="cascade"), people.frames, people.edge_frames, people.coordinate)
    with pytest.raises(CardinalityError):
        wr.create_edges(strict, "worksAt", spark.createDataFrame([("c9", "hana", "mill")], "id string, from_id string, to_id string"))
    gone = wr.delete(strict, "Person", spark.createDataFrame([("hana",)], "id string"))
    assert gone.nodes(["Person"]).count() == 5 and gone.edges(["knows"]).count() == 4 and gone.view("includeTombstones").edges(["knows"]).count() == 7
    found, store = wr.get_or_create(people, "Person", "email", new(("n1", "x", "IVO@mill.test"), ("n2", "y", "n@x"), ("n3", "y", "N@x")))
    assert {(r["id"], r["found_id"]) for r in found.collect()} == {("n1", "ivo"), ("n2", "n2"), ("n3", "n2")} and store.nodes(["Person"]).count() == 7
    assert wr.get_or_create_edges(people, "knows", spark.createDataFrame([("k8", "hana", "ivo"), ("k9", "jun", "ivo")], "id string, from_id string, to_id string")).edges(["knows"]).count() == 8


def test_identity(people, spark):
    pairs = lambda *rows: spark.createDataFrame(rows, "a_kind string, a_id string, b_kind string, b_id string")
    one = Identity(people).asserted(pairs(("Person", "hana", "Person", "ivo"), ("Person", "ivo", "Person", "jun")), "same")
    i = Identity(one)
    assert {r["id"] for r in i.members_of("Person", "jun").collect()} == {"hana", "ivo", "jun"} and i.representative_of("Person", "jun").first()["id"] == "hana"
    with pytest.raises(IdentityContradiction):
        i.asserted(pairs(("Person", "jun", "Person", "hana")), "different")
    with pytest.raises(IdentityContradiction):
        i.asserted(pairs(("Person", "jun", "Company", "mill")), "same")
    apart = i.retracted(pairs(("Person", "jun", "Person", "ivo")), "same")
    assert {r["id"] for r in Identity(apart).members_of("Person", "jun").collect()} == {"jun"}
    q = one.query().from_("Person", "p").where_node("p", lambda n: n.id.eq("jun")).traverse("knows", "e", identity=True).to("Person", "q").select({"id": ("q", "id")})
    assert sorted(r["id"] for r in q.execute()) == ["hana", "ivo", "kira", "lars"]


def test_provenance_laws(spark):
    f = lambda rows, s: spark.createDataFrame(rows, s)
    p = Provenance(f([("s1", None), ("s2", True), ("s3", False)], "id string, retracted boolean"), f([("j1", "s1"), ("j2", "a"), ("j2", "s3"), ("j3", "s2"), ("j4", "c"), ("j5", "d")], "justification string, premise string"), f([("j1", "a"), ("j2", "b"), ("j3", "x"), ("j4", "d"), ("j5", "c"), ("j6", "always")], "justification string, fact string"))
    held = lambda q: {r["id"] for r in q.holding().collect()}
    assert held(p) == {"a", "b", "always"}  # c and d hold each other up, but nothing holds them
    after, report = p.retract(f([("s1",)], "id string"))
    assert held(after) == {"always"} and {(r["id"], r["outcome"]) for r in report.collect()} == {("a", "died"), ("b", "died")}
    assert held(after.unretract(f([("s1",)], "id string"))[0]) == held(p)


def test_merge(people, spark):
    base = mg.canonical(people, ["Person"])
    assert mg.diff(base, base).count() == 0
    drop = lambda n: F.map_filter("props", lambda k, _: k != n)
    fork = base.withColumn("props", F.when(F.col("id") == "ivo", drop("age")).otherwise(F.col("props")))
    changes = mg.diff(base, fork).withColumn("branch", F.lit("a")).withColumn("rank", F.lit(0))
    props, conflicts = mg.merged_props(changes)
    assert conflicts.count() == 0 and "age" not in props.first()["props"] and "name" in props.first()["props"]
    rows = spark.createDataFrame([("K", str(i), t, None) for i, t in enumerate(["ab", "ac", "ad", "b", "ba", "c"])], "kind string, id string, text string, vector array<double>")
    pairs = {(r["a"]["id"], r["b"]["id"]) for r in mg.window_pairs(rows, 2, 3).collect()}
    assert pairs == {(str(i), str(j)) for i in range(6) for j in range(i + 1, min(6, i + 3))}
    links = spark.createDataFrame([(("K", "1"), ("K", "2"), 0.9), (("K", "2"), ("K", "3"), 0.8), (("K", "3"), ("K", "4"), 0.95)], "a struct<kind: string, id: string>, b struct<kind: string, id: string>, score double")
    grouped = lambda df: sorted(sorted(r["m"]) for r in df.groupBy("cluster").agg(F.collect_list("node.id").alias("m")).collect())
    assert grouped(mg.clusters(links)) == [["1", "2", "3", "4"]] and grouped(mg.clusters(links, 2)) == [["1", "2"], ["3", "4"]]
    edges = spark.createDataFrame([("1", "knows", "P", "a", "P", "b"), ("2", "knows", "P", "a2", "P", "b"), ("3", "knows", "P", "a", "P", "a2"), ("4", "knows", "P", "z", "P", "z")], "id string, kind string, from_kind string, from_id string, to_kind string, to_id string")
    to = spark.createDataFrame([("P", "a2", "P", "a")], "kind string, id string, to_kind string, to_id string")
    assert {r["id"] for r in mg.repoint(edges, to).collect()} == {"1", "4"}


def test_interchange(people, spark, tmp_path):
    lines = interchange.export_graph(people, ["Person", "Company"], ["knows"], meta=True)
    lines.write.text(str(tmp_path / "g"))
    empty = GraphStore(spark, people.graph, {}, {}, people.coordinate)
    back = interchange.import_graph(empty, interchange.read_lines(spark, str(tmp_path / "g")))
    assert sorted(map(repr, back.nodes(["Person"]).select("id", "p__age", "p__email").collect())) == sorted(map(repr, people.nodes(["Person"]).select("id", "p__age", "p__email").collect()))
    with pytest.raises(ImportConflictError):
        interchange.import_graph(back, interchange.parse_lines(lines))
    assert interchange.import_graph(back, interchange.parse_lines(lines), "skip").nodes(["Person"]).count() == 6
    odd = spark.createDataFrame([('{"type": "node", "kind": "Person", "id": "x", "properties": {"colour": 1}}',)], "value string")
    with pytest.raises(ValidationError):
        interchange.import_graph(empty, interchange.parse_lines(odd))
    assert interchange.import_graph(empty, interchange.parse_lines(odd), on_unknown="strip").nodes(["Person"]).count() == 1
    said = spark.createDataFrame([("s1", "same", "Person", "hana", "Person", "mona", None, None, None)], ASSERTIONS)
    frames = {k: f for k, f in people.frames.items()}
    whole = GraphStore(spark, people.graph, frames, people.edge_frames, Coordinate("asOf", as_of=dt.datetime(2021, 1, 1), now=NOW), {"Company": people.frames["Company"].selectExpr("*", "0L recorded_from", "7L recorded_to")}, {"knows": people.edge_frames["knows"].selectExpr("*", "2L recorded_from", "9L recorded_to")}, said)
    interchange.save(whole, str(tmp_path / "saved"), 2)
    again = interchange.open_saved(spark, people.graph, str(tmp_path / "saved"))
    rows = lambda df: sorted(map(repr, df.select(*[F.to_json(c).alias(c) if t == "variant" else c for c, t in df.dtypes]).collect()))  # noqa: E731  (a variant's bytes may differ)
    assert again.coordinate == whole.coordinate and rows(again.assertions) == rows(said) and again.recorded_now() == 2
    for kind in people.graph.nodes:
        assert rows(again.nodes([kind], visible=False)) == rows(whole.nodes([kind], visible=False)) and rows(again.nodes([kind])) == rows(whole.nodes([kind]))
    for kind in people.graph.edges:
        assert rows(again.edges([kind], visible=False)) == rows(whole.edges([kind], visible=False)) and rows(again.edges([kind])) == rows(whole.edges([kind]))
    assert rows(again.as_of_recorded(5).edges(["knows"])) == rows(whole.as_of_recorded(5).edges(["knows"])) and whole.nodes(["Company"]).count() == 2
    (tmp_path / "k.csv").write_text("Comment.id|Comment.id\n1|2\n3|4\n")
    assert interchange.edges_from(interchange.read_delimited(spark, str(tmp_path / "k.csv"), "a long, b long"), "a", "b").select("id").collect()[0][0] == "1-2"


def test_schema_versions(people):
    g = people.graph
    more = extend(g, {"nodes": {"Tag": {"properties": {"label": {"type": "string"}, "w": {"type": "array", "items": {"type": "number"}}}}}, "edges": {"tagged": {"from": ["Person"], "to": ["Tag"]}}})
    assert {c.severity for c in diff(g, more)} == {"safe"} and {c.severity for c in diff(more, g)} == {"breaking"}
    v = Versions.start(g)
    assert v.ensure(more) and v.active == 2 and v.ensure(more) == [] and v.rollback(1) is g
    with pytest.raises(ValidationError):
        Versions.start(more).ensure(g)
    assert deprecate(g, ["Person"]).nodes["Person"].deprecated
    assert set(remove_kinds(people, ["Company"]).graph.edges) == {"knows"}


def test_profiler_and_hooks(people):
    q = people.query().from_("Person", "p").where_node("p", lambda n: n.age.gt(20)).traverse("knows", "e").to("Person", "q").select({"id": ("q", "id")}).order_by("p", "name")
    p, seen = Profiler(), []
    for _ in range(3):
        p.observe(q)
    assert {(r["kind"], r["property"], r["use"]) for r in p.recommendations()} == {("Person", "age", "filter"), ("Person", "name", "order"), ("knows", "from_id", "traverse")}
    Hooks([lambda q: seen.append("start")], [lambda q, s: seen.append("end")]).run(q)
    assert seen == ["start", "end"]


def test_streaming(spark, tmp_path):
    from graphloom.streaming import events

    src = "/root/testdata/sf0.001"
    stream = spark.readStream.schema(events.SCHEMA).option("pathGlobFilter", "events.parquet").parquet(src)
    q = events.into(events.edges(stream), str(tmp_path / "out"), str(tmp_path / "check")).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(f"{src}/events.parquet").count()


@pytest.mark.parametrize("parts", [1, 3, 64])
def test_window_pairs_lose_none(spark, monkeypatch, parts):
    monkeypatch.setattr(mg, "STRETCH", 7)
    rows = [(kind, str(i), f"t{i * 37 % 100:03}", None) for kind, n in (("K", 100), ("L", 4)) for i in range(n)]
    df = spark.createDataFrame(rows, "kind string, id string, text string, vector array<double>")
    want = set()
    for kind in "KL":
        own = sorted((t, i) for k, i, t, _ in rows if k == kind)
        want |= {(kind, own[i][1], own[j][1]) for i in range(len(own)) for j in range(i + 1, min(len(own), i + 6))}
    assert {(r["kind"], r["a"]["id"], r["b"]["id"]) for r in mg.window_pairs(df, 5, parts).collect()} == want


def test_pages_of_parallel_edges(people, spark):
    edges = spark.createDataFrame([("b", "ivo", "jun", 1.0), ("a", "ivo", "jun", 2.0), ("c", "ivo", "jun", 3.0)], "id string, from_id string, to_id string, weight double")
    store = GraphStore(spark, people.graph, people.frames, {"knows": edges}, people.coordinate)
    q = store.query().from_("Person", "p").traverse("knows", "e").to("Person", "q").select({"w": ("e", "weight")}).order_by("p", "name")
    one = q.paginate(first=2)
    assert [r.w for r in one.data] + [r.w for r in q.paginate(first=2, after=one.end_cursor).data] == [2.0, 1.0, 3.0]


def test_edges_are_counted_before_the_join(people):
    q = people.query().from_("Person", "p").optional_traverse("knows", "e").to("Person", "q").group_by_node("p").aggregate({"p": ("p", "id"), "n": count_edges("e")})
    assert dict(map(tuple, q.execute())) == {"hana": 2, "ivo": 2, "jun": 0, "kira": 1, "lars": 1, "mona": 1}
    plan = q.explain("extended").split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert plan.index("Aggregate") < plan.index("Join") < plan.rindex("Aggregate")


def test_retyped_clusters_and_merged_assertions(people, spark):
    g = people.graph
    assert mg.common_kind(g, ["Person", "Person"]) == "Person" and mg.common_kind(g, ["Person", "Company"]) is None
    members = spark.createDataFrame([("x", "Person"), ("x", "Person"), ("y", "Person"), ("y", "Company")], "cluster string, kind string")
    assert [tuple(r) for r in mg.retyped(g, members).collect()] == [("y", None)]
