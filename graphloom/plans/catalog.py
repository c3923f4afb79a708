"""Registered queries over the star-schema graph, each with the SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import Ref, exists, not_exists, param
from ..functions.variants import set_path, unset_path
from ..operators import ann
from ..operators import fulltext as ft
from ..operators import merge as mg
from ..operators import writes as wr
from ..operators.algorithms import Algorithms
from ..operators.identity import SCHEMA as ASSERTIONS
from ..operators.identity import Identity
from ..operators.provenance import Provenance
from ..operators.search import StoreSearch
from ..sources import interchange
from ..sources.star_schema import load
from ..store import GraphStore
from ..temporal import OPEN_REVISION
from .query import avg, count, count_distinct, count_distinct_edges, count_edges, max_, min_, sum_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW = "TIMESTAMP '2024-01-01'"


def query(sql: str | None = None) -> Callable[[Callable[[GraphStore], DataFrame]], Callable[[GraphStore], DataFrame]]:
    def register(fn: Callable[[GraphStore], DataFrame]) -> Callable[[GraphStore], DataFrame]:
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(load(spark, sf_dir))
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


# Predicates: name, kind, predicate, SQL of the ids that it keeps
_C, _O, _P, _E = "SELECT c_custkey::VARCHAR AS id FROM customer WHERE ", "SELECT o_orderkey::VARCHAR AS id FROM orders WHERE ", "SELECT p_partkey::VARCHAR AS id FROM part WHERE ", "SELECT event_id::VARCHAR AS id FROM events WHERE "
_TAGS, _K = "string_split(event_type, 'r')", "props::JSON->>'k'"
PREDICATES: list[tuple[str, str, Callable[[Ref], Any], str]] = [
    ("eq", "Customer", lambda n: n.mktsegment.eq("BUILDING"), _C + "c_mktsegment = 'BUILDING'"),
    ("neq", "Customer", lambda n: n.mktsegment.neq("BUILDING"), _C + "c_mktsegment <> 'BUILDING'"),
    ("gt", "Customer", lambda n: n.acctbal.gt(5000), _C + "c_acctbal > 5000"),
    ("gte", "Part", lambda n: n.size.gte(30), _P + "p_size >= 30"),
    ("lt", "Customer", lambda n: n.name.lt("Customer#000000100"), _C + "c_name < 'Customer#000000100'"),
    ("lte", "Order", lambda n: n.orderdate.lte("1997-01-01T00:00:00.000Z"), _O + "o_orderdate <= TIMESTAMP '1997-01-01'"),
    ("in", "Customer", lambda n: n.mktsegment.in_(["BUILDING", "MACHINERY"]), _C + "c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    ("in_empty", "Customer", lambda n: n.mktsegment.in_([]), _C + "false"),
    ("not_in", "Customer", lambda n: n.mktsegment.not_in(["BUILDING", "MACHINERY"]), _C + "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"),
    ("not_in_empty", "Customer", lambda n: n.mktsegment.not_in([]), _C + "true"),
    ("between", "Order", lambda n: n.orderdate.between("1996-01-01T00:00:00.000Z", "1996-12-31T00:00:00.000Z"), _O + "o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'"),
    ("is_null", "Event", lambda n: n.props.get("k").is_null(), _E + f"{_K} IS NULL"),
    ("is_null_all", "Order", lambda n: n.valid_to.is_null(), _O + "true"),
    ("is_not_null", "Customer", lambda n: n.name.is_not_null(), _C + "c_name IS NOT NULL"),
    ("contains", "Customer", lambda n: n.mktsegment.contains("uild"), _C + "contains(lower(c_mktsegment), 'uild')"),
    ("contains_wildcard", "Customer", lambda n: n.name.contains("%"), _C + "contains(c_name, '%')"),
    ("contains_percent", "Document", lambda n: n.text.contains("%"), "SELECT doc_id::VARCHAR AS id FROM documents WHERE contains(text, '%')"),
    ("starts_with", "Part", lambda n: n.name.starts_with("SMALL r"), _P + "starts_with(lower(p_name), 'small r')"),
    ("ends_with", "Customer", lambda n: n.name.ends_with("7"), _C + "ends_with(c_name, '7')"),
    ("like", "Customer", lambda n: n.name.like("Customer#%5_"), _C + "c_name LIKE 'Customer#%5_'"),
    ("ilike", "Customer", lambda n: n.mktsegment.ilike("m%y"), _C + "c_mktsegment ILIKE 'm%y'"),
    ("and_or_not", "Customer", lambda n: n.mktsegment.eq("BUILDING").or_(n.acctbal.lt(0)).and_(n.name.ends_with("1").not_()), _C + "(c_mktsegment = 'BUILDING' OR c_acctbal < 0) AND NOT ends_with(c_name, '1')"),
    ("array_contains", "Event", lambda n: n.tags.contains("pu"), _E + f"list_contains({_TAGS}, 'pu')"),
    ("contains_all", "Event", lambda n: n.tags.contains_all(["pu", "chase"]), _E + f"list_has_all({_TAGS}, ['pu', 'chase'])"),
    ("contains_any", "Event", lambda n: n.tags.contains_any(["pu", "view"]), _E + f"list_has_any({_TAGS}, ['pu', 'view'])"),
    ("contains_any_empty", "Event", lambda n: n.tags.contains_any([]), _E + "false"),
    ("is_empty", "Event", lambda n: n.tags.is_empty(), _E + f"len({_TAGS}) = 0"),
    ("is_empty_some", "Event", lambda n: n.long_parts.is_empty(), _E + f"len(list_filter({_TAGS}, lambda x: length(x) > 4)) = 0"),
    ("is_not_empty", "Event", lambda n: n.tags.is_not_empty(), _E + f"len({_TAGS}) > 0"),
    ("length_eq", "Event", lambda n: n.tags.length_eq(2), _E + f"len({_TAGS}) = 2"),
    ("length_gt", "Event", lambda n: n.tags.length_gt(1), _E + f"len({_TAGS}) > 1"),
    ("length_gte", "Event", lambda n: n.tags.length_gte(2), _E + f"len({_TAGS}) >= 2"),
    ("length_lt", "Event", lambda n: n.tags.length_lt(2), _E + f"len({_TAGS}) < 2"),
    ("length_lte", "Event", lambda n: n.tags.length_lte(1), _E + f"len({_TAGS}) <= 1"),
    ("has_key", "Event", lambda n: n.props.has_key("k"), _E + "json_exists(props, '$.k')"),
    ("has_path_missing", "Event", lambda n: n.props.has_path("/k/x"), _E + "json_exists(props, '$.k.x')"),
    ("has_path", "Event", lambda n: n.nested.has_path("/a/0"), _E + f"({_K})::INT % 2 = 0"),
    ("has_path_digit_key", "Event", lambda n: n.nested.has_path("/0"), _E + f"({_K})::INT % 3 = 0"),
    ("path_contains", "Event", lambda n: n.nested.path_contains("/a", 8), _E + f"({_K})::INT = 8"),
    ("path_equals", "Event", lambda n: n.props.path_equals("/k", 42), _E + f"({_K})::DOUBLE = 42"),
    ("path_is_null", "Event", lambda n: n.props.path_is_null("/none"), _E + "props::JSON->>'none' IS NULL"),
    ("path_is_not_null", "Event", lambda n: n.props.path_is_not_null("/k"), _E + f"{_K} IS NOT NULL"),
    ("nested_in", "Event", lambda n: n.props.get("k").in_([3, 14, 15]), _E + f"({_K})::DOUBLE IN (3, 14, 15)"),
    ("nested_not_in", "Event", lambda n: n.props.get("k").not_in([3, 14, 15]), _E + f"({_K})::DOUBLE NOT IN (3, 14, 15)"),
    ("nested_contains", "Event", lambda n: n.nested.get("s").contains("LIC"), _E + "contains(event_type, 'lic')"),
    ("nested_starts_with", "Event", lambda n: n.nested.get("s").starts_with("v"), _E + "starts_with(event_type, 'v')"),
    ("nested_like", "Event", lambda n: n.nested.get("s").like("%ck"), _E + "event_type LIKE '%ck'"),
    ("nested_get", "Event", lambda n: n.props.get("k").gt(50), _E + f"({_K})::DOUBLE > 50"),
]


def _predicate(name: str, kind: str, fn: Callable[[Ref], Any], sql: str) -> None:
    def run(s: GraphStore) -> DataFrame:
        return s.query().from_(kind, "n").where_node("n", fn).select({"id": ("n", "id")}).to_df()

    run.__name__ = f"pred_{name}"
    query(sql)(run)


for _p in PREDICATES:
    _predicate(*_p)


@query("SELECT c_custkey::VARCHAR AS id FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def pred_in_subquery(s: GraphStore) -> DataFrame:
    asia = s.query().from_("Region", "r").where_node("r", lambda n: n.id.eq("1")).traverse("inRegion", "e", direction="in").to("Nation", "n").traverse("customerIn", "f", direction="in").to("Customer", "c").select({"id": ("c", "id")})
    return s.query().from_("Customer", "c").where_node("c", lambda n: n.id.in_subquery(asia)).select({"id": ("c", "id")}).to_df()


@query("SELECT c_custkey::VARCHAR AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def pred_not_in_subquery(s: GraphStore) -> DataFrame:
    buyers = s.query().from_("Customer", "c").traverse("placed", "e").to("Order", "o").select({"id": ("c", "id")})
    return s.query().from_("Customer", "c").where_node("c", lambda n: n.id.not_in_subquery(buyers)).select({"id": ("c", "id")}).to_df()


@query("SELECT n_name AS name FROM nation WHERE EXISTS (SELECT 1 FROM region WHERE r_regionkey = 2) AND NOT EXISTS (SELECT 1 FROM region WHERE r_regionkey = 99)")
def pred_exists(s: GraphStore) -> DataFrame:
    some, none = (s.query().from_("Region", "r").where_node("r", lambda n, i=i: n.id.eq(i)) for i in ("2", "99"))
    return s.query().from_("Nation", "n").where_node("n", lambda n: exists(some) & not_exists(none)).select({"name": ("n", "name")}).to_df()


@query("SELECT c_custkey::VARCHAR AS id FROM customer WHERE c_mktsegment IN ('FURNITURE', 'BUILDING') AND c_acctbal > 100 ORDER BY c_acctbal DESC, c_custkey LIMIT 7")
def prepared_params(s: GraphStore) -> DataFrame:
    q = s.query().from_("Customer", "c").where_node("c", lambda n: n.mktsegment.in_(param("segments")) & n.acctbal.gt(param("least")))
    run = q.order_by("c", "acctbal", "desc").limit(param("n")).select({"id": ("c", "id")}).prepare()
    return run(segments=["FURNITURE", "BUILDING"], least=100, n=7)


@query("SELECT c_custkey::VARCHAR AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def pred_not_in_subquery_some(s: GraphStore) -> DataFrame:
    large = s.query().from_("Customer", "c").traverse("placed", "e").to("Order", "o").where_node("o", lambda n: n.totalprice.gt(400000)).select({"id": ("c", "id")})
    return s.query().from_("Customer", "c").where_node("c", lambda n: n.id.not_in_subquery(large)).select({"id": ("c", "id")}).to_df()


# Scans
@query("SELECT 'Customer' AS kind, c_custkey::VARCHAR AS id, c_name AS name FROM customer UNION ALL SELECT 'Supplier', s_suppkey::VARCHAR, s_name FROM supplier")
def scan_sub_classes(s: GraphStore) -> DataFrame:
    return s.query().from_("Party", "p", sub_classes=True).select({"kind": ("p", "kind"), "id": ("p", "id"), "name": ("p", "name")}).to_df()


@query("SELECT count(*) AS count FROM (SELECT c_custkey FROM customer UNION ALL SELECT s_suppkey FROM supplier)")
def scan_count(s: GraphStore) -> DataFrame:
    return s.count("Party", True)


@query("SELECT p_partkey::VARCHAR AS id, p_name AS name FROM part WHERE p_size = 10 ORDER BY p_partkey::VARCHAR LIMIT 5 OFFSET 2")
def scan_find(s: GraphStore) -> DataFrame:
    return s.find("Part", lambda n: n.size.eq(10), 5, 2).select("id", F.col("p__name").alias("name"))


@query("SELECT position::INT AS position, asked, n_name AS name FROM (VALUES (0, '3'), (1, '77'), (2, '1'), (3, '3')) v(position, asked) LEFT JOIN nation ON n_nationkey::VARCHAR = asked")
def scan_get_by_ids(s: GraphStore) -> DataFrame:
    return s.get_by_ids("Nation", ["3", "77", "1", "3"]).select("position", "asked", F.col("p__name").alias("name"))


@query("SELECT r_regionkey::VARCHAR AS id FROM region WHERE lower(r_name) IN ('asia', 'europe', lower((SELECT min(r_name) FROM region)))")
def scan_find_by_constraint(s: GraphStore) -> DataFrame:
    first = s.frames["Region"].agg(F.upper(F.min("name")).alias("name"))
    keys = first.unionAll(s.spark.createDataFrame([("asia",), ("Europe",)], "name string"))
    return s.bulk_find_by_constraint("Region", "name", keys).select("id")


@query("SELECT p_size, p_partkey::VARCHAR AS id FROM part WHERE p_size IN (5, 9) QUALIFY row_number() OVER (PARTITION BY p_size ORDER BY p_partkey::VARCHAR) <= 3")
def scan_find_by_index(s: GraphStore) -> DataFrame:
    keys = s.spark.createDataFrame([(5,), (9,), (999,)], "size int")
    return s.bulk_find_by_index("Part", keys, 3).select(F.col("p__size").alias("p_size"), "id")


@query("SELECT o_orderkey::VARCHAR AS id FROM orders WHERE o_custkey = 5")
def scan_edges_from(s: GraphStore) -> DataFrame:
    return s.find_edges("placed", from_=("Customer", "5")).select("id")


@query("SELECT n_nationkey::VARCHAR AS from_id, c_custkey::VARCHAR AS to_id FROM nation JOIN customer ON n_nationkey = c_nationkey WHERE n_regionkey = 0 QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY 'c' || c_custkey) <= 4")
def scan_bulk_edges(s: GraphStore) -> DataFrame:
    ends = s.find_edges("inRegion", to=("Region", "0")).select(F.lit("Nation").alias("kind"), F.col("from_id").alias("id"))
    return s.bulk_find_edges(ends, ["customerIn"], "in", 4).select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))


def _recorded(s: GraphStore) -> GraphStore:
    """Orders in two revisions: at 2 the ones whose key leaves 1 by 5 get a new status; those that leave 2 are gone."""
    o, mod = s.frames["Order"], F.col("id").cast("long") % 5
    end = F.when(mod.isin(1, 2), F.lit(2)).otherwise(F.lit(OPEN_REVISION)).cast("long")
    first = o.withColumn("recorded_from", F.lit(1).cast("long")).withColumn("recorded_to", end)
    second = o.where(mod == 1).withColumn("status", F.lit("X")).withColumn("recorded_from", F.lit(2).cast("long")).withColumn("recorded_to", F.lit(OPEN_REVISION))
    return GraphStore(s.spark, s.graph, s.frames, s.edge_frames, s.coordinate, {"Order": first.unionByName(second)}, s.edge_frames and {})


@query("SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 5 = 1 THEN 'X' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 5 <> 2")
def temporal_recorded(s: GraphStore) -> DataFrame:
    view = _recorded(s).as_of_recorded(2)
    return view.query().from_("Order", "o").select({"id": ("o", "id"), "status": ("o", "status")}).to_df()


@query("SELECT o_orderkey::VARCHAR AS id, o_orderstatus AS status FROM orders WHERE o_orderkey::VARCHAR > '2' ORDER BY o_orderkey::VARCHAR LIMIT 20")
def temporal_recorded_page(s: GraphStore) -> DataFrame:
    return _recorded(s).recorded_scan("Order", 1, "2", 20).select("id", F.col("p__status").alias("status"))


# Temporal modes
_OPEN = "o_orderdate <= {t} AND o_orderdate + INTERVAL 90 DAY > {t} AND o_orderkey % 17 <> 0"


def _open(s: GraphStore) -> DataFrame:
    return s.find_edges("openFor").select("id")


@query("SELECT 'open' || o_orderkey AS id FROM orders WHERE " + _OPEN.format(t=NOW))
def temporal_current(s: GraphStore) -> DataFrame:
    return _open(s)


@query("SELECT 'open' || o_orderkey AS id FROM orders WHERE " + _OPEN.format(t="TIMESTAMP '1998-06-01'"))
def temporal_as_of(s: GraphStore) -> DataFrame:
    return _open(s.as_of("1998-06-01T00:00:00.000Z"))


@query("SELECT 'open' || o_orderkey AS id FROM orders WHERE o_orderkey % 17 <> 0")
def temporal_include_ended(s: GraphStore) -> DataFrame:
    return _open(s.view("includeEnded"))


@query("SELECT 'open' || o_orderkey AS id FROM orders")
def temporal_include_tombstones(s: GraphStore) -> DataFrame:
    return _open(s.view("includeTombstones"))


@query("SELECT c_custkey::VARCHAR AS customer, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey WHERE " + _OPEN.format(t="TIMESTAMP '1998-06-01'") + " GROUP BY 1")
def temporal_hop_as_of(s: GraphStore) -> DataFrame:
    q = s.query().temporal("asOf", dt.datetime(1998, 6, 1)).from_("Customer", "c").traverse("openFor", "e").to("Order", "o")
    return q.group_by_node("c").aggregate({"customer": ("c", "id"), "n": count("o")}).to_df()


# Hops
@query("SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def hop_out(s: GraphStore) -> DataFrame:
    return s.query().from_("Nation", "n").traverse("inRegion", "e").to("Region", "r").select({"nation": ("n", "name"), "region": ("r", "name")}).to_df()


@query("SELECT r_name AS region, n_name AS nation FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey > 1")
def hop_in(s: GraphStore) -> DataFrame:
    return s.query().from_("Region", "r").where_node("r", lambda n: n.id.gt("1")).traverse("inRegion", "e", direction="in").to("Nation", "n").select({"region": ("r", "name"), "nation": ("n", "name")}).to_df()


@query("SELECT c_custkey::VARCHAR AS customer, o_orderkey::VARCHAR AS ordered FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000")
def hop_optional(s: GraphStore) -> DataFrame:
    q = s.query().from_("Customer", "c").optional_traverse("placed", "e").to("Order", "o").where_node("o", lambda n: n.totalprice.gt(300000))
    return q.select({"customer": ("c", "id"), "ordered": ("o", "id")}).to_df()


@query("SELECT p_partkey::VARCHAR AS part, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_quantity > 40 GROUP BY 1")
def hop_where_edge(s: GraphStore) -> DataFrame:
    q = s.query().from_("Order", "o").traverse("contains", "l").where_edge(lambda e: e.returnflag.eq("R") & e.quantity.gt(40)).to("Part", "p")
    return q.group_by_node("p").aggregate({"part": ("p", "id"), "n": count("o")}).to_df()


@query("SELECT k AS kind, i::VARCHAR AS id, n_name AS nation FROM (SELECT 'Customer' k, c_custkey i, c_nationkey n FROM customer UNION ALL SELECT 'Supplier', s_suppkey, s_nationkey FROM supplier) JOIN nation ON n = n_nationkey")
def hop_implying(s: GraphStore) -> DataFrame:
    q = s.query().from_("Party", "p", sub_classes=True).traverse("locatedIn", "e", expand="implying").to("Nation", "n")
    return q.select({"kind": ("p", "kind"), "id": ("p", "id"), "nation": ("n", "name")}).to_df()


@query("SELECT o_orderkey::VARCHAR AS ordered, o_custkey::VARCHAR AS customer FROM orders WHERE o_totalprice > 350000")
def hop_inverse(s: GraphStore) -> DataFrame:
    q = s.query().from_("Order", "o").where_node("o", lambda n: n.totalprice.gt(350000)).traverse("placedBy", "e").to("Customer", "c")
    return q.select({"ordered": ("o", "id"), "customer": ("c", "id")}).to_df()


@query("SELECT c_custkey::VARCHAR AS customer, n_name AS nation, count(*) AS orders FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def hop_branching(s: GraphStore) -> DataFrame:
    q = s.query().from_("Customer", "c").traverse("customerIn", "e").to("Nation", "n").traverse("placed", "f", source="c").to("Order", "o")
    return q.aggregate({"customer": ("c", "id"), "nation": ("n", "name"), "orders": count("o")}).to_df()


@query("""SELECT s_suppkey::VARCHAR AS supplier, count(*) AS n, count(DISTINCT o_custkey) AS customers
FROM supplier JOIN lineitem a ON s_suppkey = a.l_suppkey JOIN part ON a.l_partkey = p_partkey JOIN lineitem b ON b.l_partkey = p_partkey JOIN orders ON b.l_orderkey = o_orderkey WHERE p_size = 7 GROUP BY 1""")
def hop_fan_in(s: GraphStore) -> DataFrame:
    q = s.query().from_("Supplier", "s").traverse("supplies", "e").to("Part", "p").where_node("p", lambda n: n.size.eq(7)).traverse("contains", "f", direction="in").to("Order", "o").traverse("placed", "g", direction="in").to("Customer", "c")
    return q.group_by_node("s").aggregate({"supplier": ("s", "id"), "n": count("c"), "customers": count_distinct("c")}).to_df()


@query("SELECT n_nationkey::VARCHAR AS n_id, struct_pack(id := r_regionkey::VARCHAR, name := r_name).name AS name FROM nation JOIN region ON n_regionkey = r_regionkey")
def project_whole(s: GraphStore) -> DataFrame:
    q = s.query().from_("Nation", "n").traverse("inRegion", "e").to("Region", "r").select(lambda c: {"n_id": c.n.id, "r": c.whole("r")})
    return q.to_df().select("n_id", "r.name")


# Recursion over orders, each with the next of its customer and the next of its day
_LEAD = "SELECT o_orderkey::VARCHAR AS a, lead(o_orderkey::VARCHAR) OVER w AS b, date_diff('day', o_orderdate::DATE, (lead(o_orderdate) OVER w)::DATE) + {c} AS w FROM orders WINDOW w AS (PARTITION BY {k} ORDER BY o_orderdate, o_orderkey)"
_NB = f"nb AS MATERIALIZED (SELECT * FROM ({_LEAD.format(c='1.0', k='o_custkey')} UNION ALL {_LEAD.format(c='3.0', k='o_orderdate')}) WHERE b IS NOT NULL), ub AS MATERIALIZED (SELECT a, b, w FROM nb UNION ALL SELECT b, a, w FROM nb)"


@query(f"WITH RECURSIVE {_NB}, r AS (SELECT '7' AS x, 0 AS d, ['7'] AS path UNION ALL SELECT b, d + 1, list_append(path, b) FROM r JOIN ub ON a = x WHERE d < 4 AND NOT list_contains(path, b)) SELECT x AS id, d::INT AS depth, path FROM r WHERE d >= 1")
def recursive_paths(s: GraphStore) -> DataFrame:
    q = s.query().from_("Order", "n").where_node("n", lambda n: n.id.eq("7")).traverse("neighbour", "e").recursive(max_hops=4, path="path", depth="depth").to("Order", "m")
    return q.select({"id": ("m", "id")}).to_df()


@query(f"WITH RECURSIVE {_NB}, r AS (SELECT '3' AS x, 0 AS d UNION ALL SELECT b, d + 1 FROM r JOIN nb ON a = x WHERE d < 6) SELECT x AS id, count(*) AS n FROM r WHERE d BETWEEN 2 AND 6 GROUP BY 1")
def recursive_allow(s: GraphStore) -> DataFrame:
    q = s.query().from_("Order", "n").where_node("n", lambda n: n.id.eq("3")).traverse("neighbour", "e", expand="none").recursive(min_hops=2, max_hops=6, cycles="allow").to("Order", "m")
    return q.group_by_node("m").aggregate({"id": ("m", "id"), "n": count("n")}).to_df()


@query(f"WITH RECURSIVE {_NB}, start AS (SELECT o_orderkey::VARCHAR AS o FROM orders WHERE o_totalprice > 300000), r AS (SELECT o AS x, 0 AS d, [o] AS path FROM start UNION ALL SELECT b, d + 1, list_append(path, b) FROM r JOIN nb ON a = x JOIN orders ON o_orderkey::VARCHAR = b WHERE d < 3 AND NOT list_contains(path, b) AND w < 60 AND o_orderstatus <> 'F') SELECT r.x AS id, d::INT AS depth FROM r JOIN orders ON o_orderkey::VARCHAR = x WHERE d > 0 OR o_orderstatus <> 'F'")
def recursive_filtered(s: GraphStore) -> DataFrame:
    q = s.query().from_("Order", "n").where_node("n", lambda n: n.totalprice.gt(300000)).traverse("neighbour", "e", expand="none").where_edge(lambda e: e.weight.lt(60)).recursive(min_hops=0, max_hops=3, depth="depth").to("Order", "m")
    return q.where_node("m", lambda n: n.status.neq("F")).select({"id": ("m", "id")}).to_df()


# Aggregates
@query("SELECT c_mktsegment AS segment, count(*) AS n, count(DISTINCT c_nationkey) AS nations, round(sum(c_acctbal), 2) AS total, round(avg(c_acctbal), 4) AS mean, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def agg_all(s: GraphStore) -> DataFrame:
    q = s.query().from_("Customer", "c").traverse("customerIn", "e").to("Nation", "n").group_by("c", "mktsegment")
    out = q.aggregate({"segment": ("c", "mktsegment"), "n": count("c"), "nations": count_distinct("n"), "total": sum_("c", "acctbal"), "mean": avg("c", "acctbal"), "low": min_("c", "acctbal"), "high": max_("c", "acctbal")}).to_df()
    return out.withColumn("total", F.round("total", 2)).withColumn("mean", F.round("mean", 4))


@query("SELECT count(*) AS n, round(avg(p_retailprice), 4) AS mean, count(DISTINCT p_brand) AS brands FROM part")
def agg_global(s: GraphStore) -> DataFrame:
    q = s.query().from_("Part", "p").aggregate({"n": count("p"), "mean": avg("p", "retailprice"), "brands": count_distinct("p", "brand")})
    return q.to_df().withColumn("mean", F.round("mean", 4))


@query("SELECT c_custkey::VARCHAR AS customer, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1 HAVING count(*) > 12")
def agg_having(s: GraphStore) -> DataFrame:
    q = s.query().from_("Customer", "c").traverse("placed", "e").to("Order", "o").group_by_node("c")
    return q.aggregate({"customer": ("c", "id"), "n": count("o")}).having(lambda c: c("n") > 12).to_df()


@query("SELECT c_custkey::VARCHAR AS customer, count(*) AS n, count(DISTINCT o_orderkey) AS d FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def agg_count_edges(s: GraphStore) -> DataFrame:
    q = s.query().from_("Customer", "c").traverse("placed", "e").to("Order", "o").group_by_node("c")
    return q.aggregate({"customer": ("c", "id"), "n": count_edges("e"), "d": count_distinct_edges("e")}).to_df()


@query("SELECT n_name AS nation, o_orderpriority AS priority, round(sum(o_totalprice), 2) AS total FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2 ORDER BY total DESC, nation, priority LIMIT 15 OFFSET 3")
def agg_ordered(s: GraphStore) -> DataFrame:
    q = s.query().from_("Nation", "n").traverse("customerIn", "e", direction="in").to("Customer", "c").traverse("placed", "f").to("Order", "o").group_by("n", "name").group_by("o", "priority")
    q = q.aggregate({"nation": ("n", "name"), "priority": ("o", "priority"), "total": sum_("o", "totalprice")}).order_by(None, "total", "desc").order_by(None, "nation").order_by(None, "priority").limit(15).offset(3)
    return q.to_df().withColumn("total", F.round("total", 2))


@query("""SELECT c_custkey::VARCHAR AS customer, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
WHERE c_mktsegment = 'BUILDING' GROUP BY 1 HAVING revenue > 1000 ORDER BY revenue DESC LIMIT 10""")
def flagship_revenue(s: GraphStore) -> DataFrame:
    """Customers of a segment by revenue of the parts in their orders."""
    q = s.query().from_("Customer", "c").where_node("c", lambda n: n.mktsegment.eq("BUILDING")).traverse("placed", "e").to("Order", "o").traverse("contains", "l").to("Part", "p")
    q = q.group_by_node("c").aggregate({"customer": ("c", "id"), "revenue": sum_("l", "revenue")}).having(lambda c: c("revenue") > 1000).order_by(None, "revenue", "desc").limit(10)
    return q.to_df().withColumn("revenue", F.round("revenue", 2))


# Order and pages
@query("SELECT c_custkey::VARCHAR AS customer, o_orderkey::VARCHAR AS ordered FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 350000 ORDER BY o_totalprice ASC NULLS LAST, c_custkey::VARCHAR LIMIT 40")
def sort_nulls_last(s: GraphStore) -> DataFrame:
    q = s.query().from_("Customer", "c").optional_traverse("placed", "e").to("Order", "o").where_node("o", lambda n: n.totalprice.gt(350000))
    return q.select({"customer": ("c", "id"), "ordered": ("o", "id")}).order_by("o", "totalprice").order_by("c", "id").limit(40).to_df()


@query("SELECT c_custkey::VARCHAR AS customer FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 350000 ORDER BY o_totalprice DESC NULLS FIRST, c_custkey::VARCHAR LIMIT 20")
def sort_nulls_first(s: GraphStore) -> DataFrame:
    q = s.query().from_("Customer", "c").optional_traverse("placed", "e").to("Order", "o").where_node("o", lambda n: n.totalprice.gt(350000))
    return q.select({"customer": ("c", "id")}).order_by("o", "totalprice", "desc").order_by("c", "id").limit(20).to_df()


@query("SELECT c_name AS name FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey::VARCHAR LIMIT 20 OFFSET 20")
def page_second(s: GraphStore) -> DataFrame:
    q = s.query().from_("Customer", "c").select({"name": ("c", "name")}).order_by("c", "mktsegment").order_by("c", "acctbal", "desc")
    page = q.paginate(after=q.paginate().end_cursor)
    return s.spark.createDataFrame(page.data, "name string")


@query("SELECT supplier, part, edge FROM (SELECT l_suppkey::VARCHAR AS supplier, l_partkey::VARCHAR AS part, l_orderkey || '-' || row_number() OVER (PARTITION BY l_orderkey ORDER BY lineitem) AS edge FROM lineitem) ORDER BY supplier, part, edge LIMIT 30")
def page_parallel_edges(s: GraphStore) -> DataFrame:
    """Pages of seven over edges of which several join the same nodes: none is lost at a border."""
    q = s.query().from_("Supplier", "s").traverse("supplies", "e").to("Part", "p").select({"supplier": ("s", "id"), "part": ("p", "id"), "edge": ("e", "id")}).order_by("s", "id")
    table = q.written()
    page = q.paginate(first=7, of=table)
    rows = list(page.data)
    while len(rows) < 30 and page.end_cursor:
        page = q.paginate(first=7, after=page.end_cursor, of=table)
        rows += page.data
    return s.spark.createDataFrame(rows[:30], "supplier string, part string, edge string")


@query("SELECT c_name AS name FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey::VARCHAR LIMIT 10 OFFSET 10")
def page_backward(s: GraphStore) -> DataFrame:
    q = s.query().from_("Customer", "c").select({"name": ("c", "name")}).order_by("c", "mktsegment").order_by("c", "acctbal", "desc")
    third = q.paginate(first=10, after=q.paginate(first=20).end_cursor)
    return s.spark.createDataFrame(q.paginate(last=10, before=third.start_cursor).data, "name string")


# Set operations
def _sides(s: GraphStore) -> tuple[Any, Any]:
    base = s.query().from_("Customer", "c").traverse("customerIn", "e").to("Nation", "n").select({"nation": ("n", "name")})
    return base.where_node("c", lambda n: n.acctbal.gt(9000)), base.where_node("c", lambda n: n.acctbal.lt(-500))


_A, _B = ("SELECT n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal " + x for x in ("> 9000", "< -500"))


@query(f"{_A} UNION {_B}")
def set_union(s: GraphStore) -> DataFrame:
    a, b = _sides(s)
    return a.union(b).to_df()


@query(f"{_A} UNION ALL {_B}")
def set_union_all(s: GraphStore) -> DataFrame:
    a, b = _sides(s)
    return a.union_all(b).to_df()


@query(f"{_A} INTERSECT {_B}")
def set_intersect(s: GraphStore) -> DataFrame:
    a, b = _sides(s)
    return a.intersect(b).to_df()


@query(f"{_A} EXCEPT {_B}")
def set_except(s: GraphStore) -> DataFrame:
    a, b = _sides(s)
    return a.except_(b).to_df()


@query(f"SELECT * FROM (({_A} UNION {_B}) EXCEPT SELECT n_name FROM nation WHERE n_regionkey = 2) ORDER BY nation DESC LIMIT 6 OFFSET 1")
def set_chained(s: GraphStore) -> DataFrame:
    a, b = _sides(s)
    out = s.query().from_("Nation", "n").traverse("inRegion", "e").to("Region", "r").where_node("r", lambda n: n.id.eq("2")).select({"nation": ("n", "name")})
    return a.union(b).except_(out).order_by("nation", "desc").limit(6).offset(1).to_df()


# Algorithms over the same graph
def _bfs_sql(source: str, edges: str, hops: int) -> str:
    """CTEs l0, l1 ... and ``found`` (n, before, d): each node at its least depth, with the smallest node before it."""
    steps = [f"l0 AS (SELECT '{source}' AS n, NULL::VARCHAR AS before, 0 AS d)"]
    for i in range(1, hops + 1):
        past = " UNION ALL ".join(f"SELECT n FROM l{j}" for j in range(i))
        steps.append(f"l{i} AS MATERIALIZED (SELECT b AS n, min(a) AS before, {i} AS d FROM l{i - 1} JOIN {edges} ON a = n WHERE b NOT IN ({past}) GROUP BY b)")
    return ", ".join(steps) + ", found AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(hops + 1)) + ")"


@query(f"WITH {_NB}, {_bfs_sql('0', 'ub', 8)} SELECT n AS id, 'Order' AS kind, d::INT AS depth FROM found")
def algo_reachable(s: GraphStore) -> DataFrame:
    return Algorithms(s).reachable("Order", "0", ["neighbour"], "both", 8)


@query(f"WITH {_NB}, {_bfs_sql('0', 'nb', 2)} SELECT n AS id, 'Order' AS kind, d::INT AS depth FROM found WHERE d > 0")
def algo_neighbors(s: GraphStore) -> DataFrame:
    return Algorithms(s).neighbors("Order", "0", ["neighbour"], depth=2)


@query(f"WITH RECURSIVE {_NB}, {_bfs_sql('0', 'ub', 14)}, p AS (SELECT * FROM found WHERE n = '1001' UNION ALL SELECT found.* FROM found JOIN p ON found.n = p.before) SELECT d::INT AS position, n AS id, 'Order' AS kind FROM p")
def algo_shortest_path(s: GraphStore) -> DataFrame:
    return Algorithms(s).shortest_path(("Order", "0"), ("Order", "1001"), ["neighbour"], "both", 14)


@query(f"WITH RECURSIVE {_NB}, f AS (SELECT '0' AS x, 0 AS d UNION SELECT b, d + 1 FROM f JOIN nb ON a = x WHERE d < 6), g AS (SELECT '0' AS x, 0 AS d UNION SELECT a, d + 1 FROM g JOIN nb ON b = x WHERE d < 6), t AS (SELECT max(x) AS t FROM f) SELECT t AS target, true AS forward, t IN (SELECT x FROM g) AS backward FROM t")
def algo_can_reach(s: GraphStore) -> DataFrame:
    """The last by id of what an order leads to in six steps: it is reached, and leads back or doesn't."""
    a = Algorithms(s)
    target = a.reachable("Order", "0", ["neighbour"], max_hops=6).agg(F.max("id")).first()[0]
    forward = a.can_reach(("Order", "0"), ("Order", target), ["neighbour"], max_hops=6).first()[0]
    backward = a.can_reach(("Order", "0"), ("Order", target), ["neighbour"], "in", max_hops=6).first()[0]
    return s.spark.createDataFrame([(target, forward, backward)], "target string, forward boolean, backward boolean")


def _lightest_sql(source: str, target: str, rounds: int) -> str:
    steps = [f"b0 AS (SELECT '{source}' AS n, 0.0::DOUBLE AS d)"]
    steps += [f"b{i} AS MATERIALIZED (SELECT n, min(d) AS d FROM (SELECT n, d FROM b{i - 1} UNION ALL SELECT b, d + w FROM b{i - 1} JOIN ub ON a = n) GROUP BY n)" for i in range(1, rounds + 1)]
    return f"WITH {_NB}, {', '.join(steps)} SELECT d AS total_weight, d AS along_edges FROM b{rounds} WHERE n = '{target}'"


@query(_lightest_sql("0", "1001", 40))
def algo_weighted_shortest_path(s: GraphStore) -> DataFrame:
    """The weight of the lightest path, and the same again from the edges along it."""
    path = Algorithms(s).weighted_shortest_path(("Order", "0"), ("Order", "1001"), ["neighbour"], "weight", "both")
    ends = s.edges(["neighbour"]).select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), F.col("p__weight").alias("w"))
    ends = ends.unionAll(ends.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.min("w").alias("w"))
    hops = path.select(F.col("id").alias("a"), (F.col("position") + 1).alias("p")).join(path.select(F.col("id").alias("b"), F.col("position").alias("p")), "p")
    along = hops.join(ends, ["a", "b"]).agg(F.sum("w").alias("along_edges"))
    return path.select("total_weight").distinct().withColumn("along_edges", along.scalar())


@query("SELECT id::VARCHAR AS id, kind, count(*) AS degree FROM (SELECT o_custkey AS id, 'Customer' AS kind FROM orders UNION ALL SELECT o_orderkey, 'Order' FROM orders) GROUP BY 1, 2")
def algo_degree(s: GraphStore) -> DataFrame:
    return Algorithms(s).degree(["placed"])


@query("""WITH e AS (SELECT c_custkey AS a, c_nationkey AS n FROM customer), nodes AS (SELECT 'Nation' AS kind, n_nationkey AS id, n_nationkey AS g FROM nation UNION ALL SELECT 'Customer', a, n FROM e),
c AS (SELECT *, min(id::VARCHAR) OVER (PARTITION BY g) AS component_id, count(*) OVER (PARTITION BY g) AS size FROM nodes)
SELECT id::VARCHAR AS id, kind, component_id, first_value(kind) OVER (PARTITION BY g ORDER BY id::VARCHAR, kind) AS component_kind, size FROM c""")
def algo_wcc(s: GraphStore) -> DataFrame:
    return Algorithms(s).weakly_connected_components(["customerIn"])


def _cdlp_sql(rounds: int) -> str:
    steps = [f"{_NB}, l0 AS (SELECT o_orderkey::VARCHAR AS x, o_orderkey::VARCHAR AS l FROM orders), e AS MATERIALIZED (SELECT DISTINCT a, b FROM ub)"]
    for i in range(rounds):
        steps.append(f"l{i + 1} AS MATERIALIZED (SELECT o.x, coalesce(v.l, o.l) AS l FROM l{i} o LEFT JOIN (SELECT a, l FROM (SELECT a, l, row_number() OVER (PARTITION BY a ORDER BY count(*) DESC, l) AS r FROM e JOIN l{i} ON b = x GROUP BY a, l) WHERE r = 1) v ON v.a = o.x)")
    return f"WITH {', '.join(steps)} SELECT x AS id, 'Order' AS kind, l AS label_id, 'Order' AS label_kind FROM l{rounds}"


@query(_cdlp_sql(5))
def algo_label_propagation(s: GraphStore) -> DataFrame:
    return Algorithms(s).label_propagation(["neighbour"], max_iterations=5, on_max="return")


def _pagerank_sql(rounds: int, damping: float, seed: str) -> str:
    """Scores times a million, by rounds that give the mass of nodes without a way out to the jumps."""
    steps = [f"{_NB}, p AS (SELECT o_orderkey::VARCHAR AS x, {seed} AS p FROM orders), o AS (SELECT a, count(*) AS k FROM nb GROUP BY a), s0 AS (SELECT x, 1.0::DOUBLE / (SELECT count(*) FROM orders) AS s FROM p)"]
    for i in range(rounds):
        lost = f"(SELECT coalesce(sum(s), 0) FROM s{i} WHERE x NOT IN (SELECT a FROM o))"
        got = f"(SELECT b, sum(s / k) AS g FROM nb JOIN s{i} ON x = a JOIN o USING (a) GROUP BY b)"
        steps.append(f"s{i + 1} AS MATERIALIZED (SELECT p.x, p.p * ({1 - damping} + {damping} * {lost}) + {damping} * coalesce(g, 0) AS s FROM p LEFT JOIN {got} ON b = p.x)")
    return f"WITH {', '.join(steps)} SELECT x AS id, 'Order' AS kind, round(s * 1e6, 4) AS score FROM s{rounds}"


@query(_pagerank_sql(45, 0.6, "1.0::DOUBLE / (SELECT count(*) FROM orders)"))
def algo_page_rank(s: GraphStore) -> DataFrame:
    return Algorithms(s).page_rank(["neighbour"], damping=0.6, tolerance=1e-12).withColumn("score", F.round(F.col("score") * 1e6, 4))


@query(_pagerank_sql(45, 0.6, "CASE o_orderkey WHEN 0 THEN 0.75 WHEN 7 THEN 0.25 ELSE 0 END"))
def algo_personalized_page_rank(s: GraphStore) -> DataFrame:
    return Algorithms(s).personalized_page_rank({("Order", "0"): 3.0, ("Order", "7"): 1.0}, ["neighbour"], damping=0.6, tolerance=1e-12).withColumn("score", F.round(F.col("score") * 1e6, 4))


@query("SELECT 'node' AS what, count(*) AS n FROM (SELECT c_custkey FROM customer WHERE c_custkey = 8 UNION ALL SELECT o_orderkey FROM orders WHERE o_custkey = 8 UNION ALL SELECT DISTINCT l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey = 8) UNION ALL SELECT 'edge', count(*) FROM (SELECT o_orderkey FROM orders WHERE o_custkey = 8 UNION ALL SELECT l_orderkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey = 8)")
def algo_subgraph(s: GraphStore) -> DataFrame:
    nodes, edges = Algorithms(s).subgraph(("Customer", "8"), ["placed", "contains"])
    return nodes.agg(F.lit("node").alias("what"), F.count("*").alias("n")).unionAll(edges.agg(F.lit("edge").alias("what"), F.count("*").alias("n")))


# Search
_VEC = [0.1 * ((i % 7) - 3) for i in range(64)]
_Q = "[" + ", ".join(repr(x) for x in _VEC) + "]"
_DOT = f"list_sum(list_transform(list_zip(embedding, {_Q}), lambda z: z[1]::DOUBLE * z[2]))"
_NORM = "sqrt(list_sum(list_transform(embedding, lambda z: z::DOUBLE * z)))"
_COS = f"1 - {_DOT} / ({_NORM} * {sum(x * x for x in _VEC) ** 0.5!r})"
_L2 = f"sqrt(list_sum(list_transform(list_zip(embedding, {_Q}), lambda z: (z[1]::DOUBLE - z[2]) ** 2)))"


@query(f"SELECT vec_id::VARCHAR AS id, round(1 - ({_COS}), 6) AS score FROM embeddings ORDER BY {_COS}, id LIMIT 10")
def vector_cosine(s: GraphStore) -> DataFrame:
    return StoreSearch(s).vector("Vector", "embedding", _VEC).select("id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id::VARCHAR AS id, round({_L2}, 6) AS score FROM embeddings ORDER BY {_L2}, id LIMIT 10")
def vector_l2(s: GraphStore) -> DataFrame:
    return StoreSearch(s).vector("Vector", "embedding", _VEC, metric="l2").select("id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id::VARCHAR AS id, round(-({_DOT}), 6) AS score FROM embeddings WHERE label <> 3 ORDER BY {_DOT} DESC, id LIMIT 10")
def vector_inner_product(s: GraphStore) -> DataFrame:
    return StoreSearch(s).vector("Vector", "embedding", _VEC, metric="inner_product", where=lambda n: n.label.neq(3)).select("id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id::VARCHAR AS id FROM embeddings WHERE 1 - ({_COS}) >= 0.05 ORDER BY {_COS}, id LIMIT 25")
def vector_query_min_score(s: GraphStore) -> DataFrame:
    q = s.query().from_("Vector", "v").where_node("v", lambda n: n.embedding.similar_to(_VEC, 25, min_score=0.05)).select({"id": ("v", "id")})
    return q.to_df().select("id")


_NEAR = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(f"SELECT a.vec_id::VARCHAR AS query, b.vec_id::VARCHAR AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY 1 - {_NEAR}, b.vec_id::VARCHAR) AS rank, round({_NEAR}, 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 QUALIFY rank <= 10")
def vector_nearest_to_each(s: GraphStore) -> DataFrame:
    """Exactly, every row against each whose id is divisible by 50."""
    rows = s.nodes(["Vector"]).select("kind", "id", F.col("p__embedding").alias("vector"))
    found = ann.nearest_to_each(rows, rows.where(F.col("id").cast("long") % 50 == 0).select(F.col("id").alias("query"), "vector"))
    return found.select("query", "id", F.col("rank").cast("long").alias("rank"), F.round(1 - F.col("distance"), 6).alias("score"))


def _approximate(s: GraphStore) -> DataFrame:
    rows = s.nodes(["Vector"]).where(F.col("id").cast("long") % 50 == 0)
    return StoreSearch(s).vectors("Vector", "embedding").search_all(rows.select(F.col("id").alias("query"), F.col("p__embedding").alias("vector")))


@query()
def vector_ann(s: GraphStore) -> DataFrame:
    """The same by the index; tests hold it against brute force."""
    return _approximate(s).select("query", "id", F.col("rank").cast("long").alias("rank"), F.round(1 - F.col("distance"), 6).alias("score"))


@query("SELECT count(*) AS queries, true AS reached FROM embeddings WHERE vec_id % 50 = 0")
def vector_ann_recall(s: GraphStore) -> DataFrame:
    """Whether the index finds nine of ten true neighbours or more, over all queries."""
    exact = vector_nearest_to_each(s).select("query", "id")
    both = exact.join(_approximate(s).select("query", "id", F.lit(1).alias("hit")), ["query", "id"], "left")
    return both.agg(F.count_distinct("query").alias("queries"), (F.count("hit") >= 0.9 * F.count("*")).alias("reached"))


_TOKENS = "list_filter(string_split(regexp_replace(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '')"


def _bm25(terms: list[str], holds: str, k: int, extra: str = "") -> str:
    """``word*`` stands for all words that begin so."""
    name = lambda t: t.replace("*", "_all")
    of = lambda t: f"starts_with(x, '{t[:-1]}')" if t.endswith("*") else f"x = '{t}'"
    tf = lambda t: f"len(list_filter(tok, lambda x: {of(t)}))::DOUBLE"
    idf = lambda t: f"ln(1 + (n - d_{name(t)} + 0.5) / (d_{name(t)} + 0.5))"
    parts = " + ".join(f"{idf(t)} * {tf(t)} * 2.2 / ({tf(t)} + 1.2 * (0.25 + 0.75 * len(tok) / size))" for t in terms)
    counts = ", ".join(f"sum(({tf(t)} > 0)::INT)::BIGINT AS d_{name(t)}" for t in terms)
    return f"WITH t AS (SELECT doc_id::VARCHAR AS id, lang, {_TOKENS} AS tok FROM documents), u AS (SELECT *, ' ' || array_to_string(tok, ' ') || ' ' AS line FROM t WHERE len(tok) > 0), c AS (SELECT count(*) AS n, avg(len(tok)) AS size, {counts} FROM u) SELECT id, round({parts}, 5) AS score FROM u CROSS JOIN c WHERE {holds} {extra} ORDER BY {parts} DESC, id LIMIT {k}"


def _porter_sql(words: str) -> str:
    """CTEs that give ``stems`` (w, s): the words of the CTE ``words`` (w) with Porter's stems, one step each by regular expressions. A y that begins a word is
    written Y, so that it counts as a consonant."""
    con, vow = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
    m0, m1, one, vowel, cvc = f"^({con})?{vow}{con}", f"^({con})?{vow}{con}{vow}{con}", f"^({con})?{vow}{con}({vow})?$", f"^({con})?[aeiouy]", f"^{con}[aeiouy][^aeiouwxy]$"
    has = lambda x, r: f"regexp_matches({x}, '{r}')"

    def swap(rules: dict[str, str], above: str) -> str:
        cases = []
        for end in sorted(rules, key=len, reverse=True):
            rest = f"s[:-{len(end) + 1}]"
            more = f" AND right({rest}, 1) IN ('s', 't')" if end == "ion" else ""
            cases.append(f"WHEN s LIKE '%{end}' THEN CASE WHEN {has(rest, above)}{more} THEN {rest} || '{rules[end]}' ELSE s END")
        return "CASE " + " ".join(cases) + " ELSE s END"

    cut = "regexp_replace(s, '(ed|ing)$', '')"
    steps = [
        "CASE WHEN regexp_matches(s, '(ss|i)es$') THEN s[:-3] WHEN regexp_matches(s, '[^s]s$') THEN s[:-2] ELSE s END",
        f"CASE WHEN s LIKE '%eed' THEN CASE WHEN {has('s[:-4]', m0)} THEN s[:-2] ELSE s END WHEN regexp_matches(s, '(ed|ing)$') AND {has(cut, vowel)} THEN {cut} || '+' ELSE s END",
        f"CASE WHEN s NOT LIKE '%+' THEN s WHEN regexp_matches(s, '(at|bl|iz).$') THEN s[:-2] || 'e' WHEN s[-2] = s[-3] AND s[-2] NOT IN ('a', 'e', 'i', 'o', 'u', 'l', 's', 'z') THEN s[:-3] WHEN {has('s[:-2]', one)} AND {has('s[:-2]', cvc)} THEN s[:-2] || 'e' ELSE s[:-2] END",
        f"CASE WHEN s LIKE '%y' AND {has('s[:-2]', vowel)} THEN s[:-2] || 'i' ELSE s END",
        swap(ft._STEP_2, m0), swap(ft._STEP_3, m0), swap(ft._STEP_4, m1),
        f"CASE WHEN s LIKE '%e' AND ({has('s[:-2]', m1)} OR ({has('s[:-2]', one)} AND NOT {has('s[:-2]', cvc)})) THEN s[:-2] ELSE s END",
        f"CASE WHEN s LIKE '%ll' AND {has('s', m1)} THEN s[:-2] ELSE s END",
    ]
    made = [f"s0 AS (SELECT w, regexp_replace(w, '^y', 'Y') AS s FROM {words} WHERE regexp_matches(w, '^[a-z]{{3,}}$'))"]
    made += [f"s{i} AS (SELECT w, {step} AS s FROM s{i - 1})" for i, step in enumerate(steps, 1)]
    return ", ".join(made) + f", stems AS (SELECT w, lower(s) AS s FROM s{len(steps)} UNION ALL SELECT w, w FROM {words} WHERE NOT regexp_matches(w, '^[a-z]{{3,}}$'))"


def _stemmed_sql(stems: list[str], k: int) -> str:
    """The best of the texts that have all these stems."""
    tf = [f"t{i}" for i in range(len(stems))]
    parts = " + ".join(f"ln(1 + (n - d{t} + 0.5) / (d{t} + 0.5)) * {t} * 2.2 / ({t} + 1.2 * (0.25 + 0.75 * size / average))" for t in tf)
    return (
        f"WITH tok AS (SELECT doc_id::VARCHAR AS id, unnest({_TOKENS}) AS w FROM documents), words AS (SELECT DISTINCT w FROM tok), {_porter_sql('words')}, "
        f"d AS (SELECT id, count(*) AS size, {', '.join(f'count(*) FILTER (s = {chr(39)}{x}{chr(39)})::DOUBLE AS {t}' for x, t in zip(stems, tf, strict=True))} FROM tok JOIN stems USING (w) GROUP BY id), "
        f"c AS (SELECT count(*) AS n, avg(size) AS average, {', '.join(f'count(*) FILTER ({t} > 0) AS d{t}' for t in tf)} FROM d) "
        f"SELECT id, round({parts}, 5) AS score FROM d CROSS JOIN c WHERE {' AND '.join(f'{t} > 0' for t in tf)} ORDER BY {parts} DESC, id LIMIT {k}"
    )


def _texts(s: GraphStore, language: str | None = None) -> StoreSearch:
    """A search over the documents' index, which is built once for a folder and application."""
    return StoreSearch(s).ensure_fulltext("Document", language)


@query(_bm25(["the", "idiot"], "list_contains(tok, 'the') AND list_contains(tok, 'idiot')", 10))
def fulltext_plain(s: GraphStore) -> DataFrame:
    return _texts(s).fulltext("Document", "the Idiot", mode="plain").select("id", F.round("score", 5).alias("score"))


@query(_bm25(["of", "the"], "contains(line, ' of the ')", 12))
def fulltext_phrase(s: GraphStore) -> DataFrame:
    return _texts(s).fulltext("Document", "of the", 12, mode="phrase").select("id", F.round("score", 5).alias("score"))


@query(_bm25(["der", "scum"], "(list_contains(tok, 'scum') AND NOT list_contains(tok, 'loser')) OR list_contains(tok, 'der')", 15))
def fulltext_websearch(s: GraphStore) -> DataFrame:
    return _texts(s).fulltext("Document", "scum -loser OR der", 15).select("id", F.round("score", 5).alias("score"))


@query(_bm25(["moron"], "list_contains(tok, 'moron')", 8, "AND lang = 'en'"))
def fulltext_where(s: GraphStore) -> DataFrame:
    return _texts(s).fulltext("Document", "moron", 8, where=lambda n: n.lang.eq("en")).select("id", F.round("score", 5).alias("score"))


@query(_bm25(["mor*", "scum", "the"], "(list_contains(tok, 'scum') OR len(list_filter(tok, lambda x: starts_with(x, 'mor'))) > 0) AND NOT (list_contains(tok, 'loser') OR contains(line, ' of the ')) AND list_contains(tok, 'the')", 20))
def fulltext_raw(s: GraphStore) -> DataFrame:
    """Parentheses, NOT before a group, a word's beginning."""
    return _texts(s).fulltext("Document", '(scum OR mor*) NOT (loser OR "of the") AND the', 20, mode="raw").select("id", F.round("score", 5).alias("score"))


@query(_stemmed_sql(["and", "the"], 25))
def fulltext_stemmed(s: GraphStore) -> DataFrame:
    """Ands, anded and anding are one word where the language is english."""
    return _texts(s, "english").fulltext("Document", "thes anding", 25, mode="plain", language="english").select("id", F.round("score", 5).alias("score"))


@query("SELECT id, count(*) AS n FROM (SELECT doc_id::VARCHAR AS id, unnest(" + _TOKENS + ") AS w FROM documents) WHERE starts_with(w, 'id') GROUP BY id")
def fulltext_postings(s: GraphStore) -> DataFrame:
    """Occurrences of words with a given beginning, straight from the index."""
    index = _texts(s).store.indexes["Document", "simple", s.coordinate]
    return index._read([ft.Term("id", True)]).groupBy("id").agg(F.sum("tf").alias("n"))


_PASSAGES = _bm25(["der", "scum"], "list_contains(tok, 'scum') OR list_contains(tok, 'der')", 20).replace("FROM documents)", "FROM documents JOIN embeddings ON doc_id = vec_id)")
_PV = f"SELECT vec_id::VARCHAR AS id, row_number() OVER (ORDER BY {_COS}, vec_id::VARCHAR) AS o FROM embeddings JOIN documents ON doc_id = vec_id QUALIFY o <= 20"


@query(f"WITH f AS (SELECT id, row_number() OVER () AS o FROM ({_PASSAGES})), v AS ({_PV}) SELECT 'Passage' AS kind, coalesce(v.id, f.id) AS id, round(coalesce(1.0 / (60 + v.o), 0) + coalesce(1.0 / (60 + f.o), 0), 8) AS score FROM v FULL JOIN f ON v.id = f.id ORDER BY coalesce(1.0 / (60 + v.o), 0) + coalesce(1.0 / (60 + f.o), 0) DESC, 2 LIMIT 10")
def hybrid_text_vector(s: GraphStore) -> DataFrame:
    return StoreSearch(s).hybrid("Passage", "embedding", _VEC, "scum OR der", 10, per_source=20).withColumn("score", F.round("score", 8))


@query(f"SELECT id FROM ({_bm25(['moron'], 'list_contains(tok, chr(109) || chr(111) || chr(114) || chr(111) || chr(110))', 6)})")
def fulltext_in_query(s: GraphStore) -> DataFrame:
    q = s.query().from_("Document", "d").where_node("d", lambda n: n.fulltext.matches("moron", k=6)).select({"id": ("d", "id")})
    return q.to_df().select("id")


@query("SELECT true AS marked, true AS short")
def fulltext_snippet(s: GraphStore) -> DataFrame:
    out = _texts(s).fulltext("Document", "moron", 5, snippets=True)
    return out.agg(F.min(F.lower("snippet").contains("<mark>moron</mark>")).alias("marked"), (F.max(F.char_length("snippet")) < 400).alias("short"))


_VR = f"SELECT vec_id::VARCHAR AS id, row_number() OVER (ORDER BY {_COS}, vec_id::VARCHAR) AS o FROM embeddings QUALIFY o <= 20"


@query(f"WITH v AS ({_VR}), w AS (SELECT vec_id::VARCHAR AS id, row_number() OVER (ORDER BY {_L2}, vec_id::VARCHAR) AS o FROM embeddings QUALIFY o <= 20) SELECT 'Vector' AS kind, coalesce(v.id, w.id) AS id, round(coalesce(2.0 / (60 + v.o), 0) + coalesce(1.0 / (60 + w.o), 0), 8) AS score FROM v FULL JOIN w ON v.id = w.id ORDER BY coalesce(2.0 / (60 + v.o), 0) + coalesce(1.0 / (60 + w.o), 0) DESC, 2 LIMIT 10")
def hybrid_rrf(s: GraphStore) -> DataFrame:
    from ..operators.search import fuse

    f = StoreSearch(s)
    return fuse(f.vector("Vector", "embedding", _VEC, 20), f.vector("Vector", "embedding", _VEC, 20, "l2"), 10, 60, 2.0, 1.0).withColumn("score", F.round("score", 8))


# Identity: a supplier is the customer of the same key; where nine divides the key, also the customer of the next one. Where ten leaves three, it is not the customer of the next but one
def _identity(s: GraphStore) -> Identity:
    k = F.col("id").cast("long")
    suppliers = s.frames["Supplier"].select(k.alias("k"))

    def said(rows: DataFrame, rel: str, a_kind: str, step: int) -> DataFrame:
        text = lambda c: c.cast("string")
        return rows.select(F.lit(rel).alias("rel"), F.lit(a_kind).alias("a_kind"), text(F.col("k")).alias("a_id"), F.lit("Customer").alias("b_kind"), text(F.col("k") + step).alias("b_id"))

    rows = said(suppliers, "same", "Supplier", 0).unionAll(said(suppliers.where("k % 9 = 0"), "same", "Customer", 1)).unionAll(said(suppliers.where("k % 10 = 3"), "different", "Supplier", 2))
    null = F.lit(None).cast("timestamp")
    rows = rows.select(F.concat_ws("|", "rel", "a_kind", "a_id", "b_kind", "b_id").alias("id"), "*", null.alias("valid_from"), null.alias("valid_to"), null.alias("deleted_at"))
    store = s.at(s.coordinate)
    store.assertions = rows
    assert set(rows.columns) == {x.split()[0] for x in ASSERTIONS.split(", ")}
    return Identity(store)


_GROUP = "cls AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 9 = 0 AND c_custkey IN (SELECT s_suppkey FROM supplier) THEN c_custkey WHEN c_custkey % 9 = 1 AND c_custkey - 1 IN (SELECT s_suppkey FROM supplier) THEN c_custkey - 1 ELSE c_custkey END AS g FROM customer), cid AS (SELECT k, g, min(k::VARCHAR) OVER (PARTITION BY g) AS class_id FROM cls)"


@query(f"WITH {_GROUP} SELECT 'Customer' AS kind, k::VARCHAR AS id, 'Customer' AS class_kind, class_id FROM cid UNION ALL SELECT 'Supplier', s_suppkey::VARCHAR, 'Customer', class_id FROM supplier JOIN cid ON k = s_suppkey")
def identity_classes(s: GraphStore) -> DataFrame:
    return _identity(s).classes(["Customer", "Supplier"])


@query(f"WITH {_GROUP}, m AS (SELECT k FROM cls WHERE g = (SELECT g FROM cls WHERE k = 9)) SELECT 'Customer' AS kind, k::VARCHAR AS id FROM m UNION ALL SELECT 'Supplier', s_suppkey::VARCHAR FROM supplier JOIN m ON k = s_suppkey")
def identity_members(s: GraphStore) -> DataFrame:
    return _identity(s).members_of("Supplier", "9")


@query(f"WITH {_GROUP}, a AS (SELECT x.g AS p, y.g AS q FROM supplier JOIN cls x ON x.k = s_suppkey JOIN cls y ON y.k = s_suppkey + 2 WHERE s_suppkey % 10 = 3) SELECT x.s_suppkey::VARCHAR AS a_id, y.s_suppkey::VARCHAR AS b_id, EXISTS (SELECT 1 FROM a JOIN cls u ON u.k = x.s_suppkey JOIN cls v ON v.k = y.s_suppkey WHERE (p = u.g AND q = v.g) OR (p = v.g AND q = u.g)) AS different FROM supplier x JOIN supplier y ON y.s_suppkey = x.s_suppkey + 2")
def identity_different(s: GraphStore) -> DataFrame:
    """Each supplier against the next but one, as customer and as supplier."""
    one = s.frames["Supplier"].select(F.col("id").alias("b_id"))
    pairs = s.frames["Supplier"].select(F.col("id").alias("a_id"), (F.col("id").cast("long") + 2).cast("string").alias("b_id")).join(one, "b_id", "left_semi")
    pairs = pairs.select(F.lit("Customer").alias("a_kind"), "a_id", F.lit("Supplier").alias("b_kind"), "b_id")
    return _identity(s).are_different(pairs).select("a_id", "b_id", "different")


@query(f"WITH {_GROUP} SELECT s_suppkey::VARCHAR AS supplier, count(*) AS n FROM supplier JOIN cls x ON x.k = s_suppkey JOIN cls y ON y.g = x.g JOIN orders ON o_custkey = y.k GROUP BY 1")
def identity_hop(s: GraphStore) -> DataFrame:
    q = _identity(s).store.query().from_("Supplier", "s").traverse("placed", "e", identity=True).to("Order", "o")
    return q.group_by_node("s").aggregate({"supplier": ("s", "id"), "n": count("o")}).to_df()


# Provenance: part p is a fact supported by each supplier (source) that ships it; brands are facts that need two parts
def _provenance(s: GraphStore) -> tuple[Provenance, DataFrame]:
    sources = s.frames["Supplier"].select(F.concat(F.lit("s"), "id").alias("id"), F.lit(None).cast("boolean").alias("retracted"))
    ships = s.edge_frames["supplies"].select("from_id", "to_id")
    just = F.concat_ws("-", F.lit("j"), "from_id", "to_id")
    premises = ships.select(just.alias("justification"), F.concat(F.lit("s"), "from_id").alias("premise"))
    derives = ships.select(just.alias("justification"), F.concat(F.lit("p"), "to_id").alias("fact"))
    parts = s.frames["Part"].select("id", F.concat(F.lit("b"), "brand").alias("brand"))
    need = parts.groupBy("brand").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    both = need.select(F.concat(F.lit("jb"), "brand").alias("justification"), "brand", F.explode(F.array(F.concat(F.lit("p"), "low"), F.concat(F.lit("p"), "high"))).alias("premise")).distinct()
    p = Provenance(sources, premises.unionAll(both.select("justification", "premise")), derives.unionAll(both.select("justification", F.col("brand").alias("fact")).distinct()))
    return p, sources.where(F.expr("int(substring(id, 2, 20)) % 2") == 0).select("id")


_HELD = "WITH held AS (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE {w}), b AS (SELECT p_brand, min(p_partkey::VARCHAR) AS a, max(p_partkey::VARCHAR) AS z FROM part GROUP BY 1), now AS (SELECT 'p' || p AS id FROM held UNION ALL SELECT 'b' || p_brand FROM b WHERE a IN (SELECT p::VARCHAR FROM held) AND z IN (SELECT p::VARCHAR FROM held))"


@query(_HELD.format(w="l_suppkey % 2 <> 0") + " SELECT id FROM now")
def provenance_holding(s: GraphStore) -> DataFrame:
    p, even = _provenance(s)
    return p.holding(retracted=even)


@query(_HELD.format(w="true").replace("now AS", "was AS") + ", " + _HELD.format(w="l_suppkey % 2 <> 0").removeprefix("WITH ").replace("held", "left_").replace("b AS (", "b2 AS (").replace("FROM b WHERE", "FROM b2 WHERE") + """,
hit AS (SELECT DISTINCT 'p' || l_partkey AS id FROM lineitem WHERE l_suppkey % 2 = 0), down AS (SELECT id FROM hit UNION SELECT 'b' || p_brand FROM b WHERE 'p' || a IN (SELECT id FROM hit) OR 'p' || z IN (SELECT id FROM hit))
SELECT CASE WHEN id IN (SELECT id FROM was) AND id NOT IN (SELECT id FROM now) THEN 'died' WHEN id IN (SELECT id FROM was) THEN 'survived' ELSE 'unaffected' END AS outcome, count(*) AS n FROM down GROUP BY 1""")
def provenance_retract(s: GraphStore) -> DataFrame:
    p, even = _provenance(s)
    return p.retract(even)[1].groupBy("outcome").agg(F.count("*").alias("n"))


# Merge: branch a changes balances of some customers and drops others; branch b renames some and adds new ones
def _branches(s: GraphStore) -> tuple[DataFrame, DataFrame, DataFrame]:
    base = mg.canonical(s, ["Customer"])
    k = F.col("id").cast("long")
    put = lambda name, value: F.map_concat(F.map_filter("props", lambda n, _: n != name), F.create_map(F.lit(name), value))
    a = base.where(k % 11 != 3).withColumn("props", F.when(k % 7 == 0, put("acctbal", F.lit('{"v":1.0}'))).otherwise(F.col("props")))
    renamed = F.when(k % 11 == 3, put("name", F.lit('{"v":"kept"}'))).when(k % 14 == 0, put("acctbal", F.lit('{"v":2.0}'))).otherwise(F.col("props"))
    b = base.withColumn("props", renamed)
    extra = base.where(k % 50 == 0).withColumn("id", F.concat(F.lit("new"), "id"))
    return base, a, b.unionByName(extra)


@query("SELECT 'a' AS branch, CASE WHEN c_custkey % 11 = 3 THEN 'deleted' ELSE 'modified' END AS change, count(*) AS n FROM customer WHERE c_custkey % 11 = 3 OR c_custkey % 7 = 0 GROUP BY 1, 2 UNION ALL SELECT 'b', 'modified', count(*) FROM customer WHERE c_custkey % 11 = 3 OR c_custkey % 14 = 0 UNION ALL SELECT 'b', 'new', count(*) FROM customer WHERE c_custkey % 50 = 0")
def merge_diff(s: GraphStore) -> DataFrame:
    base, a, b = _branches(s)
    both = mg.diff(base, a).withColumn("branch", F.lit("a")).unionByName(mg.diff(base, b).withColumn("branch", F.lit("b")))
    return both.groupBy("branch", "change").agg(F.count("*").alias("n"))


def _changes(s: GraphStore) -> DataFrame:
    base, a, b = _branches(s)
    return mg.diff(base, a).withColumn("branch", F.lit("a")).withColumn("rank", F.lit(0)).unionByName(mg.diff(base, b).withColumn("branch", F.lit("b")).withColumn("rank", F.lit(1)))


@query("SELECT c_custkey::VARCHAR AS id, 'acctbal' AS property, '1.0,2.0' AS vals FROM customer WHERE c_custkey % 14 = 0 AND c_custkey % 11 <> 3")
def merge_conflicts(s: GraphStore) -> DataFrame:
    _, conflicts = mg.merged_props(_changes(s).where("change in ('new', 'modified')"))
    return conflicts.select("id", "property", F.concat_ws(",", F.transform("values", lambda v: F.regexp_extract(v, "([0-9.]+)", 1))).alias("vals"))


def _value(name: str) -> Any:
    return F.from_json(F.try_element_at("props", F.lit(name)), "v double" if name == "acctbal" else "v string")["v"]


_ACCTBAL = "CASE WHEN c_custkey % 11 = 3 THEN c_acctbal WHEN c_custkey % 14 = 0 THEN 2.0 WHEN c_custkey % 7 = 0 THEN 1.0 ELSE c_acctbal END::DOUBLE AS acctbal"


@query(f"SELECT c_custkey::VARCHAR AS id, {_ACCTBAL} FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 11 = 3")
def merge_last_write_wins(s: GraphStore) -> DataFrame:
    props, _ = mg.merged_props(_changes(s).where("change = 'modified'"), "lastWriteWins")
    return props.select("id", _value("acctbal").alias("acctbal"))


@query("SELECT c_custkey::VARCHAR AS id, 'kept' AS outcome FROM customer WHERE c_custkey % 11 = 3")
def merge_delete_modify(s: GraphStore) -> DataFrame:
    return mg.delete_modify(_changes(s), "modifyWins").select("id", "outcome")


@query("SELECT ('new' || c_custkey)::VARCHAR AS id, c_custkey::VARCHAR AS to_id FROM customer WHERE c_custkey % 50 = 0 AND c_custkey % 11 <> 3")
def merge_resolve(s: GraphStore) -> DataFrame:
    base, a, b = _branches(s)
    edges = s.edges(["placed"]).select("id", "kind", "from_kind", "from_id", "to_kind", "to_id")
    plan = mg.plan_merge(base, {"a": a, "b": b}, edges, mg.Options(0.999, block=lambda: F.col("text"), delete_policy="modifyWins"))
    return plan.survivors.where("id <> to_id").select("id", "to_id")


def _by_name() -> mg.Options:
    return mg.Options(0.999, policy="lastWriteWins", block=lambda: F.col("text"), delete_policy="modifyWins")


_APPLIED = f"SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 11 = 3 THEN 'kept' ELSE c_name END AS name, {_ACCTBAL} FROM customer UNION ALL SELECT 'new' || c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 50 = 0 AND c_custkey % 11 = 3"


@query(_APPLIED)
def merge_apply(s: GraphStore) -> DataFrame:
    base, a, b = _branches(s)
    edges = s.edges(["placed"]).select("id", "kind", *mg.ENDS)
    nodes, _ = mg.apply(base, mg.plan_merge(base, {"a": a, "b": b}, edges, _by_name()))
    return nodes.select("id", _value("name").alias("name"), _value("acctbal").alias("acctbal"))


@query(_APPLIED)
def merge_incremental(s: GraphStore) -> DataFrame:
    """Branch a is merged, then b, which was taken from the same base."""
    base, a, b = _branches(s)
    edges = s.edges(["placed"]).select("id", "kind", *mg.ENDS)
    main, edges = mg.apply(base, mg.plan_merge(base, {"a": a}, edges, _by_name()))
    nodes, _ = mg.apply(base, mg.merge_next(base, main, "b", b, edges, _by_name()))
    return nodes.select("id", _value("name").alias("name"), _value("acctbal").alias("acctbal"))


@query("SELECT o_orderkey::VARCHAR AS id, o_custkey::VARCHAR AS from_id FROM orders WHERE o_orderkey % 13 <> 0 OR o_orderkey % 26 = 0 UNION ALL SELECT 'e' || c_custkey, CASE WHEN c_custkey % 11 = 3 THEN 'new' ELSE '' END || c_custkey FROM customer WHERE c_custkey % 50 = 0")
def merge_edges(s: GraphStore) -> DataFrame:
    """Branch a drops some orders' edges, b closes half of those (a change, so they stay) and ties its new nodes to new ends."""
    base, a, b = _branches(s)
    edges = mg.canonical_edges(s, ["placed"])
    k = F.col("id").cast("long")
    dropped = edges.where(k % 13 != 0)
    ended = edges.withColumn("valid_to", F.when(k % 26 == 0, F.lit(dt.datetime(2020, 1, 1)).cast("timestamp")).otherwise(F.col("valid_to")))
    fresh = b.where("id like 'new%'").select(F.concat(F.lit("e"), F.expr("substring(id, 4, 20)")).alias("id"), F.lit("placed").alias("kind"), F.lit("Customer").alias("from_kind"), F.col("id").alias("from_id"), F.lit("Order").alias("to_kind"), F.concat(F.lit("x"), "id").alias("to_id"))
    plan = mg.plan_merge(base, {"a": a, "b": b}, edges, _by_name(), [dropped, ended.unionByName(fresh, allowMissingColumns=True)])
    return plan.edges.select("id", "from_id")


@query("SELECT 'kept' AS outcome, count(*) AS n FROM supplier WHERE s_suppkey % 10 <> 0 UNION ALL SELECT 'new', count(*) FROM supplier WHERE s_suppkey % 7 = 2 UNION ALL SELECT 'contradicted', count(*) FROM supplier WHERE s_suppkey % 7 = 3")
def merge_identity(s: GraphStore) -> DataFrame:
    """One branch drops every tenth assertion, the other says of new customers that turn out to be known ones: that they are another supplier too,
    that they are not the known one, and what is known already."""
    base = _identity(s).store.assertions.where("rel = 'same' and a_kind = 'Supplier'")
    k = s.frames["Supplier"].select(F.col("id").cast("long").alias("k"), "id")
    survivors = k.select(F.lit("Customer").alias("kind"), F.concat(F.lit("new"), "id").alias("id"), F.lit("Customer").alias("to_kind"), F.col("id").alias("to_id"))

    def fresh(where: str, rel: str, a_kind: str, a_id: Any, b_kind: str, b_id: Any) -> DataFrame:
        return k.where(where).select(F.concat(F.lit("z"), "id").alias("id"), F.lit(rel).alias("rel"), F.lit(a_kind).alias("a_kind"), a_id.alias("a_id"), F.lit(b_kind).alias("b_kind"), b_id.alias("b_id"))

    new, own = F.concat(F.lit("new"), "id"), F.col("id")
    said = fresh("k % 7 = 2", "same", "Supplier", F.concat(F.lit("x"), "id"), "Customer", new).unionByName(fresh("k % 7 = 3", "different", "Customer", new, "Customer", own))
    said = said.unionByName(fresh("k % 7 = 4 and k % 10 <> 0", "same", "Customer", new, "Supplier", own))
    rows, wrong = mg.merge_assertions(base, [base.where("int(a_id) % 10 <> 0"), base.unionByName(said, allowMissingColumns=True)], survivors)
    named = rows.select(F.when(F.col("id").startswith("z"), "new").otherwise("kept").alias("outcome")).unionAll(wrong.select(F.lit("contradicted")))
    return named.groupBy("outcome").agg(F.count("*").alias("n"))


@query("WITH o AS (SELECT s_suppkey::VARCHAR AS id, row_number() OVER (ORDER BY s_name, s_suppkey::VARCHAR) AS n FROM supplier) SELECT x.id AS a, y.id AS b FROM o x JOIN o y ON y.n BETWEEN x.n + 1 AND x.n + 5")
def merge_window_pairs(s: GraphStore) -> DataFrame:
    rows = s.nodes(["Supplier"]).select("kind", "id", F.col("p__name").alias("text"), F.lit(None).cast("array<double>").alias("vector"))
    return mg.window_pairs(rows, 5).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def _trigrams_sql(text: str) -> str:
    return f"list_transform(range(1, length({text}) + 1), lambda i: substr(' ' || lower({text}) || ' ', i, 3))"


def _numbered_sql(rows: str) -> str:
    """CTEs from ``rows`` (id, text): g (id, token, size), the trigrams of each text, equal ones numbered."""
    return f"t AS ({rows}), u AS (SELECT id, length(text) AS size, unnest({_trigrams_sql('text')}) AS x FROM t WHERE text <> ''), g AS (SELECT id, size, x || row_number() OVER (PARTITION BY id, x) AS token FROM u)"


@query(f"WITH {_numbered_sql('SELECT p_partkey AS id, p_name AS text FROM part')}, {_numbered_sql('SELECT p_partkey AS id, p_type AS text FROM part').replace('t AS', 't2 AS').replace('FROM t WHERE', 'FROM t2 WHERE').replace('u AS', 'u2 AS').replace('FROM u)', 'FROM u2)').replace('g AS', 'h AS')}, c AS (SELECT g.id, count(*) AS n FROM g JOIN h ON g.token = h.token AND g.id = h.id GROUP BY 1) SELECT p_partkey::VARCHAR AS id, round(2.0 * coalesce(n, 0) / (length(p_name) + length(p_type)), 6) AS score FROM part LEFT JOIN c ON id = p_partkey")
def merge_dice(s: GraphStore) -> DataFrame:
    """How alike each part's name and type are."""
    return s.frames["Part"].select("id", F.round(mg.dice(F.col("name"), F.col("type")), 6).alias("score"))


def _similar_sql(rows: str, threshold: float) -> str:
    """Pairs of different texts by all their common trigrams."""
    return f"WITH {_numbered_sql(rows)}, p AS (SELECT x.id AS a, y.id AS b, 2.0 * count(*) / (x.size + y.size) AS score FROM g x JOIN g y ON x.token = y.token AND x.id < y.id GROUP BY x.id, y.id, x.size, y.size) SELECT a, b, round(score, 6) AS score FROM p WHERE score >= {threshold} - 1e-12"


@query(_similar_sql("SELECT min(s_suppkey::VARCHAR) AS id, lower(s_name) AS text FROM supplier GROUP BY lower(s_name)", 0.85))
def merge_similar_names(s: GraphStore) -> DataFrame:
    """Suppliers whose names are alike, without blocks: by their rarest trigrams."""
    rows = s.frames["Supplier"].select(F.lit("Supplier").alias("kind"), "id", F.col("name").alias("text"))
    return mg.similar_links(rows, 0.85).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.round("score", 6).alias("score"))


@query("SELECT c_custkey::VARCHAR AS a, 'new' || c_custkey AS b FROM customer WHERE c_custkey % 50 = 0 AND c_custkey % 11 <> 3")
def merge_unique_links(s: GraphStore) -> DataFrame:
    """New customers of a branch that have the unique name of a known one."""
    _, _, b = _branches(s)
    links = mg.unique_links(s.graph, b.where(F.col("id").startswith("new") | (F.col("id").cast("long") % 11 != 3)))
    return links.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


# Writes and rules
@query("SELECT 'unique:name' AS constraint, c_mktsegment AS key, count(*) AS n FROM customer WHERE false GROUP BY 2 UNION ALL SELECT 'one', 'Customer|' || o_custkey, count(*) FROM orders GROUP BY 2 HAVING count(*) > 1")
def rules_violations(s: GraphStore) -> DataFrame:
    from dataclasses import replace

    from ..model import GraphDef

    g = s.graph
    strict = GraphDef(g.name, g.nodes.values(), [replace(e, cardinality="one") if e.name == "placed" else e for e in g.edges.values()], g.ontology.relations)
    store = GraphStore(s.spark, strict, s.frames, s.edge_frames, s.coordinate)
    return wr.violations(store, ["Region"], ["placed", "customerIn"]).select("constraint", "key", "n")


@query("SELECT r_regionkey::VARCHAR AS id, r_name AS name, 1 AS version FROM region UNION ALL SELECT '77', 'OCEANIA', 1")
def write_create(s: GraphStore) -> DataFrame:
    rows = s.spark.createDataFrame([("77", "OCEANIA")], "id string, name string")
    return wr.create(s, "Region", rows).nodes(["Region"]).select("id", F.col("p__name").alias("name"), "version")


@query("SELECT c_custkey::VARCHAR AS id, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS acctbal, CASE WHEN c_acctbal < 0 THEN 2 ELSE 1 END AS version FROM customer")
def write_update_where(s: GraphStore) -> DataFrame:
    out = wr.update_where(s, "Customer", lambda n: n.acctbal.lt(0), {"acctbal": F.lit(0.0)})
    return out.nodes(["Customer"]).select("id", F.col("p__acctbal").alias("acctbal"), "version")


@query("SELECT n_nationkey::VARCHAR AS id, CASE WHEN n_nationkey = 3 THEN 'changed' ELSE n_name END AS name, CASE WHEN n_nationkey = 3 THEN 2 ELSE 1 END AS version FROM nation UNION ALL SELECT '99', 'Atlantis', 1")
def write_upsert(s: GraphStore) -> DataFrame:
    same = s.frames["Nation"].where("id = '4'").select("id", "name")
    rows = s.spark.createDataFrame([("3", "changed"), ("99", "Atlantis")], "id string, name string").unionAll(same)
    return wr.upsert(s, "Nation", rows).nodes(["Nation"]).select("id", F.col("p__name").alias("name"), "version")


@query("SELECT count(*) FILTER (c_custkey % 10 <> 0) AS live, (SELECT count(*) FROM orders WHERE o_custkey % 10 <> 0) AS placed FROM customer")
def write_delete_cascade(s: GraphStore) -> DataFrame:
    from dataclasses import replace

    from ..model import GraphDef

    g = s.graph
    loose = GraphDef(g.name, [replace(k, on_delete="cascade") if k.name == "Customer" else k for k in g.nodes.values()], g.edges.values(), g.ontology.relations)
    store = GraphStore(s.spark, loose, s.frames, {k: s.edge_frames[k] for k in ("placed", "customerIn")}, s.coordinate)
    out = wr.delete(store, "Customer", s.frames["Customer"].where("int(id) % 10 = 0").select("id"))
    live = out.nodes(["Customer"]).agg(F.count("*").alias("live"))
    return live.withColumn("placed", out.edges(["placed"]).agg(F.count("*")).scalar())


@query("SELECT CASE WHEN n_nationkey = 3 THEN 'update' WHEN n_nationkey = 4 THEN 'delete' ELSE 'create' END AS op, CASE WHEN n_nationkey IN (3, 4) THEN 2 ELSE 0 END::BIGINT AS recorded_from, count(*) AS n FROM nation GROUP BY 1, 2 UNION ALL SELECT 'create', 0, 2")
def write_capture(s: GraphStore) -> DataFrame:
    before = s.nodes(["Nation"]).select("id", F.col("p__name").alias("name"), "deleted_at")
    gone = F.when(F.col("id") == "4", F.lit(dt.datetime(2024, 1, 1)).cast("timestamp"))
    after = before.withColumn("name", F.when(F.col("id") == "3", "x").otherwise(F.col("name"))).withColumn("deleted_at", gone)
    return wr.capture(None, before, after, 2).groupBy("op", "recorded_from", F.col("recorded_to").alias("t")).agg(F.count("*").alias("n")).drop("t")


@query("SELECT event_id::VARCHAR AS id, CASE WHEN value > 50 THEN value * 2 ELSE value END AS value, CASE WHEN value > 50 THEN 2 ELSE 1 END::INT AS version FROM events")
def write_update_edges(s: GraphStore) -> DataFrame:
    out = wr.update_edges(s, "performed", lambda e: e.value.gt(50), {"value": F.col("p__value") * 2})
    return out.edges(["performed"]).select("id", F.col("p__value").alias("value"), "version")


@query("SELECT event_id::VARCHAR AS id, event_type AS seen_by, CASE WHEN value > 50 THEN NULL ELSE json_extract_string(props, '$.k') END AS k FROM events")
def write_json_patch(s: GraphStore) -> DataFrame:
    """A member set two levels down, and one taken out where a value is large."""
    done = set_path(F.col("p__props"), ["seen", "by"], F.col("p__event_type"))
    out = wr.update_where(s, "Event", lambda e: e.event_type.is_not_null(), {"props": F.when(F.col("p__value") > 50, unset_path(done, ["k"])).otherwise(done)})
    read = lambda path: F.expr(f"try_variant_get(p__props, '{path}', 'string')")
    return out.nodes(["Event"]).select("id", read("$.seen.by").alias("seen_by"), read("$.k").alias("k"))


# Interchange
@query("SELECT 'Nation' AS kind, n_nationkey::VARCHAR AS id, n_name AS name, n_regionkey::VARCHAR AS region FROM nation")
def interchange_round_trip(s: GraphStore) -> DataFrame:
    lines = interchange.export_graph(s, ["Region", "Nation"], ["inRegion"])
    empty = GraphStore(s.spark, s.graph, {}, {}, s.coordinate)
    back = interchange.import_graph(empty, interchange.parse_lines(lines))
    q = back.query().from_("Nation", "n").traverse("inRegion", "e").to("Region", "r")
    return q.select({"kind": ("n", "kind"), "id": ("n", "id"), "name": ("n", "name"), "region": ("r", "id")}).to_df()


_ROWS = {"Region": "region", "Nation": "nation", "Customer": "customer", "Supplier": "supplier", "Part": "part", "Order": "orders", "Document": "documents", "Vector": "embeddings", "Event": "events", "Passage": "documents JOIN embeddings ON doc_id = vec_id", "User": "(SELECT DISTINCT user_id FROM events)", "EventType": "(SELECT DISTINCT event_type FROM events)"}
_LINES = {"inRegion": "nation", "customerIn": "customer", "supplierIn": "supplier", "placed": "orders", "contains": "lineitem", "supplies": "lineitem", "performed": "events", "neighbour": "nb"}


@query(f"WITH {_NB} " + " UNION ALL ".join(f"SELECT '{what}' AS what, '{k}' AS kind, count(*) AS rows, 0::BIGINT AS deleted FROM {t}" for what, of in (("node", _ROWS), ("edge", _LINES)) for k, t in of.items()) + " UNION ALL SELECT 'edge', 'openFor', count(*), count(*) FILTER (o_orderkey % 17 = 0) FROM orders")
def introspect(s: GraphStore) -> DataFrame:
    """Rows of every kind."""
    return s.introspect()
