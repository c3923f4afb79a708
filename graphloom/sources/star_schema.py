"""The star-schema tables as a property graph."""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import EdgeKind, GraphDef, NodeKind, Unique, struct
from ..store import GraphStore, LazyFrames
from ..temporal import Coordinate

#: "Now" of queries over these tables, so that results don't depend on the clock.
NOW = dt.datetime(2024, 1, 1)

GRAPH = GraphDef(
    "star",
    nodes=[
        NodeKind("Party", struct("name string, acctbal double")),
        NodeKind("Region", struct("name string"), unique=(Unique("name", ("name",), collation="caseInsensitive"),)),
        NodeKind("Nation", struct("name string")),
        NodeKind("Customer", struct("name string, acctbal double, mktsegment string"), unique=(Unique("name", ("name",)), Unique("party", ("name",), scope="kindWithSubClasses"))),
        NodeKind("Supplier", struct("name string, acctbal double")),
        NodeKind("Part", struct("name string, brand string, type string, size int, retailprice double")),
        NodeKind("Order", struct("status string, totalprice double, orderdate timestamp, priority string")),
        NodeKind("Document", struct("text string, lang string, source string, n_chars bigint"), searchable=("text",)),
        NodeKind("Vector", struct("label int, embedding array<float>"), embeddings={"embedding": "cosine"}),
        NodeKind("Passage", struct("text string, embedding array<float>"), embeddings={"embedding": "cosine"}, searchable=("text",)),
        NodeKind("User", struct("")),
        NodeKind("EventType", struct("")),
        NodeKind("Event", struct("ts timestamp, value double, props variant, nested variant, tags array<string>, long_parts array<string>, event_type string")),
    ],
    edges=[
        EdgeKind("inRegion", ("Nation",), ("Region",), cardinality="one"),
        EdgeKind("customerIn", ("Customer",), ("Nation",), cardinality="one"),
        EdgeKind("supplierIn", ("Supplier",), ("Nation",), cardinality="one"),
        EdgeKind("locatedIn", ("Party",), ("Nation",)),
        EdgeKind("placed", ("Customer",), ("Order",)),
        EdgeKind("placedBy", ("Order",), ("Customer",)),
        EdgeKind("openFor", ("Customer",), ("Order",), cardinality="oneActive"),
        EdgeKind("contains", ("Order",), ("Part",), struct("quantity double, extendedprice double, discount double, tax double, revenue double, returnflag string, linestatus string, shipdate timestamp")),
        EdgeKind("supplies", ("Supplier",), ("Part",), struct("quantity double")),
        EdgeKind("performed", ("User",), ("EventType",), struct("value double")),
        EdgeKind("neighbour", ("Order",), ("Order",), struct("weight double")),
    ],
    ontology=[
        ("Customer", "subClassOf", "Party"), ("Supplier", "subClassOf", "Party"), ("customerIn", "implies", "locatedIn"), ("supplierIn", "implies", "locatedIn"),
        ("placed", "inverseOf", "placedBy"), ("neighbour", "inverseOf", "neighbour"), ("Order", "disjointWith", "Party"), ("Part", "disjointWith", "Party"),
        ("Nation", "partOf", "Region"), ("Document", "broader", "Event"), ("Party", "equivalentTo", "http://schema.org/Organization"),
    ],
)


def _key(name: str) -> Column:
    return F.col(name).cast("string")


#: Indexes of a folder's texts that an application has built.
_INDEXES: dict[tuple[str, str], dict] = {}


def load(spark: SparkSession, sf_dir: str) -> GraphStore:
    """The tables of a folder as a store. Scans read only the columns that a query uses. Stores of one folder share their search indexes while the application runs; where
    tables change, they are to be rebuilt."""
    t = functools.cache(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

    def bound(table: str, key: str, **props: str) -> Callable[[], DataFrame]:
        return lambda: t(table).select(_key(key).alias("id"), *[F.col(c).alias(n) for n, c in props.items()])

    def ends(table: str, a: str, b: str, id_: Column, *more: Column) -> Callable[[], DataFrame]:
        return lambda: t(table).select(id_.alias("id"), _key(a).alias("from_id"), _key(b).alias("to_id"), *more)

    def lines(a: str, b: str, *more: Column) -> Callable[[], DataFrame]:
        """Line items as edges; their ids number equal order keys in the order of all columns."""

        def make() -> DataFrame:
            place = Window.partitionBy("l_orderkey").orderBy(*[F.col(c) for c in t("lineitem").columns])
            return ends("lineitem", a, b, F.concat_ws("-", _key("l_orderkey"), F.row_number().over(place).cast("string")), *more)()

        return make

    def neighbours() -> DataFrame:
        """Each order with the next of its customer and with the next of its day; a weight of 1 or 3 and of the days between."""
        orders = t("orders")
        parts = []
        for mark, keys, cost in (("c", ["o_custkey"], 1.0), ("d", ["o_orderdate"], 3.0)):
            order = Window.partitionBy(*keys).orderBy("o_orderdate", "o_orderkey")
            days = F.datediff(F.lead("o_orderdate").over(order), "o_orderdate")
            parts.append(orders.select(F.lit(mark).alias("mark"), _key("o_orderkey").alias("from_id"), F.lead(_key("o_orderkey")).over(order).alias("to_id"), (days + cost).alias("weight")))
        both = parts[0].unionByName(parts[1]).where("to_id is not null")
        return both.select(F.concat_ws("-", "mark", "from_id", "to_id").alias("id"), "from_id", "to_id", "weight")

    # An object with an array for even k, with a member named 0 for multiples of 3, and with a string.
    k, tags = F.get_json_object("props", "$.k").cast("int"), F.split("event_type", "r")
    nested = F.parse_json(F.to_json(F.struct(F.when(k % 2 == 0, F.array(k)).alias("a"), F.when(k % 3 == 0, k).alias("0"), F.col("event_type").alias("s"))))
    nodes = {
        "Region": bound("region", "r_regionkey", name="r_name"),
        "Nation": bound("nation", "n_nationkey", name="n_name"),
        "Customer": bound("customer", "c_custkey", name="c_name", acctbal="c_acctbal", mktsegment="c_mktsegment"),
        "Supplier": bound("supplier", "s_suppkey", name="s_name", acctbal="s_acctbal"),
        "Part": bound("part", "p_partkey", name="p_name", brand="p_brand", type="p_type", size="p_size", retailprice="p_retailprice"),
        "Order": bound("orders", "o_orderkey", status="o_orderstatus", totalprice="o_totalprice", priority="o_orderpriority", orderdate="o_orderdate", valid_from="o_orderdate"),
        "Document": bound("documents", "doc_id", text="text", lang="lang", source="source", n_chars="n_chars"),
        "Vector": bound("embeddings", "vec_id", label="label", embedding="embedding"),
        "Passage": lambda: t("documents").join(t("embeddings"), F.col("doc_id") == F.col("vec_id")).select(_key("doc_id").alias("id"), "text", "embedding"),
        "User": lambda: t("events").select(_key("user_id").alias("id")).distinct(),
        "EventType": lambda: t("events").select(F.col("event_type").alias("id")).distinct(),
        "Event": lambda: t("events").select(_key("event_id").alias("id"), "ts", "value", F.parse_json("props").alias("props"), nested.alias("nested"), tags.alias("tags"), F.filter(tags, lambda x: F.char_length(x) > 4).alias("long_parts"), "event_type"),
    }
    until = F.col("o_orderdate") + F.expr("interval 90 days")
    gone = F.when(F.col("o_orderkey") % 17 == 0, F.col("o_orderdate") + F.expr("interval 30 days"))
    measures = [F.col(f"l_{n}").alias(n) for n in ("quantity", "extendedprice", "discount", "tax", "returnflag", "linestatus", "shipdate")]
    edges = {
        "inRegion": ends("nation", "n_nationkey", "n_regionkey", _key("n_nationkey")),
        "customerIn": ends("customer", "c_custkey", "c_nationkey", F.concat(F.lit("c"), _key("c_custkey"))),
        "supplierIn": ends("supplier", "s_suppkey", "s_nationkey", F.concat(F.lit("s"), _key("s_suppkey"))),
        "placed": ends("orders", "o_custkey", "o_orderkey", _key("o_orderkey"), F.col("o_orderdate").alias("valid_from")),
        "openFor": ends("orders", "o_custkey", "o_orderkey", F.concat(F.lit("open"), _key("o_orderkey")), F.col("o_orderdate").alias("valid_from"), until.alias("valid_to"), gone.alias("deleted_at")),
        "contains": lines("l_orderkey", "l_partkey", *measures, (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue")),
        "supplies": lines("l_suppkey", "l_partkey", F.col("l_quantity").alias("quantity")),
        "performed": ends("events", "user_id", "event_type", _key("event_id"), F.col("value")),
        "neighbour": neighbours,
    }
    store = GraphStore(spark, GRAPH, LazyFrames(nodes), LazyFrames(edges), Coordinate(now=NOW))
    store.indexes = _INDEXES.setdefault((spark.sparkContext.applicationId, sf_dir), {})
    return store
