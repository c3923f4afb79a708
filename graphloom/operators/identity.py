"""Operational identity: same and different assertions, their classes, and checks.

Assertions are rows (id, rel, a_kind, a_id, b_kind, b_id) with the temporal columns. Classes are connected
components of the same-assertions that the coordinate sees; with folding, equal ids of different kinds are the same too.
"""

from __future__ import annotations

import datetime as dt
import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import IdentityContradiction
from ..functions.tables import materialize
from ..store import GraphStore
from ..temporal import Coordinate
from .algorithms import key
from .components import components

SCHEMA = "id string, rel string, a_kind string, a_id string, b_kind string, b_id string, valid_from timestamp, valid_to timestamp, deleted_at timestamp"
SAME, DIFFERENT = "same", "different"


class Identity:
    def __init__(self, store: GraphStore, at: Coordinate | None = None) -> None:
        self.store, self.at = store, (at or store.coordinate).pinned()

    def _assertions(self, rel: str) -> DataFrame:
        rows = self.store.assertions
        if rows is None:
            rows = self.store.spark.createDataFrame([], SCHEMA)
        if self.at.recorded is not None and "recorded_from" in rows.columns:
            rows = rows.where(self.at.recorded_filter())
        rows = rows.where(F.col("rel") == rel).where(self.at.visible())
        return rows.select("id", key("a_kind", "a_id").alias("a"), key("b_kind", "b_id").alias("b"))

    def assertions_of(self, kind: str, id_: str) -> DataFrame:
        mine = lambda c: (F.col(f"{c}.kind") == kind) & (F.col(f"{c}.id") == id_)
        rows = functools.reduce(DataFrame.unionAll, [self._assertions(r).withColumn("rel", F.lit(r)) for r in (SAME, DIFFERENT)])
        return rows.where(mine("a") | mine("b"))

    @functools.cached_property
    def closure(self) -> DataFrame:
        """member, class (its smallest member by id, then kind), for all nodes that any assertion or fold ties to another."""
        links = self._assertions(SAME).select("a", "b")
        if self.store.graph.fold_identity:
            nodes = self.store.nodes(sorted(self.store.frames)).select("id", "kind")
            first = nodes.groupBy("id").agg(F.min("kind").alias("first"), F.count("*").alias("n")).where("n > 1")
            links = links.unionAll(nodes.join(first, "id").where("kind <> first").select(key().alias("a"), key("first").alias("b")))
        return materialize(components(links).select(F.col("node").alias("member"), F.col("component").alias("class")), "closure")

    def classes(self, kinds: list[str]) -> DataFrame:
        """kind, id, class_kind, class_id of all visible nodes of the kinds."""
        nodes = self.store.nodes(kinds, self.at).select(key().alias("member"))
        out = nodes.join(self.closure, "member", "left").select("member", F.coalesce("class", "member").alias("class"))
        return out.select("member.kind", "member.id", F.col("class.kind").alias("class_kind"), F.col("class.id").alias("class_id"))

    def members_of(self, kind: str, id_: str) -> DataFrame:
        mine = self.closure.where((F.col("member.kind") == kind) & (F.col("member.id") == id_)).select("class")
        found = self.closure.join(mine, "class").select("member.kind", "member.id")
        own = self.store.spark.createDataFrame([(kind, id_)], "kind string, id string")
        return found.unionAll(own).distinct()

    def nodes_of(self, kind: str, id_: str) -> DataFrame:
        """Visible nodes of the class."""
        kinds = sorted(self.store.frames)
        seen = self.store.nodes(kinds, self.at).select("kind", "id")
        return self.members_of(kind, id_).join(seen, ["kind", "id"], "left_semi")

    def representative_of(self, kind: str, id_: str) -> DataFrame:
        return self.members_of(kind, id_).orderBy("id", "kind").limit(1)

    def _classed(self, ends: DataFrame) -> DataFrame:
        for c in ("a", "b"):
            own = self.closure.select(F.col("member").alias(c), F.col("class").alias(f"{c}_class"))
            ends = ends.join(own, c, "left").withColumn(f"{c}_class", F.coalesce(f"{c}_class", c))
        return ends

    def are_same(self, pairs: DataFrame) -> DataFrame:
        """pairs (a_kind, a_id, b_kind, b_id) with same."""
        ends = pairs.select("*", key("a_kind", "a_id").alias("a"), key("b_kind", "b_id").alias("b"))
        return self._classed(ends).withColumn("same", F.col("a_class") == F.col("b_class")).select(*pairs.columns, "same")

    def separation(self) -> DataFrame:
        """low, high: classes that a different-assertion between any of their members keeps apart."""
        rows = self._classed(self._assertions(DIFFERENT))
        return rows.select(F.least("a_class", "b_class").alias("low"), F.greatest("a_class", "b_class").alias("high")).distinct()

    def are_different(self, pairs: DataFrame) -> DataFrame:
        ends = self._classed(pairs.select("*", key("a_kind", "a_id").alias("a"), key("b_kind", "b_id").alias("b")))
        ends = ends.withColumn("low", F.least("a_class", "b_class")).withColumn("high", F.greatest("a_class", "b_class"))
        apart = self.separation().withColumn("different", F.lit(True))
        return ends.join(apart, ["low", "high"], "left").select(*pairs.columns, F.coalesce("different", F.lit(False)).alias("different"))

    def contradictions(self) -> DataFrame:
        """why, a, b: different-assertions inside a class, and members of one class whose kinds are disjoint."""
        inside = self._classed(self._assertions(DIFFERENT)).where("a_class = b_class").select(F.lit("different").alias("why"), "a", "b")
        pairs = self.store.graph.ontology.disjoint_pairs()
        if not pairs:
            return inside
        apart = F.broadcast(self.store.spark.createDataFrame(pairs, "k1 string, k2 string"))  # as large as the schema
        one = self.closure.groupBy("class", F.col("member.kind").alias("k")).agg(F.min("member").alias("m"))
        a, b = one.select("class", F.col("k").alias("k1"), F.col("m").alias("a")), one.select("class", F.col("k").alias("k2"), F.col("m").alias("b"))
        return inside.unionAll(a.join(apart, "k1").join(b, ["class", "k2"]).select(F.lit("disjoint").alias("why"), "a", "b"))

    def validate(self) -> None:
        bad = self.contradictions().head(1)
        if bad:
            raise IdentityContradiction(f"{bad[0]['why']}: {bad[0]['a']['id']} and {bad[0]['b']['id']}")

    def asserted(self, pairs: DataFrame, rel: str, when: dt.datetime | None = None) -> GraphStore:
        """The store with more assertions; contradictions are refused."""
        have = self.store.assertions if self.store.assertions is not None else self.store.spark.createDataFrame([], SCHEMA)
        when = when or self.at.now
        new = pairs.select(F.concat_ws("|", F.lit(rel), "a_kind", "a_id", "b_kind", "b_id").alias("id"), F.lit(rel).alias("rel"), "a_kind", "a_id", "b_kind", "b_id", F.lit(when).cast("timestamp").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), F.lit(None).cast("timestamp").alias("deleted_at"))
        live = have.where(self.at.visible()).select("id")
        store = self.store.at(self.at)
        store.assertions = have.unionByName(new.dropDuplicates(["id"]).join(live, "id", "left_anti"), allowMissingColumns=True)
        Identity(store, self.at).validate()
        return store

    def retracted(self, pairs: DataFrame, rel: str, when: dt.datetime | None = None) -> GraphStore:
        """The store with the windows of these assertions (either way round) closed."""
        when = when or self.at.now
        ends = pairs.select("a_kind", "a_id", "b_kind", "b_id").unionAll(pairs.select("b_kind", "b_id", "a_kind", "a_id")).distinct().withColumn("__ends", F.lit(True))
        rows = self.store.assertions.join(ends, ["a_kind", "a_id", "b_kind", "b_id"], "left")
        closes = F.col("__ends").isNotNull() & (F.col("rel") == rel) & F.col("valid_to").isNull()
        store = self.store.at(self.at)
        store.assertions = rows.withColumn("valid_to", F.when(closes, F.lit(when).cast("timestamp")).otherwise(F.col("valid_to"))).select(*self.store.assertions.columns)
        return store


def widen(store: GraphStore, prev: DataFrame, kind: str, id_: str, at: Coordinate) -> DataFrame:
    """``prev`` with a row for each visible member of the class of (kind, id): __w_kind, __w_id."""
    closure = Identity(store, at).closure
    seen = store.nodes(sorted(store.frames), at).select(key().alias("peer"))
    peers = closure.select(F.col("member").alias("peer"), F.col("class").alias("__class")).join(seen, "peer", "left_semi")
    own = closure.select(F.col("member").alias("__n"), F.col("class").alias("__of"))
    # From each row to its class, and from there to the members: nothing grows with the square of a class.
    out = prev.withColumn("__n", key(kind, id_)).join(own, "__n", "left")
    out = out.join(peers, F.col("__of") == F.col("__class"), "left").withColumn("peer", F.coalesce("peer", "__n"))
    return out.withColumn("__w_kind", F.col("peer.kind")).withColumn("__w_id", F.col("peer.id")).drop("__n", "__of", "__class", "peer")


def empty_assertions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
