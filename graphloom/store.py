"""A graph's data as DataFrames, and views of it at a read coordinate."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Mapping
from dataclasses import replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import QueryError, TemporalError, UnknownKindError
from .functions.predicates import ROW_FIELDS, Predicate, Ref
from .model import GraphDef, Unique
from .temporal import Coordinate, instant

if TYPE_CHECKING:
    from .plans.query import Query

NODE_ROW = list(ROW_FIELDS)
EDGE_ROW = ["id", "kind", "from_kind", "from_id", "to_kind", "to_id", *NODE_ROW[2:]]


def unique_key(unique: Unique, prefix: str = "p__") -> Column:
    """The key of a uniqueness constraint: fields joined, null ones as a mark; cases folded if asked for."""
    parts = []
    for f in unique.fields:
        value = F.col(f"{prefix}{f}").cast("string")
        parts.append(F.coalesce(F.concat(F.lit("v"), F.lower(value) if unique.collation == "caseInsensitive" else value), F.lit("n")))
    return F.concat_ws("\0", *parts)


class LazyFrames(Mapping):
    """Frames by kind that are built when first asked for: a query pays for the tables that it reads."""

    def __init__(self, makers: Mapping[str, Callable[[], DataFrame]]) -> None:
        self._makers, self._made = dict(makers), {}

    def __getitem__(self, kind: str) -> DataFrame:
        if kind not in self._made:
            self._made[kind] = self._makers[kind]()
        return self._made[kind]

    def __iter__(self):
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)

    def put(self, kind: str, frame: DataFrame) -> LazyFrames:
        out = LazyFrames(self._makers | {kind: lambda: frame})
        out._made = {k: f for k, f in self._made.items() if k != kind}
        return out


class GraphStore:
    """Frames by kind. A node frame has id and the kind's properties, an edge frame also from_id and to_id (and from_kind and
    to_kind where its kind has several); version, valid_from, valid_to, created_at, updated_at and deleted_at are optional.

    ``recorded_nodes`` and ``recorded_edges``: the same with recorded_from and recorded_to, for reads of the past.
    """

    def __init__(self, spark: SparkSession, graph: GraphDef, nodes: Mapping[str, DataFrame], edges: Mapping[str, DataFrame], coordinate: Coordinate | None = None, recorded_nodes: Mapping[str, DataFrame] | None = None, recorded_edges: Mapping[str, DataFrame] | None = None, assertions: DataFrame | None = None) -> None:
        self.spark, self.graph = spark, graph
        self.frames, self.edge_frames = (f if isinstance(f, LazyFrames) else dict(f) for f in (nodes, edges))
        self.recorded_nodes, self.recorded_edges = dict(recorded_nodes or {}), dict(recorded_edges or {})
        self.assertions = assertions
        self.indexes: dict = {}  # by kind, language and coordinate; views share them
        self.coordinate = (coordinate or Coordinate()).pinned()
        for k in self.frames:
            graph.node(k)
        for k in self.edge_frames:
            graph.edge(k)

    # Views
    def at(self, coordinate: Coordinate) -> GraphStore:
        out = GraphStore(self.spark, self.graph, self.frames, self.edge_frames, coordinate, self.recorded_nodes, self.recorded_edges, self.assertions)
        out.indexes = self.indexes
        return out

    def as_of(self, when: str | dt.datetime) -> GraphStore:
        return self.at(replace(self.coordinate, mode="asOf", as_of=instant(when)))

    def view(self, mode: str, as_of: str | dt.datetime | None = None) -> GraphStore:
        return self.at(replace(self.coordinate, mode=mode, as_of=instant(as_of) if as_of is not None else None))

    def snapshot(self) -> GraphStore:
        """A view whose "now" stays what it is when this is called."""
        return self.at(replace(self.coordinate, now=None).pinned())

    def as_of_recorded(self, revision: int) -> GraphStore:
        if not self.recorded_nodes and not self.recorded_edges:
            raise TemporalError("this store has no recorded tables")
        return self.at(replace(self.coordinate, recorded=revision))

    def recorded_now(self) -> int:
        """The newest revision of the recorded tables."""
        frames = [*self.recorded_nodes.values(), *self.recorded_edges.values()]
        tops = [f.agg(F.max("recorded_from")).first()[0] for f in frames]
        return max((t for t in tops if t is not None), default=0)

    # Frames
    def _row(self, frame: DataFrame, names: list[str], schema: T.StructType, fixed: dict[str, Column]) -> list[Column]:
        out = []
        for n in names:
            kind = ROW_FIELDS.get(n, T.StringType())
            out.append((fixed[n] if n in fixed else F.col(n).cast(kind) if n in frame.columns else F.lit(1 if n == "version" else None).cast(kind)).alias(n))
        for f in schema:
            out.append((F.col(f.name) if f.name in frame.columns else F.lit(None).cast(f.dataType)).alias(f"p__{f.name}"))
        return out

    def schema_of(self, kinds: Iterable[str], edges: bool = False) -> T.StructType:
        """Properties of all the kinds; those that differ in type are refused."""
        merged: dict[str, T.StructField] = {}
        for k in kinds:
            for f in (self.graph.edge(k) if edges else self.graph.node(k)).schema:
                if merged.setdefault(f.name, f).dataType != f.dataType:
                    raise QueryError(f"property {f.name} has several types")
        return T.StructType(list(merged.values()))

    def _union(self, parts: list[DataFrame], names: list[str], schema: T.StructType) -> DataFrame:
        if not parts:
            fields = [T.StructField(n, ROW_FIELDS.get(n, T.StringType())) for n in names] + [T.StructField(f"p__{f.name}", f.dataType) for f in schema]
            return self.spark.createDataFrame([], T.StructType(fields))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def nodes(self, kinds: Iterable[str], coordinate: Coordinate | None = None, visible: bool = True) -> DataFrame:
        """Rows of the kinds that the coordinate sees: NODE_ROW and p__<property>."""
        kinds, at = list(kinds), coordinate or self.coordinate
        schema, parts = self.schema_of(kinds), []
        frames = self.recorded_nodes if at.recorded is not None else self.frames
        for k in kinds:
            if k in frames:
                frame = frames[k].where(at.recorded_filter()) if at.recorded is not None else frames[k]
                parts.append(frame.select(*self._row(frame, NODE_ROW, schema, {"kind": F.lit(k)})))
        out = self._union(parts, NODE_ROW, schema)
        return out.where(at.visible()) if visible else out

    def edges(self, kinds: Iterable[str], coordinate: Coordinate | None = None, visible: bool = True) -> DataFrame:
        """Rows of the edge kinds that the coordinate sees: EDGE_ROW and p__<property>."""
        kinds, at = list(kinds), coordinate or self.coordinate
        schema, parts = self.schema_of(kinds, True), []
        frames = self.recorded_edges if at.recorded is not None else self.edge_frames
        for k in kinds:
            if k not in frames:
                continue
            frame, fixed, kind = frames[k], {"kind": F.lit(k)}, self.graph.edge(k)
            frame = frame.where(at.recorded_filter()) if at.recorded is not None else frame
            for side, own in (("from_kind", kind.from_kinds), ("to_kind", kind.to_kinds)):
                if side not in frame.columns:
                    if len(own) > 1:
                        raise UnknownKindError(f"edge kind {k} has several {side}s, but its rows don't tell")
                    fixed[side] = F.lit(own[0])
            parts.append(frame.select(*self._row(frame, EDGE_ROW, schema, fixed)))
        out = self._union(parts, EDGE_ROW, schema)
        return out.where(at.visible()) if visible else out

    # Queries
    def query(self) -> Query:
        from .plans.query import Query

        return Query(self)

    # Collections
    def find(self, kind: str, where: Callable[[Ref], Predicate] | None = None, limit: int | None = None, offset: int = 0, sub_classes: bool = False) -> DataFrame:
        kinds = self.graph.node_kinds(kind, sub_classes)
        return self._page(self.nodes(kinds), self.schema_of(kinds), where, limit, offset)

    def find_edges(self, kind: str, where: Callable[[Ref], Predicate] | None = None, from_: tuple[str, str] | None = None, to: tuple[str, str] | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
        """Edges of a kind, from and to given (kind, id) if asked for."""
        rows = self.edges([kind])
        for side, end in (("from", from_), ("to", to)):
            if end:
                rows = rows.where((F.col(f"{side}_kind") == end[0]) & (F.col(f"{side}_id") == end[1]))
        return self._page(rows, self.schema_of([kind], True), where, limit, offset)

    def _page(self, rows: DataFrame, schema: T.StructType, where: Callable[[Ref], Predicate] | None, limit: int | None, offset: int) -> DataFrame:
        if where:
            made = where(Ref(schema))
            if made.searches or made.column is None:
                raise QueryError("searches go through query() or search")
            rows = rows.where(made.column)
        if limit is not None or offset:
            rows = rows.orderBy("kind", "id").offset(offset)
        return rows if limit is None else rows.limit(limit)

    def count(self, kind: str, sub_classes: bool = False) -> DataFrame:
        return self.find(kind, sub_classes=sub_classes).agg(F.count("*").alias("count"))

    def get_by_ids(self, kind: str, ids: list[str]) -> DataFrame:
        """One row for each id in the order given (position), nulls where there is none."""
        asked = self.spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "position int, asked string")
        return asked.join(self.nodes([kind]), F.col("asked") == F.col("id"), "left").orderBy("position")

    def get_by_id(self, kind: str, id_: str) -> DataFrame:
        return self.nodes([kind]).where(F.col("id") == id_)

    def bulk_find_by_constraint(self, kind: str, constraint: str, keys: DataFrame) -> DataFrame:
        """Nodes whose key under the constraint is that of a row of ``keys`` (its fields as columns)."""
        unique = next((u for u in self.graph.node(kind).unique if u.name == constraint), None)
        if unique is None:
            raise QueryError(f"{kind} has no constraint {constraint}")
        kinds = self.graph.node_kinds(kind, True) if unique.scope == "kindWithSubClasses" else [kind]
        rows = self.nodes(kinds)
        for f in unique.where_not_null:
            rows = rows.where(F.col(f"p__{f}").isNotNull())
        return rows.join(keys.select(unique_key(unique, "").alias("__key")).distinct(), unique_key(unique) == F.col("__key"), "left_semi")

    def bulk_find_by_index(self, kind: str, keys: DataFrame, limit_per_input: int | None = None) -> DataFrame:
        """Nodes that equal a row of ``keys`` in its columns; of each row as many as asked for, by id."""
        named = keys.select(*[F.col(c).alias(f"k__{c}") for c in keys.columns]).distinct()
        on = [F.col(f"p__{c}") == F.col(f"k__{c}") for c in keys.columns]
        return self._per_input(self.nodes([kind]).join(named, on), [f"k__{c}" for c in keys.columns], limit_per_input)

    def bulk_find_edges(self, ends: DataFrame, kinds: list[str], direction: str = "out", limit_per_input: int | None = None) -> DataFrame:
        """Edges from (or to) the (kind, id) rows of ``ends``."""
        side = "from" if direction == "out" else "to"
        asked = ends.select(F.col("kind").alias("k__kind"), F.col("id").alias("k__id")).distinct()
        rows = self.edges(kinds).join(asked, (F.col(f"{side}_kind") == F.col("k__kind")) & (F.col(f"{side}_id") == F.col("k__id")))
        return self._per_input(rows, ["k__kind", "k__id"], limit_per_input)

    def _per_input(self, rows: DataFrame, keys: list[str], limit: int | None) -> DataFrame:
        if limit is not None:
            rank = F.row_number().over(Window.partitionBy(*keys).orderBy("kind", "id"))
            rows = rows.withColumn("__rank", rank).where(F.col("__rank") <= limit).drop("__rank")
        return rows.drop(*keys)

    def batch(self, *queries: Any) -> list[DataFrame]:
        return [q if isinstance(q, DataFrame) else q.to_df() for q in queries]

    def recorded_scan(self, kind: str, revision: int, after: str | None = None, first: int = 1000, edges: bool = False) -> DataFrame:
        """A page of the rows as recorded at a revision, by id."""
        view = self.as_of_recorded(revision)
        rows = view.edges([kind], visible=False) if edges else view.nodes([kind], visible=False)
        return (rows.where(F.col("id") > after) if after is not None else rows).orderBy("id").limit(first)

    def introspect(self) -> DataFrame:
        """Rows of every kind, live and deleted."""
        out = None
        for what, frames in (("node", self.frames), ("edge", self.edge_frames)):
            for k, f in sorted(frames.items()):
                gone = F.col("deleted_at").isNotNull() if "deleted_at" in f.columns else F.lit(False)
                one = f.agg(F.lit(what).alias("what"), F.lit(k).alias("kind"), F.count("*").alias("rows"), F.coalesce(F.sum(gone.cast("long")), F.lit(0)).alias("deleted"))
                out = one if out is None else out.unionByName(one)
        if out is None:
            raise QueryError("the store is empty")
        return out
