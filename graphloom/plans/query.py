"""The fluent query builder. A query is a plain description; ``to_df`` turns it into one DataFrame plan.

Columns of an alias are ``alias__<row column>`` and ``alias__p__<property>`` until they are projected, so
Catalyst prunes what is not used. Predicates of an alias go on its scan, before any join.
"""

from __future__ import annotations

import base64
import datetime as dt
import itertools
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CursorError, QueryError, TemporalError
from ..functions.predicates import BINDINGS, Field, Param, Predicate, Ref, Search, bound
from ..functions.tables import materialize
from ..store import EDGE_ROW, NODE_ROW, GraphStore
from ..temporal import Coordinate, instant

#: Depth of a recursion without a limit, and the largest limit; rows of a page and of a streamed batch.
OPEN_DEPTH, MOST_DEPTH, PAGE = 10, 1000, 20

Where = Callable[[Ref], Predicate]


@dataclass(frozen=True)
class Recursion:
    min_hops: int = 1
    max_hops: int | None = None
    cycles: str = "prevent"
    path: str | None = None
    depth: str | None = None


@dataclass(frozen=True)
class Hop:
    edges: tuple[str, ...]
    edge_alias: str
    kind: str
    alias: str
    source: str
    direction: str = "out"
    expand: str = "inverse"
    optional: bool = False
    sub_classes: bool = False
    identity: bool = False
    recursion: Recursion | None = None


@dataclass(frozen=True)
class Agg:
    how: str
    alias: str
    name: str | None = None


def count(alias: str, name: str | None = None) -> Agg:
    return Agg("count", alias, name)


def count_distinct(alias: str, name: str | None = None) -> Agg:
    return Agg("count_distinct", alias, name)


def count_edges(alias: str) -> Agg:
    return Agg("count_edges", alias)


def count_distinct_edges(alias: str) -> Agg:
    return Agg("count_distinct_edges", alias)


def sum_(alias: str, name: str) -> Agg:
    return Agg("sum", alias, name)


def avg(alias: str, name: str) -> Agg:
    return Agg("avg", alias, name)


def min_(alias: str, name: str) -> Agg:
    return Agg("min", alias, name)


def max_(alias: str, name: str) -> Agg:
    return Agg("max", alias, name)


@dataclass(frozen=True)
class Order:
    alias: str | None
    name: str
    down: bool = False
    nulls: str | None = None  # first or last; by default last ascending, first descending

    def column(self, c: Column) -> Column:
        first = self.nulls == "first" if self.nulls else self.down
        if self.down:
            return c.desc_nulls_first() if first else c.desc_nulls_last()
        return c.asc_nulls_first() if first else c.asc_nulls_last()


class Context:
    """What ``select`` gets: ``ctx.alias.property`` is a Column, ``ctx.whole(alias)`` the node or edge as a struct."""

    def __init__(self, aliases: dict[str, tuple[T.StructType, bool]]) -> None:
        self._aliases = aliases

    def __getattr__(self, alias: str) -> Any:
        if alias not in self._aliases:
            raise QueryError(f"no alias {alias}")
        return _Selected(self, alias)

    def column(self, alias: str, name: str) -> Column:
        schema, edge = self._aliases[alias]
        rows = EDGE_ROW if edge else NODE_ROW
        if name in rows:
            return F.col(f"{alias}__{name}")
        if name in schema.fieldNames():
            return F.col(f"{alias}__p__{name}")
        raise QueryError(f"{alias} has no field {name}")

    def whole(self, alias: str) -> Column:
        schema, edge = self._aliases[alias]
        rows = EDGE_ROW if edge else NODE_ROW
        given = F.struct(*[F.col(f"{alias}__{n}").alias(n) for n in rows], *[F.col(f"{alias}__p__{n}").alias(n) for n in schema.fieldNames()])
        return F.when(F.col(f"{alias}__id").isNotNull(), given)


class _Selected:
    def __init__(self, ctx: Context, alias: str) -> None:
        self._ctx, self._alias = ctx, alias

    def __getattr__(self, name: str) -> Column:
        return self._ctx.column(self._alias, name)


class Traversal:
    def __init__(self, query: Query, hop: dict[str, Any]) -> None:
        self._query, self._hop, self._where = query, hop, []

    def where_edge(self, fn: Where) -> Traversal:
        self._where.append(fn)
        return self

    def recursive(self, min_hops: int = 1, max_hops: int | None = None, cycles: str = "prevent", path: str | None = None, depth: str | None = None) -> Traversal:
        if max_hops is not None and not 1 <= max_hops <= MOST_DEPTH or min_hops < 0 or max_hops is not None and min_hops > max_hops:
            raise QueryError(f"hops from {min_hops} to {max_hops}")
        if cycles not in ("prevent", "allow"):
            raise QueryError(f"cycles: {cycles}")
        self._hop["recursion"] = Recursion(min_hops, max_hops, cycles, path, depth)
        return self

    def to(self, kind: str, alias: str, sub_classes: bool = False) -> Query:
        hop = Hop(kind=kind, alias=alias, sub_classes=sub_classes, **self._hop)
        q = self._query._with_hop(hop)
        for fn in self._where:
            q = q.where_edge(hop.edge_alias, fn)
        return q

    to_dynamic = to


@dataclass(frozen=True)
class Query:
    store: GraphStore
    start: tuple[str, str, bool] | None = None
    hops: tuple[Hop, ...] = ()
    wheres: tuple[tuple[str, Where], ...] = ()
    shape: Any = None
    aggregates: tuple[tuple[str, Any], ...] = ()
    keys: tuple[tuple[str, str], ...] = ()
    having_: Callable[[Callable[[str], Column]], Column] | None = None
    orders: tuple[Order, ...] = ()
    limit_: Any = None
    offset_: Any = None
    fusion: dict[str, Any] = field(default_factory=dict)
    coordinate: Coordinate | None = None

    # Building
    def from_(self, kind: str, alias: str, sub_classes: bool = False) -> Query:
        self.store.graph.node(kind)
        return replace(self, start=(kind, alias, sub_classes))

    from_dynamic = from_

    def _with_hop(self, hop: Hop) -> Query:
        taken = self.aliases()
        for a in (hop.alias, hop.edge_alias):
            if a in taken or hop.alias == hop.edge_alias:
                raise QueryError(f"alias {a} is taken")
        if any(h.recursion for h in (*self.hops, hop)) and self.hops:
            raise QueryError("a recursive query has exactly one traversal")
        return replace(self, hops=(*self.hops, hop))

    def _traverse(self, edge: str | list[str], alias: str, optional: bool, direction: str, expand: str, source: str | None, identity: bool) -> Traversal:
        if self.start is None:
            raise QueryError("from_ comes first")
        if direction not in ("out", "in"):
            raise QueryError(f"direction: {direction}")
        kinds = (edge,) if isinstance(edge, str) else tuple(edge)
        for k in kinds:
            self.store.graph.edge(k)
        last = source or (self.hops[-1].alias if self.hops else self.start[1])
        if last not in self.aliases() or self.aliases()[last][1]:
            raise QueryError(f"no node alias {last}")
        return Traversal(self, {"edges": kinds, "edge_alias": alias, "source": last, "direction": direction, "expand": expand, "optional": optional, "identity": identity})

    def traverse(self, edge: str | list[str], alias: str, direction: str = "out", expand: str = "inverse", source: str | None = None, identity: bool = False) -> Traversal:
        return self._traverse(edge, alias, False, direction, expand, source, identity)

    def optional_traverse(self, edge: str | list[str], alias: str, direction: str = "out", expand: str = "inverse", source: str | None = None, identity: bool = False) -> Traversal:
        return self._traverse(edge, alias, True, direction, expand, source, identity)

    traverse_dynamic, optional_traverse_dynamic = traverse, optional_traverse

    def where_node(self, alias: str, fn: Where) -> Query:
        return replace(self, wheres=(*self.wheres, (alias, fn)))

    where_edge = where_node

    def select(self, shape: Callable[[Context], dict[str, Column]] | dict[str, tuple[str, str]]) -> Query:
        return replace(self, shape=shape)

    def group_by(self, alias: str, name: str) -> Query:
        return replace(self, keys=(*self.keys, (alias, name)))

    def group_by_node(self, alias: str) -> Query:
        return self.group_by(alias, "id")

    def aggregate(self, fields: dict[str, Agg | tuple[str, str]]) -> Query:
        return replace(self, aggregates=tuple(fields.items()))

    def having(self, fn: Callable[[Callable[[str], Column]], Column]) -> Query:
        """fn gets a function from output names to Columns; rows for which its result holds stay."""
        return replace(self, having_=fn)

    def order_by(self, alias: str | None, name: str, direction: str = "asc", nulls: str | None = None) -> Query:
        """By a field of an alias, or (alias None) by an output name of an aggregate."""
        return replace(self, orders=(*self.orders, Order(alias, name, direction == "desc", nulls)))

    def limit(self, n: int | Param) -> Query:
        return replace(self, limit_=n)

    def offset(self, n: int | Param) -> Query:
        return replace(self, offset_=n)

    def temporal(self, mode: str, as_of: str | dt.datetime | None = None) -> Query:
        base = self.coordinate or self.store.coordinate
        return replace(self, coordinate=replace(base, mode=mode, as_of=instant(as_of) if as_of is not None else None))

    def fuse_with(self, k: int = 60, vector_weight: float = 1.0, fulltext_weight: float = 1.0) -> Query:
        return replace(self, fusion={"k": k, "vector": vector_weight, "fulltext": fulltext_weight})

    def pipe(self, fragment: Callable[[Query], Query]) -> Query:
        return fragment(self)

    # Shape
    def aliases(self) -> dict[str, tuple[T.StructType, bool]]:
        """Properties of each alias and whether it is an edge's."""
        if self.start is None:
            return {}
        s, g = self.store, self.store.graph
        out = {self.start[1]: (s.schema_of(g.node_kinds(self.start[0], self.start[2])), False)}
        for h in self.hops:
            direct, back = g.expand_edges(h.edges, h.expand)
            out[h.edge_alias] = (s.schema_of(sorted({*direct, *back}), True), True)
            out[h.alias] = (s.schema_of(g.node_kinds(h.kind, h.sub_classes)), False)
        return out

    def at(self) -> Coordinate:
        return self.coordinate or self.store.coordinate

    def _predicates(self, alias: str) -> tuple[Column | None, tuple[Search, ...]]:
        schema = self.aliases()[alias][0]
        all_: Predicate | None = None
        for a, fn in self.wheres:
            if a == alias:
                made = fn(Ref(schema))
                all_ = made if all_ is None else all_ & made
        return (all_.column, all_.searches) if all_ else (None, ())

    def _scan(self, alias: str, rows: DataFrame) -> DataFrame:
        column, _ = self._predicates(alias)
        rows = rows if column is None else rows.where(column)
        return rows.select(*[F.col(c).alias(f"{alias}__{c}") for c in rows.columns])

    # Hops
    def _steps(self, h: Hop, sources: list[str], targets: list[str]) -> DataFrame:
        """Edges of a hop as edge columns and s__kind, s__id (where it starts), t__kind, t__id."""
        direct, back = self.store.graph.expand_edges(h.edges, h.expand)
        schema = self.store.schema_of(sorted({*direct, *back}), True)
        column, searches = self._predicates(h.edge_alias)
        if searches:
            raise QueryError("searches apply to nodes")

        def branch(kinds: list[str], out: bool, guard: bool) -> DataFrame:
            rows = self.store.edges(kinds, self.at())
            rows = rows.select(*EDGE_ROW, *[(F.col(f"p__{f.name}") if f"p__{f.name}" in rows.columns else F.lit(None).cast(f.dataType)).alias(f"p__{f.name}") for f in schema])
            if column is not None:
                rows = rows.where(column)
            a, b = ("from", "to") if out else ("to", "from")
            rows = rows.where(F.col(f"{a}_kind").isin(sources) & F.col(f"{b}_kind").isin(targets))
            if guard and (both := sorted(set(direct) & set(back))):
                rows = rows.where(~((F.col("from_id") == F.col("to_id")) & (F.col("from_kind") == F.col("to_kind")) & F.col("kind").isin(both)))
            named = [F.col(c).alias(f"{h.edge_alias}__{c}") for c in rows.columns]
            return rows.select(*named, F.col(f"{a}_kind").alias("__s_kind"), F.col(f"{a}_id").alias("__s_id"), F.col(f"{b}_kind").alias("__t_kind"), F.col(f"{b}_id").alias("__t_id"))

        frames = self.store.recorded_edges if self.at().recorded is not None else self.store.edge_frames
        back = [k for k in back if k in frames]
        steps = branch(direct, h.direction == "out", False)
        return steps.unionByName(branch(back, h.direction != "out", True)) if back else steps

    def _kinds(self, alias: str) -> list[str]:
        if self.start and alias == self.start[1]:
            return self.store.graph.node_kinds(self.start[0], self.start[2])
        h = next(h for h in self.hops if h.alias == alias)
        return self.store.graph.node_kinds(h.kind, h.sub_classes)

    def _hop(self, prev: DataFrame, h: Hop, edges_only: bool = False) -> DataFrame:
        sources, targets = self._kinds(h.source), self._kinds(h.alias)
        s_kind, s_id = f"{h.source}__kind", f"{h.source}__id"
        if h.identity:
            from ..operators.identity import widen

            sources = sorted(self.store.graph.nodes)
            prev = widen(self.store, prev, s_kind, s_id, self.at())
            s_kind, s_id = "__w_kind", "__w_id"
        steps = self._steps(h, sources, targets)
        if not edges_only:
            node = self._scan(h.alias, self.store.nodes(targets, self.at()))
            steps = steps.join(node, (F.col("__t_kind") == F.col(f"{h.alias}__kind")) & (F.col("__t_id") == F.col(f"{h.alias}__id")))
        if edges_only and self._edges_alone():
            # Counted before the join: one row for each node that edges start at.
            numbers = [F.count("*").alias(f"{h.edge_alias}____n")]
            if any(spec.how == "count_distinct_edges" for _, spec in self.aggregates if isinstance(spec, Agg)):
                numbers.append(F.countDistinct(f"{h.edge_alias}__id").alias(f"{h.edge_alias}____d"))
            steps = steps.groupBy("__s_kind", "__s_id").agg(*numbers)
        on = (F.col(s_kind) == F.col("__s_kind")) & (F.col(s_id) == F.col("__s_id"))
        return prev.join(steps, on, "left" if h.optional else "inner").drop("__s_kind", "__s_id", "__t_kind", "__t_id", "__w_kind", "__w_id")

    def _recursive(self, prev: DataFrame, h: Hop) -> DataFrame:
        r, targets = h.recursion, self._kinds(h.alias)
        most = r.max_hops or OPEN_DEPTH
        steps = self._steps(replace(h, recursion=None), sorted({*self._kinds(h.source), *targets}), targets)
        node = self._scan(h.alias, self.store.nodes(targets, self.at()))
        token = lambda k, i: F.concat_ws("|", F.col(k), F.col(i)) if r.cycles == "prevent" else F.col(i)
        keeps = r.cycles == "prevent" or r.path is not None
        first, reach = self._kinds(h.source), f"{h.alias}__"
        frontier = prev.withColumn("__f_kind", F.col(f"{h.source}__kind")).withColumn("__f_id", F.col(f"{h.source}__id")).withColumn("__r_depth", F.lit(0))
        if keeps:
            frontier = frontier.withColumn("__r_path", F.array(token("__f_kind", "__f_id")))
        if r.path:
            frontier = frontier.withColumn("__r_ids", F.array(F.col("__f_id")))
        move = steps.select("__s_kind", "__s_id", "__t_kind", "__t_id")
        # A node must be visible and fit at every step, so edges to others are dropped before the loop.
        fits = node.select(F.col(f"{reach}kind").alias("__t_kind"), F.col(f"{reach}id").alias("__t_id"))
        if most > 1:  # of a single step the join with the node is enough
            move = move.join(fits, ["__t_kind", "__t_id"], "left_semi")
        if most > 3:
            move = materialize(move, "moves")
        levels = [frontier.where(F.col("__f_kind").isin(sorted({*first} & {*targets})))] if r.min_hops == 0 else []
        for depth in range(1, most + 1):
            on = (F.col("__f_kind") == F.col("__s_kind")) & (F.col("__f_id") == F.col("__s_id"))
            frontier = frontier.join(move, on).drop("__f_kind", "__f_id", "__s_kind", "__s_id").withColumnRenamed("__t_kind", "__f_kind").withColumnRenamed("__t_id", "__f_id")
            if r.cycles == "prevent":
                frontier = frontier.where(~F.array_contains("__r_path", token("__f_kind", "__f_id")))
            if keeps:
                frontier = frontier.withColumn("__r_path", F.array_append("__r_path", token("__f_kind", "__f_id")))
            if r.path:
                frontier = frontier.withColumn("__r_ids", F.array_append("__r_ids", F.col("__f_id")))
            frontier = frontier.withColumn("__r_depth", F.lit(depth))
            if most > 3:
                frontier = materialize(frontier, "frontier")
                if not frontier.head(1):
                    break
            if depth >= r.min_hops:
                levels.append(frontier)
        if not levels:
            levels = [frontier.limit(0)]
        out = levels[0]
        for more in levels[1:]:
            out = out.unionByName(more)
        return out.join(node, (F.col("__f_kind") == F.col(f"{reach}kind")) & (F.col("__f_id") == F.col(f"{reach}id"))).drop("__f_kind", "__f_id", "__r_path")

    # Compilation
    def _counts_only(self) -> bool:
        """Whether one hop's edges are counted without its target being looked at."""
        if len(self.hops) != 1 or not self.aggregates or self.hops[0].recursion:
            return False
        h = self.hops[0]
        if any(a == h.alias for a, _ in self.wheres) or any(a == h.alias for a, _ in self.keys) or any(o.alias == h.alias for o in self.orders):
            return False
        for _, spec in self.aggregates:
            if (spec.alias if isinstance(spec, Agg) else spec[0]) == h.alias or isinstance(spec, Agg) and spec.alias == h.edge_alias and not spec.how.endswith("edges"):
                return False
        return any(isinstance(spec, Agg) and spec.how.endswith("edges") for _, spec in self.aggregates)

    def _edges_alone(self) -> bool:
        """Whether all aggregates count the edges of the hop, so that they can be counted by source first."""
        h, made = self.hops[0], [spec for _, spec in self.aggregates if isinstance(spec, Agg)]
        by_node = (h.source, "id") in self.keys  # else a distinct edge might start at several nodes of a group
        plain = all(spec.alias == h.edge_alias and (spec.how == "count_edges" or spec.how == "count_distinct_edges" and by_node) for spec in made)
        return plain and not h.identity and not any(k == h.edge_alias for k, _ in self.keys)

    def matched(self) -> DataFrame:
        """All columns of all aliases, before projection."""
        if self.start is None:
            raise QueryError("from_ comes first")
        known = self.aliases()
        for a, _ in self.wheres:
            if a not in known:
                raise QueryError(f"no alias {a}")
        rows = self._scan(self.start[1], self.store.nodes(self._kinds(self.start[1]), self.at()))
        searched = [(a, s) for a in known if not known[a][1] for s in self._predicates(a)[1]]
        for h in self.hops:
            rows = self._recursive(rows, h) if h.recursion else self._hop(rows, h, self._counts_only())
        return self._searched(rows, searched) if searched else rows

    def _searched(self, rows: DataFrame, searched: list[tuple[str, Search]]) -> DataFrame:
        from ..operators.search import ranked_ids

        if self.at().recorded is not None:
            raise TemporalError("searches don't read recorded time")
        kinds = [s.kind for _, s in searched]
        if len(set(kinds)) < len(kinds):
            raise QueryError("one vector and one full-text predicate at most")
        marks: list[Column] = []
        for alias, s in searched:
            own = [n for n in (*NODE_ROW, *(f"p__{f}" for f in self.aliases()[alias][0].fieldNames()))]
            candidates = rows.select(*[F.col(f"{alias}__{n}").alias(n) for n in own]).dropDuplicates(["kind", "id"])
            top = ranked_ids(self.store, self._kinds(alias), candidates, s).select(F.col("kind").alias(f"__{s.kind}_k"), F.col("id").alias(f"__{s.kind}_i"), F.col("score").alias(f"__{s.kind}_score"), F.col("ord").alias(f"__{s.kind}_ord"))
            rows = rows.join(top, (F.col(f"{alias}__kind") == F.col(f"__{s.kind}_k")) & (F.col(f"{alias}__id") == F.col(f"__{s.kind}_i")), "inner" if len(searched) == 1 else "left").drop(f"__{s.kind}_k", f"__{s.kind}_i")
            marks.append(F.col(f"__{s.kind}_ord"))
        if len(searched) == 2:
            k = self.fusion.get("k", 60)
            rows = rows.where(marks[0].isNotNull() | marks[1].isNotNull())
            parts = [F.coalesce(F.lit(float(self.fusion.get(s.kind, 1.0))) / (F.lit(k) + F.col(f"__{s.kind}_ord")), F.lit(0.0)) for _, s in searched]
            rows = rows.withColumn("__fused_score", parts[0] + parts[1])
        return rows

    def _ordered(self, rows: DataFrame, columns: list[Column]) -> DataFrame:
        if columns:
            rows = rows.orderBy(*columns)
        offset, limit = bound(self.offset_), bound(self.limit_)
        if offset:
            rows = rows.offset(offset)
        return rows if limit is None else rows.limit(limit)

    def to_df(self, **parameters: Any) -> DataFrame:
        token = BINDINGS.set(parameters) if parameters else None
        try:
            return self._compiled()
        finally:
            if token:
                BINDINGS.reset(token)

    def _compiled(self) -> DataFrame:
        rows, known = self.matched(), self.aliases()
        ctx = Context(known)
        if self.aggregates:
            return self._aggregated(rows, ctx)
        h = next((h for h in self.hops if h.recursion), None)
        extra = {}
        if h:
            extra = {name: F.col(c) for name, c in ((h.recursion.path, "__r_ids"), (h.recursion.depth, "__r_depth")) if name}
        for c, name in (("__vector_score", "vector_score"), ("__fulltext_score", "fulltext_score"), ("__fused_score", "fused_score")):
            if c in rows.columns:
                extra[name] = F.col(c)
        if self.shape is None:
            shape = {a: ctx.whole(a) for a in known if f"{a}__id" in rows.columns} | extra
        else:
            made = self.shape(ctx) if callable(self.shape) else {n: ctx.column(*ref) for n, ref in self.shape.items()}
            shape = made | extra
        orders = []
        for a, s, down in (("__fused_score", None, True), ("__vector_ord", None, False), ("__fulltext_ord", None, False)):
            if a in rows.columns and (a == "__fused_score" or "__fused_score" not in rows.columns):
                orders.append(F.col(a).desc() if down else F.col(a).asc())
        for o in self.orders:
            c = ctx.column(o.alias, o.name) if o.alias else F.col("__r_depth") if h and o.name == h.recursion.depth else F.lit(None)
            if o.alias and isinstance(known[o.alias][0][o.name].dataType if o.name in known[o.alias][0].fieldNames() else T.StringType(), (T.ArrayType, T.StructType, T.MapType)):
                raise QueryError(f"can't order by {o.name}")
            orders.append(o.column(c))
        if "__fused_score" in rows.columns:
            orders.append(F.col(f"{self.start[1]}__id").asc())
        return self._ordered(rows, orders).select(*[c.alias(n) for n, c in shape.items()])

    def _aggregated(self, rows: DataFrame, ctx: Context) -> DataFrame:
        keys = {f"k{i}": ctx.column(a, n) for i, (a, n) in enumerate(self.keys)}
        plain, made = {}, []
        for name, spec in self.aggregates:
            if not isinstance(spec, Agg):
                plain[name] = ctx.column(*spec)
                continue
            counted = f"{spec.alias}____{'n' if spec.how == 'count_edges' else 'd'}"
            if spec.how.endswith("edges") and f"{spec.alias}____n" in rows.columns:
                made.append(F.coalesce(F.sum(counted), F.lit(0)).alias(name))
                continue
            c = ctx.column(spec.alias, "id" if spec.name is None else spec.name)
            if spec.how in ("sum", "avg"):
                c = c.cast("double")
            how = {"count": F.count, "count_edges": F.count, "count_distinct": F.countDistinct, "count_distinct_edges": F.countDistinct, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[spec.how]
            made.append(how(c).alias(name))
        grouped = [c.alias(n) for n, c in {**keys, **plain}.items()]
        if not made:
            raise QueryError("an aggregate query aggregates something")
        out = rows.groupBy(*grouped).agg(*made) if grouped else rows.agg(*made)
        if self.having_:
            out = out.where(self.having_(F.col))
        orders = []
        for o in self.orders:
            at = o.name if o.alias is None else next((f"k{i}" for i, k in enumerate(self.keys) if k == (o.alias, o.name)), None)
            if at is None:
                raise QueryError(f"can't order an aggregate by {o.alias}.{o.name}")
            orders.append(o.column(F.col(at)))
        return self._ordered(out, orders).select(*[n for n, _ in self.aggregates])

    # Running
    def execute(self, **parameters: Any) -> list[Any]:
        return self.to_df(**parameters).collect()

    def prepare(self) -> Callable[..., DataFrame]:
        """A function of the query's parameters."""
        return lambda **parameters: self.to_df(**parameters)

    def explain(self, mode: str = "formatted") -> str:
        return self.to_df()._jdf.queryExecution().toString() if mode == "extended" else self.to_df()._sc._jvm.PythonSQLUtils.explainString(self.to_df()._jdf.queryExecution(), mode)

    to_sql = explain

    def stream(self, batch: int | None = None) -> Iterator[Any]:
        """Rows one by one. By default one partition at most is held. With ``batch``, which needs an order, so many rows at most are: the rows come in keyset pages,
        each a query of its own, so a stream may go on after a pause and sees no row twice."""
        if batch is None:
            return self.to_df().toLocalIterator(prefetchPartitions=False)
        if batch <= 0:
            raise QueryError("a batch is positive")
        first = self.offset_ or 0
        if isinstance(first, Param) or isinstance(self.limit_, Param):
            raise QueryError("a stream by pages has no parameters")
        return itertools.islice(self._by_pages(batch), first, None if self.limit_ is None else first + self.limit_)

    def _by_pages(self, batch: int) -> Iterator[Any]:
        page = self.paginate(first=batch)
        while True:
            yield from page.data
            if not page.has_next:
                return
            page = self.paginate(first=batch, after=page.end_cursor)

    # Pages
    def _page_orders(self) -> list[Order]:
        if not self.orders or self.aggregates:
            raise QueryError("pages need an order")
        keyed = {(o.alias, o.name) for o in self.orders}
        known = self.aliases()
        looped = {h.edge_alias for h in self.hops if h.recursion}  # those have no edge of their own
        ids = [Order(a, "id") for a in sorted(known, key=lambda a: known[a][1]) if a not in looped and (a, "id") not in keyed]
        return [*self.orders, *ids]

    def paginate(self, first: int | None = None, after: str | None = None, last: int | None = None, before: str | None = None, of: DataFrame | None = None) -> Page:
        """``of``: what ``written`` returned, so that a page is a scan and the query runs once for all pages."""
        if (first is not None or after is not None) and (last is not None or before is not None):
            raise CursorError("a page goes forward or backward")
        back = last is not None or before is not None
        size = (last if back else first) or PAGE
        orders = self._page_orders()
        rows, columns, made = self._paged(orders) if of is None else (of, [F.col(f"__o{i}") for i in range(len(orders))], {c: F.col(c) for c in of.columns if not c.startswith("__o")})
        names = [f"{o.alias}.{o.name}.{'desc' if o.down else 'asc'}" for o in orders]
        cursor = before if back else after
        if cursor is not None:
            rows = rows.where(keyset(orders, columns, decode_cursor(cursor, names, "b" if back else "f"), back))
        sort = []
        for o, c in zip(orders, columns, strict=True):
            way = Order(o.alias, o.name, not o.down, {"first": "last", "last": "first"}[o.nulls or ("first" if o.down else "last")]) if back else o
            sort.append(way.column(c))
        got = rows.orderBy(*sort).limit(size + 1).select(*[c.alias(n) for n, c in made.items()], *[c.alias(f"__o{i}") for i, c in enumerate(columns)]).collect()
        more, got = len(got) > size, got[:size]
        if back:
            got.reverse()
        ends = [encode_cursor(names, [r[f"__o{i}"] for i in range(len(columns))]) for r in (got[:1] + got[-1:])]
        data = [T.Row(**{n: r[n] for n in made}) for r in got]
        return Page(data, more if not back else cursor is not None, more if back else cursor is not None, ends[0] if ends else None, ends[-1] if ends else None)

    def _paged(self, orders: list[Order]) -> tuple[DataFrame, list[Column], dict[str, Column]]:
        ctx = Context(self.aliases())
        made = self.shape(ctx) if callable(self.shape) else {n: ctx.column(*ref) for n, ref in (self.shape or {}).items()}
        return self.matched(), [ctx.column(o.alias, o.name) for o in orders], made or {a: ctx.whole(a) for a in self.aliases()}

    def written(self) -> DataFrame:
        """The rows with what they are ordered by, written once, for many pages."""
        rows, columns, made = self._paged(self._page_orders())
        return materialize(rows.select(*[c.alias(n) for n, c in made.items()], *[c.alias(f"__o{i}") for i, c in enumerate(columns)]), "pages")

    # Set operations
    def union(self, other: Any) -> SetQuery:
        return SetQuery(self, other, "union")

    def union_all(self, other: Any) -> SetQuery:
        return SetQuery(self, other, "union_all")

    def intersect(self, other: Any) -> SetQuery:
        return SetQuery(self, other, "intersect")

    def except_(self, other: Any) -> SetQuery:
        return SetQuery(self, other, "except")


@dataclass
class Page:
    data: list[Any]
    has_next: bool
    has_previous: bool
    start_cursor: str | None
    end_cursor: str | None


def encode_cursor(names: list[str], values: list[Any]) -> str:
    values = [{"t": v.isoformat()} if isinstance(v, dt.datetime) else v for v in values]
    return base64.urlsafe_b64encode(json.dumps({"v": 1, "d": "f", "vals": values, "cols": names}).encode()).decode().rstrip("=")


def decode_cursor(text: str, names: list[str], direction: str = "f") -> list[Any]:
    try:
        made = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
        columns, values = made["cols"], made["vals"]
    except (ValueError, KeyError, TypeError) as e:
        raise CursorError("not a cursor") from e
    if made.get("v") != 1 or columns != names or len(values) != len(names):
        raise CursorError("the cursor is from another query")
    return [dt.datetime.fromisoformat(v["t"]) if isinstance(v, dict) else v for v in values]


def keyset(orders: list[Order], columns: list[Column], values: list[Any], back: bool) -> Column:
    """Rows after (or before) the values in the given order."""
    out, equal = F.lit(False), F.lit(True)
    for o, c, v in zip(orders, columns, values, strict=True):
        first = (o.nulls == "first" if o.nulls else o.down) != back  # where nulls are, in reading order
        down = o.down != back
        if v is None:
            beyond = c.isNotNull() if first else F.lit(False)
            same = c.isNull()
        else:
            beyond = (c < F.lit(v)) if down else (c > F.lit(v))
            if not first:
                beyond = beyond | c.isNull()
            same = c == F.lit(v)
        out, equal = out | (equal & beyond), equal & same
    return out


@dataclass(frozen=True)
class SetQuery:
    left: Any
    right: Any
    how: str
    orders: tuple[Order, ...] = ()
    limit_: int | None = None
    offset_: int | None = None

    def recorded(self) -> set[int | None]:
        return set().union(*(q.recorded() if isinstance(q, SetQuery) else {q.at().recorded} for q in (self.left, self.right)))

    def to_df(self, **parameters: Any) -> DataFrame:
        if len(self.recorded()) > 1:
            raise TemporalError("the parts of a set operation read one recorded revision")
        a, b = (q.to_df(**parameters) for q in (self.left, self.right))
        if len(a.columns) != len(b.columns):
            raise QueryError("the parts of a set operation have the same number of columns")
        b = b.toDF(*a.columns)
        out = {"union": lambda: a.union(b).distinct(), "union_all": lambda: a.unionAll(b), "intersect": lambda: a.intersect(b), "except": lambda: a.subtract(b)}[self.how]()
        for o in self.orders:
            if o.name not in a.columns:
                raise QueryError(f"{o.name} isn't an output of the first part")
        if self.orders:
            out = out.orderBy(*[o.column(F.col(o.name)) for o in self.orders])
        out = out.offset(self.offset_) if self.offset_ else out
        return out if self.limit_ is None else out.limit(self.limit_)

    def execute(self, **parameters: Any) -> list[Any]:
        return self.to_df(**parameters).collect()

    def order_by(self, name: str, direction: str = "asc", nulls: str | None = None) -> SetQuery:
        return replace(self, orders=(*self.orders, Order(None, name, direction == "desc", nulls)))

    def limit(self, n: int) -> SetQuery:
        return replace(self, limit_=n)

    def offset(self, n: int) -> SetQuery:
        return replace(self, offset_=n)

    def union(self, other: Any) -> SetQuery:
        return SetQuery(self, other, "union")

    def union_all(self, other: Any) -> SetQuery:
        return SetQuery(self, other, "union_all")

    def intersect(self, other: Any) -> SetQuery:
        return SetQuery(self, other, "intersect")

    def except_(self, other: Any) -> SetQuery:
        return SetQuery(self, other, "except")


# Reusable parts of queries
def compose(*fragments: Callable[[Query], Query]) -> Callable[[Query], Query]:
    def run(q: Query) -> Query:
        for f in fragments:
            q = f(q)
        return q

    return run


def ordered_by(alias: str, name: str, direction: str = "asc") -> Callable[[Query], Query]:
    return lambda q: q.order_by(alias, name, direction)


def limited(n: int) -> Callable[[Query], Query]:
    return lambda q: q.limit(n)


def skipping(n: int) -> Callable[[Query], Query]:
    return lambda q: q.offset(n)


def field_of(q: Query, alias: str, name: str) -> Field:
    return getattr(Ref(q.aliases()[alias][0], f"{alias}__"), name)
