"""Batch writes: each returns a new store whose frame for a kind is the old one with the change applied, checked first."""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import CardinalityError, DisjointnessError, EndpointError, RestrictedDeleteError, UniquenessError, ValidationError
from ..functions.predicates import Predicate, Ref
from ..model import NodeKind
from ..store import EDGE_ROW, NODE_ROW, GraphStore, LazyFrames, unique_key
from ..temporal import OPEN_REVISION


def _flat(store: GraphStore, kind: str, edge: bool = False) -> DataFrame:
    """All rows of a kind, deleted ones too, with plain property names."""
    rows = store.edges([kind], visible=False) if edge else store.nodes([kind], visible=False)
    schema = store.graph.edge(kind).schema if edge else store.graph.node(kind).schema
    own = EDGE_ROW if edge else NODE_ROW
    return rows.select(*[n for n in own if n != "kind"], *[F.col(f"p__{f.name}").alias(f.name) for f in schema])


def _with(store: GraphStore, kind: str, frame: DataFrame, edge: bool = False) -> GraphStore:
    put = lambda frames: frames.put(kind, frame) if isinstance(frames, LazyFrames) else {**frames, kind: frame}
    nodes, edges = (store.frames, put(store.edge_frames)) if edge else (put(store.frames), store.edge_frames)
    return GraphStore(store.spark, store.graph, nodes, edges, store.coordinate, store.recorded_nodes, store.recorded_edges, store.assertions)


def _filled(store: GraphStore, kind: str, rows: DataFrame, now: dt.datetime, edge: bool = False) -> DataFrame:
    """New rows with the row columns they lack."""
    schema = store.graph.edge(kind).schema if edge else store.graph.node(kind).schema
    unknown = set(rows.columns) - set(schema.fieldNames()) - set(EDGE_ROW) - set(NODE_ROW)
    if unknown:
        raise ValidationError(f"{kind} has no properties {sorted(unknown)}")
    time = F.lit(now).cast("timestamp")
    fixed = {"version": F.lit(1), "valid_from": time, "valid_to": F.lit(None).cast("timestamp"), "created_at": time, "updated_at": time, "deleted_at": F.lit(None).cast("timestamp")}
    own = [n for n in (EDGE_ROW if edge else NODE_ROW) if n != "kind"]
    if edge:
        k = store.graph.edge(kind)
        fixed |= {"from_kind": F.lit(k.from_kinds[0]), "to_kind": F.lit(k.to_kinds[0])}
    return rows.select(*[(F.col(n) if n in rows.columns else fixed[n]).alias(n) for n in own], *[(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def create(store: GraphStore, kind: str, rows: DataFrame, check: bool = True) -> GraphStore:
    """More nodes. Ids that live already, broken uniqueness and disjoint kinds are errors."""
    old, new = _flat(store, kind), _filled(store, kind, rows, store.coordinate.now)
    if check:
        live = old.where("deleted_at is null").select("id")
        if new.join(live, "id", "left_semi").head(1) or new.groupBy("id").count().where("count > 1").head(1):
            raise ValidationError(f"an id of the new {kind} rows is taken")
    out = _with(store, kind, old.join(new, "id", "left_anti").unionByName(new))
    if check:
        enforce(out, [kind], [])
    return out


def _updated(store: GraphStore, kind: str, where: Callable[[Ref], Predicate], values: dict[str, Column], edge: bool) -> GraphStore:
    old, k = _flat(store, kind, edge), store.graph.edge(kind) if edge else store.graph.node(kind)
    fields = k.schema.fieldNames()
    if unknown := set(values) - set(fields):
        raise ValidationError(f"{kind} has no properties {sorted(unknown)}")
    own = [n for n in (EDGE_ROW if edge else NODE_ROW) if n != "kind"]
    rows = old.select(*own, *[F.col(f).alias(f"p__{f}") for f in fields]).withColumn("kind", F.lit(kind))
    rows = rows.withColumn("__hit", F.coalesce(where(Ref(k.schema)).column & store.coordinate.visible(), F.lit(False)))
    changed = lambda c, new: F.when(F.col("__hit"), new).otherwise(F.col(c))
    special = {"version": changed("version", F.col("version") + 1), "updated_at": changed("updated_at", F.lit(store.coordinate.now).cast("timestamp"))}
    out = rows.select(*[special.get(n, F.col(n)).alias(n) for n in own], *[(changed(f"p__{f}", values[f]) if f in values else F.col(f"p__{f}")).alias(f) for f in fields])
    return _with(store, kind, out, edge)


def update_where(store: GraphStore, kind: str, where: Callable[[Ref], Predicate], values: dict[str, Column]) -> GraphStore:
    """Live rows that fit get new values (of ``p__`` columns) and a higher version."""
    return _updated(store, kind, where, values, False)


def update_edges(store: GraphStore, kind: str, where: Callable[[Ref], Predicate], values: dict[str, Column]) -> GraphStore:
    """The same for edges; their ends stay."""
    return _updated(store, kind, where, values, True)


def upsert(store: GraphStore, kind: str, rows: DataFrame) -> GraphStore:
    """By id: new ones are added, live ones whose properties differ are replaced with a higher version, equal ones stay as they are."""
    fields = store.graph.node(kind).schema.fieldNames()
    old, new = _flat(store, kind), _filled(store, kind, rows, store.coordinate.now)
    given = [f for f in fields if f in rows.columns]
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.id") == F.col("n.id"), "full")
    live = F.col("o.id").isNotNull() & F.col("o.deleted_at").isNull()
    differ = functools.reduce(lambda a, b: a | b, [~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")) for f in given], F.lit(False))
    change = live & F.col("n.id").isNotNull() & differ
    fresh = F.col("n.id").isNotNull() & ~live
    pick = lambda c, changed: F.when(fresh, F.col(f"n.{c}")).when(change, changed).otherwise(F.col(f"o.{c}")).alias(c)
    out = both.select(
        F.coalesce("o.id", "n.id").alias("id"), pick("version", F.col("o.version") + 1), pick("valid_from", F.col("o.valid_from")), pick("valid_to", F.col("o.valid_to")),
        pick("created_at", F.col("o.created_at")), pick("updated_at", F.col("n.updated_at")), pick("deleted_at", F.col("o.deleted_at")),
        *[pick(f, F.col(f"n.{f}") if f in given else F.col(f"o.{f}")) for f in fields],
    )
    return _with(store, kind, out)


def get_or_create(store: GraphStore, kind: str, constraint: str, rows: DataFrame) -> tuple[DataFrame, GraphStore]:
    """Of each row (with an id for the case that it is new) the id that lives under its unique key, and the store with the new ones."""
    unique = next(u for u in store.graph.node(kind).unique if u.name == constraint)
    keyed = rows.withColumn("__key", unique_key(unique, ""))
    first = keyed.withColumn("__n", F.row_number().over(Window.partitionBy("__key").orderBy("id"))).where("__n = 1").select("__key", F.col("id").alias("__new"))
    live = store.nodes([kind]).select(unique_key(unique).alias("__key"), F.col("id").alias("__old"))
    ids = keyed.join(first, "__key").join(live, "__key", "left").select(*rows.columns, F.coalesce("__old", "__new").alias("found_id"), F.col("__old").isNull().alias("created"))
    fresh = ids.where("created and id = found_id").select(*rows.columns)
    return ids, create(store, kind, fresh, False)


def delete(store: GraphStore, kind: str, ids: DataFrame, hard: bool = False) -> GraphStore:
    """Deletes nodes. With edges: restrict is an error, cascade and disconnect delete those too. Hard deletes drop rows."""
    touched, now = {}, F.lit(store.coordinate.now).cast("timestamp")
    gone = ids.select("id").distinct()
    for e, k in store.graph.edges.items():
        if e not in store.edge_frames:
            continue
        rows = _flat(store, e, True)
        for side, kinds in (("from", k.from_kinds), ("to", k.to_kinds)):
            if store.graph.ontology.is_assignable_to_any(kind, kinds):
                ends = gone.select(F.col("id").alias(f"{side}_id"), F.lit(kind).alias(f"{side}_kind"), F.lit(True).alias(f"__{side}"))
                rows = rows.join(ends, [f"{side}_id", f"{side}_kind"], "left")
            else:
                rows = rows.withColumn(f"__{side}", F.lit(None).cast("boolean"))
        rows = rows.withColumn("__hit", F.coalesce("__from", "__to", F.lit(False)))
        if store.graph.node(kind).on_delete == "restrict" and rows.where("__hit and deleted_at is null").head(1):
            raise RestrictedDeleteError(f"{kind} nodes have {e} edges")
        own = _flat(store, e, True).columns
        touched[e] = rows.where("not __hit").select(*own) if hard else rows.withColumn("deleted_at", F.when(F.col("__hit") & F.col("deleted_at").isNull(), now).otherwise(F.col("deleted_at"))).select(*own)
    old = _flat(store, kind)
    if hard:
        left = old.join(gone, "id", "left_anti")
    else:
        mark = old.join(gone.withColumn("__gone", F.lit(True)), "id", "left")
        left = mark.withColumn("deleted_at", F.when(F.col("__gone") & F.col("deleted_at").isNull(), now).otherwise(F.col("deleted_at"))).select(*old.columns)
    out = _with(store, kind, left)
    for e, frame in touched.items():
        out = _with(out, e, frame, True)
    return out


def create_edges(store: GraphStore, kind: str, rows: DataFrame, check: bool = True) -> GraphStore:
    new = _filled(store, kind, rows, store.coordinate.now, True)
    old = _flat(store, kind, True)
    out = _with(store, kind, old.join(new.select("id"), "id", "left_anti").unionByName(new), True)
    if check:
        enforce(out, [], [kind])
    return out


def get_or_create_edges(store: GraphStore, kind: str, rows: DataFrame) -> GraphStore:
    """Edges whose ends have no live edge of the kind yet."""
    ends = ["from_kind", "from_id", "to_kind", "to_id"]
    new = _filled(store, kind, rows, store.coordinate.now, True)
    new = new.withColumn("__n", F.row_number().over(Window.partitionBy(*ends).orderBy("id"))).where("__n = 1").drop("__n")
    have = store.edges([kind]).select(*ends)
    return create_edges(store, kind, new.join(have, ends, "left_anti"))


def delete_edges(store: GraphStore, kind: str, ids: DataFrame, hard: bool = False) -> GraphStore:
    old, now = _flat(store, kind, True), F.lit(store.coordinate.now).cast("timestamp")
    gone = ids.select("id").distinct().withColumn("__gone", F.lit(True))
    rows = old.join(gone, "id", "left")
    rows = rows.where("__gone is null") if hard else rows.withColumn("deleted_at", F.when(F.col("__gone") & F.col("deleted_at").isNull(), now).otherwise(F.col("deleted_at")))
    return _with(store, kind, rows.select(*old.columns), True)


# Constraints
def unique_scope(store: GraphStore, kind: NodeKind, scope: str) -> list[str]:
    """Kinds whose rows share a key: the kind, or all subclasses of its topmost ancestors."""
    if scope == "kind":
        return [kind.name]
    o = store.graph.ontology
    roots = {a for a in {kind.name, *o.ancestors.get(kind.name, ())} if not o.ancestors.get(a)}
    return sorted(k for r in roots for k in o.expand_sub_classes(r) if k in store.frames)


def violations(store: GraphStore, node_kinds: list[str] | None = None, edge_kinds: list[str] | None = None) -> DataFrame:
    """constraint, kind, key, n: every broken rule of the given kinds (all by default)."""
    g, at, parts = store.graph, store.coordinate, []
    node_kinds = sorted(store.frames) if node_kinds is None else node_kinds
    edge_kinds = sorted(store.edge_frames) if edge_kinds is None else edge_kinds
    out = lambda rows, rule, kind, *named: rows.select(F.lit(rule).alias("constraint"), F.lit(kind).alias("kind"), F.concat_ws("|", *named).alias("key"), F.col("n").cast("long").alias("n"))
    for k in node_kinds:
        for u in g.node(k).unique:
            have = [s for s in unique_scope(store, g.node(k), u.scope) if set(u.fields) <= set(g.node(s).schema.fieldNames())]
            rows = functools.reduce(DataFrame.unionAll, [store.nodes([s], at).select("id", "kind", *[F.col(f"p__{f}") for f in dict.fromkeys((*u.fields, *u.where_not_null)) if f in g.node(s).schema.fieldNames()]) for s in have])
            for f in u.where_not_null:
                rows = rows.where(F.col(f"p__{f}").isNotNull())
            dup = rows.groupBy(unique_key(u).alias("key")).agg(F.count("*").alias("n")).where("n > 1")
            parts.append(out(dup, f"unique:{u.name}", k, F.translate("key", "\0", "/")))
    for k in edge_kinds:
        e, rows = g.edge(k), store.edges([k])
        if e.cardinality in ("one", "oneActive"):
            some = rows.where("valid_to is null") if e.cardinality == "oneActive" else rows
            parts.append(out(some.groupBy("from_kind", "from_id").agg(F.count("*").alias("n")).where("n > 1"), e.cardinality, k, "from_kind", "from_id"))
        if e.cardinality == "unique":
            parts.append(out(rows.groupBy("from_kind", "from_id", "to_kind", "to_id").agg(F.count("*").alias("n")).where("n > 1"), "unique edge", k, "from_kind", "from_id", "to_kind", "to_id"))
        for side, kinds in (("from", e.from_kinds), ("to", e.to_kinds)):
            allowed = sorted(set().union(*(g.node_kinds(x, True) for x in kinds)))
            odd = rows.where(~F.col(f"{side}_kind").isin(allowed)).groupBy(f"{side}_kind").agg(F.count("*").alias("n"))
            parts.append(out(odd, f"{side} kind", k, f"{side}_kind"))
            seen = store.nodes(allowed, visible=e.endpoint_existence == "currentlyValid")
            seen = seen.where("deleted_at is null") if e.endpoint_existence == "notDeleted" else seen
            ends = rows.where(F.col(f"{side}_kind").isin(allowed)).select(F.col(f"{side}_kind").alias("kind"), F.col(f"{side}_id").alias("id"))
            lost = ends.join(seen.select("kind", "id"), ["kind", "id"], "left_anti").groupBy("kind", "id").agg(F.count("*").alias("n"))
            parts.append(out(lost, f"{side} missing", k, "kind", "id"))
    for a, b in g.ontology.disjoint_pairs():
        if a in store.frames and b in store.frames and (a in node_kinds or b in node_kinds):
            both = store.nodes([a]).select("id").join(store.nodes([b]).select("id"), "id", "left_semi").groupBy("id").agg(F.count("*").alias("n"))
            parts.append(out(both, f"disjoint:{b}", a, "id"))
    if not parts:
        return store.spark.createDataFrame([], "constraint string, kind string, key string, n long")
    return functools.reduce(DataFrame.unionAll, parts)


def enforce(store: GraphStore, node_kinds: list[str], edge_kinds: list[str]) -> None:
    bad = violations(store, node_kinds, edge_kinds).head(1)
    if bad:
        rule = bad[0]["constraint"]
        kind = UniquenessError if rule.startswith("unique:") else DisjointnessError if rule.startswith("disjoint:") else EndpointError if rule.startswith(("from", "to")) else CardinalityError
        raise kind(f"{rule} of {bad[0]['kind']}: {bad[0]['key']}")


# Recorded time
def capture(history: DataFrame | None, before: DataFrame, after: DataFrame, revision: int) -> DataFrame:
    """History (row columns, op, recorded_from, recorded_to) after a batch that turned ``before`` into ``after``.

    Open rows whose image changed are closed at the revision, and the new image is appended: delete if it is a tombstone or
    gone, create if nothing live was open, else update.
    """
    if before.columns != after.columns:
        raise ValidationError("before and after have the same columns")
    columns = after.columns
    if history is None:
        history = before.select("*", F.lit("create").alias("op"), F.lit(0).cast("long").alias("recorded_from"), F.lit(OPEN_REVISION).alias("recorded_to"))
    image = lambda c: F.hash(*[F.col(f"{c}.{n}") for n in columns])
    same = functools.reduce(lambda a, b: a & b, [F.col(f"b.{n}").eqNullSafe(F.col(f"a.{n}")) for n in columns])
    joined = before.alias("b").join(after.alias("a"), F.col("b.id") == F.col("a.id"), "full").where(~same | (image("b") != image("a")))
    op = F.when(F.col("a.id").isNull() | F.col("a.deleted_at").isNotNull(), "delete").when(F.col("b.id").isNull() | F.col("b.deleted_at").isNotNull(), "create").otherwise("update")
    now = joined.select(*[F.coalesce(f"a.{n}", f"b.{n}").alias(n) if n == "id" else F.when(F.col("a.id").isNotNull(), F.col(f"a.{n}")).otherwise(F.col(f"b.{n}")).alias(n) for n in columns], op.alias("op"))
    changed = now.select("id").withColumn("__changed", F.lit(True))
    closed = history.join(changed, "id", "left").withColumn("recorded_to", F.when(F.col("__changed") & (F.col("recorded_to") == OPEN_REVISION), F.lit(revision).cast("long")).otherwise(F.col("recorded_to")))
    added = now.select("*", F.lit(revision).cast("long").alias("recorded_from"), F.lit(OPEN_REVISION).alias("recorded_to"))
    return closed.select(*columns, "op", "recorded_from", "recorded_to").unionByName(added)
