"""Graph interchange: JSON in and out, delimited files, JDBC.

A graph document has one JSON line for each node and edge. Nodes: {"type": "node", kind, id, properties, validFrom, validTo, meta}; edges
also have from and to as {kind, id}. Reads name their schema, so nothing is inferred from the data.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ImportConflictError, ValidationError
from ..model import GraphDef, struct
from ..operators.writes import create, create_edges, enforce, upsert
from ..store import GraphStore
from ..temporal import Coordinate

VERSION = "2.0"
_END = "struct<kind: string, id: string>"
SCHEMA = struct(f"type string, kind string, id string, properties string, validFrom timestamp, validTo timestamp, from {_END}, to {_END}, meta struct<version: int, createdAt: timestamp, updatedAt: timestamp, deletedAt: timestamp>")


def export_graph(store: GraphStore, node_kinds: Iterable[str] | None = None, edge_kinds: Iterable[str] | None = None, temporal: bool = True, meta: bool = False, deleted: bool = False) -> DataFrame:
    """Lines of the document as a DataFrame (value): write it with ``.write.text``. Nodes come before edges only by their type."""
    nodes = sorted(store.frames) if node_kinds is None else list(node_kinds)
    edges = sorted(store.edge_frames) if edge_kinds is None else list(edge_kinds)
    view = store.view("includeTombstones") if deleted else store.view("includeEnded")
    parts = []
    for kinds, edge in ((nodes, False), (edges, True)):
        for k in kinds:
            rows = view.edges([k]) if edge else view.nodes([k])
            schema = (store.graph.edge(k) if edge else store.graph.node(k)).schema
            properties = F.struct(*[F.col(f"p__{f.name}").alias(f.name) for f in schema]) if schema.fields else None
            columns = [F.lit("edge" if edge else "node").alias("type"), "kind", "id"]
            if properties is not None:
                columns.append(properties.alias("properties"))
            if edge:
                columns += [F.struct(F.col("from_kind").alias("kind"), F.col("from_id").alias("id")).alias("from"), F.struct(F.col("to_kind").alias("kind"), F.col("to_id").alias("id")).alias("to")]
            if temporal:
                columns += [F.col("valid_from").alias("validFrom"), F.col("valid_to").alias("validTo")]
            if meta:
                columns.append(F.struct("version", F.col("created_at").alias("createdAt"), F.col("updated_at").alias("updatedAt"), F.col("deleted_at").alias("deletedAt")).alias("meta"))
            parts.append(rows.select(F.to_json(F.struct(*columns)).alias("value")))
    return functools.reduce(DataFrame.unionAll, parts)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of one or many files as rows of SCHEMA, properties as JSON text."""
    return parse_lines(spark.read.text(path))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Lines (value) as rows. Properties keep their JSON, so a null stays apart from an absent one."""
    return lines.select(F.from_json("value", SCHEMA).alias("r")).select("r.*")


def import_graph(store: GraphStore, rows: DataFrame, on_conflict: str = "error", on_unknown: str = "error", validate: bool = True) -> GraphStore:
    """The store with the rows of a document. ``on_conflict``: skip, update or error for ids that live already, or trust
    that there are none, nor any twice;
    ``on_unknown``: error, strip or allow for properties that the kind doesn't declare (allow keeps declared ones only)."""
    if on_conflict not in ("skip", "update", "error", "trust") or on_unknown not in ("error", "strip", "allow"):
        raise ValidationError(f"{on_conflict}, {on_unknown}")
    known = {("node", k) for k in store.graph.nodes} | {("edge", k) for k in store.graph.edges}
    kinds = [(r["type"], r["kind"]) for r in rows.select("type", "kind").distinct().limit(len(known) + 1).collect()]  # as many as the schema has, or an error
    if unknown := [k for k in kinds if k not in known]:
        raise ValidationError(f"unknown kinds {unknown}")
    out, touched = store, {"node": [], "edge": []}
    for what, k in sorted(kinds, key=lambda x: x[0] != "node"):
        schema = (store.graph.edge(k) if what == "edge" else store.graph.node(k)).schema
        own = rows.where((F.col("type") == what) & (F.col("kind") == k))
        if on_unknown == "error":
            names = F.array(*[F.lit(f.name) for f in schema]) if schema.fields else F.array().cast("array<string>")
            odd = own.select(F.explode(F.array_except(F.json_object_keys("properties"), names)).alias("n")).head(1)
            if odd:
                raise ValidationError(f"{k} has no property {odd[0]['n']}")
        parsed = own.withColumn("p", F.from_json(F.coalesce("properties", F.lit("{}")), schema)) if schema.fields else own
        time = [F.col("validFrom").alias("valid_from"), F.col("validTo").alias("valid_to")]
        fields = [F.col(f"p.{f.name}").alias(f.name) for f in schema]
        if what == "edge":
            fresh = parsed.select("id", F.col("from.kind").alias("from_kind"), F.col("from.id").alias("from_id"), F.col("to.kind").alias("to_kind"), F.col("to.id").alias("to_id"), *time, *fields)
        else:
            fresh = parsed.select("id", *time, *fields)
        if on_conflict != "trust" and fresh.groupBy("id").count().where("count > 1").head(1):
            raise ImportConflictError(f"a {k} id comes twice")
        have = (out.edges([k], visible=False) if what == "edge" else out.nodes([k], visible=False)).where("deleted_at is null").select("id")
        if on_conflict == "error" and fresh.join(have, "id", "left_semi").head(1):
            raise ImportConflictError(f"a {k} id is taken")
        if on_conflict == "skip":
            fresh = fresh.join(have, "id", "left_anti")
        if what == "edge":
            out = create_edges(out, k, fresh, False)
        else:
            out = upsert(out, k, fresh) if on_conflict == "update" else create(out, k, fresh, False)
        touched[what].append(k)
    if validate:
        enforce(out, touched["node"], touched["edge"])
    return out


def trusted_import(store: GraphStore, rows: DataFrame) -> GraphStore:
    """Bulk load of rows that are known to be good: nothing is checked."""
    return import_graph(store, rows, "trust", "strip", False)


def to_document(graph: GraphDef) -> str:
    return json.dumps({"formatVersion": VERSION, "schema": graph.document()}, sort_keys=True, default=list)


def read_delimited(spark: SparkSession, path: str | list[str], columns: str, sep: str = "|") -> DataFrame:
    """A delimited file with a header; ``columns`` is its schema in DDL, by position (headers may repeat)."""
    return spark.read.schema(columns).option("sep", sep).option("header", True).option("enforceSchema", True).csv(path)


def edges_from(frame: DataFrame, from_: str, to: str, *more: str) -> DataFrame:
    """An edge frame of two key columns; its ids are made of the ends."""
    return frame.select(F.concat_ws("-", F.col(from_).cast("string"), F.col(to).cast("string"), *[F.col(c).cast("string") for c in more]).alias("id"), F.col(from_).cast("string").alias("from_id"), F.col(to).cast("string").alias("to_id"), *more)


def read_jdbc(spark: SparkSession, url: str, table: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A database table, read in parallel over ranges of a column: (column, low, high, parts)."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition:
        column, low, high, parts = partition
        reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.load()


_FRAMES = ("nodes", "edges", "recorded_nodes", "recorded_edges")


def save(store: GraphStore, path: str, files: int | None = None) -> None:
    """The whole store as Parquet: kinds under path/nodes/kind=K and path/edges/kind=K, recorded rows likewise, assertions, and the coordinate, so that
    ``open_saved`` reads what this store reads. Edges are sorted by source within files, so that statistics skip row groups."""
    for what, frames in zip(_FRAMES, (store.frames, store.edge_frames, store.recorded_nodes, store.recorded_edges), strict=True):
        for k, f in frames.items():
            edges = "from_id" in f.columns
            rows = f.repartition(files, "from_id").sortWithinPartitions("from_id") if edges and files else f.sortWithinPartitions("from_id") if edges else f
            rows.write.mode("overwrite").parquet(f"{path}/{what}/kind={k}")
    if store.assertions is not None:
        store.assertions.write.mode("overwrite").parquet(f"{path}/assertions")
    at = store.coordinate
    row = (at.mode, at.as_of, at.recorded, at.now)
    store.spark.createDataFrame([row], _COORDINATE).coalesce(1).write.mode("overwrite").parquet(f"{path}/coordinate")


_COORDINATE = "mode string, as_of timestamp_ntz, recorded long, now timestamp_ntz"


def open_saved(spark: SparkSession, graph: GraphDef, path: str) -> GraphStore:
    """A store that ``save`` has written, at the coordinate it had."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def found(place: str) -> DataFrame | None:
        at = jvm.org.apache.hadoop.fs.Path(place)
        return spark.read.parquet(place) if at.getFileSystem(hadoop).exists(at) else None

    def frames(what: str) -> dict[str, DataFrame]:
        kinds = graph.edges if what.endswith("edges") else graph.nodes
        return {k: f for k in kinds if (f := found(f"{path}/{what}/kind={k}")) is not None}

    kept = spark.read.schema(_COORDINATE).parquet(f"{path}/coordinate").first()
    nodes, edges, recorded_nodes, recorded_edges = map(frames, _FRAMES)
    return GraphStore(spark, graph, nodes, edges, Coordinate(**kept.asDict()), recorded_nodes, recorded_edges, found(f"{path}/assertions"))
