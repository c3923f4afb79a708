"""Connected components of an edge table, without bringing edges or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import forget, materialize, with_totals


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``edges`` (a, b).

    Alternates two steps until nothing moves. Nodes may be of any type that has an order. Large star: each edge's
    larger end is tied to the smallest neighbour of its smaller end. Small star: the smaller neighbours of a node
    and the node itself are tied to the smallest of them. The smallest neighbour of a hub is found with map-side
    combination and broadcast (``with_totals``), so no task reads all edges of a hub. Both steps are written, and
    removed when the next is there. Null ends and loops are left out; no edges give no rows. Raises RuntimeError if
    ``rounds`` don't suffice.
    """

    def row(u: str, v: str, *more):
        return F.struct(F.col(u).alias("u"), F.col(v).alias("v"), *more)

    def least(rows: DataFrame, size: int | None = None) -> DataFrame:
        return with_totals(rows, "u", [("m", F.min("v"))], size)

    def both(rows: DataFrame) -> DataFrame:
        return rows.select(F.explode(F.array(row("u", "v"), row("v", "u"))).alias("e")).select("e.*")

    state = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state = materialize(state, "edges")
    for _ in range(rounds):
        if not (size := state.count()):
            return state.select(F.col("u").alias("node"), F.col("v").alias("component"))
        large = least(both(state), 2 * size).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"), (F.col("m") < F.col("u")).alias("moved"))
        large = materialize(large.groupBy("u", "v").agg(F.max("moved").alias("moved")), "large")
        tie = F.when(F.col("v") == F.col("m"), row("u", "m", "moved")).otherwise(row("v", "m", F.lit(True).alias("moved")))
        small = least(large).select(tie.alias("e")).select("e.*").groupBy("u", "v").agg(F.max("moved").alias("moved"))
        small = materialize(small, "small")
        forget(state, large)
        if not small.where("moved").head(1):
            return small.select(F.explode(F.array(row("u", "v"), row("v", "v"))).alias("e")).select(F.col("e.u").alias("node"), F.col("e.v").alias("component")).distinct()
        state = small
    raise RuntimeError(f"components did not settle in {rounds} rounds")
