"""Graph algorithms as loops over DataFrames.

A node is the struct (id, kind), which orders by id and then kind in code points. Rounds are written to
the shared folder, so lineage stays short and a lost executor costs a read. Frontiers and labels never come to the driver; what
does is one number or one path.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConvergenceError, InvalidEdgeWeightError, NodeNotFoundError, OscillationError, QueryError
from ..functions.tables import Growing, forget, materialize
from ..store import GraphStore

HOPS, MOST_HOPS, ROUNDS = 10, 1000, 1000
#: Largest weight of an edge, so that sums over a path stay finite.
MOST_WEIGHT = 1.7976931348623157e308 / 2.0**64


def key(kind: str = "kind", id_: str = "id") -> Column:
    return F.struct(F.col(id_).alias("id"), F.col(kind).alias("kind"))


class Algorithms:
    def __init__(self, store: GraphStore) -> None:
        self.store = store
        self._steps: dict[tuple[str, ...], DataFrame] = {}  # by edge kinds, one way

    # Input
    def _ends(self, kinds: Iterable[str]) -> list[str]:
        g, out = self.store.graph, set()
        for k in kinds:
            for n in (*g.edge(k).from_kinds, *g.edge(k).to_kinds):
                out |= set(g.node_kinds(n, True))
        return sorted(out)

    def _nodes(self, kinds: Iterable[str]) -> DataFrame:
        return self.store.nodes(kinds).select(key().alias("n"))

    def _edges(self, kinds: Iterable[str], direction: str, weight: Column | None = None) -> DataFrame:
        """Directed steps s -> t (with the edge's id and weight); both directions for ``both``."""
        kinds = list(kinds)
        if not kinds:
            raise QueryError("at least one edge kind")
        if direction not in ("out", "in", "both"):
            raise QueryError(f"direction: {direction}")
        rows = self.store.edges(kinds).select(key("from_kind", "from_id").alias("s"), key("to_kind", "to_id").alias("t"), F.struct("kind", "id").alias("edge"), (weight if weight is not None else F.lit(1.0)).alias("w"))
        back = rows.select(F.col("t").alias("s"), F.col("s").alias("t"), "edge", "w")
        return rows if direction == "out" else back if direction == "in" else rows.unionAll(back)

    @staticmethod
    def _hops(hops: int) -> int:
        if not 1 <= hops <= MOST_HOPS:
            raise QueryError(f"hops: {hops}")
        return hops

    def _source(self, kind: str, id_: str) -> DataFrame:
        return self.store.nodes([kind]).where(F.col("id") == id_).select(key().alias("n"))

    # Breadth first
    @staticmethod
    def _next(frontier: DataFrame, steps: DataFrame, visited: DataFrame) -> DataFrame:
        """Nodes that a step leads to for the first time, each with its smallest predecessor."""
        found = frontier.select(F.col("n").alias("s")).join(steps, "s").groupBy(F.col("t").alias("n")).agg(F.min("s").alias("before"))
        return materialize(found.join(visited, "n", "left_anti"), "level")

    def _seen_steps(self, edges: list[str], direction: str, kept: bool = True) -> DataFrame:
        """Steps s -> t between visible nodes. ``kept``: written once for all searches over these edges, whatever their direction."""
        if direction not in ("out", "in", "both"):
            raise QueryError(f"direction: {direction}")
        rows = self._steps.get(tuple(edges))
        if rows is None:
            rows = self._edges(edges, "out").select("s", "t")
            for end in ("s", "t"):
                rows = rows.join(self._nodes(self._ends(edges)).withColumnRenamed("n", end), end, "left_semi").select("s", "t")
            if kept:
                rows = self._steps[tuple(edges)] = materialize(rows, "steps")
        back = rows.select(F.col("t").alias("s"), F.col("s").alias("t"))
        return rows if direction == "out" else back if direction == "in" else rows.unionAll(back)

    def _levels(self, source: DataFrame, edges: Iterable[str], direction: str, hops: int) -> list[DataFrame]:
        """Frames (n, before) by depth; each node once, at its smallest depth, with its smallest predecessor."""
        steps = self._seen_steps(list(edges), direction, hops > 2)
        frontier = materialize(source.select("n", F.lit(None).cast(source.schema["n"].dataType).alias("before")), "level")
        levels, visited = [frontier], frontier.select("n")
        for _ in range(hops):
            frontier = self._next(frontier, steps, visited)
            if not frontier.count():
                break
            levels.append(frontier)
            visited = visited.unionAll(frontier.select("n"))
        return levels

    def reachable(self, kind: str, id_: str, edges: Iterable[str], direction: str = "out", max_hops: int = HOPS, exclude_source: bool = False) -> DataFrame:
        """id, kind, depth of what the source reaches, itself at depth 0."""
        out = None
        for depth, level in enumerate(self._levels(self._source(kind, id_), edges, direction, self._hops(max_hops))):
            one = level.select("n.id", "n.kind", F.lit(depth).alias("depth"))
            out = one if out is None else out.unionAll(one)
        out = out.where(F.col("id") != id_) if exclude_source else out
        return out.orderBy("depth", "id", "kind")

    def neighbors(self, kind: str, id_: str, edges: Iterable[str], direction: str = "out", depth: int = 1) -> DataFrame:
        return self.reachable(kind, id_, edges, direction, depth).where("depth > 0")

    def _between(self, source: tuple[str, str], target: tuple[str, str], edges: list[str], direction: str, hops: int) -> list[DataFrame] | None:
        """Frames (n, before) of the nodes at each place of the paths of fewest edges, with the smallest node before each; None if there is no path.

        The search goes on from both ends, always from the one with fewer nodes to leave, so that it looks at about twice the square root of what a search
        from one end would."""
        steps = self._seen_steps(edges, direction)
        back = steps.select(F.col("t").alias("s"), F.col("s").alias("t"))
        kind = steps.schema["s"].dataType
        ends = [self._source(*end).select("n", F.lit(None).cast(kind).alias("before")) for end in (source, target)]
        levels = [[materialize(end, "level")] for end in ends]
        sizes, visited = [level[0].count() for level in levels], [level[0].select("n") for level in levels]
        if not all(sizes):
            return None
        while True:
            meet = levels[0][-1].join(levels[1][-1].select("n"), "n", "left_semi")
            if meet.head(1):
                break
            if len(levels[0]) + len(levels[1]) - 2 >= hops:
                return None
            side = 0 if sizes[0] <= sizes[1] else 1
            more = self._next(levels[side][-1], (steps, back)[side], visited[side])
            sizes[side] = more.count()
            if not sizes[side]:
                return None
            levels[side].append(more)
            visited[side] = visited[side].unionAll(more.select("n"))
        # Of the second half only what the meeting nodes lead to is on a path.
        now, rest = meet, []
        for level in reversed(levels[1][:-1]):
            now = materialize(now.select(F.col("n").alias("s")).join(steps, "s").groupBy(F.col("t").alias("n")).agg(F.min("s").alias("before")).join(level.select("n"), "n", "left_semi"), "level")
            rest.append(now)
        return [*levels[0][:-1], meet, *rest]

    def shortest_path(self, source: tuple[str, str], target: tuple[str, str], edges: Iterable[str], direction: str = "out", max_hops: int = HOPS) -> DataFrame:
        """position, id, kind along a path of fewest edges, of such the one with the smallest predecessors; empty if there is none."""
        levels = self._between(source, target, list(edges), direction, self._hops(max_hops))
        path: list[tuple[str, str]] = []
        now = target
        for level in reversed(levels or []):
            path.append(now)
            before = level.where((F.col("n.id") == now[1]) & (F.col("n.kind") == now[0])).first()["before"]
            now = (before["kind"], before["id"]) if before else now
        rows = [(i, id_, kind) for i, (kind, id_) in enumerate(reversed(path))]
        return self.store.spark.createDataFrame(rows, "position int, id string, kind string")

    def can_reach(self, source: tuple[str, str], target: tuple[str, str], edges: Iterable[str], direction: str = "out", max_hops: int = HOPS) -> DataFrame:
        found = self._between(source, target, list(edges), direction, self._hops(max_hops)) is not None
        return self.store.spark.createDataFrame([(found,)], "can_reach boolean")

    def weighted_shortest_path(self, source: tuple[str, str], target: tuple[str, str], edges: Iterable[str], weight: str, direction: str = "out", default: float | None = None) -> DataFrame:
        """position, id, kind, total_weight along a path of least weight (ties: of fewest edges, then the smallest predecessors).

        Weights are finite, not negative and at most MOST_WEIGHT; a missing one is ``default`` or an error.

        The search goes on from both ends in steps of weight as wide as a mean edge: labels below the limit lead on, round by round, until none
        improves; then the limit moves. So only new labels are moved, and no end looks farther than half the least weight.
        """
        edges = list(edges)
        w = F.col(f"p__{weight}").cast("double")
        nodes, rows = self._weighted(edges, direction, F.coalesce(w, F.lit(default)) if default is not None else w)
        ends = [self._source(*end).join(nodes, "n").select("v").first() for end in (source, target)]
        if source == target:
            found = [(0, source[1], source[0], 0.0)] if self._source(*source).head(1) else []
            return self.store.spark.createDataFrame(found, "position int, id string, kind string, total_weight double")
        path = self._lightest(rows, ends[0]["v"], ends[1]["v"], direction == "both") if all(ends) else []
        names = {r["v"]: r["n"] for r in nodes.where(F.col("v").isin([v for v, _ in path])).collect()} if path else {}
        found = [(i, names[v]["id"], names[v]["kind"], path[-1][1]) for i, (v, _) in enumerate(path)]
        return self.store.spark.createDataFrame(found, "position int, id string, kind string, total_weight double")

    def _weighted(self, edges: list[str], direction: str, weight: Column) -> tuple[DataFrame, DataFrame]:
        """The nodes (n, v) and steps (s, t, w) of ``_numbered``, one way for ``both`` too; a weight that can't be is an error."""
        nodes = self._number(self._nodes(self._ends(edges)))
        rows = self._edges(edges, "out" if direction == "both" else direction, weight)
        for end in ("s", "t"):
            rows = rows.join(nodes.withColumnsRenamed({"n": end, "v": f"v_{end}"}), end, "left")
        wrong = f"(w is null or isnan(w) or w < 0 or w > {MOST_WEIGHT!r}D)"
        rows = rows.where(f"{wrong} or v_s is not null and v_t is not null")
        rows = materialize(rows.select(F.col("v_s").alias("s"), F.col("v_t").alias("t"), "w", F.expr(f"if({wrong}, edge, null)").alias("edge")), "edges")
        bad = rows.where("edge is not null").head(1)
        if bad:
            raise InvalidEdgeWeightError(f"edge {bad[0]['edge']['kind']} {bad[0]['edge']['id']} has weight {bad[0]['w']}")
        return nodes, rows.select("s", "t", "w")

    def _lightest(self, rows: DataFrame, source: int, target: int, both: bool) -> list[tuple[int, float]]:
        """Node and weight so far along the lightest path over steps (s, t, w), which lead either way with ``both``."""
        spark = self.store.spark
        back = rows.select(F.col("t").alias("s"), F.col("s").alias("t"), "w")
        steps = rows.unionAll(back) if both else rows.withColumn("side", F.lit(0)).unionAll(back.withColumn("side", F.lit(1)))
        on = ["s"] if both else ["side", "s"]
        wide = rows.agg(F.avg("w")).first()[0] or 0.0
        # A label x: weight and edges from its end (side 0: source, 1: target), and the node before.
        label = "side int, n bigint, x struct<d: double, h: int, before: bigint>, through struct<d: double, h: int>"
        known = Growing(spark, "labels")
        front = known.append(spark.createDataFrame([(0, source, (0.0, 0, None), None), (1, target, (0.0, 0, None), None)], label))
        limit, best = math.nextafter(wide, math.inf), None
        for _ in range(ROUNDS):
            lead = front.where(F.col("x.d") < limit).select("side", F.col("n").alias("s"), F.col("x.d").alias("d"), F.col("x.h").alias("h"))
            tried = lead.join(steps, on).select("side", F.col("t").alias("n"), F.struct((F.col("d") + F.col("w")).alias("d"), (F.col("h") + 1).alias("h"), F.col("s").alias("before")).alias("x"))
            if best is not None:
                tried = tried.where(F.col("x.d") <= best[0])
            tried = materialize(tried.groupBy("side", "n").agg(F.min("x").alias("x")), "tried")
            front = known.append(self._improved(known.read().join(tried.select("n").distinct(), "n", "left_semi"), tried))
            forget(tried)
            met, more = front.agg(F.min("through"), F.max(F.col("x.d") < limit)).first()
            if met is not None and (best is None or tuple(met) < best):
                best = tuple(met)
                limit = min(limit, math.nextafter(best[0] / 2, math.inf))
            if more:
                continue
            # All labels below the limit have led on; of a node with several the least holds.
            least = known.read().groupBy("side", "n").agg(F.min("x").alias("x"))
            known = Growing(spark, "labels")
            front = known.append(least.select("side", "n", "x", F.lit(None).cast("struct<d: double, h: int>").alias("through")))
            front = front.where(F.col("x.d") >= limit)
            low = {r["side"]: r["d"] for r in front.groupBy("side").agg(F.min("x.d").alias("d")).collect()}
            if len(low) < 2 or (best is not None and low[0] + low[1] > best[0]):
                return self._traced(known.read(), steps if both else steps.where("side = 0"), limit, best) if best else []
            limit = max(min(low.values()) + wide, math.nextafter(min(low.values()), math.inf))
            if best is not None:
                limit = min(limit, math.nextafter(best[0] / 2, math.inf))
        raise ConvergenceError("no end of improvements")

    @staticmethod
    def _improved(old: DataFrame, tried: DataFrame) -> DataFrame:
        """Labels that are tried and less than all old ones of their node and side, with the weight and edges of the paths through their node."""
        rows = old.select("side", "n", "x", F.lit(False).alias("new")).unionAll(tried.select("side", "n", "x", F.lit(True).alias("new")))
        of = lambda side, new: F.min(F.when((F.col("side") == side) & (F.col("new") == new), F.col("x"))).alias(f"{'new' if new else 'old'}{side}")
        each = rows.groupBy("n").agg(*[of(side, new) for side in (0, 1) for new in (False, True)])
        x, y = (F.least(f"old{side}", f"new{side}") for side in (0, 1))
        through = F.when(x.isNotNull() & y.isNotNull(), F.struct((x["d"] + y["d"]).alias("d"), (x["h"] + y["h"]).alias("h")))
        sides = [F.when(F.col(f"old{i}").isNull() | (F.col(f"new{i}") < F.col(f"old{i}")), F.struct(F.lit(i).alias("side"), F.col(f"new{i}").alias("x"))) for i in (0, 1)]
        moved = each.select("n", through.alias("through"), F.explode(F.array(*sides)).alias("m")).where("m.x is not null")
        return moved.select("m.side", "n", "m.x", "through")

    @staticmethod
    def _traced(labels: DataFrame, steps: DataFrame, limit: float, best: tuple[float, int]) -> list[tuple[int, float]]:
        """The path of least labels. Up to the limit labels from the source name the node before; beyond it the labels from the target tell which
        steps are on a lightest path, and of those only what lightest paths from the source lead to counts."""
        first = labels.where("side = 0").select("n", F.col("x").alias("x0"))
        last = labels.where("side = 1").select("n", F.col("x.d").alias("d"), F.col("x.h").alias("h"))
        own = first.where(F.col("x0.d") < limit).join(last, "n").where((F.col("x0.d") + F.col("d") == best[0]) & (F.col("x0.h") + F.col("h") == best[1]))
        own = materialize(own.select("n", "h", "x0"), "met")
        inner = first.where(F.col("x0.d") < limit).select("n")
        tight = last.select(F.col("n").alias("t"), F.col("d").alias("dt"), F.col("h").alias("ht")).join(inner.withColumnRenamed("n", "t"), "t", "left_anti").join(steps.select("s", "t", "w"), "t")
        tight = tight.join(last.select(F.col("n").alias("s"), F.col("d").alias("ds"), F.col("h").alias("hs")), "s").where("ds = dt + w and hs = ht + 1")
        tight = materialize(tight.select("s", "t", "w", F.col("ht").alias("h")), "tight")
        at = own.agg(F.max("h")).first()[0]
        levels, reached = [], own.where(F.col("h") == at).select("n")
        for h in range(at - 1, -1, -1):
            level = reached.withColumnRenamed("n", "s").join(tight.where(F.col("h") == h), "s").groupBy(F.col("t").alias("n")).agg(F.min(F.struct("s", "w")).alias("before"))
            levels.append(materialize(level, "level"))
            reached = levels[-1].select("n").unionAll(own.where(F.col("h") == h).select("n"))
        far, now = [], None
        for level in reversed(levels):
            row = level.first() if now is None else level.where(F.col("n") == now).first()
            if row is None:
                break
            far.append((row["n"], row["before"]["w"]))
            now = row["before"]["s"]
        row = (own.where("h = 0") if now is None else first.where(F.col("n") == now).select("n", "x0")).first()
        near, total = [], row["x0"]["d"]
        while row is not None:
            near.append((row["n"], row["x0"]["d"]))
            row = first.where(F.col("n") == row["x0"]["before"]).first() if row["x0"]["before"] is not None else None
        path = near[::-1]
        for n, w in reversed(far):
            total += w
            path.append((n, total))
        return path

    def degree(self, edges: Iterable[str] | None = None, direction: str = "both", node: tuple[str, str] | None = None) -> DataFrame:
        """id, kind, degree of every node with an edge; a loop counts once in ``both``. The far end isn't looked at."""
        edges = list(edges) if edges is not None else sorted(self.store.edge_frames)
        rows = self._edges(edges, direction)
        if direction == "both":
            loop = F.col("s") == F.col("t")
            rows = self._edges(edges, "out").unionAll(self._edges(edges, "in").where(~loop))
        if node:
            rows = rows.where((F.col("s.kind") == node[0]) & (F.col("s.id") == node[1]))
        return rows.groupBy("s").agg(F.count("*").alias("degree")).select("s.id", "s.kind", "degree")

    # The whole graph
    def _scope(self, edges: Iterable[str], node_kinds: Iterable[str] | None, direction: str = "both", weight: Column | None = None) -> tuple[DataFrame, DataFrame]:
        """Visible nodes of the kinds, and the edges with both ends among them."""
        edges = list(edges)
        nodes = materialize(self._nodes(self._ends(edges) if node_kinds is None else list(node_kinds)), "nodes")
        rows = self._edges(edges, direction, weight)
        for end in ("s", "t"):
            rows = rows.join(nodes.withColumnRenamed("n", end), end, "left_semi")
        return nodes, materialize(rows.select("s", "t", "w"), "edges")

    @staticmethod
    def _number(nodes: DataFrame) -> DataFrame:
        return materialize(nodes.repartitionByRange("n").sortWithinPartitions("n").select("n", F.monotonically_increasing_id().alias("v")), "nodes")

    def _numbered(self, edges: Iterable[str], node_kinds: Iterable[str] | None, direction: str = "both", weight: Column | None = None) -> tuple[DataFrame, DataFrame]:
        """The same with a number v for each node, in the nodes' order, so that rounds move numbers instead of names: (n, v) and (s, t, w)."""
        edges = list(edges)
        nodes = self._number(self._nodes(self._ends(edges) if node_kinds is None else list(node_kinds)))
        rows = self._edges(edges, "out" if direction == "both" else direction, weight).select("s", "t", "w")
        for end in ("s", "t"):
            rows = rows.join(nodes.withColumnsRenamed({"n": end, "v": f"v_{end}"}), end)
        rows = materialize(rows.select(F.col("v_s").alias("s"), F.col("v_t").alias("t"), "w"), "edges")
        return nodes, rows.unionAll(rows.select(F.col("t").alias("s"), F.col("s").alias("t"), "w")) if direction == "both" else rows

    def weakly_connected_components(self, edges: Iterable[str], node_kinds: Iterable[str] | None = None, min_size: int = 1, max_iterations: int = ROUNDS) -> DataFrame:
        """id, kind, component_id (smallest id), component_kind, size; nodes without edges are alone."""
        nodes, links = self._scope(edges, node_kinds, "out")
        from .components import components

        label = components(links.select(F.col("s").alias("a"), F.col("t").alias("b")), max_iterations)
        out = nodes.join(label.withColumnRenamed("node", "n"), "n", "left").select("n", F.coalesce("component", "n").alias("c"))
        sizes = out.groupBy("c").agg(F.count("*").alias("size")).where(F.col("size") >= min_size)
        return out.join(sizes, "c").select("n.id", "n.kind", F.col("c.id").alias("component_id"), F.col("c.kind").alias("component_kind"), "size").orderBy("component_id", "component_kind", "id", "kind")

    def label_propagation(self, edges: Iterable[str], node_kinds: Iterable[str] | None = None, max_iterations: int = 100, on_max: str = "raise") -> DataFrame:
        """id, kind, label_id, label_kind: each round a node takes the label most of its distinct neighbours have (ties: the smallest)."""
        nodes, links = self._numbered(edges, node_kinds)
        near = materialize(links.where("s <> t").select("s", "t").distinct(), "near")
        now, past = nodes.select("v", F.col("v").alias("label")), None
        for _ in range(max_iterations):
            # Votes are dealt by voter's neighbour alone, so both sums are of rows that are together already.
            heard = near.join(now.select(F.col("v").alias("t"), "label"), "t").select("s", "label").repartition("s")
            won = heard.groupBy("s", "label").agg(F.count("*").alias("votes")).groupBy("s").agg(F.min(F.struct((-F.col("votes")).alias("v"), "label")).alias("x")).select(F.col("s").alias("v"), F.col("x.label").alias("new"))
            after = materialize(now.join(won, "v", "left").select("v", F.coalesce("new", "label").alias("label"), F.coalesce(F.col("new") != F.col("label"), F.lit(False)).alias("moved")), "labels")
            done = not after.where("moved").head(1)
            swings = not done and past is not None and not after.select("v", "label").join(past.select("v", F.col("label").alias("was")), "v").where("label <> was").head(1)
            past, now = now, after.select("v", "label")
            if done:
                break
            if swings and on_max == "raise":
                raise OscillationError("labels swing between two states")
        else:
            if on_max == "raise":
                raise ConvergenceError(f"labels still move after {max_iterations} rounds")
        label = nodes.select(F.col("v").alias("label"), F.col("n").alias("of"))
        named = nodes.join(now, "v").join(label, "label")
        return named.select("n.id", "n.kind", F.col("of.id").alias("label_id"), F.col("of.kind").alias("label_kind")).orderBy("id", "kind")

    def page_rank(self, edges: Iterable[str], node_kinds: Iterable[str] | None = None, direction: str = "out", damping: float = 0.85, tolerance: float = 1e-8, max_iterations: int = ROUNDS, weight: str | None = None, seeds: Mapping[tuple[str, str], float] | None = None, top_k: int | None = None, every: int = 5) -> DataFrame:
        """id, kind, score. Parallel edges count each; a loop counts half a side in ``both``. Mass of nodes without
        outgoing weight goes where a jump goes. ``every``: rounds between two looks at the largest change.

        What such nodes give back is the same share of every jump, so it only scales all scores: the rounds leave it out and the
        end divides by the total. So a round needs no number from all nodes, and ``every`` rounds are one plan and one job, in which
        the flows are dealt once.
        """
        w = F.col(f"p__{weight}").cast("double") if weight else None
        nodes, links = self._numbered(edges, node_kinds, direction, w)
        if direction == "both":
            links = links.withColumn("w", F.when(F.col("s") == F.col("t"), F.col("w") / 2).otherwise(F.col("w")))
        n = nodes.count()
        if n == 0:
            return nodes.select("n.id", "n.kind", F.lit(0.0).alias("score"))
        if seeds:
            rows = self.store.spark.createDataFrame([(k, i, float(w)) for (k, i), w in seeds.items()], "kind string, id string, p double").select(key().alias("n"), "p")
            if rows.join(nodes, "n", "left_anti").head(1):
                raise NodeNotFoundError("a seed isn't in scope")
            total = sum(seeds.values())
            base = materialize(nodes.join(F.broadcast(rows), "n", "left").select("v", (F.coalesce("p", F.lit(0.0)) / total).alias("p")), "base")
        else:
            base = nodes.select("v", F.lit(1.0 / n).alias("p"))
        flows = links.groupBy("s", "t").agg(F.sum("w").alias("w")).where("w > 0")
        flows = materialize(flows.join(flows.groupBy("s").agg(F.sum("w").alias("out")), "s").select("s", "t", (F.col("w") / F.col("out")).alias("share")), "flows")
        score, done = base.select("v", (F.col("p") * (1 - damping)).alias("score")), 0
        while done < max_iterations:
            for _ in range(min(every, max_iterations - done)):
                was = score
                got = flows.join(was.select(F.col("v").alias("s"), "score"), "s").groupBy(F.col("t").alias("v")).agg(F.sum(F.col("score") * F.col("share")).alias("got"))
                score = base.join(got, "v", "left").select("v", (F.col("p") * (1 - damping) + damping * F.coalesce("got", F.lit(0.0))).alias("score"))
                done += 1
            step = materialize(score.join(was.withColumnRenamed("score", "was"), "v"), "scores")
            total, moved = step.agg(F.sum("score"), F.max(F.abs(F.col("score") - F.col("was")))).first()
            score = step.select("v", "score")
            if moved <= tolerance * total:
                break
        else:
            raise ConvergenceError(f"scores still move after {max_iterations} rounds")
        ranked = nodes.join(score, "v").select("n.id", "n.kind", (F.col("score") / total).alias("score")).orderBy(F.col("score").desc(), "id", "kind")
        return ranked.limit(top_k) if top_k else ranked

    def personalized_page_rank(self, seeds: Mapping[tuple[str, str], float] | Iterable[tuple[str, str]], edges: Iterable[str], **how: Any) -> DataFrame:
        given = dict(seeds) if isinstance(seeds, Mapping) else {s: 1.0 for s in seeds}
        if not given or any(w <= 0 for w in given.values()):
            raise QueryError("seeds have positive weights")
        return self.page_rank(edges, seeds=given, **how)

    def subgraph(self, root: tuple[str, str], edges: Iterable[str], max_depth: int = HOPS, direction: str = "out", include: Iterable[str] | None = None, exclude_root: bool = False) -> tuple[DataFrame, DataFrame]:
        """Nodes (id, kind, depth) and edges (kind, id, ends) around a root. Nodes of kinds not included are passed through
        but left out; edges have both ends among the nodes. Membership goes by (id, kind)."""
        edges = list(edges)
        found = materialize(self.reachable(root[0], root[1], edges, direction, max_depth), "subgraph")
        if include is not None:
            found = found.where(F.col("kind").isin(list(include)))
        if exclude_root:
            found = found.where(~((F.col("id") == root[1]) & (F.col("kind") == root[0])))
        rows = self.store.edges(edges).select("kind", "id", "from_kind", "from_id", "to_kind", "to_id")
        for side in ("from", "to"):
            ends = found.select(F.col("kind").alias(f"{side}_kind"), F.col("id").alias(f"{side}_id"))
            rows = rows.join(ends, [f"{side}_kind", f"{side}_id"], "left_semi")
        return found, rows.select("kind", "id", "from_kind", "from_id", "to_kind", "to_id")

    def adjacency(self, root: tuple[str, str], edges: Iterable[str], reverse: bool = False, **how: Any) -> DataFrame:
        """Of each node of the subgraph and edge kind: the ids it leads to (or comes from), sorted."""
        _, rows = self.subgraph(root, edges, **how)
        a, b = ("to", "from") if reverse else ("from", "to")
        return rows.groupBy(F.col(f"{a}_kind").alias("kind"), F.col(f"{a}_id").alias("id"), F.col("kind").alias("edge_kind")).agg(F.sort_array(F.collect_list(f"{b}_id")).alias("ids"))


