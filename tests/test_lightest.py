"""Weighted paths against a plain search, on small graphs with many equal weights."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import tables
from graphloom.model import EdgeKind, GraphDef, NodeKind, struct
from graphloom.operators.algorithms import Algorithms
from graphloom.store import GraphStore

GRAPH = GraphDef("roads", [NodeKind("Place", struct(""))], [EdgeKind("road", ("Place",), ("Place",), struct("weight double"))])


def store(spark, n, rows):
    nodes = spark.createDataFrame([(f"n{i:03d}",) for i in range(n)], "id string")
    edges = spark.createDataFrame([(f"e{i}", f"n{a:03d}", f"n{b:03d}", w) for i, (a, b, w) in enumerate(rows)], "id string, from_id string, to_id string, weight double")
    return GraphStore(spark, GRAPH, {"Place": nodes}, {"road": edges})


def plain(rows, source, target, both):
    """Of least (weight, edges) the path whose predecessors are the smallest, from the target back."""
    out = {}
    for a, b, w in rows:
        for x, y in ((a, b), (b, a))[: 1 + both]:
            out.setdefault(x, []).append((y, w))
    best, heap = {source: (0.0, 0, -1)}, [(0.0, 0, source)]
    while heap:
        d, h, x = heapq.heappop(heap)
        if (d, h) > best[x][:2]:
            continue
        for y, w in out.get(x, []):
            if y not in best or (d + w, h + 1, x) < best[y]:
                heapq.heappush(heap, (d + w, h + 1, y)) if y not in best or (d + w, h + 1) < best[y][:2] else None
                best[y] = (d + w, h + 1, x)
    if target not in best:
        return [], None
    path = [target]
    while path[-1] != source:
        path.append(best[path[-1]][2])
    return path[::-1], best[target][0]


@pytest.mark.parametrize(("seed", "n", "m", "direction", "most"), [(1, 30, 60, "both", 3), (2, 30, 80, "out", 2), (3, 40, 90, "in", 0), (4, 24, 20, "both", 5)])
def test_ties_and_zero_weights(spark, seed, n, m, direction, most):
    r = random.Random(seed)
    rows = [(r.randrange(n), r.randrange(n), float(r.randint(0, most))) for _ in range(m)]
    turned = [(b, a, w) for a, b, w in rows] if direction == "in" else rows
    path, total = plain(turned, 0, n - 1, direction == "both")
    got = Algorithms(store(spark, n, rows)).weighted_shortest_path(("Place", "n000"), ("Place", f"n{n - 1:03d}"), ["road"], "weight", direction).orderBy("position").collect()
    assert [x.id for x in got] == [f"n{i:03d}" for i in path] and {x.total_weight for x in got} == ({total} if path else set())


def test_a_round_moves_new_labels_alone(spark, monkeypatch):
    """A chain beside a far region: labels written are about the nodes within half the weight, not all nodes a round."""
    rows = [(i, i + 1, 1.0) for i in range(12)] + [(i, i + 1, 1.0) for i in range(20, 219)] + [(0, 20, 50.0)]
    written = []
    append = tables.Growing.append

    def counted(self, df):
        out = append(self, df)
        written.append(out.count())
        return out

    monkeypatch.setattr(tables.Growing, "append", counted)
    got = Algorithms(store(spark, 220, rows)).weighted_shortest_path(("Place", "n000"), ("Place", "n012"), ["road"], "weight", "both")
    assert got.agg(F.max("total_weight"), F.count("*")).first()[:] == (12.0, 13) and sum(written) < 100
