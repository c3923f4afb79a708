import random

from graphloom.operators.components import components


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(40)] + [(3, 3), (None, 1)]
    parent = {x: x for e in edges for x in e if x is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    linked = {x for a, b in edges if a != b and a is not None for x in (a, b)}
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_hubs(spark, monkeypatch):
    """Hubs are looked up, not dealt to one task; labels are the same."""
    from graphloom.functions import tables

    monkeypatch.setattr(tables, "HOT_ROWS", 10)
    monkeypatch.setattr(tables, "SMALL", 0)
    monkeypatch.setattr(tables, "HOT_KEYS", 3)
    edges = [(0, i) for i in range(1, 80)] + [(500 + i, 500) for i in range(60)] + [(700 + i, 900) for i in range(50)] + [(900, 559)] + [(1000 + i, 1001 + i) for i in range(30)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: 0 if n < 80 else 500 if n < 1000 else 1000 for e in edges for n in e}
