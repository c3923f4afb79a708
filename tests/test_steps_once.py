from graphloom.operators import algorithms
from graphloom.operators.algorithms import Algorithms
from graphloom.sources.star_schema import load


def test_searches_over_the_same_edges_write_their_steps_once(spark, monkeypatch):
    written = []
    write = algorithms.materialize
    monkeypatch.setattr(algorithms, "materialize", lambda df, name="step": written.append(name) or write(df, name))
    a = Algorithms(load(spark, "/root/testdata/sf0.001"))
    far = {r["id"]: r["depth"] for r in a.reachable("Order", "0", ["neighbour"], max_hops=3).collect()}
    target = max(far, key=far.get)
    assert a.can_reach(("Order", "0"), ("Order", target), ["neighbour"], max_hops=3).first()[0]
    assert a.can_reach(("Order", target), ("Order", "0"), ["neighbour"], "in", max_hops=3).first()[0]
    assert not a.can_reach(("Order", target), ("Order", "0"), ["neighbour"], max_hops=3).first()[0]
    assert written.count("steps") == 1
