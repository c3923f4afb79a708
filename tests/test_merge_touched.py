"""A merge groups and joins what branches changed and what clusters hold; the rest passes by, with the same results."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import merge as mg
from graphloom.operators.components import components

FRAME = "id string, kind string, props map<string, string>, valid_from timestamp, valid_to timestamp, deleted_at timestamp"


def frame(spark, nodes):
    rows = [(i, "P", props, None, None) for i, props in nodes.items()]
    return spark.createDataFrame(rows, FRAME.replace(", deleted_at timestamp", "")).withColumn("deleted_at", F.when(F.map_contains_key("props", "gone"), F.timestamp_seconds(F.lit(0))))


def plain(base, branches):
    """Nodes after a merge: the last change of a property wins, changes win over deletion, equal names join where one of them is new."""
    live, kept, fresh = {i: p for i, p in base.items() if "gone" not in p}, {}, set()
    for i in sorted(set(live).union(*branches)):
        old, forks = live.get(i), [b.get(i) for b in branches]
        changed = [f for f in forks if f is not None and f != old]
        if old is None:
            fresh.add(i)
        if not changed and None in forks:
            continue
        props = dict(old or {})
        for f in changed:
            for k in {*(old or {}), *f}:
                if f.get(k) != (old or {}).get(k):
                    props[k] = f.get(k)
        kept[i] = {k: v for k, v in props.items() if v is not None}
    named, out = {}, {}
    for i, props in kept.items():
        named.setdefault(props.get("name", i), []).append(i)
    for name, ids in named.items():
        joined = name.startswith("{") and name != '{"v":""}' and fresh & set(ids)
        for group in [ids] if joined else [[i] for i in ids]:
            own = min(group, key=lambda i: (i in fresh, i))
            out[own] = {}
            for i in sorted(group, key=lambda i: (i != own, i)):
                out[own] = kept[i] | out[own]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_nodes_of_a_plan(spark, monkeypatch, seed):
    r = random.Random(seed)
    written = {}
    write = mg.materialize
    monkeypatch.setattr(mg, "materialize", lambda df, name="step": written.setdefault(name, write(df, name)))

    def props(n):
        return {k: v for k, v in (("name", f'{{"v":"{n}"}}'), ("x", str(r.randrange(3))), ("y", str(r.randrange(3)))) if r.random() < 0.9}

    base = {f"n{i:03d}": props(f"name {i % 70}" if i % 9 else "") for i in range(120)}
    base |= {f"t{i}": {"gone": "1"} for i in range(3)} | {"bare": {}}
    forks = []
    for b in "ab":
        fork = {i: dict(reversed(p.items())) for i, p in base.items() if "gone" not in p and r.random() > 0.05}
        for i in r.sample(sorted(fork), 12):
            fork[i] = props(f"name {r.randrange(80)}")
        fork |= {f"{b}{i}": props(f"name {r.randrange(90)}") for i in range(4)} | {"both": props("name 1")}
        forks.append(fork)
    options = mg.Options(0.999, policy="lastWriteWins", block=lambda: F.col("text"), delete_policy="modifyWins")
    edges = spark.createDataFrame([], "id string, kind string, from_kind string, from_id string, to_kind string, to_id string")
    plan = mg.plan_merge(frame(spark, base), dict(zip("ab", (frame(spark, f) for f in forks), strict=True)), edges, options)
    got = plan.nodes.collect()
    assert {x.id: x.props for x in got} == plain(base, forks) and len(got) == len({x.id for x in got})
    fresh = sum(i not in base for i in set(forks[0]) | set(forks[1]))
    assert written["similar-rows"].count() <= 5 * fresh < 60  # blocks with a new node alone
    assert plan.digest == plan.digest != "None"


def test_no_links_no_rounds(spark, monkeypatch):
    empty = spark.createDataFrame([("a", "a")], "a string, b string")
    monkeypatch.setattr("graphloom.operators.components.with_totals", lambda *a: pytest.fail("a round"))
    assert components(empty).columns == ["node", "component"] and components(empty).collect() == []
