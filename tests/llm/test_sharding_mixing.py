import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.llm import mixing, sharding


def rows(n, seed=1):
    r = random.Random(seed)
    return [(i, "x " * r.randint(0, 60), "en", r.choice(["a", "b", "c", None])) for i in range(n)]


def test_shards_fit_and_split_only_if_needed(documents):
    data = [*rows(300), (None, "same"), (None, "same"), (7, None), (8, ""), (9000, "y" * 5000)]
    out = sharding.shard(documents(data), 700).collect()
    assert len(out) == len(data)
    held = defaultdict(int)
    for r in out:
        held[r["shard"]] += r["doc_bytes"]
        assert r["doc_bytes"] == len((r["text"] or "").encode()) and r["size"] == 9
    for r in out:
        assert held[r["shard"]] == r["shard_bytes"] and r["oversized"] == (r["shard_bytes"] > 700)
        if r["shard_bytes"] > 700:
            assert r["doc_id"] == 9000 and r["shard_depth"] == sharding.BITS
        if r["shard_depth"]:  # what it was split from was too large
            assert sum(b for s, b in held.items() if s.startswith(r["shard"][:-1])) > 700
    assert {r["shard"] for r in sharding.shard(documents(rows(5)), 1 << 30).collect()} == {""}
    assert sharding.shard(documents([]), 10).count() == 0


def test_targets():
    assert mixing.targets([10, 10, 10], [3, 1, 2], 45) == [20, 45 - 20 - 50 / 3, 50 / 3] or sum(mixing.targets([10, 10, 10], [3, 1, 2], 45)) == 45
    for sizes in ([1, 100, 5, 0], [7], [3, 3], [1000, 1, 1, 1, 50]):
        total = 1.5 * sum(sizes)
        t = mixing.targets(sizes, [3.0, 1.0, 2.0, 3.0, 1.0][: len(sizes)], total)
        assert abs(sum(t) - total) < 1e-9 and all(x <= 2 * s + 1e-9 for x, s in zip(t, sizes, strict=True))


def brute_cost(patterns, quotas, most):
    """Least cost of routing as much as can be, by trying every split in single words."""
    from functools import lru_cache

    @lru_cache(None)
    def go(p, left):
        if p == len(patterns):
            return (0, 0)
        best = None
        sources, words = patterns[p]

        def spread(i, used, left_, cost):
            nonlocal best
            if i == len(sources):
                more = go(p + 1, left_)
                total = (used + more[0], cost + more[1])
                if best is None or (-total[0], total[1]) < (-best[0], best[1]):
                    best = total
                return
            for take in range(min(left_[sources[i]], most * words - used) + 1):
                after = tuple(x - take if k == sources[i] else x for k, x in enumerate(left_))
                spread(i + 1, used + take, after, cost + sum((used + j) // words for j in range(take)))

        spread(0, 0, left, 0)
        return best

    return go(0, tuple(quotas))


def test_flow_is_cheapest():
    r = random.Random(3)
    for _ in range(25):
        k = r.randint(1, 3)
        every = [(0,), (1,), (2,), (0, 1), (1, 2), (0, 1, 2)]
        patterns = [(s, r.randint(1, 3)) for s in r.sample([e for e in every if max(e) < k], r.randint(1, min(3, len([e for e in every if max(e) < k]))))]
        quotas = [r.randint(0, 5) for _ in range(k)]
        flow = mixing.min_cost_flow(patterns, quotas, 2)
        for (sources, words), f in zip(patterns, flow, strict=True):
            assert set(f) <= set(sources) and sum(f.values()) <= 2 * words and all(v >= 0 for v in f.values())
        for s in range(k):
            assert sum(f.get(s, 0) for f in flow) <= quotas[s]
        routed = sum(sum(f.values()) for f in flow)
        cost = sum(j // words for (_, words), f in zip(patterns, flow, strict=True) for j in range(sum(f.values())))
        assert (routed, cost) == brute_cost(patterns, quotas, 2)


def mixed(df, **how):
    return mixing.mix(df, F.array("source"), mixing.word_count(F.col("text")), **how).collect()


def test_mix(documents):
    data = [*rows(400), (1, "dup dup"), (1, "dup dup"), (5000, None), (5001, ""), (None, "a b c")]
    out = mixed(documents(data))
    assert len(out) == len(data)
    by = defaultdict(list)
    for r in out:
        assert r["size"] == len((r["text"] or "").split()) and r["taken"] in (0, r["size"], 2 * r["size"])
        by[r["source"]].append(r)
    for own in by.values():
        assert {r["source_size"] for r in own} == {sum(r["size"] for r in own)}
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 5
    assert sorted(map(repr, out)) == sorted(map(repr, mixed(documents(data[::-1]))))
    assert mixed(documents([])) == []


def test_overlapping_sources(spark):
    df = spark.createDataFrame([(i, "w " * 10, ["a", "b"] if i % 3 == 0 else ["a"] if i % 3 == 1 else ["b"]) for i in range(90)], "doc_id long, text string, sources array<string>")
    out = mixing.mix(df, F.col("sources"), mixing.word_count(F.col("text"))).collect()
    assert abs(sum(r["taken"] for r in out) - 1.5 * 900) <= 60 and all(r["taken"] <= 20 for r in out)


def test_mix_of_equal_rows(documents):
    """Of a thousand equal rows as many are taken as the target asks for."""
    data = [(k, "w " * 10, "en", f"s{k}") for k in range(3) for _ in range(1000)]
    df = documents(data).repartition(7)
    taken = defaultdict(int)
    for r in mixed(df):
        assert r["taken"] in (0, 10, 20)
        taken[r["source"]] += r["taken"]
        assert abs({"s0": 20_000, "s1": 25_000 / 3, "s2": 50_000 / 3}[r["source"]] - r["target"]) < 1e-6
    assert taken == {"s0": 20_000, "s1": 8_330, "s2": 16_670}


@pytest.mark.parametrize("seed", range(4))
def test_mix_against_brute_force(documents, seed):
    """Every row of a source as often as its target holds all of them; then by hash, then the one that fits best."""
    r = random.Random(seed)
    data = [(r.randrange(40), "w " * r.randrange(9), "en", r.choice(["a", "b", None, "a"])) for _ in range(r.randint(1, 90))]
    df = documents(data)
    hashed = df.select("source", mixing.word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(7), F.xxhash64(F.col("doc_id").cast("string"), F.xxhash64("text"))).alias("h"))
    by = defaultdict(list)
    for x in hashed.withColumn("range", F.pmod("h", F.lit(mixing.RANGES))).collect():
        by[x["source"]].append((x["range"], x["h"], x["size"]))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(x[2] for x in by[s]) for s in names]
    want = {}
    for s, size, target in zip(names, sizes, mixing.targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * sum(sizes)), strict=True):
        times, left = divmod(min(round(target), 2 * size), size) if size else (0, 0)
        own, total = sorted(by[s]), times * size
        i = 0
        while i < len(own) and own[i][2] <= left:
            left, total, i = left - own[i][2], total + own[i][2], i + 1
        fits = [(abs(n - left), h, n) for _, h, n in own[i:] if abs(n - left) < left]
        want[s] = total + (min(fits)[2] if fits else 0)
    taken = defaultdict(int)
    for x in mixed(df):
        taken[x["source"]] += x["taken"]
    assert dict(taken) == want
