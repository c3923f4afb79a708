import random
import re
import time
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import jaccard_join as jj
from graphloom.llm._shared import word_hashes


def shingles(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset([tuple(words)] if 0 < len(words) < k else [tuple(words[i : i + k]) for i in range(len(words) - k + 1)])


def expected(rows):
    """(doc_id, n, component) of every row, by comparing all pairs."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                parent[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        group = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), (min(group) if group else None) if sets[i] else d))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, jj.jaccard_components(df).select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def near_copies(seed, n, words=120, edits=4, groups=6):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[r.choice(vocabulary) for _ in range(r.randint(3, words))] for _ in range(groups)]
    rows = []
    for i in range(n):
        text = list(r.choice(bases))
        for _ in range(r.randint(0, edits)):
            at = r.randrange(len(text))
            text[at : at + r.randint(0, 1)] = [r.choice(vocabulary)]
        rows.append((i * 7 % 1000, " ".join(text)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(documents, seed):
    rows = near_copies(seed, 140)
    assert got(documents(rows)) == expected(rows)


def test_many_chunks(documents, monkeypatch):
    monkeypatch.setattr(jj, "CHUNK", 600)
    rows = near_copies(3, 120, groups=2, edits=6)
    assert got(documents(rows)) == expected(rows)


def test_chunks_in_rounds(documents, monkeypatch):
    """Pairs of chunks are compared in rounds that deal the table's shingles about once each."""
    monkeypatch.setattr(jj, "CHUNK", 300)
    monkeypatch.setattr(jj, "ROUND", 1)
    rounds, append = [], jj.Growing.append
    monkeypatch.setattr(jj.Growing, "append", lambda self, df: rounds.append(1) or append(self, df))
    r, rows = random.Random(14), []
    for i in range(50):  # they have about 80 of 100 shingles in common, so keys, but hardly any link
        text = [f"w{k}" for k in range(100)]
        for k in r.sample(range(100), 3 + i % 2):
            text[k] = f"x{i}y{k}"
        rows.append((i, " ".join(text)))
    assert got(documents(rows)) == expected(rows) and len(rounds) > 1


@pytest.mark.parametrize("lot", [50, 1 << 20])
def test_shared_passages(documents, monkeypatch, lot):
    """Passages that many texts share are common; links are the same, whatever is told to be."""
    monkeypatch.setattr(jj, "LOT", lot)
    monkeypatch.setattr(jj, "COMMON", 4)
    monkeypatch.setattr(jj, "SHARED", 2)
    r = random.Random(6)
    passages = [" ".join(f"p{k}x{i}" for i in range(r.choice([3, 12, 30]))) for k in range(4)]
    rows = [(i, " ".join([r.choice(passages), text, r.choice(passages)][r.randint(0, 1) : r.randint(2, 3)])) for i, (_, text) in enumerate(near_copies(7, 110, words=40))]
    assert got(documents(rows)) == expected(rows)


def test_folded_keys_tie_the_same():
    r = np.random.default_rng(9)
    keys, nodes = r.integers(0, 9, 400), r.integers(0, 300, 400)

    def groups(keys, nodes):
        parent = {("n", n): ("n", n) for n in nodes} | {("k", k): ("k", k) for k in keys}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for k, n in zip(keys, nodes):
            parent[find(("k", k))] = find(("n", n))
        return {frozenset(m for m in set(nodes) if find(("n", m)) == find(("n", n))) for n in set(nodes)}

    few = jj.fold_keys(keys, nodes)
    assert groups(keys.tolist(), nodes.tolist()) == groups(few[0].tolist(), few[1].tolist())
    assert max(np.bincount(np.unique(few[0], return_inverse=True)[1])) <= jj.SHARED


def test_corner_cases(documents):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(5, None), (6, ""), (7, " \t\n"), (1, "One"), (2, "one "), (3, "one two"), (4, "ONE  TWO"), (8, "a b c"), (8, "a b c"), (8, "q r s t"), (9, "Q R s t"), (None, "a b c"), (None, "zz yy xx"), (10, long), (11, long + " end"), (12, "É b c"), (13, "é b c"), (14, "a\x85b c d"), (15, "a b c d")]
    assert got(documents(rows)) == expected(rows)


def test_empty(documents):
    assert got(documents([])) == []


def test_bounds_and_index():
    ends = jj.size_buckets(9, 10)
    assert all(9 * ends[k + 1] >= 10 * ends[k - 1] * 0 and 10 * ends[k - 1] <= 9 * ends[k + 1] for k in range(1, 200))
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 200).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[i % 7 :], r.integers(0, 1 << 63, i % 11).astype(np.uint64)])) for i in range(60)]
    found = jj.links_between(sets, np.zeros(60, int), 9, 10)
    whole = [(i, j) for i in range(60) for j in range(i) if 10 * len(np.intersect1d(sets[i], sets[j])) >= 9 * len(np.union1d(sets[i], sets[j]))]
    for i, j in whole:  # every link lies within one tree of the forest
        parent = list(range(60))
        for a, b in found:
            jj_find = jj._find(parent, a)
            parent[jj_find] = jj._find(parent, b)
        assert jj._find(parent, i) == jj._find(parent, j)
    keys = [set(jj.group_keys(s, ends, 9, 10).tolist()) for s in sets]
    assert all(keys[i] & keys[j] for i, j in whole)


def test_five_words(documents):
    rows = near_copies(5, 120, edits=5)
    parent = {}
    sets = [shingles(t, 5) for _, t in rows]
    from fractions import Fraction

    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jj.jaccard_components(documents(rows), 5, Fraction(4, 5)).collect()}
    parent = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= 80 * len(a | b):
                parent[jj._find(parent, i)] = jj._find(parent, j)
    for i, (d, _) in enumerate(rows):
        assert got[d, len(sets[i])] == min(rows[j][0] for j in range(len(rows)) if jj._find(parent, j) == jj._find(parent, i))


def test_linked_sets_share_a_key():
    r = np.random.default_rng(8)
    for numerator, denominator in ((4, 5), (9, 10), (1, 2)):
        ends = jj.size_buckets(numerator, denominator)
        for n in [*range(1, 60), *[40] * 20, 200, 777]:
            a = r.integers(0, 1 << 63, n).astype(np.uint64)
            most = n * (denominator - numerator) // numerator
            b = np.unique(np.concatenate([a, r.integers(0, 1 << 63, r.integers(0, most + 1)).astype(np.uint64)]))
            drop = max(0, (n * denominator // denominator) * (denominator - numerator) // (2 * denominator))
            c = np.unique(a)[drop:]
            for x, y in ((a, b), (a, c)):
                x, y = np.unique(x), np.unique(y)
                if not np.array_equal(x, y) and denominator * len(np.intersect1d(x, y)) >= numerator * len(np.union1d(x, y)):
                    union = np.union1d(x, y)
                    for part in (0, 0.3, 0.6, 0.9, 1):  # whatever is common
                        common = np.union1d(union[r.random(len(union)) < part], r.integers(0, 1 << 63, 5).astype(np.uint64))
                        assert set(jj.group_keys(x, ends, numerator, denominator, common)) & set(jj.group_keys(y, ends, numerator, denominator, common)), (n, numerator, part)


def test_words_are_those_of_the_pattern():
    texts = ["a b", "", "  x\ty\x0bz ", "ä ö"]
    hashes, at = word_hashes([t.encode() for t in texts])
    assert np.diff(at).tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts]
    assert len(set(hashes.tolist())) == 7


def test_forest_ties_what_edges_tie():
    draw = np.random.default_rng(11)
    for n in (1, 2, 7, 60, 400):
        a, b = draw.integers(-n, n, (2, n))
        least = {x: x for x in {*a.tolist(), *b.tolist()}}
        for _ in range(2 * n):
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                least[x] = least[y] = min(least[x], least[y])
        u, v = jj.forest(a, b)
        assert len(set(u.tolist())) == len(u) and {x: x for x in least} | dict(zip(u.tolist(), v.tolist(), strict=True)) == least
    chain = np.arange(3000)
    assert not len(jj.forest(chain[:0], chain[:0])[0])
    u, v = jj.forest(chain[1:], chain[:-1])
    assert len(u) == 2999 and not v.any()


def test_linked_sets_share_a_window():
    r = np.random.default_rng(12)
    linked = 0
    for numerator, denominator in ((4, 5), (3, 4), (9, 10), (1, 2), (17, 20)):
        for n in [*range(1, 40), *[40] * 20, 200, 777] * 3:
            a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
            more = r.integers(0, 1 << 63, r.integers(0, n * (denominator - numerator) // numerator + 1)).astype(np.uint64)
            drop = r.integers(0, n * (denominator - numerator) // denominator + 1)
            swap = r.integers(0, 2 * n * (denominator - numerator) // (denominator + numerator) // 2 + 1)
            for b in (np.union1d(a, more), r.permutation(a)[drop:], np.union1d(r.permutation(a)[swap:], more[:swap])):
                x, y = a, np.unique(b)
                union, both = np.union1d(x, y), np.intersect1d(x, y)
                if np.array_equal(x, y) or denominator * len(both) < numerator * len(union):
                    continue
                linked += 1
                for part in (0, 0.1, 0.3, 0.5, 0.6, 0.7, 0.9, 1):  # whatever is common
                    common = np.union1d(union[r.random(len(union)) < part], r.integers(0, 1 << 63, 5).astype(np.uint64))
                    keys = [set(jj.window_keys(s, numerator, denominator, common).tolist()) for s in (x, y)]
                    assert keys[0] & keys[1], (n, numerator, part)
    assert linked > 1000


def test_phrases_shared_by_chance_make_no_candidates():
    """Unlike texts that have a phrase with one and another with others aren't tied to one large candidate component."""
    r = random.Random(13)
    phrases = [" ".join(f"p{k}x{i}" for i in range(5)) for k in range(300)]
    texts = [" ".join(x for j in range(8) for x in (r.choice(phrases), *(f"t{i}x{j}x{k}" for k in range(8)))) for i in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    rows = pa.Table.from_batches(jj._keys(5, 4, 5, SimpleNamespace(value=np.zeros(0, np.uint64)))([batch]))
    keys, nodes = rows["key"].to_numpy(), rows["node"].to_numpy()
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    hub = nodes[np.searchsorted(keys, keys)]
    tied = jj.forest(nodes[hub != nodes], hub[hub != nodes])[1]
    assert len(np.unique(nodes)) == 400 and (not len(tied) or np.unique(tied, return_counts=True)[1].max() < 20)


def test_shuffles_of_finished_steps_are_freed(spark, documents, monkeypatch):
    """When texts are dealt, the keys' shuffle and those of the component rounds are gone."""
    held = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    left, write = [], jj.written

    def spy(df, name):
        if name == "cells":
            until = time.time() + 10
            while held() > before + 2 and time.time() < until:  # files go in the background
                time.sleep(0.1)
            left.append(held())
        return write(df, name)

    monkeypatch.setattr(jj, "written", spy)
    spark.sparkContext._jvm.System.gc()
    time.sleep(1)
    before = held()
    jj.keep_one(documents(near_copies(4, 60)))
    assert left and left[0] <= before + 2
