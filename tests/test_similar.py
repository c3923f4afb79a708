import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.model import GraphDef, NodeKind, Unique, struct
from graphloom.operators import merge as mg
from graphloom.operators.components import components


def grams(text):
    padded = f" {text.lower()} "
    return Counter(padded[i : i + 3] for i in range(len(padded) - 2))


def dice(a, b):
    x, y = grams(a), grams(b)
    return 2 * sum((x & y).values()) / (sum(x.values()) + sum(y.values()))


def parts_of(links, nodes):
    """Components by a plain union."""
    at = {n: n for n in nodes}

    def top(n):
        while at[n] != n:
            n = at[n]
        return n

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        at[y] = x
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.95, 1.0])
@pytest.mark.parametrize("marked", [False, True])
def test_links_without_blocks(spark, threshold, marked):
    """The same components as all pairs give, and every pair of different texts."""
    r = random.Random(int(threshold * 100))
    names = ["Customer#0001", "customer#0001", "Customer#0002", "Customer#0102", "aaaa aaaa", "aaaaaaaaa", "Anna", "Hannah", "é", "", None, "new york city", "new york  city", "city new york"]
    rows = [(r.choice(["A", "B"]), f"n{i:03d}", r.choice(names) if r.random() < 0.8 else f"Customer#{r.randrange(40):04d}", r.random() < 0.4, 1) for i in range(150)]
    df = spark.createDataFrame(rows, "kind string, id string, text string, fresh boolean, score int")
    got = [((x.a.kind, x.a.id), (x.b.kind, x.b.id), x.score) for x in mg.similar_links(df if marked else df.drop("fresh"), threshold).collect()]
    want = {}
    for i, (k, a, s, f, _) in enumerate(rows):
        for l, b, t, g, _ in rows[i + 1 :]:
            if k == l and s and t and (f or g or not marked) and dice(s, t) >= threshold - 1e-12:
                want[(k, a), (l, b)] = dice(s, t)
    assert all(abs(want[a, b] - s) < 1e-12 for a, b, s in got) and len({x[:2] for x in got}) == len(got)
    nodes = [(k, i) for k, i, *_ in rows]
    assert parts_of([x[:2] for x in got], nodes) == parts_of(want, nodes)


def test_blocks_and_empty(spark):
    rows = [("A", "1", "same name"), ("A", "2", "same name"), ("A", "3", "other name")]
    df = spark.createDataFrame(rows, "kind string, id string, text string")
    links = mg.similar_links(df, 0.1, F.substring("text", 1, 1)).collect()
    assert [(x.a.id, x.b.id) for x in links] == [("1", "2")]
    assert mg.similar_links(df.limit(0), 0.5).collect() == []


def test_a_block_of_twenty_thousand_rows(spark):
    """Half of all rows share one name, the others differ in a digit or two: no block is too large."""
    df = spark.range(20_000).select(F.lit("A").alias("kind"), F.col("id").cast("string").alias("id"), F.when(F.col("id") % 2 == 0, "Customer").otherwise(F.format_string("Customer#%09d", F.col("id") * 7919)).alias("text"))
    links = mg.similar_links(df, 0.97)
    sizes = components(links.select("a", "b")).groupBy("component").count().orderBy(F.col("count").desc()).head(1)
    assert sizes[0]["count"] == 10_000


def test_unique_links(spark):
    graph = GraphDef("u", [NodeKind("P", struct("name string")), NodeKind("Q", struct("name string, mail string"), (Unique("mail", ("mail",), collation="caseInsensitive", where_not_null=("mail",)), Unique("n", ("name",), scope="kindWithSubClasses")))], [], [("P", "subClassOf", "Q")])
    j = lambda v: None if v is None else f'{{"v":"{v}"}}'
    rows = [("Q", "1", "a", "X@y"), ("Q", "2", "b", "x@Y"), ("P", "3", "b", None), ("Q", "4", "c", None), ("Q", "5", "d", None)]
    df = spark.createDataFrame([(k, i, {f: j(v) for f, v in (("name", n), ("mail", m)) if v}) for k, i, n, m in rows], "kind string, id string, props map<string, string>").withColumn("deleted_at", F.lit(None).cast("timestamp"))
    assert sorted((x.a.id, x.b.id) for x in mg.unique_links(graph, df).collect()) == [("1", "2"), ("3", "2")]
    assert mg.unique_links(GraphDef("v", [NodeKind("P", struct("name string"))], []), df).collect() == []


def test_candidates_of_numbered_names(spark, threshold=0.85):
    """Names that differ in digits alone share each trigram with many others, but few share several rare ones; no link is lost."""
    names = [f"supplier#{n:09d}" for n in random.Random(5).sample(range(20_000), 1500)]
    rows = spark.createDataFrame([("S", f"{i:05d}", n) for i, n in enumerate(names)], "kind string, id string, text string")
    tokens = [(i, "S", "", len(n), [f"{g}{j}" for g, c in grams(n).items() for j in range(c)]) for i, n in enumerate(names)]
    near = mg.candidates(spark.createDataFrame(tokens, "g long, kind string, block string, size int, tokens array<string>"), threshold)
    counted = [grams(n) for n in names]
    want = {(i, j) for i in range(len(names)) for j in range(i) if 2 * sum((counted[i] & counted[j]).values()) / (len(names[i]) + len(names[j])) >= threshold - 1e-12}
    found = {(max(r), min(r)) for r in near.collect()}
    assert want <= found and len(found) <= 8 * len(names)
    assert {(int(r.b.id), int(r.a.id)) for r in mg.similar_links(rows, threshold).collect()} == want
