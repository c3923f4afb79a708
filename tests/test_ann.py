import numpy as np
import pytest

from graphloom.errors import QueryError
from graphloom.operators import ann
from graphloom.operators.ann import Model, VectorIndex, fit, nearest_to_each, row_distances


def vectors(n, dim=16, seed=0, clusters=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim))
    return x + 6 * r.normal(size=(clusters, dim))[r.integers(clusters, size=n)] if clusters else x


def table(spark, x, extra=()):
    rows = [("V", str(i), [float(a) for a in v]) for i, v in enumerate(x)]
    return spark.createDataFrame([*rows, *extra], "kind string, id string, vector array<float>")


ODD = [("V", "none", None), ("V", "short", [1.0]), ("V", "nan", [float("nan")] * 16), ("V", "zero", [0.0] * 16), ("V", "hole", [None] * 16)]


def truth(x, q, metric, k):
    d = row_distances(x.astype(np.float32).astype(float), q.astype(np.float32).astype(float)[None], metric)
    return [str(i) for i in np.lexsort((np.array([str(i) for i in range(len(x))]), d))[:k]]


@pytest.mark.parametrize("metric", ["cosine", "l2", "inner_product"])
@pytest.mark.parametrize("clusters", [0, 12])
def test_recall(spark, monkeypatch, metric, clusters):
    monkeypatch.setattr(ann, "CHUNK", 100)
    x = vectors(900, clusters=clusters)
    index = VectorIndex.build(table(spark, x, ODD), "vector", metric)
    assert index.rows.count() == 900 + (metric != "cosine")
    queries = table(spark, x[::50]).selectExpr("id as query", "vector")
    found = {}
    for r in index.search_all(queries).collect():
        found.setdefault(r["query"], {})[r["rank"]] = r["id"]
    exact = [set(truth(x, v, metric, 10)) for v in x[::50]]
    assert np.mean([len(exact[int(q)] & set(f.values())) / 10 for q, f in found.items()]) >= 0.9 and len(found) == len(exact)
    one = [r["id"] for r in index.search(x[7], 10).collect()]
    assert len(set(one) & set(truth(x, x[7], metric, 10))) >= 8
    if clusters:
        assert index.model.probes < len(index.model.centres) / 2  # clustered data needs few cells
    exactly = {}
    for r in nearest_to_each(table(spark, x, ODD), queries, metric=metric).collect():
        exactly.setdefault(int(r["query"]), []).append((r["rank"], r["id"]))
    if metric != "inner_product" or not clusters:
        assert all([i for _, i in sorted(exactly[q])] == truth(x, x[50 * q], metric, 10) for q in exactly)


def test_cells_are_partitions(spark, tmp_path):
    x = vectors(400, clusters=8)
    VectorIndex.build(table(spark, x), "vector", "l2", place=str(tmp_path / "v"))
    index = VectorIndex(spark, str(tmp_path / "v"))
    found = index.search(x[3], 5, allowed=table(spark, x).where("id % 2 = 1"))
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell#" in plan or "cell#" in plan.split("PartitionFilters:")[1][:40]
    assert found.first()["id"] == "3" and all(int(r["id"]) % 2 for r in found.collect())
    assert index.model.dump() == Model.load(index.model.dump()).dump()


def test_refusals(spark):
    with pytest.raises(QueryError):
        VectorIndex.build(table(spark, [], ODD[:1]), "vector")
    with pytest.raises(QueryError):
        VectorIndex.build(table(spark, vectors(3)), "vector", "manhattan")
    index = VectorIndex.build(table(spark, vectors(3)), "vector")
    for bad in ([1.0], [0.0] * 16, [float("inf")] * 16):
        with pytest.raises(QueryError):
            index.search(bad)
    assert index.search(vectors(3)[1], 5).count() == 3
    assert fit(np.ones((5, 4)), "l2", 2.0, 5).probes == 1
