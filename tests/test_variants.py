import json

import pytest
from pyspark.sql import functions as F

from graphloom.errors import QueryError
from graphloom.functions.variants import set_path, unset_path


def patched(doc, path, *value):
    """The same on a Python value."""
    own = dict(doc) if isinstance(doc, dict) else {}
    name, rest = path[0], path[1:]
    if value:
        own[name] = patched(own.get(name), rest, *value) if rest else value[0]
        return own
    if name not in own:
        return doc
    if rest:
        own[name] = patched(own[name], rest)
    else:
        del own[name]
    return own


DOCS = [{}, {"a": 1}, {"a": {"b": [1, {"c": None}], "d": "x"}, "z": 1.5}, [1, 2], "text", 7, None, {"a": None}, {"a": {"b": {"c": 3}}}, {"é": {"b": 1}}]


@pytest.mark.parametrize("path", [["a"], ["a", "b"], ["a", "b", "c"], ["é"]])
def test_patches(spark, path):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(DOCS)], "i int, t string").withColumn("v", F.parse_json("t"))
    text = lambda c: F.to_json(c)
    rows = df.select("i", text(set_path(F.col("v"), path, F.lit("new"))).alias("put"), text(set_path(F.col("v"), path, F.lit(None).cast("int"))).alias("null"), text(unset_path(F.col("v"), path)).alias("out")).collect()
    for r in rows:
        d = DOCS[r["i"]]
        assert json.loads(r["put"]) == patched(d, path, "new") and json.loads(r["null"]) == patched(d, path, None)
        assert r["out"] is None and d is None or json.loads(r["out"]) == patched(d, path), (d, path)


def test_null_documents_and_empty_paths(spark):
    row = spark.range(1).select(F.to_json(set_path(F.lit(None).cast("variant"), ["a"], F.lit(1))).alias("x"), unset_path(F.lit(None).cast("variant"), ["a"]).isNull().alias("y")).first()
    assert json.loads(row["x"]) == {"a": 1} and row["y"]
    for change in (lambda: set_path(F.col("v"), [], F.lit(1)), lambda: unset_path(F.col("v"), [])):
        with pytest.raises(QueryError):
            change()
