from collections import defaultdict

import pyarrow as pa

from graphloom.operators import fulltext as ft


def plain(rows):
    for kind, id_, words in rows:
        places = defaultdict(list)
        for i, w in enumerate(words or []):
            places[w].append(i)
        if words:
            yield kind, id_, len(words), "", len(words), None
        for w, at in places.items():
            yield kind, id_, len(words), w, len(at), at


def test_postings_of_a_batch():
    rows = [("A", "1", ["b", "a", "b"]), ("A", "2", []), ("B", "1", None), ("B", "3", ["a"]), ("B", "4", ["z", "z", "z", "y"])]
    for some in (rows, rows[1:3], rows[:0]):
        batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.string()), pa.array([r[1] for r in some], pa.string()), pa.array([r[2] for r in some], pa.list_(pa.string()))], ["kind", "id", "words"])
        got = [tuple(r.values()) for b in ft._postings(iter([batch])) for r in b.to_pylist()]
        assert sorted(got, key=str) == sorted(plain(some), key=str)


def test_texts_are_cut_once_and_postings_not_dealt(spark):
    rows = spark.range(3).selectExpr("'A' as kind", "string(id) as id", "concat('word ', id) as p__text")
    plan = ft.FulltextIndex.segments(rows, ["text"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "Exchange" not in plan
