import __spark_entry__
import corpus_pipeline as cp
from graphloom.llm import toxicity
from tests.llm.test_jaccard_join import shingles

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns = docs.columns
    clean = cp.drop_toxic(spark, docs, SF).cache()
    scored = toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    assert clean.columns == columns and {r[0] for r in clean.select("doc_id").collect()} == {r[0] for r in scored.where("predicted = 0").select("doc_id").collect()}
    one = cp.drop_near_copies(spark, docs, SF)
    assert one.columns == columns and 0 < one.count() < docs.count()
    assert cp.drop_leaks(spark, docs, SF).columns == columns
    mixed = cp.mix_sources(spark, docs, SF)
    assert mixed.columns == columns and mixed.groupBy("doc_id").count().where("count > 2").count() == 0
    total = cp.deal_shards(spark, docs, SF)
    assert total.count() == docs.count() and total.where("oversized").count() == 0


def test_repeated_and_null_rows(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(1, "a b c d e", "en", "s", 9), (1, "a b c d e", "en", "s", 9), (2, "a b c d e", "en", "s", 9), (None, "a b c d e", "en", None, 9), (None, None, None, None, None), (3, None, None, None, None), (4, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, schema)
    kept = sorted((r["doc_id"] for r in cp.drop_near_copies(spark, docs, SF).collect()), key=repr)
    assert kept == [1, 3, 4, None]
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        stage(spark, docs, SF).count()


def test_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names and len(cp.STAGES) == 5


def test_near_copies_by_five_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = {r["doc_id"]: shingles(r["text"], 5) for r in docs.collect()}
    kept = {r["doc_id"] for r in cp.drop_near_copies(spark, docs, SF).collect()}
    linked = [(a, b) for a, x in sets.items() for b, y in sets.items() if a < b and x and 10 * len(x & y) >= 8 * len(x | y)]
    assert linked and not [(a, b) for a, b in linked if a in kept and b in kept]
    assert sets.keys() - {a for pair in linked for a in pair} <= kept


def test_near_copies_are_rows(spark, documents):
    """An id with a copy and a text of its own loses the copy only; null ids have copies too."""
    mine, other, third = ("one two three four five six", "nothing like it at all here", "no id but a text of its own")
    rows = [(2, mine), (5, mine), (5, other), (None, mine), (None, third), (None, third), (7, third + " and more of it"), (8, None), (9, "")]
    kept = sorted(((r["doc_id"], r["text"]) for r in cp.drop_near_copies(spark, documents(rows), SF).collect()), key=repr)
    assert kept == sorted([(2, mine), (5, other), (None, third), (7, third + " and more of it"), (8, None), (9, "")], key=repr)


def test_leaks_are_rows(spark, documents):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    rows = [(1, item), (1, "a clean text under the same id"), (None, item), (None, "clean and without an id"), (3, " ".join(["padding"] * 30_000) + " " + item)]
    kept = sorted(((r["doc_id"], r["text"]) for r in cp.drop_leaks(spark, documents(rows), SF).collect()), key=repr)
    assert kept == [(1, "a clean text under the same id"), (None, "clean and without an id")]
