"""A corpus pipeline over ``documents``: toxic documents, near copies and benchmark leaks go, sources are mixed to
target weights, and what remains is dealt into shards.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of ``docs``.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate as leaks
from graphloom.llm import jaccard_join, mixing, sharding, toxicity
from graphloom.llm._shared import ship, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the classifier predicts as toxic; it learns from the labelled rows of ``documents``."""
    ship(spark)
    model = toxicity.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group that Jaccard similarities of 0.8 or more of their five-word
    shingles link. Rows are told apart by id and text, null ids included; documents without words stay."""
    ship(spark)
    return jaccard_join.keep_one(docs, 5, Fraction(4, 5)).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that repeat a benchmark item, also with other numbers, names or units."""
    ship(spark)
    return leaks.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice. Documents without words hold nothing to
    mix and leave here."""
    ship(spark)
    taken = mixing.mix(docs, F.array("source"), mixing.word_count(F.col("text")))
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    return taken.where("taken > 0").withColumn("__times", F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With the shard of each row; no shard holds more bytes of text than its limit."""
    ship(spark)
    return sharding.shard(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

#: The classifier, the hash of the mix and the component search have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
