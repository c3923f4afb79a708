"""Extendible hashing into shards of bounded size, in DataFrame functions only.

The directory is indexed by the leading bits of a row's hash. A bucket whose rows exceed the byte limit splits on
one more bit, and only such a bucket. Bytes shrink along a prefix, so a row's shard is the
shortest prefix of its hash that fits. Byte counts are kept for prefixes only: a first
histogram is as deep as the total asks for, and is deepened just for the buckets that are still too large.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import written

#: Bits of the hash, and how many of them one histogram adds at most.
BITS, STEP = 60, 12
#: Rows of a directory that may be broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Bytes of a shard in the registered query.
LIMIT = 1 << 20


def row_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of MD5 of the id and the MD5 of the text; nulls are empty."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5(F.encode(text, "UTF-8")), F.lit("")))
    return F.conv(F.substring(F.md5(F.encode(key, "UTF-8")), 1, BITS // 4), 16, 10).cast("long")


def _prefix(h: Column, depth: Column | int) -> Column:
    return F.call_function("shiftrightunsigned", h, (F.lit(BITS) - depth).cast("int"))


def directory(sized: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """For sized (h, bytes): tables (cell, depth, shard_bytes) and the depth of their cells, one for each level
    at which shards were found. A row's shard comes from the first table that has its cell."""
    total = sized.agg(F.sum("bytes")).first()[0] or 0
    top, deep = 0, min(BITS, max(4, math.ceil(math.log2(max(1, total / limit))) + 3))
    levels, open_ = [], sized
    while True:
        cells = open_.groupBy(_prefix(F.col("h"), deep).alias("cell")).agg(F.sum("bytes").alias("bytes"))
        sums = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(top), F.lit(deep))).alias("depth"))
        at = F.call_function("shiftrightunsigned", F.col("cell"), (F.lit(deep) - F.col("depth")).cast("int"))
        sums = sums.withColumn("prefix", at)
        buckets = sums.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"))
        fits = buckets.where((F.col("shard_bytes") <= limit) | (F.col("depth") == BITS))
        shard = sums.select("cell", "depth", "prefix").join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min_by(F.struct("depth", "shard_bytes"), "depth").alias("s"))
        found = written(cells.join(shard, "cell", "left").select("cell", "s.depth", "s.shard_bytes"), "directory")
        levels.append((deep, found.where("depth is not null")))
        left = found.where("depth is null").select("cell")
        if not left.head(1):
            return levels
        open_ = open_.withColumn("cell", _prefix(F.col("h"), deep)).join(left, "cell", "left_semi").drop("cell")
        top, deep = deep + 1, min(BITS, deep + STEP)


def shard(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``docs`` with shard (its hash prefix, as a string of bits; empty if one shard holds all), shard_depth,
    doc_bytes (UTF-8 bytes of the text, null: 0), shard_bytes and oversized.

    Every shard has ``limit`` bytes or less, but for a row that is larger by itself or rows with the
    same id and text, which no bit tells apart: those
    fill a shard of full depth and are marked oversized. An empty table gives none; columns of these names are
    replaced, others stay.
    """
    names = ["shard", "shard_depth", "doc_bytes", "shard_bytes", "oversized"]
    rows = docs.drop(*names)
    text = F.col("text").cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    sized = written(rows.select(row_hash(F.col("doc_id"), text).alias("h"), size.alias("bytes")), "sized")
    out = rows.withColumn("__h", row_hash(F.col("doc_id"), text)).withColumn("doc_bytes", size)
    depth, held = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, (deep, found) in enumerate(directory(sized, limit)):
        small = found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        found = found.select(F.col("cell").alias("__cell"), F.col("depth").alias(f"__d{i}"), F.col("shard_bytes").alias(f"__b{i}"))
        out = out.withColumn("__cell", _prefix(F.col("__h"), deep)).join(F.broadcast(found) if small else found, "__cell", "left").drop("__cell")
        depth, held = F.coalesce(depth, F.col(f"__d{i}")), F.coalesce(held, F.col(f"__b{i}"))
    out = out.withColumn("shard_depth", depth).withColumn("shard_bytes", held)
    bits = F.lpad(F.bin(_prefix(F.col("__h"), F.col("shard_depth"))), F.col("shard_depth"), F.lit("0"))
    out = out.withColumn("shard", F.when(F.col("shard_depth") == 0, "").otherwise(bits)).withColumn("oversized", F.col("shard_bytes") > limit)
    return out.select(*rows.columns, *names)


def shard_sizes(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """shard, n_docs, shard_bytes, oversized: one row for each shard."""
    return shard(docs, limit).groupBy("shard").agg(F.count("*").alias("n_docs"), F.max("shard_bytes").alias("shard_bytes"), F.max("oversized").alias("oversized"))


def oracle(limit: int = LIMIT, table: str = "documents") -> str:
    """The same shards in SQL for DuckDB: the shortest prefix whose rows fit."""
    return f"""
WITH rows AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS doc_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(md5(text), '')), 1, {BITS // 4}))::BIGINT AS h
  FROM {table}),
sums AS (
  SELECT d.depth, r.h >> ({BITS} - d.depth)::INT AS prefix, sum(r.doc_bytes)::BIGINT AS shard_bytes
  FROM rows r CROSS JOIN (SELECT unnest(range(0, {BITS + 1})) AS depth) d GROUP BY ALL),
fits AS (
  SELECT r.doc_id, r.doc_bytes, r.h, min(s.depth) AS depth
  FROM rows r JOIN sums s ON s.prefix = r.h >> ({BITS} - s.depth)::INT
  WHERE s.shard_bytes <= {limit} OR s.depth = {BITS} GROUP BY r.doc_id, r.doc_bytes, r.h)
SELECT f.doc_id, f.doc_bytes, f.depth::INT AS shard_depth, s.shard_bytes,
       CASE WHEN f.depth = 0 THEN '' ELSE lpad(bin(s.prefix), f.depth::INT, '0') END AS shard,
       s.shard_bytes > {limit} AS oversized
FROM fits f JOIN sums s ON s.depth = f.depth AND s.prefix = f.h >> ({BITS} - f.depth)::INT
"""
