"""Bottom-k sketches of word shingles, in DataFrame functions only.

A sketch is the ascending array of the k smallest distinct 48-bit hashes of a text's shingles. Sketches
of parts merge into the sketch of the whole, and two of them estimate resemblance and
containment; one estimates the number of distinct shingles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hashes kept, and words in a shingle.
K, SHINGLE = 128, 5
HASH_BITS = 48


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    """The maximal runs of characters other than space and \\x09-\\x0D."""
    plain = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.filter(F.split(plain, " "), lambda w: w != "")


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """Sketch of a text. Fewer words than ``shingle`` make one shingle; no words or null make an empty sketch."""

    def hashes(w: Column) -> Column:
        n = F.size(w)
        runs = F.transform(F.sequence(F.lit(0), n - shingle), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(shingle)]))
        return F.when(n >= shingle, runs).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    every = let(F.transform(words(F.coalesce(text, F.lit(""))), lambda w: F.xxhash64(w)), hashes)
    return F.slice(F.sort_array(F.array_distinct(F.transform(every, lambda h: F.shiftrightunsigned(h, 64 - HASH_BITS)))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two shingle sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity; two empty sketches are alike (1), an empty and another aren't (0)."""
    return let(merge(a, b, k), lambda u: F.when(F.size(u) == 0, 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * F.lit(float(1 << HASH_BITS)) / (F.element_at(a, k) + 1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    shared = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def encoded(a: Column) -> Column:
    """A sketch as a string: base64 of its hashes, six bytes each."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), HASH_BITS // 4, "0")), "")))


def merge_sketches(df: DataFrame, key: str, value: str, k: int = K, salts: int = 32) -> DataFrame:
    """``key, sketch`` of all parts of a key: each part has k hashes at most, and the k smallest are
    taken in two steps, so that a key with many parts is spread out first. Null sketches add nothing."""
    parts = df.select(key, F.explode(F.coalesce(value, F.array().cast("array<bigint>"))).alias("h")).distinct()
    for by in ([key, "salt"], [key]):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("h"))
        parts = parts.withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(salts))).withColumn("r", rank).where(F.col("r") <= k).drop("r", "salt")
    some = parts.groupBy(key).agg(F.sort_array(F.collect_list("h")).alias("sketch"))
    keys = df.select(key).distinct().withColumnRenamed(key, "_key")
    empty = F.array().cast("array<bigint>")
    return keys.join(some, F.col("_key").eqNullSafe(F.col(key)), "left").select(F.col("_key").alias(key), F.coalesce("sketch", empty).alias("sketch"))


def _range_of(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are <= value, by binary search; -1 for null."""
    steps = [1 << i for i in reversed(range(max(1, len(bounds)).bit_length()))]
    edges = F.lit(bounds) if bounds else F.array().cast("array<bigint>")
    found = F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(F.get(edges, at + step - 1) <= value, at + step).otherwise(at))
    return F.when(value.isNull(), -1).otherwise(found)


def fingerprint_edits(docs: DataFrame, k: int = K, shingle: int = SHINGLE, ranges: int | None = None) -> DataFrame:
    """Fingerprints of every text, and of the text whose last floor(n_chars / 2) code points are replaced by
    the first as many (or all) of the next row's, in descending doc_id (after the last: the first).

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. A null
    text is empty. Rows with one id follow each other by text; null ids come after all others. Each
    repeated row is a row of the result. Extra columns are ignored. An empty table gives none.

    The rows are dealt into ranges of doc_id with about as many rows each (bounds from approximate
    percentiles); the first row of a range also goes to the end of the range before it, so that "next" is
    found within a range. Texts are shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = min(1 << 16, ranges or 3 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    points = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], max(10_000, 10 * n))).first()[0] or []
    bounds = sorted(set(points))
    rows = rows.withColumn("bucket", _range_of(F.col("doc_id"), bounds))

    # The range that comes before each range in descending order; the last one's successor is the first.
    heads = rows.groupBy("bucket").agg(F.max("doc_id").alias("head_id"))
    order = Window.orderBy(F.lit(0), F.col("bucket").desc())  # one row for each range
    before = F.coalesce(F.lag("bucket").over(order), F.last("bucket").over(order.rowsBetween(0, Window.unboundedFollowing)))
    heads = heads.select(F.col("bucket").alias("head_bucket"), "head_id", before.alias("goes_to"))
    # At most `n` + 1 rows.
    joined = rows.join(F.broadcast(heads), (F.col("bucket") == F.col("head_bucket")) & F.col("doc_id").eqNullSafe(F.col("head_id")))
    top = F.row_number().over(Window.partitionBy("bucket").orderBy("text"))
    guests = joined.withColumn("r", top).where("r = 1").select("doc_id", "text", F.col("goes_to").alias("bucket"), F.lit(1).alias("guest"))

    every = rows.select("doc_id", "text", "bucket", F.lit(0).alias("guest")).unionByName(guests).withColumn("fp", sketch(F.col("text"), k, shingle))
    run = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")
    every = every.withColumn("next_text", F.lead("text").over(run)).withColumn("next_fp", F.lead("fp").over(run)).where("guest = 0")

    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - int(floor(char_length(text) / 2)))"), F.substring(F.col("next_text"), F.lit(1), half))
    every = every.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "fp", "next_fp", edited.alias("edited"))
    every = every.select("doc_id", "n_chars", "fp", "next_fp", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), sketch(F.col("edited"), k, shingle).alias("efp"))
    return every.select(
        "doc_id", "n_chars", "edited_sha256", encoded(F.col("fp")).alias("fingerprint"), encoded(F.col("efp")).alias("edited_fingerprint"),
        resemblance(F.col("fp"), F.col("efp"), k).alias("near_edited"), resemblance(F.col("fp"), F.col("next_fp"), k).alias("near_next"),
    )
