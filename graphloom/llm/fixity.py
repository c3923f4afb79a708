"""Merkle fixity audit of WARC replicas.

Each record's bytes are hashed; records in file order get byte offsets, and consecutive ranges of them are the leaves
of a file's tree, ``FAN`` nodes make one of the next level, up to the file's root. A node's hash holds lengths and
order of what is below it, not offsets, and ranges are bounded by ids, so damage to a record leaves all other ranges of
the file as they were, though they move. Two replicas are compared root by root; only children of nodes that
differ are looked at on the way down, and in the leaf ranges that differ records are matched by id. Hashes and offsets
are kept in a narrow manifest; record bytes are read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import written

#: Ids in a file, ids in a leaf range, children of a node, levels of a tree.
FILE_IDS, LEAF_IDS, FAN = 256, 4, 4
LEVELS = next(k for k in range(1, 64) if LEAF_IDS * FAN**k >= FILE_IDS) + 1
_SHIFT = FAN.bit_length() - 1
#: Files over which records without an id are dealt, by their hash.
NO_ID_FILES = 4096


def record(page_id: Column, url: Column, payload: Column) -> Column:
    """A WARC/1.0 response record as text. Null payloads are empty, null urls and ids are left out."""
    body = F.coalesce(payload, F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\n"))
    head = F.concat(head, F.coalesce(F.concat(F.lit("WARC-Target-URI: "), url, F.lit("\r\n")), F.lit("")))
    return F.concat(head, F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def _hex(at: int, digits: int) -> Column:
    return F.conv(F.substring("record_sha256", at, digits), 16, 10).cast("long")


def manifest(pages: DataFrame) -> DataFrame:
    """file, page_id, n (of equal records), warc_offset, warc_length, record_sha256, and leaf and part (the range of the
    record, and by its hash a part of that) of pages (page_id, url, html).

    Files hold ranges of ``FILE_IDS`` ids; records without an id are dealt by hash over files -1 to -``NO_ID_FILES``. Records
    are in order of id, then of hash. Equal records of one id are one row with their number ``n`` and lie next to each
    other. Offsets are running sums over (id, part), then within each, so an id with very many records is spread out.
    """
    text = record(F.col("page_id"), F.col("url"), F.col("html"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.octet_length(text).cast("long").alias("warc_length"), F.sha2(F.encode(text, "UTF-8"), 256).alias("record_sha256"))
    rows = rows.groupBy("page_id", "warc_length", "record_sha256").agg(F.count("*").alias("n"))
    none, leaves = F.col("page_id").isNull(), FILE_IDS // LEAF_IDS
    rows = rows.withColumn("file", F.when(none, -1 - _hex(1, 3) % NO_ID_FILES).otherwise(F.floor(F.col("page_id") / FILE_IDS)))
    rows = rows.withColumn("leaf", F.when(none, F.floor(_hex(4, 4) * leaves / (1 << 16))).otherwise(F.floor(F.pmod("page_id", F.lit(FILE_IDS)) / LEAF_IDS)))
    rows = rows.withColumn("part", F.when(none, _hex(4, 4)).otherwise(_hex(1, 2))).withColumn("bytes", F.col("warc_length") * F.col("n"))
    rows = written(rows, "records")
    group = ["file", "leaf", "page_id", "part"]
    sums = rows.groupBy(*group).agg(F.sum("bytes").alias("all"))
    upto = Window.partitionBy("file").orderBy("leaf", F.col("page_id").asc_nulls_first(), "part").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.select("file", "leaf", F.col("page_id").alias("id"), "part", (F.sum("all").over(upto) - F.col("all")).alias("base"))
    out = rows.join(sums, ["file", "leaf", "part"]).where(F.col("page_id").eqNullSafe(F.col("id")))
    within = Window.partitionBy(*group).orderBy("record_sha256", "warc_length").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("warc_offset", F.col("base") + F.sum("bytes").over(within) - F.col("bytes"))
    return out.select("file", "page_id", "n", "warc_offset", "warc_length", "record_sha256", "leaf", "part")


def tree(records: DataFrame) -> DataFrame:
    """file, level, node, begin, bytes, sha256: level 0 are the leaf ranges, the one node of the highest level is the root.
    ``begin`` and ``bytes`` are the node's range of offsets; the hash holds the bytes, but not where they begin."""

    def joined(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
        line = F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "n", "bytes", "sha256") if "page_id" in order else F.concat_ws(":", order[0], "bytes", "sha256")
        listed = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
        hashed = F.sha2(F.array_join(F.transform(listed, lambda x: x["line"]), ","), 256)
        return rows.groupBy(*by).agg(hashed.alias("sha256"), F.min("begin").alias("begin"), F.sum("bytes").alias("bytes"))

    flat = records.select("file", F.col("leaf").alias("node"), "part", "page_id", "n", F.col("warc_offset").alias("begin"), (F.col("warc_length") * F.col("n")).alias("bytes"), F.col("record_sha256").alias("sha256"))
    level = joined(joined(flat, ["file", "node", "part"], ["page_id", "sha256"]), ["file", "node"], ["part"])
    level = written(level, "tree0")
    out = level.withColumn("level", F.lit(0))
    for number in range(1, LEVELS):
        up = level.withColumn("child", F.col("node")).withColumn("node", F.shiftright("node", _SHIFT))
        level = written(joined(up, ["file", "node"], ["child"]), f"tree{number}")
        out = out.unionByName(level.withColumn("level", F.lit(number)))
    return out.select("file", "level", "node", "begin", "bytes", "sha256")


def compare(one: DataFrame, two: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of two manifests: the leaf ranges that differ (file, leaf), and of each file the nodes of both trees (a node that
    both have counts once) and those that were looked at: file, nodes, visited."""
    trees, open_, seen = (tree(one), tree(two)), None, None
    for level in range(LEVELS - 1, -1, -1):
        sides = [t.where(F.col("level") == level).select("file", "node", F.col("sha256").alias(name)) for t, name in zip(trees, ("s1", "s2"), strict=True)]
        if open_ is not None:
            up = open_.select(F.col("file").alias("pf"), F.col("node").alias("pn"))
            sides = [s.join(up, [s["file"] == up["pf"], F.shiftright(s["node"], _SHIFT) == up["pn"]], "left_semi") for s in sides]
        looked = written(sides[0].join(sides[1], ["file", "node"], "full").select("file", "node", (~F.col("s1").eqNullSafe(F.col("s2"))).alias("differs")), f"looked{level}")
        seen = looked if seen is None else seen.unionByName(looked)
        open_ = looked.where("differs").select("file", "node")
    nodes = trees[0].select("file", "level", "node").union(trees[1].select("file", "level", "node")).distinct().groupBy("file").agg(F.count("*").alias("nodes"))
    return open_.withColumnRenamed("node", "leaf"), nodes.join(seen.groupBy("file").agg(F.count("*").alias("visited")), "file")


def audit(one: DataFrame, two: DataFrame, leaves: DataFrame | None = None) -> DataFrame:
    """Rows of two manifests that don't agree: file, page_id, warc_offset, status, sha256 of both sides.

    ``status``: corrupt (same id, other bytes), missing (only in ``one``) or extra (only in ``two``). The offset is that in
    ``one``, or in ``two`` for an extra record. A record whose bytes agree but whose offset moved isn't reported.
    ``leaves``: the ranges that differ, if ``compare`` has found them already.
    """
    leaves = compare(one, two)[0] if leaves is None else leaves
    near = [m.join(leaves, ["file", "leaf"], "left_semi") for m in (one, two)]
    flat = [m.select("file", F.coalesce("page_id", F.lit(-1)).alias("k"), F.col("page_id").isNull().alias("none"), F.col("n").alias(f"n{i}"), F.col("warc_offset").alias(f"o{i}"), F.col("record_sha256")) for i, m in enumerate(near)]
    both = flat[0].join(flat[1], ["file", "k", "none", "record_sha256"], "full").where(~F.col("n0").eqNullSafe(F.col("n1")))
    each = both.groupBy("file", "k", "none").agg(
        F.min("o0").alias("o0"), F.min("o1").alias("o1"),
        F.min(F.when(F.col("n0").isNotNull(), F.col("record_sha256"))).alias("sha256"), F.min(F.when(F.col("n1").isNotNull(), F.col("record_sha256"))).alias("replica_sha256"),
    )
    status = F.when(F.col("o1").isNull(), "missing").when(F.col("o0").isNull(), "extra").otherwise("corrupt")
    return each.select("file", F.when(~F.col("none"), F.col("k")).alias("page_id"), F.coalesce("o0", "o1").alias("warc_offset"), status.alias("status"), "sha256", "replica_sha256")


#: Ids of the query's damage: what they leave by the first number.
EVERY, CUT, OTHER, GONE = 701, 7, 13, 29


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with known damage for the registered query, in one file of three or so: of the ids that leave CUT by
    EVERY, the last characters are gone; those that leave OTHER have another first character; those that leave GONE are missing."""
    rest, n = F.pmod("page_id", F.lit(EVERY)), F.char_length("html")
    shorter, changed = F.expr("substring(html, 1, char_length(html) - 3)"), F.concat(F.lit("#"), F.expr("substring(html, 2, char_length(html) - 1)"))
    html = F.when(rest == CUT, shorter).when(rest == OTHER, changed).otherwise(F.col("html"))
    return pages.where((rest != GONE) | rest.isNull()).withColumn("html", F.when(n > 3, html).otherwise(F.col("html")))


def fixity(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """Every record of ``pages`` with its place and hash, what the audit against the replica says of it, and of its file the
    nodes of the trees and how many of them the descent looked at: file, page_id, n, warc_offset, warc_length,
    record_sha256, status (intact, corrupt or missing), nodes, visited. Null ids are kept in files of their own,
    repeated records are one row; an empty table gives none."""
    one, two = written(manifest(pages), "manifest"), written(manifest(replica), "manifest")
    leaves, counts = compare(one, two)
    bad = audit(one, two, leaves).where("status <> 'extra'").select(F.col("file").alias("__file"), F.col("page_id").alias("__id"), F.col("status").alias("__status"))
    out = one.join(bad, (one["file"] == bad["__file"]) & one["page_id"].eqNullSafe(bad["__id"]), "left").join(counts, "file")
    return out.select("file", "page_id", "n", "warc_offset", "warc_length", "record_sha256", F.coalesce("__status", F.lit("intact")).alias("status"), "nodes", "visited")


def _levels(rows: str) -> str:
    """SQL: every node (file, level, node, whether it differs) over the leaves of ``rows``."""
    return " UNION ALL ".join(f"SELECT file, {k} AS level, leaf // {FAN**k} AS node, max(bad) AS bad FROM {rows} GROUP BY ALL" for k in range(LEVELS))


ORACLE = f"""
WITH r AS (
  SELECT page_id,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS record,
    length(html) > 3 AS long_enough
  FROM pages),
s AS (
  SELECT page_id // {FILE_IDS} AS file, page_id % {FILE_IDS} // {LEAF_IDS} AS leaf, page_id, record,
    CASE WHEN page_id % {EVERY} = {GONE} THEN 'missing' WHEN page_id % {EVERY} IN ({CUT}, {OTHER}) AND long_enough THEN 'corrupt' ELSE 'intact' END AS status
  FROM r),
leaves AS (SELECT file, leaf, max((status <> 'intact')::INT) AS bad FROM s GROUP BY ALL),
nodes AS ({_levels("leaves")}),
counts AS (
  SELECT n.file, count(*)::BIGINT AS nodes, count(*) FILTER (n.level = {LEVELS - 1} OR up.bad = 1)::BIGINT AS visited
  FROM nodes n LEFT JOIN nodes up ON up.file = n.file AND up.level = n.level + 1 AND up.node = n.node // {FAN} GROUP BY n.file)
SELECT s.file, page_id, 1::BIGINT AS n,
  (sum(strlen(record)) OVER (PARTITION BY s.file ORDER BY page_id ROWS UNBOUNDED PRECEDING) - strlen(record))::BIGINT AS warc_offset,
  strlen(record)::BIGINT AS warc_length, sha256(record) AS record_sha256, status, nodes, visited
FROM s JOIN counts ON counts.file = s.file
"""
