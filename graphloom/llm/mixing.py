"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are aggregated by the set of sources they belong to (their pattern). The network runs from each
pattern, whose words may be taken once at no cost and again at growing cost (an arc for each
repetition, so the costs are convex), to the quotas of its sources. The flow tells how
many words of a pattern each source takes; documents are then chosen in the order of a seeded hash until those words are there.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import written

#: The driver holds one number for each source and each pattern: more than this many are refused.
MAX_PATTERNS = 1_000_000
#: Hash ranges into which the documents of a pattern are summed; only the one where the words run out is sorted.
RANGES = 4096

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], total: float, most: float = 2.0) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size; what is above is shared again by weight."""
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), total
    while open_:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / weight > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in full:
            out[i] = most * float(sizes[i])
            left -= out[i]
        closed = set(full)
        open_ = [i for i in open_ if i not in closed]
    return out


def min_cost_flow(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], most: int) -> list[dict[int, int]]:
    """Words of each pattern that each source takes: {source: words}, by successive shortest paths.

    patterns: (sources, words). The r-th repetition of a pattern's words costs r - 1 a word.
    """
    flow: list[dict[int, int]] = [{} for _ in patterns]
    sharers: dict[int, list[int]] = {}
    for p, (sources, _) in enumerate(patterns):
        for s in sources:
            sharers.setdefault(s, []).append(p)
    left = list(quotas)
    used = [0] * len(patterns)

    def level(p: int) -> int:
        return used[p] // patterns[p][1]

    # Breadth first from a source that wants more: to its patterns, from a full pattern to the sources that hold
    # its words, from those to their other patterns. All steps cost nothing; the pattern at the end costs its level.
    for s in sorted(sharers):
        while left[s] > 0:
            came: dict[int, int | None] = {~s: None}
            queue, ends = deque([~s]), []
            while queue:
                node = queue.popleft()
                if node >= 0 and patterns[node][1] > 0 and used[node] < most * patterns[node][1]:
                    ends.append((level(node), node))
                near = [~o for o, words in flow[node].items() if words > 0] if node >= 0 else sharers[~node]
                for to in near:
                    if to not in came:
                        came[to] = node
                        queue.append(to)
            if not ends:
                break
            path: list[int] = []
            step: int | None = min(ends)[1]
            while step is not None:
                path.append(step)
                step = came[step]
            p = path[0]
            room = min([left[s], (level(p) + 1) * patterns[p][1] - used[p], *(flow[path[i + 1]][~path[i]] for i in range(1, len(path) - 1, 2))])
            used[p] += room
            left[s] -= room
            for i in range(0, len(path), 2):
                flow[path[i]][~path[i + 1]] = flow[path[i]].get(~path[i + 1], 0) + room
                if i + 2 < len(path):
                    flow[path[i + 2]][~path[i + 1]] -= room
    return flow


def mix(docs: DataFrame, sources: Column, size: Column, weight_cycle: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: int = 2, seed: int = 7, key: Column | None = None) -> DataFrame:
    """``docs`` with size, source_size, target (of its first source) and taken (words taken, repeats counted).

    ``sources``: array of the sources a row belongs to; a null source is a source, and comes last in
    order. Sources in code point order weigh ``weight_cycle``, repeating, and share ``share`` times all words; none
    gets more than ``most`` times its own. Rows are taken whole: all rows of a pattern as often as the flow asks, and
    one time more those that come first by seeded hash of ``key`` (the id and the text), as far as the words
    go, and then the row whose size comes nearest to what is short. Of equal rows, as many are taken once more as there
    are words for; which ones of them makes no difference, so reruns agree. A row without words takes 0. Empty tables give none.
    More than MAX_PATTERNS patterns are refused.
    """
    given = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    key = F.xxhash64(F.col("doc_id").cast("string"), F.xxhash64("text")) if key is None else key
    keyed = docs.withColumn("__sources", F.array_sort(F.array_distinct(sources))).withColumn("__size", size).withColumn("__h", F.xxhash64(F.lit(seed), key))
    keyed = keyed.withColumn("__p", F.xxhash64(F.to_json("__sources", {"ignoreNullFields": "false"}))).withColumn("__range", F.pmod("__h", F.lit(RANGES)))
    rows = written(keyed.select("__sources", "__p", "__range", "__h", "__size"), "sized")
    totals = rows.groupBy("__sources").agg(F.sum("__size").alias("words")).limit(MAX_PATTERNS + 1).collect()
    if len(totals) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    names = sorted({s for r in totals for s in r[0]}, key=lambda s: (s is None, (s or "").encode()))
    number = {s: i for i, s in enumerate(names)}
    patterns = sorted(((tuple(sorted(number[s] for s in r[0])), r[0], int(r[1] or 0)) for r in totals), key=lambda x: x[0])
    sizes = [0] * len(names)
    for own, _, words in patterns:
        for s in own:
            sizes[s] += words
    total = sum(w for _, _, w in patterns)
    wanted = targets(sizes, [weight_cycle[i % len(weight_cycle)] for i in range(len(names))], share * total, most)
    flow = min_cost_flow([(own, w) for own, _, w in patterns], [round(x) for x in wanted], most)

    spark = docs.sparkSession
    plan = []
    for (own, real, words), taken in zip(patterns, flow, strict=True):
        take = sum(taken.values())
        first = own[0] if own else None
        plan.append(Row(real, words, sizes[first] if own else 0, float(wanted[first]) if own else 0.0, take // words if words else 0, take % words if words else 0))
    kind = T.StructType([T.StructField("__sources", docs.select(sources.alias("x")).schema[0].dataType), T.StructField("__words", T.LongType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("__times", T.LongType()), T.StructField("__rest", T.LongType())])
    known = spark.createDataFrame(plan, kind).withColumn("__p", F.xxhash64(F.to_json("__sources", {"ignoreNullFields": "false"}))).drop("__sources")
    known = F.broadcast(known) if len(plan) <= 10_000 else known

    # Where the words of a pattern run out: running sums over hash ranges, then over the rows of one range.
    sums = rows.groupBy("__p", "__range").agg(F.sum("__size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("__p").orderBy("__range"))
    sums = sums.withColumn("upto", upto).withColumn("base", F.col("upto") - F.col("words")).join(known.select("__p", "__rest"), "__p")
    edge = sums.where("base < __rest and upto >= __rest").select("__p", F.col("__range").alias("__edge"), "base", "__rest")
    inside = rows.select("__p", "__range", "__h", "__size").join(edge, "__p").where("__range = __edge")
    inside = inside.groupBy("__p", "__h").agg(*[F.max(c).alias(c) for c in ("__edge", "base", "__rest")], F.max("__size").alias("one"), F.sum("__size").alias("words"), F.count("*").alias("rows"))
    run = F.sum("words").over(Window.partitionBy("__p").orderBy("__h").rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("s", F.col("base") + run)
    whole = F.max(F.when(F.col("s") <= F.col("__rest"), F.col("__h"))).alias("__last")
    got = F.coalesce(F.max(F.when(F.col("s") <= F.col("__rest"), F.col("s"))), F.max("base"))
    cross = F.min(F.when(F.col("s") > F.col("__rest"), F.struct("__h", "rows", "one"))).alias("cross")
    edge = inside.groupBy("__p").agg(F.max("__edge").alias("__edge"), whole, (F.max("__rest") - got).alias("short"), cross)
    # Of equal rows where the words run out, as many as fit.
    some = F.when(F.col("cross.rows") > 1, F.floor(F.col("short") / F.col("cross.one"))).otherwise(0)
    edge = edge.withColumn("__some", some).withColumn("short", F.col("short") - F.coalesce(F.col("__some") * F.col("cross.one"), F.lit(0)))
    edge = written(edge.select("__p", "__edge", "__last", "short", F.col("cross.__h").alias("__cross"), "__some"), "edge")
    # What is short then is less than a row; of the rows not chosen, the one whose size comes nearest to it.
    few = len(plan) <= 10_000
    free = rows.join(F.broadcast(edge) if few else edge, "__p").where("__range > __edge or (__range = __edge and (__last is null or __h > __last))")
    off = F.abs(F.col("__size") - F.col("short"))
    fill = free.where(off < F.col("short")).groupBy("__p").agg(F.min_by("__h", F.struct(off, "__h")).alias("__fill"))
    edge = edge.join(fill, "__p", "left").drop("short")
    picked = edge.select("__p", F.explode(F.array_distinct(F.array("__cross", "__fill"))).alias("__h"), "__cross", "__some", "__fill").where("__h is not null")
    more = F.when(F.col("__h") == F.col("__cross"), F.col("__some")).otherwise(0) + F.coalesce((F.col("__h") == F.col("__fill")).cast("long"), F.lit(0))
    picked = picked.select("__p", "__h", more.alias("__more")).where("__more > 0")
    several = rows.join(F.broadcast(picked) if few else picked, ["__p", "__h"]).groupBy("__p", "__h").agg(F.max("__more").alias("__more"), F.count("*").alias("n"))
    several = written(several, "picked")
    edge = written(edge.select("__p", "__edge", "__last"), "edge")

    out = keyed.join(known, "__p", "left").join(F.broadcast(edge) if few else edge, "__p", "left").join(F.broadcast(several) if few else several, ["__p", "__h"], "left")
    before = (F.col("__range") < F.col("__edge")) | ((F.col("__range") == F.col("__edge")) & (F.col("__h") <= F.col("__last")))
    out = out.withColumn("__extra", F.coalesce(before | (F.col("__more") >= F.col("n")), F.lit(False)))
    if several.where("n > __more").head(1):
        # Equal rows of which only some are taken: numbered within the partitions they come from, and those by their counts.
        tied = F.coalesce(F.col("n") > F.col("__more"), F.lit(False))
        rows_ = written(out.where(tied).withColumn("__part", F.spark_partition_id()).withColumn("__place", F.monotonically_increasing_id()), "tied")
        group = ["__p", "__h"]
        upto = F.sum("count").over(Window.partitionBy(*group).orderBy("__part")) - F.col("count")
        base = rows_.groupBy(*group, "__part").count().withColumn("__base", upto).drop("count")
        place = F.row_number().over(Window.partitionBy(*group, "__part").orderBy("__place"))
        rows_ = rows_.join(base, [*group, "__part"]).withColumn("__extra", F.col("__base") + place <= F.col("__more"))
        out = out.where(~tied).unionByName(rows_.select(*out.columns))
    out = out.withColumn("size", F.col("__size")).withColumn("taken", F.col("__size") * (F.col("__times") + F.col("__extra").cast("long")))
    return out.select(*given, "size", "source_size", "target", "taken")
