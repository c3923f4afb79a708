"""N-gram Jaccard join by count vectors in an R-tree, exact, for sets of word shingles.

Shingles are hashed into groups. Two uses are made of them:

* Distribution. Sets A and B with J(A, B) >= t differ in at most d = floor(s (1 - t) / t) shingles,
  s being the smaller size. Dealt by hash into groups of which more than d are filled, at least one filled group is
  the same in both; its content is the key by which they meet. The number of groups depends on a bucket of sizes, so
  a set makes keys for its own bucket and for the one below, where its smaller partners are. Passages that many texts share
  would bring all of those together, so common shingles are left out first: that takes from both sets alike, so
  the same bound holds for what is left. Only sets that then fill too few groups meet by their whole content as well.
  Which shingles count as common decides how many candidates there are, never which pairs are found.
  The lower the threshold, the smaller the groups: at 0.8 many hold one shingle, which texts of a large table share by chance, until
  chains of such pairs tie most of it. Below GROUPED shingles a group, keys are windows over the sorted set instead
  (``window_keys``), each of as many shingles.
* Search. Sets that share a key (directly or through others) form a candidate component. Its members
  are compared in chunks of bounded size: the counts of ``DIMS`` groups are points in an R-tree, a
  pair of nodes is dropped if the sum of coordinate minima can't reach the overlap needed, and
  the pairs that survive are verified on the whole sets. A pair that links have joined already is skipped.

Equal sets are one node throughout, so thousands of copies cost one comparison. No key group is
ever brought into one task with its texts, and no list of pairs is made.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import Growing, forget, release, with_totals
from ..operators.components import components
from ._shared import mix64, shingle_hashes, signed, slices, texts_of, whole_hash, word_hashes, written

#: Coordinates of a point, and points in a leaf of the R-tree.
DIMS, LEAF = 32, 16
#: Shingles in a chunk of sets that are compared in one task; one set may have more.
CHUNK = 150_000
#: Shingles that a round of such comparisons deals, where the table has fewer.
ROUND = 1 << 24
#: Shingles that are counted at once, times they must be seen in all such lots (twice in a lot) to be common, and how many can be.
LOT, COMMON, MOST_COMMON = 1 << 20, 256, 1 << 20
#: The same for near copies: their sets may differ in more shingles, so their keys hold fewer and shared passages make up more of them.
COMMON_NEAR = 24
#: Shingles that a group holds on average, t / (1 - t), from which keys are groups; below, they are windows of WIDTHS
#: shingles, the first of these for which a set has enough.
GROUPED, WIDTHS = 8, (3, 2, 1)
#: Keys that a task folds at once, and sets that share a key there before it is folded: of such a key one set goes on.
FOLD, SHARED = 1 << 19, 64


def size_buckets(numerator: int, denominator: int, largest: int = 1 << 40) -> np.ndarray:
    """Lower ends of size ranges such that linked sets lie in the same or in adjacent ranges."""
    ends = [1]
    while ends[-1] <= largest:
        ends.append(-(-ends[-1] * denominator // numerator) + 1)
    return np.array(ends, np.int64)


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a shorter text is one shingle, none without words."""
    for a, b in slices(texts):
        words, at = word_hashes(texts[a:b])
        every = shingle_hashes(words, size)
        for i in range(b - a):
            n = at[i + 1] - at[i]
            if n >= size:
                yield np.unique(every[at[i] : at[i + 1] - size + 1])
            elif n:
                yield np.array([whole_hash(words[at[i] : at[i + 1]])], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def digest(hashes: np.ndarray) -> int:
    """A 64-bit hash of a set, as a signed number."""
    total = mix64(hashes ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(hashes))
    return int(signed(mix64(np.array([total])))[0])


def spare_groups(size: int, differ: int) -> int:
    """Groups beyond differ + 1 that a set of this size is likely to leave empty, and some more."""
    empty = (differ + 1) * math.exp(-size / (differ + 1))
    return math.ceil(empty + 3 * math.sqrt(empty))


def group_keys(hashes: np.ndarray, ends: np.ndarray, numerator: int, denominator: int, common: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the content of every filled group, under the set's own scheme and the one below.

    If a set fills more groups than two sets can differ in, one filled group is the same in the other. Groups are
    made of the shingles outside ``common`` (ascending). A set that fills too few of them also has keys for the groups
    of all its shingles; and if those are too few as well, for the empty ones, and so meets others of that kind.
    """
    n, out = len(hashes), []
    rare = _without(hashes, common)
    own = int(np.searchsorted(ends, n, "right")) - 1
    for k in (own, own - 1):
        if k < 0:
            continue
        differ = int((ends[k + 1] - 1) * (denominator - numerator) // numerator)
        if differ == 0:  # only equal sets, which are one node, link here
            continue
        # Groups enough for a set half of whose shingles are common, then for whole sets.
        for of, size, scheme in ((rare, int(ends[k]) // 2, 2 * k + 1), (hashes, int(ends[k]), 2 * k)):
            salt = np.uint64(scheme * 0x2545F4914F6CDD1D & (1 << 64) - 1)
            groups = differ + 1 + spare_groups(size, differ)
            group = ((mix64(of + salt) >> np.uint64(33)) % np.uint64(groups)).astype(np.int64)
            content = np.zeros(groups, np.uint64)
            np.add.at(content, group, mix64(of ^ np.uint64(0x14057B7EF767814F)))
            keys = mix64(content + mix64(np.arange(groups, dtype=np.uint64) + salt))
            filled = np.bincount(group, minlength=groups) > 0
            enough = filled.sum() > differ
            out.append(keys[filled] if enough or of is rare and rare is not hashes else keys)
            if enough or rare is hashes:
                break
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def window_keys(hashes: np.ndarray, numerator: int, denominator: int, common: np.ndarray | None = None) -> np.ndarray:
    """Hashes of windows of consecutive shingles of a set (ascending), one of which every set that links with it has too.

    A shingle that only this set has is in w windows of width w at most, one that only the other set has parts w - 1. With
    J >= t that changes n max(w (1 - t), (w - 1) (1 - t) / t) windows at most of a set of n. Where the set has more windows
    than that, its smallest ones beyond that number are enough (a prefix in an order that all sets share). Windows are made
    of the shingles outside ``common`` (ascending); a set with too few also has keys for narrower ones, and then for windows of all
    its shingles. The set of a pair that stops first has its last kind in common with the other; single shingles always suffice.
    """
    n, out = len(hashes), []
    if n * (denominator - numerator) < numerator:  # only equal sets, which are one node, link here
        return np.zeros(0, np.uint64)
    rare = _without(hashes, common)
    for kind, of in enumerate((rare, hashes)):
        for width in WIDTHS:
            lost = max(n * width * (denominator - numerator) // denominator, n * (width - 1) * (denominator - numerator) // numerator)
            windows = max(len(of) - width + 1, 0)
            keys = np.full(windows, (8 * kind + width) * 0x2545F4914F6CDD1D & (1 << 64) - 1, np.uint64)
            for j in range(width):
                keys = mix64(keys + of[j : j + windows])
            out.append(keys if windows <= lost else np.partition(keys, lost)[: lost + 1])
            if windows > lost:
                return np.concatenate(out)
    raise AssertionError("single shingles suffice")


def _without(hashes: np.ndarray, common: np.ndarray | None) -> np.ndarray:
    if common is None or not len(common):
        return hashes
    return hashes[common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] != hashes]


class RTree:
    """Count vectors packed bottom up: sorted by size and by their largest coordinates, then ``LEAF`` to a node."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        self.order = np.lexsort((points[:, 1], points[:, 0], sizes)) if len(points) else np.zeros(0, np.int64)
        points, sizes = points[self.order], sizes[self.order]
        cut = np.arange(0, len(points), LEAF)
        self.levels = [(np.maximum.reduceat(points, cut), np.minimum.reduceat(sizes, cut), np.maximum.reduceat(sizes, cut))]
        while len(self.levels[-1][0]) > LEAF:
            high, low, top = self.levels[-1]
            cut = np.arange(0, len(high), LEAF)
            self.levels.append((np.maximum.reduceat(high, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(top, cut)))
        self.points, self.sizes = points, sizes

    def near(self, point: np.ndarray, size: int, numerator: int, denominator: int) -> np.ndarray:
        """Positions of the points whose bound lets them link with this one."""
        need = numerator / (numerator + denominator)
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            high, low, top = (x[nodes] for x in self.levels[depth])
            fits = (top * denominator >= size * numerator) & (low * numerator <= size * denominator) & (np.minimum(high, point).sum(1) >= need * (low + size) - 1e-6)
            nodes = nodes[fits]
            nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
            nodes = nodes[nodes < (len(self.levels[depth - 1][0]) if depth else len(self.points))]
        shared = np.minimum(self.points[nodes], point).sum(1)
        return self.order[nodes[shared * (numerator + denominator) >= numerator * (self.sizes[nodes] + size)]]


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def links_between(sets: list[np.ndarray], side: np.ndarray, numerator: int, denominator: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets of side 0 and side 1 (all sets, if only one side is there)."""
    n = len(sets)
    if n < 2:
        return []
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    points = np.zeros((n, DIMS), np.int64)
    np.add.at(points, (owner, (mix64(flat) % np.uint64(DIMS)).astype(np.int64)), 1)
    held, column = np.unique(flat, return_inverse=True)
    order = np.argsort(column, kind="stable")
    posting, first = owner[order], np.searchsorted(column[order], np.arange(len(held) + 1))
    at = np.concatenate([[0], np.cumsum(sizes)])
    two = side.any() and not side.all()
    inside = np.flatnonzero(side == 1) if two else np.arange(n)
    tree, parent, found = RTree(points[inside], sizes[inside]), list(range(n)), []
    for a in np.flatnonzero(side == 0) if two else range(n):
        near = inside[tree.near(points[a], int(sizes[a]), numerator, denominator)]
        near = near[near != a] if two else near[near > a]
        root = _find(parent, a)
        near = np.array([b for b in near if _find(parent, b) != root], np.int64)
        if not len(near):
            continue
        own = column[at[a] : at[a + 1]]
        begin, count = first[own], first[own + 1] - first[own]
        reach = np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        common = np.bincount(posting[reach], minlength=n)[near]
        for b in near[common * denominator >= numerator * (sizes[a] + sizes[near] - common)]:
            x, y = _find(parent, a), _find(parent, b)
            if x != y:
                parent[x] = y
                found.append((int(a), int(b)))
    return found


_FEATURES = "doc_id long, text_hash long, n_shingles long, node long, often array<long>, times array<long>"


def _features(shingle: int):
    """(doc_id, text_hash, text) -> size and digest of the set; and, in rows of their own, shingles seen twice in a lot."""

    def row_of(lot: list[np.ndarray]) -> pa.RecordBatch:
        held, times = np.unique(np.concatenate(lot), return_counts=True)
        some = times > 1
        arrays = [pa.array([x[some].tolist()], pa.list_(pa.int64())) for x in (signed(held), times)]
        return pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64()) for _ in range(4)], *arrays], names)

    names = ["doc_id", "text_hash", "n_shingles", "node", "often", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot, seen, size = [], set(), 0
        for batch in batches:
            made = []
            for s in shingle_sets(texts_of(batch["text"]), shingle):
                made.append((len(s), digest(s)))
                if made[-1][1] not in seen:
                    seen.add(made[-1][1])
                    lot.append(s)
                    size += len(s)
                if size >= LOT:
                    yield row_of(lot)
                    lot, seen, size = [], set(), 0
            more = [pa.array([x[i] for x in made], pa.int64()) for i in (0, 1)]
            none = [pa.nulls(len(made), pa.list_(pa.int64()))] * 2
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], *more, *none], names)
        if size:
            yield row_of(lot)

    return run


def _common(features: DataFrame, least: int) -> np.ndarray:
    """Hashes of the shingles seen ``least`` times or more, ascending: the MOST_COMMON of them seen most."""
    pairs = features.where("node is null").select(F.explode(F.arrays_zip("often", "times")).alias("x"))
    sums = pairs.groupBy("x.often").agg(F.sum("x.times").alias("n")).where(F.col("n") >= least)
    found = sums.orderBy(F.col("n").desc(), "often").limit(MOST_COMMON).select("often").toArrow()
    return np.sort(found["often"].to_numpy().astype(np.int64).view(np.uint64))


def _keys(shingle: int, numerator: int, denominator: int, common: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = size_buckets(numerator, denominator)
        grouped = numerator >= GROUPED * (denominator - numerator)
        for batch in batches:
            seen: dict[int, None] = {}
            for s in shingle_sets(texts_of(batch["text"]), shingle):
                if len(s) and (d := digest(s)) not in seen:
                    seen[d] = None
                    keys = group_keys(s, ends, numerator, denominator, common.value) if grouped else window_keys(s, numerator, denominator, common.value)
                    for a in range(0, len(keys), 1 << 16):
                        part = signed(keys[a : a + (1 << 16)])
                        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), d))], ["key", "node"])

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in run(batches):
            held.append((batch["key"].to_numpy(), batch["node"].to_numpy()))
            size += len(held[-1][0])
            if size >= FOLD or len(held) >= 20_000:
                yield from _packed(*fold_keys(*(np.concatenate(x) for x in zip(*held, strict=True))))
                held, size = [], 0
        if held:
            yield from _packed(*fold_keys(*(np.concatenate(x) for x in zip(*held, strict=True))))

    return folded


def _packed(keys: np.ndarray, nodes: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(keys), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(x[a : a + (1 << 16)]) for x in (keys, nodes)], ["key", "node"])


def fold_keys(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, node) rows that tie the same nodes, with fewer of a key that more than SHARED nodes share: its smallest
    node alone, and each other one tied to that by a key of their own. So no key leaves a task with many rows."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    begin = np.flatnonzero(first)
    size = np.diff(np.append(begin, len(keys)))
    first |= np.repeat(size <= SHARED, size)
    hub = nodes[np.repeat(begin, size)]
    tied = np.unique(np.stack([hub, nodes], 1)[~first & (hub != nodes)], axis=0)
    own = signed(mix64(mix64(tied[:, 0].view(np.uint64)) + tied[:, 1].view(np.uint64))) if len(tied) else np.zeros(0, np.int64)
    return np.concatenate([keys[first], own, own]), np.concatenate([nodes[first], tied[:, 0], tied[:, 1]])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that tie the same nodes as edges (a, b), one for each node but the smallest it reaches: to that one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root, (u, v) = np.arange(len(nodes)), at.reshape(2, -1)
    while (apart := root[u] != root[v]).any():
        u, v = u[apart], v[apart]
        np.minimum.at(root, np.maximum(root[u], root[v]), np.minimum(root[u], root[v]))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    tied = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[tied], nodes[root[tied]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) -> forests of FOLD edges at a time."""
    held, size = [], 0
    for batch in batches:
        held.append((batch["a"].to_numpy(), batch["b"].to_numpy()))
        size += len(batch)
        if size >= FOLD:
            yield _edges(*forest(*(np.concatenate(x) for x in zip(*held, strict=True))))
            held, size = [], 0
    if held:
        yield _edges(*forest(*(np.concatenate(x) for x in zip(*held, strict=True))))


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _verify(shingle: int, numerator: int, denominator: int):
    """Rows sorted by task: (task, side, node, text) -> links (a, b). Holds one task's sets at a time."""

    def solve(kept: dict[tuple[int, int], np.ndarray]) -> list[tuple[int, int]]:
        names = [n for _, n in kept]
        found = links_between(list(kept.values()), np.array([side for side, _ in kept]), numerator, denominator)
        return [(names[a], names[b]) for a, b in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows = None, {}
        for batch in batches:
            out: list[tuple[int, int]] = []
            columns = batch["task"].to_pylist(), batch["side"].to_pylist(), batch["node"].to_pylist()
            for t, side, node, s in zip(*columns, shingle_sets(texts_of(batch["text"]), shingle), strict=True):
                if t != task:
                    out += solve(rows)
                    task, rows = t, {}
                if (side, node) not in rows and digest(s) == node:  # else another text under the same id
                    rows[side, node] = s
            yield _pairs(out)
        yield _pairs(solve(rows))

    def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _linked(docs: DataFrame, shingle: int, threshold: Fraction, common_from: int) -> tuple[DataFrame, DataFrame]:
    """Features of every row (doc_id, text_hash, n_shingles, node: the digest of its set), and of every node that isn't
    empty its first row (null ids last) and the label of what it is linked with (node, first, label)."""
    numerator, denominator = threshold.numerator, threshold.denominator
    rows = _keyed(docs)
    features = written(rows.mapInArrow(_features(shingle), _FEATURES), "features")
    common = docs.sparkSession.sparkContext.broadcast(_common(features, common_from))  # 8 bytes each of MOST_COMMON at most
    features = features.where("node is not null").drop("often", "times")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    nodes = features.where("n_shingles > 0").groupBy("node").agg(first.alias("first"), F.max("n_shingles").alias("n"))

    keys = rows.select("text").mapInArrow(_keys(shingle, numerator, denominator, common), "key long, node long")
    hub = F.min("node").over(Window.partitionBy("key"))  # of a key, one row for each FOLD keys of a task at most
    # Near copies share many keys and so have edges to many hubs. One edge to the least of a node's hubs stays, and the
    # others are tied to that one hub to hub, which is the same edge for many nodes; then forests, which are fewer still.
    edges = keys.select(F.col("node").alias("a"), hub.alias("b")).where("a <> b").distinct()
    edges = edges.withColumn("m", F.min("b").over(Window.partitionBy("a")))  # as many rows as the node has keys at most
    edges = edges.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
    candidates = components(edges.mapInArrow(_forests, "a long, b long"))

    # Chunks of a candidate component: as many as its shingles ask for, each text read once.
    member = written(candidates.join(nodes, "node").select("node", "component", "n", "first.doc_id", "first.text_hash"), "members")
    release(docs.sparkSession)  # the keys, the largest shuffle of all; texts are dealt next
    member = with_totals(member, "component", [("all_n", F.sum("n"))]).withColumn("parts", F.ceil(F.col("all_n") / CHUNK).cast("int"))
    member = member.select("node", F.col("doc_id").alias("id"), F.col("text_hash").alias("h"), "component", "parts", F.expr("pmod(xxhash64(node), parts)").cast("int").alias("part"))
    same = (F.col("h") == F.col("text_hash")) & F.col("id").eqNullSafe(F.col("doc_id"))
    # Members are no bounded table: texts are dealt to them by key at every size.
    cells = written(member.hint("merge").join(rows, same).select("node", "component", "parts", "part", "text"), "cells")
    release(docs.sparkSession)

    def compare(wanted: DataFrame) -> DataFrame:
        """wanted: node, text, task, side."""
        sets = wanted.select("task", "side", "node", "text").repartition(F.col("task")).sortWithinPartitions("task")
        return sets.mapInArrow(_verify(shingle, numerator, denominator), "a long, b long")

    # First within each chunk, and between each and the component's first.
    def task(low, high) -> Column:
        return F.struct(F.xxhash64("component", low, high).alias("task"), (F.col("part") == high).cast("int").alias("side"))

    zero = F.lit(0)
    rest_of = F.expr("if(parts > 1, sequence(1, parts - 1), array())")
    others = F.array(task(F.col("part"), F.col("part")), task(zero, F.col("part")))
    firsts = F.when(F.col("part") > 0, others).otherwise(F.concat(F.array(task(zero, zero)), F.transform(rest_of, lambda q: task(zero, q))))
    links = written(compare(cells.withColumn("t", F.explode(firsts)).select("node", "text", "t.task", "t.side")), "links")
    label = written(components(links), "labels")
    release(docs.sparkSession)

    # Then between other chunks, unless all their members are linked already.
    large = cells.where("parts > 2").select("node", "component", "part")
    if large.head(1):
        state = large.join(label.select("node", F.col("component").alias("linked")), "node", "left").withColumn("linked", F.coalesce("linked", "node"))
        state = written(state.where("part > 0").groupBy("component", "part").agg(F.min("linked").alias("low"), F.max("linked").alias("high")), "states")
        other = state.select("component", *[F.col(c).alias(f"{c}2") for c in ("part", "low", "high")])
        rest = state.join(other, "component").where("part < part2 and not (low = high and low2 = high2 and low = low2)")
        rest = written(rest.select("component", F.col("part").alias("p"), F.col("part2").alias("q"), F.xxhash64("component", "part", "part2").alias("task")), "rest")
        if pairs := rest.count():
            # Each round deals about as many shingles as the table has, so disk doesn't grow with the pairs of chunks.
            rounds = -(-2 * pairs * CHUNK // max(nodes.agg(F.sum("n")).head()[0], ROUND))
            ends = F.array(F.struct(F.col("p").alias("part"), zero.alias("side")), F.struct(F.col("q").alias("part"), F.lit(1).alias("side")))
            more = Growing(docs.sparkSession, "more")
            for k in range(rounds):
                sides = rest.where(F.expr(f"pmod(task, {rounds}) = {k}")).select("component", "task", F.explode(ends).alias("s"))
                more.append(compare(cells.join(sides.select("component", "task", "s.part", "s.side"), ["component", "part"])))
                release(docs.sparkSession)
            links = written(links.unionByName(more.read()), "links")
            label = written(components(links), "labels")

    known = written(nodes.join(label, "node", "left").select("node", "first", F.coalesce("component", "node").alias("label")), "known")
    forget(cells, links, label)
    release(docs.sparkSession)
    return features, known


def jaccard_components(docs: DataFrame, shingle: int = 3, threshold: Fraction = Fraction(9, 10), common_from: int | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id that links reach; a link is a Jaccard similarity of
    ``threshold`` or more between the sets of distinct ``shingle``-word shingles (A-Z lowered, words
    are runs of characters other than space and \\x09-\\x0D). A text of fewer words is one shingle; a
    null text or one without words has an empty set, links with nothing and is its own component.

    Repeated rows come back as often; several texts under one id link each by themselves. Rows with
    a null id link like others, and have a null component if there is no id in reach. Other columns of ``docs`` are
    not looked at. An empty table gives none. Sets are told apart by 64-bit digests. ``common_from`` (how often a shingle
    is seen before keys leave it out, COMMON if not given) changes the work, not the result.
    """
    features, known = _linked(docs, shingle, threshold, common_from or COMMON)
    known = with_totals(known, "label", [("component_id", F.min("first.doc_id"))]).select("node", "component_id")
    # A set that many rows have is one row of `known`; AQE can split those rows of `features`.
    out = features.join(known, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 5, threshold: Fraction = Fraction(4, 5), common_from: int = COMMON_NEAR) -> DataFrame:
    """``docs`` with one row of each group that links join: that of the smallest doc_id, then of the smallest text hash.

    Rows are told apart by id and text, so another text under the id of a copy stays, and a null id is like
    any other (after all ids). Of equal rows one stays. A null text or one without words has no copies: all such rows stay.
    ``common_from`` as in ``jaccard_components``.
    """
    features, known = _linked(docs, shingle, threshold, common_from)
    first = with_totals(known, "label", [("keep", F.min("first"))]).select("node", "keep")
    each = features.where("n_shingles > 0").groupBy("node", "doc_id", "text_hash").count().join(first, "node")
    same = F.col("text_hash").eqNullSafe(F.col("keep.text_hash")) & F.col("doc_id").eqNullSafe(F.col("keep.doc_id"))
    each = written(each.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__h"), same.alias("stays"), "count"), "decided")
    text_hash = F.xxhash64(F.col("text").cast("string"))
    found = (text_hash == F.col("__h")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__id"))
    kept = docs.join(each.where("not stays").select("__id", "__h"), found, "left_anti")
    several = each.where("stays and count > 1").select("__id", "__h")
    if several.head(1):
        once = kept.join(several, found, "left_anti")
        more = kept.join(several, found, "left_semi").withColumn("__h", text_hash).dropDuplicates(["doc_id", "__h"]).drop("__h")
        kept = once.unionByName(more)
    return kept
