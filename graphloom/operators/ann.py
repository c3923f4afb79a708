"""Approximate nearest neighbours: an inverted file of k-means cells with product-quantised residuals.

Cells and code books are fitted in numpy on a bounded sample (SAMPLE rows and SAMPLE_BYTES at most, by hash of the id); every row is
indexed. A row lies in the directory of its nearest cell with a code of one byte for each few dimensions, apart from its vector. A search reads the
codes of the cells nearest to the query, which are partitions of the table, keeps the best by the distance to what the codes stand
for, and ranks those again by their own vectors. How many cells are read is calibrated on the sample, so that there the share of true neighbours
found is TARGET or more: few where vectors cluster, most where they don't.

Cosine is euclidean distance of unit vectors, inner product that of vectors with one more coordinate, which makes all norms equal.
"""

from __future__ import annotations

import io
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.tables import materialize, new_table

SAMPLE, SAMPLE_BYTES = 20_000, 32 << 20
TARGET = 0.95
#: Rows of a cell, and queries, that one task compares.
CHUNK = 8192
#: Rows ranked again for each neighbour asked for.
AGAIN = 20


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the right length without nulls or infinities, and which rows they are."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    fits = pa.compute.fill_null(pa.compute.equal(pa.compute.list_value_length(column), dim), False)
    rows = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(rows)).flatten()
    out = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dim)
    good = np.isfinite(out).all(1)
    return out[good], rows[good]


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    r = np.random.default_rng(0)
    centres = x[r.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
        centres[n == 0] = x[r.integers(len(x), size=int((n == 0).sum()))]
    return centres


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1), 0.0)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([_distances(x[i : i + 4096], centres).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


@dataclass
class Model:
    metric: str
    dim: int
    top: float  # largest norm, for inner products
    centres: np.ndarray
    books: np.ndarray  # part, code, coordinates of the part
    probes: int

    def shaped(self, x: np.ndarray) -> np.ndarray:
        """Rows as they are indexed; cosine has no direction for a zero vector, which is left out before."""
        if self.metric == "cosine":
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
        if self.metric == "inner_product":
            x = np.hstack([x, np.sqrt(np.maximum(self.top**2 - (x * x).sum(1), 0.0))[:, None]])
        return x

    def asked(self, q: np.ndarray) -> np.ndarray:
        return np.hstack([q, np.zeros((len(q), 1))]) if self.metric == "inner_product" else self.shaped(q)

    def _parts(self, residual: np.ndarray) -> np.ndarray:
        width = self.books.shape[2]
        padded = np.pad(residual, ((0, 0), (0, len(self.books) * width - residual.shape[1])))
        return padded.reshape(len(residual), len(self.books), width)

    def codes(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        parts = self._parts(x - self.centres[cell])
        return np.stack([_nearest(parts[:, j], self.books[j]) for j in range(len(self.books))], 1).astype(np.uint8)

    def decoded(self, codes: np.ndarray, cell: np.ndarray) -> np.ndarray:
        residual = np.concatenate([self.books[j][codes[:, j]] for j in range(len(self.books))], 1)
        return self.centres[cell] + residual[:, : self.centres.shape[1]]

    def cells(self, q: np.ndarray) -> np.ndarray:
        """The cells to read for each query, nearest first."""
        return np.argsort(_distances(self.asked(q), self.centres), axis=1, kind="stable")[:, : self.probes]

    def exact(self, x: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Distances of raw rows from one raw query."""
        if self.metric == "l2":
            return np.sqrt(((x - q) ** 2).sum(1))
        dot = x @ q
        return -dot if self.metric == "inner_product" else 1 - dot / (np.linalg.norm(x, axis=1) * np.linalg.norm(q))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, metric=self.metric, dim=self.dim, top=self.top, centres=self.centres, books=self.books, probes=self.probes)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Model:
        z = np.load(io.BytesIO(data))
        return cls(str(z["metric"]), int(z["dim"]), float(z["top"]), z["centres"], z["books"], int(z["probes"]))


def fit(x: np.ndarray, metric: str, top: float, rows: int, k: int = 10, target: float = TARGET) -> Model:
    """Cells, code books and probes from a sample of raw vectors of a table of so many ``rows``."""
    dim = x.shape[1]
    model = Model(metric, dim, top, np.zeros((1, dim)), np.zeros((1, 1, 1)), 1)
    shaped = model.shaped(x)
    model.centres = _kmeans(shaped, max(1, min(int(math.sqrt(rows)), len(x) // 16)))
    own = _nearest(shaped, model.centres)
    width = -(-shaped.shape[1] // max(1, shaped.shape[1] // 4))
    model.books = np.zeros((-(-shaped.shape[1] // width), 1, width))
    parts = model._parts(shaped - model.centres[own])
    model.books = np.stack([_kmeans(parts[:, j], min(256, len(x))) for j in range(parts.shape[1])])
    asked = x[:: max(1, len(x) // 200)]
    nearest = np.argsort(_distances(model.asked(asked), shaped), axis=1)[:, : k + 1]
    model.probes = len(model.centres)
    order = model.cells(asked)
    place = np.argsort(order, axis=1)  # of each cell in a query's order
    needed = np.sort(np.take_along_axis(place, own[nearest], 1).ravel())
    model.probes = int(needed[min(len(needed) - 1, math.ceil(target * len(needed)) - 1)]) + 1
    return model


class VectorIndex:
    """An index of the vectors of (kind, id) rows, in a folder that all executors reach."""

    SCHEMA = "kind string, id string, vector array<float>, code binary, cell int"

    def __init__(self, spark: SparkSession, place: str) -> None:
        self.spark, self.place = spark, place
        self.model = Model.load(bytes(spark.read.parquet(f"{place}/model").first()["model"]))
        self.rows = spark.read.schema(self.SCHEMA).parquet(f"{place}/rows")

    @classmethod
    def build(cls, rows: DataFrame, field: str, metric: str = "cosine", k: int = 10, target: float = TARGET, place: str | None = None) -> VectorIndex:
        """Indexes column ``field`` of (kind, id) rows. Rows whose vector is null, of another length than most, not finite or (cosine) zero aren't in it."""
        if metric not in ("cosine", "l2", "inner_product"):
            raise QueryError(f"metric: {metric}")
        spark, place = rows.sparkSession, place or new_table(rows.sparkSession, "vectors")
        vectors = rows.select("kind", "id", F.col(field).cast("array<float>").alias("vector"))
        usual = vectors.where("size(vector) > 0").groupBy(F.size("vector").alias("dim")).count().orderBy(F.col("count").desc(), "dim").first()
        if usual is None:
            raise QueryError("there is no vector to index")
        dim = usual["dim"]
        norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
        sound = vectors.where((F.size("vector") == dim)).withColumn("norm", norm).where("norm is not null and norm < double('inf')")
        sound = sound.where("norm > 0") if metric == "cosine" else sound
        n, top = sound.agg(F.count("*"), F.max("norm")).first()
        if not n:
            raise QueryError("there is no vector to index")
        bound = min(SAMPLE, max(256, SAMPLE_BYTES // (8 * dim)))
        some = sound.select("vector", F.xxhash64("id").alias("h")).orderBy("h").limit(bound).select("vector").toArrow()
        model = fit(_matrix(some["vector"], dim)[0], metric, float(top), n, k, target)
        spark.createDataFrame([(bytearray(model.dump()),)], "model binary").coalesce(1).write.mode("overwrite").parquet(f"{place}/model")
        shared = spark.sparkContext.broadcast(model)  # at most SAMPLE / 16 centres and 256 codes a part

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value
            for batch in batches:
                raw, kept = _matrix(batch["vector"], m.dim)
                x = m.shaped(raw)
                cell = _nearest(x, m.centres)
                codes = m.codes(x, cell) if len(x) else np.zeros((0, 1), np.uint8)
                own = batch.take(pa.array(kept))
                yield pa.RecordBatch.from_arrays([own["kind"], own["id"], own["vector"], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(cell, pa.int32())], ["kind", "id", "vector", "code", "cell"])

        made = sound.select("kind", "id", "vector").mapInArrow(encode, cls.SCHEMA)
        made.hint("rebalance", "cell").write.partitionBy("cell").mode("overwrite").parquet(f"{place}/rows")
        return cls(spark, place)

    def search(self, query: Sequence[float], k: int = 10, allowed: DataFrame | None = None) -> DataFrame:
        """kind, id, distance of about the k nearest rows (ties by id, kind); of those in ``allowed`` (kind, id) where it is given."""
        m, q = self.model, np.asarray(query, float)
        if k <= 0 or len(q) != m.dim or not np.isfinite(q).all() or (m.metric == "cosine" and not q.any()):
            raise QueryError("a query is a finite vector of the index's length with a direction, k is positive")
        near = self.rows.where(F.col("cell").isin([int(c) for c in m.cells(q[None])[0]]))
        near = near.join(allowed.select("kind", "id"), ["kind", "id"], "left_semi") if allowed is not None else near
        asked, shared = m.asked(q[None]), self.spark.sparkContext.broadcast(m)

        def roughly(code: pa.Array, cell: pa.Array) -> pa.Array:
            x = shared.value.decoded(_codes(code), cell.to_numpy(zero_copy_only=False))
            return pa.array(_distances(asked, x)[0] if len(x) else [], pa.float64())

        def exactly(vector: pa.Array) -> pa.Array:
            return pa.array(shared.value.exact(_matrix(vector, shared.value.dim)[0], q), pa.float64())

        best = near.select("kind", "id", "cell", _arrow(roughly, "code", "cell").alias("rough")).orderBy("rough", "id", "kind").limit(k * AGAIN).select("kind", "id", "cell")
        again = near.join(F.broadcast(best) if k * AGAIN <= 100_000 else best, ["cell", "kind", "id"], "left_semi")
        return again.select("kind", "id", _arrow(exactly, "vector").alias("distance")).orderBy("distance", "id", "kind").limit(k)

    def search_all(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """query, kind, id, distance, rank of about the k nearest rows for each row (query, vector) of ``queries``, an id unique there.

        Cells and queries meet in blocks of CHUNK rows and CHUNK queries, so a cell or a query set of any size is many tasks."""
        shared = self.spark.sparkContext.broadcast(self.model)

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own_model = shared.value
            for batch in batches:
                raw, kept = _matrix(batch["vector"], own_model.dim)
                raw, kept = (raw[raw.any(1)], kept[raw.any(1)]) if own_model.metric == "cosine" else (raw, kept)
                cells = own_model.cells(raw) if len(raw) else np.zeros((0, 1), int)
                own = batch.take(pa.array(np.repeat(kept, cells.shape[1])))
                yield pa.RecordBatch.from_arrays([own["query"], own["vector"], pa.array(cells.ravel(), pa.int32())], ["query", "vector", "cell"])

        asked = materialize(queries.select(F.col("query").cast("string").alias("query"), F.col("vector").cast("array<float>").alias("vector")).mapInArrow(probe, "query string, vector array<float>, cell int"), "probes")
        blocks = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias(name))  # noqa: E731  one row a cell
        sizes = materialize(blocks(self.rows, "row_blocks").join(blocks(asked, "query_blocks"), "cell"), "cells")
        part = lambda of, n: F.pmod(F.xxhash64(*of), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = self.rows.select("kind", "id", "code", "cell").join(F.broadcast(sizes), "cell").select("kind", "id", "code", "cell", part(["kind", "id"], "row_blocks").alias("rb"), every("query_blocks").alias("qb"))
        right = asked.join(F.broadcast(sizes), "cell").select("query", "vector", "cell", part(["query"], "query_blocks").alias("qb"), every("row_blocks").alias("rb"))
        keys = ["cell", "rb", "qb"]

        def compare(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            return roughly_nearest(shared.value, rows, asked, k * AGAIN)

        rough = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "query string, kind string, id string, cell int, rough double")
        best = rough.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("rough", "id", "kind"))).where(F.col("n") <= k * AGAIN).select("query", "kind", "id", "cell")
        met = best.join(self.rows.select("cell", "kind", "id", "vector"), ["cell", "kind", "id"])
        raw = asked.select("query", F.col("vector").alias("asked")).dropDuplicates(["query"])
        met = met.join(raw, "query").select("query", "kind", "id", _arrow(self._pairwise(shared), "vector", "asked").alias("distance"))
        order = Window.partitionBy("query").orderBy("distance", "id", "kind")
        return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    @staticmethod
    def _pairwise(shared) -> Callable[[pa.Array, pa.Array], pa.Array]:
        def pairwise(vector: pa.Array, asked: pa.Array) -> pa.Array:
            m = shared.value
            return pa.array(row_distances(_matrix(vector, m.dim)[0], _matrix(asked, m.dim)[0], m.metric), pa.float64())

        return pairwise


def roughly_nearest(own: Model, rows: pd.DataFrame, asked: pd.DataFrame, most: int) -> pd.DataFrame:
    """query, kind, id, cell, rough: for each query the rows of a cell that their codes put nearest. They stay in columns, since tuples take far more."""
    if not len(rows) or not len(asked):
        return pd.DataFrame(columns=["query", "kind", "id", "cell", "rough"])
    x = own.decoded(np.stack([np.frombuffer(c, np.uint8) for c in rows["code"]]), rows["cell"].to_numpy())
    q = own.asked(np.stack([np.asarray(v, float) for v in asked["vector"]]))
    kinds, ids, names = rows["kind"].to_numpy(), rows["id"].to_numpy(), asked["query"].to_numpy()
    cell, n, out = int(rows["cell"].iloc[0]), min(most, len(x)), []
    for i in range(0, len(q), 512):
        d = _distances(q[i : i + 512], x)
        at = np.argpartition(d, n - 1, axis=1)[:, :n]
        best = at.ravel()
        out.append(pd.DataFrame({"query": names[i : i + 512].repeat(n), "kind": kinds[best], "id": ids[best], "cell": cell, "rough": np.take_along_axis(d, at, 1).ravel()}))
    return pd.concat(out, ignore_index=True)


def row_distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return np.sqrt(((a - b) ** 2).sum(1))
    dot = (a * b).sum(1)
    return -dot if metric == "inner_product" else 1 - dot / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))


def _codes(column: pa.Array) -> np.ndarray:
    found = column.to_pylist()
    return np.frombuffer(b"".join(found), np.uint8).reshape(len(found), -1) if found else np.zeros((0, 1), np.uint8)


def _arrow(fn: Callable, *columns: str):
    fn.__annotations__ = dict.fromkeys(fn.__code__.co_varnames[: len(columns)], pa.Array) | {"return": pa.Array}
    return F.arrow_udf(fn, "double")(*[F.col(c) for c in columns])


def nearest_to_each(rows: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine") -> DataFrame:
    """query, kind, id, distance, rank: the k nearest rows (kind, id, vector) for each of ``queries`` (query, vector), exactly. Every query meets every row, in blocks of
    CHUNK rows and CHUNK queries; rows with another length, without a direction or with nulls have no distance."""
    clean = lambda df, *own: df.select(*own, F.col("vector").cast("array<float>").alias("vector")).where("size(vector) > 0 and forall(vector, v -> v is not null and abs(v) < double('inf'))")
    left, right = clean(rows, "kind", "id"), clean(queries, F.col("query").cast("string").alias("query"))
    n, m = ((max(1, -(-df.count() // CHUNK))) for df in (left, right))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = left.select("*", F.pmod(F.xxhash64("kind", "id"), F.lit(n)).cast("int").alias("rb"), every(m).alias("qb"))
    right = right.select("*", F.pmod(F.xxhash64("query"), F.lit(m)).cast("int").alias("qb"), every(n).alias("rb"))

    def compare(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for dim, some in own.groupby(own["vector"].map(len)):
            x = np.stack([np.asarray(v, float) for v in some["vector"]])
            for name, v in zip(asked["query"], asked["vector"], strict=True):
                if len(v) != dim:
                    continue
                with np.errstate(invalid="ignore", divide="ignore"):
                    d = row_distances(x, np.asarray(v, float)[None], metric)
                good = np.flatnonzero(np.isfinite(d))
                least = np.partition(d[good], k - 1)[k - 1] if len(good) > k else np.inf
                out += [(name, some["kind"].iloc[b], some["id"].iloc[b], float(d[b])) for b in good if d[b] <= least]
        return pd.DataFrame(out, columns=["query", "kind", "id", "distance"])

    found = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInPandas(compare, "query string, kind string, id string, distance double")
    order = Window.partitionBy("query").orderBy("distance", "id", "kind")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
