"""Vector, full-text and fused search.

Distances are computed on Arrow batches as numpy matrices. Full text: see ``fulltext``.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import QueryError, TemporalError
from ..functions.predicates import Predicate, Ref, Search
from ..store import GraphStore
from . import ann
from . import fulltext as ft

METRICS = ("cosine", "l2", "inner_product")


# Vectors
def distance(vector: Column, query: Sequence[float], metric: str) -> Column:
    """Distance of a vector column from a query; null where lengths differ, values are null or cosine has no direction.

    Arrow batches: the values of a batch are one numpy matrix, so a row costs one pass over its numbers.
    """
    if metric not in METRICS:
        raise QueryError(f"metric: {metric}")
    if not query or not all(math.isfinite(x) for x in query):
        raise QueryError("a query vector has finite numbers")
    asked = [float(x) for x in query]

    def batch(v: pa.Array) -> pa.Array:
        q = np.array(asked)
        v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
        sizes = pa.compute.list_value_length(v).fill_null(-1).to_numpy(zero_copy_only=False)
        values = v.flatten()
        bad = np.zeros(len(v), bool)
        if values.null_count:
            at = np.repeat(np.arange(len(v)), np.maximum(sizes, 0))
            bad[at[np.asarray(values.is_null())]] = True
        flat = values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
        fits, out = (sizes == len(q)) & ~bad, np.full(len(v), np.nan)
        begin = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))[:-1]]) if len(v) else np.zeros(0, np.int64)
        rows = np.flatnonzero(fits)
        if len(rows):
            m = flat[begin[rows][:, None] + np.arange(len(q))]
            if metric == "l2":
                out[rows] = np.sqrt(((m - q) ** 2).sum(1))
            else:
                dot = m @ q
                with np.errstate(invalid="ignore", divide="ignore"):
                    out[rows] = -dot if metric == "inner_product" else 1 - dot / (np.sqrt((m * m).sum(1)) * math.sqrt((q * q).sum()))
        return pa.array(out, pa.float64(), mask=~np.isfinite(out))

    batch.__annotations__ = {"v": pa.Array, "return": pa.Array}
    return F.arrow_udf(batch, "double")(vector)


def vector_score(d: Column, metric: str) -> Column:
    return 1 - d if metric == "cosine" else d


def nearest(rows: DataFrame, field: str, query: Sequence[float], k: int, metric: str = "cosine", min_score: float | None = None, offset: int = 0) -> DataFrame:
    """The k nearest rows with distance, score and ord (1 is nearest; ties by id, kind)."""
    if k <= 0:
        raise QueryError("k is positive")
    if metric == "cosine" and min_score is not None and abs(min_score) > 1:
        raise QueryError("cosine scores are between -1 and 1")
    found = rows.withColumn("distance", distance(F.col(f"p__{field}"), query, metric)).where("distance is not null")
    if min_score is not None:
        found = found.where(F.col("distance") <= (1 - min_score if metric == "cosine" else min_score if metric == "l2" else -min_score))
    order = [F.col("distance").asc(), F.col("id").asc(), F.col("kind").asc()]
    top = found.orderBy(*order).offset(offset).limit(k) if offset else found.orderBy(*order).limit(k)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))  # k rows
    return top.withColumn("score", vector_score(F.col("distance"), metric)).withColumn("ord", rank)


# Full text
def matching(rows: DataFrame, fields: Sequence[str], query: str, k: int, mode: str = "websearch", min_score: float | None = None, corpus: DataFrame | None = None, offset: int = 0, language: str = "simple") -> DataFrame:
    """The k rows that match best, with score (BM25 of the query's words) and ord (ties by id, kind), by a scan of the texts.

    Word statistics are those of ``corpus`` (by default of ``rows``): one pass, for the query's words only. For searches within a query's own
    candidates; searches over a kind read its index where there is one.
    """
    if k <= 0:
        raise QueryError("k is positive")
    e = ft.parse(query, mode, language)
    terms = ft.terms_of(e, False)
    with_tokens = lambda df: df.withColumn("__tokens", ft.tokens(ft.content(df, fields), language)).withColumn("__size", F.size("__tokens")).where("__size > 0")
    phrase = ft.in_tokens(F.col("__tokens"))
    counted = with_tokens(corpus if corpus is not None else rows).agg(F.count("*").alias("n"), F.avg("__size").alias("size"), *[F.sum(phrase((t,)).cast("long")).alias(f"d{i}") for i, t in enumerate(terms)])
    stats = counted.first()
    near = rows
    if language == "simple" and not ft.of_nothing(e):  # a row without any of the words can't match: that is seen before it is cut into words
        line = F.translate(F.lower(ft.content(rows, fields)), *ft._ACCENTS)
        near = rows.where(functools.reduce(lambda a, b: a | b, [line.contains(t.word) for t in ft.terms_of(e)])) if ft.terms_of(e) else rows.limit(0)
    found = with_tokens(near).where(ft.holds(e, phrase))
    parts = [F.lit(0.0)]
    for i, t in enumerate(terms):
        tf = F.size(F.filter("__tokens", t.matches)).cast("double")
        parts.append(F.lit(ft.idf(stats["n"], stats[f"d{i}"] or 0)) * ft.weight(tf, F.col("__size"), stats["size"]))
    found = found.withColumn("score", ft.total(parts))
    if min_score is not None:
        found = found.where(F.col("score") >= min_score)
    order = [F.col("score").desc(), F.col("id").asc(), F.col("kind").asc()]
    top = found.orderBy(*order).offset(offset).limit(k) if offset else found.orderBy(*order).limit(k)
    return top.withColumn("ord", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))).drop("__tokens", "__size")


def snippet(text: Column, query: str, mode: str = "websearch", width: int = 60, language: str = "simple") -> Column:
    """The text around the first word of the query that it has, words of the query in <mark>. Of stemmed words, those that begin with the stem."""
    terms = ft.terms_of(ft.parse(query, mode, language), False)
    if not terms:
        return F.substring(text, 1, 2 * width)
    open_end = lambda t: t.prefix or language != "simple"
    either = "|".join(re.escape(t.word) + (r"[\p{L}\p{N}]*" if open_end(t) else "") for t in terms)
    pattern = rf"(?iu)(?<![\p{{L}}\p{{N}}])({either})(?![\p{{L}}\p{{N}}])"
    around = F.regexp_extract(text, rf"(?s)(.{{0,{width}}}{pattern}.{{0,{width}}})", 1)
    return F.regexp_replace(around, pattern, "<mark>$1</mark>")


def ranked_ids(store: GraphStore, kinds: list[str], candidates: DataFrame, s: Search) -> DataFrame:
    """kind, id, score, ord of a search predicate within a query."""
    if s.kind == "vector":
        metric = s.metric or next((store.graph.node(k).embeddings[s.field] for k in kinds if s.field in store.graph.node(k).embeddings), "cosine")
        declared = [k for k in kinds if s.field in store.graph.node(k).embeddings]
        if not declared:
            raise QueryError(f"{s.field} is no embedding")
        return nearest(candidates.where(F.col("kind").isin(declared)), s.field, s.query, s.k, metric, s.min_score)
    fields = list(dict.fromkeys(f for k in kinds for f in store.graph.node(k).searchable))
    if not fields:
        raise QueryError(f"{kinds} have no searchable property")
    language = s.language or store.graph.node(next(k for k in kinds if store.graph.node(k).searchable)).language
    return matching(candidates, fields, s.query, s.k, s.mode, s.min_score, language=language)


class StoreSearch:
    """Searches over a kind (and its subclasses if asked for)."""

    def __init__(self, store: GraphStore) -> None:
        self.store = store

    def _rows(self, kind: str, sub_classes: bool, where: Callable[[Ref], Predicate] | None) -> DataFrame:
        if self.store.coordinate.recorded is not None:
            raise TemporalError("searches don't read recorded time")
        return self.store.find(kind, where, sub_classes=sub_classes)

    def vector(self, kind: str, field: str, query: Sequence[float], limit: int = 10, metric: str | None = None, min_score: float | None = None, where: Any = None, offset: int = 0, sub_classes: bool = False, approximate: bool = False) -> DataFrame:
        """The nearest rows with distance, score and ord. ``approximate``: from the kind's index, in its own metric."""
        declared = self.store.graph.node(kind).embeddings.get(field)
        if (metric or declared) is None:
            raise QueryError(f"{kind}.{field} is no embedding")
        if approximate:
            if sub_classes or metric not in (None, declared):
                raise QueryError("an index has the vectors of one kind, in its own metric")
            rows = self._rows(kind, False, where)
            top = self.vectors(kind, field).search(query, limit + offset, rows if where else None)
            near = rows.join(F.broadcast(top.drop("distance")) if limit + offset <= 10_000 else top.drop("distance"), ["kind", "id"], "left_semi")
            return nearest(near.select(*rows.columns), field, query, limit, declared, min_score, offset)
        metric = metric or declared
        return nearest(self._rows(kind, sub_classes, where), field, query, limit, metric, min_score, offset)

    def build_vectors(self, kind: str, field: str, target: float = ann.TARGET, place: str | None = None) -> ann.VectorIndex:
        """Indexes a kind's embeddings as this store's coordinate sees them, for ``vector(..., approximate=True)`` and ``neighbours``."""
        metric = self.store.graph.node(kind).embeddings.get(field)
        if metric is None:
            raise QueryError(f"{kind}.{field} is no embedding")
        index = ann.VectorIndex.build(self._rows(kind, False, None), f"p__{field}", metric, target=target, place=place)
        self.store.indexes[kind, field, self.store.coordinate] = index
        return index

    def vectors(self, kind: str, field: str) -> ann.VectorIndex:
        """The index of a kind's embeddings, built unless there is one."""
        return self.store.indexes.get((kind, field, self.store.coordinate)) or self.build_vectors(kind, field)

    def fulltext(self, kind: str, query: str, limit: int = 10, mode: str = "websearch", min_score: float | None = None, snippets: bool = False, where: Any = None, offset: int = 0, sub_classes: bool = False, language: str | None = None) -> DataFrame:
        """Rows with score and ord. Reads the index of the kind where ``rebuild_fulltext`` has made one for this store's coordinate and the language; else the
        texts are scanned. Both give the same scores."""
        fields, language = self.store.graph.node(kind).searchable, language or self.store.graph.node(kind).language
        if not fields:
            raise QueryError(f"{kind} has no searchable property")
        if limit <= 0:
            raise QueryError("k is positive")
        rows = self._rows(kind, sub_classes, where)
        index = None if sub_classes else self.store.indexes.get((kind, language, self.store.coordinate))
        if index is None:
            out = matching(rows, fields, query, limit, mode, min_score, self._rows(kind, sub_classes, None), offset, language)
        else:
            top = index.search(ft.parse(query, mode, language), limit, min_score, rows if where else None, offset)
            order = [F.col("score").desc(), F.col("id").asc(), F.col("kind").asc()]
            top = top.withColumn("ord", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))  # as many rows as asked for
            out = rows.join(F.broadcast(top) if limit <= 10_000 else top, ["kind", "id"]).select(*rows.columns, "score", "ord").orderBy("ord")
        return out.withColumn("snippet", snippet(ft.content(out, fields), query, mode, language=language)) if snippets else out

    def hybrid(self, kind: str, field: str, vector: Sequence[float], text: str, limit: int = 10, k: int = 60, vector_weight: float = 1.0, fulltext_weight: float = 1.0, per_source: int | None = None, where: Any = None, offset: int = 0, mode: str = "websearch") -> DataFrame:
        """kind, id, score: sum of weight / (k + rank) over both searches (ties by kind, id)."""
        return fuse(
            self.vector(kind, field, vector, per_source or (limit + offset) * 4, where=where), self.fulltext(kind, text, per_source or (limit + offset) * 4, mode, where=where),
            limit, k, vector_weight, fulltext_weight, offset,
        )

    def rebuild_fulltext(self, kind: str, language: str | None = None, place: str | None = None) -> ft.FulltextIndex:
        """Indexes the kind's texts as this store's coordinate sees them; searches of this store and its views at the same coordinate read the index. ``place``: a
        folder to keep it in, for ``open_fulltext``; by default it goes with the application."""
        node = self.store.graph.node(kind)
        if not node.searchable:
            raise QueryError(f"{kind} has no searchable property")
        index = ft.FulltextIndex.build(self._rows(kind, False, None), node.searchable, language or node.language, place)
        self.store.indexes[kind, index.language, self.store.coordinate] = index
        return index

    def open_fulltext(self, kind: str, place: str) -> ft.FulltextIndex:
        """An index that ``rebuild_fulltext`` has left in a folder. It must be of these rows."""
        index = ft.FulltextIndex(self.store.spark, place)
        self.store.indexes[kind, index.language, self.store.coordinate] = index
        return index

    def ensure_fulltext(self, kind: str, language: str | None = None) -> StoreSearch:
        """Builds the index unless there is one."""
        if (kind, language or self.store.graph.node(kind).language, self.store.coordinate) not in self.store.indexes:
            self.rebuild_fulltext(kind, language)
        return self

    def reembed(self, kind: str, field: str, embed: Callable[[Any], Any]) -> DataFrame:
        """The kind's frame with the field made again: ``embed`` takes pandas strings and returns pandas lists of floats."""
        rows = self._rows(kind, False, None)
        made = F.pandas_udf(embed, "array<float>")
        return rows.withColumn(f"p__{field}", made(ft.content(rows, self.store.graph.node(kind).searchable)))


def fuse(one: DataFrame, two: DataFrame, limit: int, k: int = 60, one_weight: float = 1.0, two_weight: float = 1.0, offset: int = 0) -> DataFrame:
    """Reciprocal rank fusion of two rankings (kind, id, ord)."""
    a = one.select("kind", "id", F.col("ord").alias("o1"))
    b = two.select("kind", "id", F.col("ord").alias("o2"))
    part = lambda w, o: F.coalesce(F.lit(float(w)) / (F.lit(k) + F.col(o)), F.lit(0.0))
    both = a.join(b, ["kind", "id"], "full").select("kind", "id", (part(one_weight, "o1") + part(two_weight, "o2")).alias("score"))
    return both.orderBy(F.col("score").desc(), "kind", "id").offset(offset).limit(limit)
