"""Convolutional toxicity classifier over hashed word embeddings, trained in numpy.

A word is the sum of the embeddings of its hash and of its prefix's hash. Filters of widths 1, 2 and 3 run over the whole
text, each keeps its maximum, and a logistic layer weighs those. Embeddings start from smoothed log odds of
the buckets in the training sample, and all parts are then trained by Adagrad. Since a filter is linear in the words'
embeddings, scoring looks its products up in one table by bucket. Thresholds are calibrated on all labelled rows, at their own
share of labels, by models that haven't seen the row; for each language as told from the words. A score of ``CUT`` is the
threshold of the text's language.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import MARKS, mix64, slices, word_hashes, written

#: Labelled rows used for training at most, of either label: those with the smallest hash of their id; and bytes of text of either.
MOST_TOXIC, MOST_CLEAN, MOST_BYTES = 2000, 2500, 16 << 20
BUCKETS, DIM, FILTERS, WIDTHS, PREFIX = 1 << 18, 12, 8, (1, 2, 3), 5
EPOCHS, BATCH, RATE, FOLDS = 2, 64, 0.05, 3
CUT = 0.3
WORDS_AT_ONCE = 60_000
#: Texts of prior evidence that a bucket's log odds are shrunk by.
SHRINK = 4
#: Languages with fewer rows of either label use the threshold of all.
LEAST_ROWS = 8
#: Languages that are told apart, those with most rows in the sample; where there are more, the last of these is all others together. So a
#: model has BUCKETS * (DIM + LANGUAGES) * 4 bytes and a bit, 30 MB, at most.
LANGUAGES = 16
OTHERS = "other languages"
#: Logits of rows outside the sample are counted in steps of 1 / STEPS, up to MOST on either side.
STEPS, MOST = 64, 40


def word_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word and of its prefix, and the offsets of each text's words. Case and ASCII marks don't count."""
    words, at, prefixes = word_hashes([t.lower().encode("utf-8", "surrogatepass") for t in texts], False, MARKS, PREFIX)
    half = np.uint64(BUCKETS // 2)
    return (words % half).astype(np.int32), (half + mix64(prefixes) % half).astype(np.int32), at


def _pooled(values: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximum over each text's windows, 0 at least (also for texts without any), and which texts have windows."""
    begin, stop = at[:-1], at[1:] - width + 1
    some = np.flatnonzero(stop > begin)
    out = np.zeros((len(begin), values.shape[1]), np.float32)
    if len(some):
        edges = np.stack([begin[some], stop[some]], 1).ravel()
        padded = np.concatenate([values, np.full((max(1, edges[-1] - len(values) + 1), values.shape[1]), -1, np.float32)])
        out[some] = np.maximum(0, np.maximum.reduceat(padded, edges, axis=0)[::2])
    return out, some


@dataclass
class Model:
    embedding: np.ndarray  # BUCKETS, DIM
    filters: list[np.ndarray]  # for each width: width, DIM, FILTERS
    bias: np.ndarray  # of all filters
    weights: np.ndarray
    offset: float
    languages: list[str]
    language_odds: np.ndarray  # BUCKETS, languages
    thresholds: np.ndarray  # of each language
    scale: float = 1.0
    table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}

    def compiled(self) -> "Model":
        """With the products of every bucket with every column of every filter."""
        parts = [part for f in self.filters for part in f]
        self.table = np.empty((BUCKETS, len(parts) * FILTERS + len(self.languages)), np.float32)
        for k, part in enumerate(parts):
            self.table[:, k * FILTERS : (k + 1) * FILTERS] = self.embedding @ part
        self.table[:, len(parts) * FILTERS :] = self.language_odds
        return self

    def logits(self, word: np.ndarray, prefix: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the logit and the number of its language; some texts at a time."""
        out, first = [(np.zeros(0), np.zeros(0, np.int64))], 0
        while first < len(at) - 1:
            stop = max(first + 1, int(np.searchsorted(at, at[first] + WORDS_AT_ONCE, "right")) - 1)
            own = slice(at[first], at[stop])
            out.append(self._logits(word[own], prefix[own], at[first : stop + 1] - at[first]))
            first = stop
        return np.concatenate([z for z, _ in out]), np.concatenate([k for _, k in out])

    def _logits(self, word: np.ndarray, prefix: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.table is None:
            self.compiled()
        every = self.table[word] + self.table[prefix]
        pooled, column = [], 0
        for k, width in enumerate(WIDTHS):
            n = max(0, len(word) - width + 1)
            total = np.zeros((n, FILTERS), np.float32)
            for j in range(width):
                total += every[j : j + n, column : column + FILTERS]
                column += FILTERS
            pooled.append(_pooled(total + self.bias[k * FILTERS : (k + 1) * FILTERS], at, width)[0])
        z = np.concatenate(pooled, 1) @ self.weights + self.offset
        sums = np.concatenate([np.zeros((1, len(self.languages))), np.cumsum(every[:, column:], 0, np.float64)])
        return z, np.argmax(sums[at[1:]] - sums[at[:-1]], 1)

    def scores(self, texts: list[str]) -> np.ndarray:
        z, language = self.logits(*word_buckets(texts))
        return 1 / (1 + np.exp(-np.clip(self.scale * (z - self.thresholds[language]) + np.log(CUT / (1 - CUT)), -30, 30)))


def _log_odds(word: np.ndarray, prefix: np.ndarray, at: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Of each bucket: how much likelier it is in texts of label 1, each text counted once, shrunk for rare buckets."""
    counts = np.zeros((2, BUCKETS))
    for i in range(len(at) - 1):
        own = slice(at[i], at[i + 1])
        for buckets in (word, prefix):
            counts[label[i], np.unique(buckets[own])] += 1
    n = np.bincount(label, minlength=2)
    rate = (n[1] + 1) / (n[0] + 1)
    return np.log((counts[1] + SHRINK * rate) / (counts[0] + SHRINK) / rate)


def train(word: np.ndarray, prefix: np.ndarray, at: np.ndarray, label: np.ndarray, language: list[str | None], seed: int = 5) -> tuple[Model, np.ndarray, np.ndarray] | None:
    """None if there are not both labels. A model without thresholds, and each row's logit and language by a fold's model that hasn't seen it."""
    n = len(label)
    if n == 0 or label.min() == label.max():
        return None
    model = _trained(word, prefix, at, label, language, np.arange(n), seed)
    fold = np.random.default_rng(seed).permutation(n) % FOLDS
    if any(len(set(label[fold != k])) < 2 for k in range(FOLDS)):
        z, told = model.logits(word, prefix, at)
    else:
        z, told = np.zeros(n), np.zeros(n, np.int64)
        for k in range(FOLDS):
            part = np.flatnonzero(fold == k)
            rows = np.isin(np.repeat(np.arange(n), np.diff(at)), part)
            edges = np.concatenate([[0], np.cumsum(at[part + 1] - at[part])])
            z[part], told[part] = _trained(word, prefix, at, label, language, np.flatnonzero(fold != k), seed + k).logits(word[rows], prefix[rows], edges)
    return model, z, told


def calibrate(model: Model, z: np.ndarray, told: np.ndarray, label: np.ndarray, times: np.ndarray) -> Model:
    """Sets the threshold of each language from logits that stand for ``times`` rows each."""
    general = threshold(z, label, times)
    for k in range(len(model.languages)):
        own = told == k
        few = min(times[own & (label == v)].sum() for v in (0, 1)) < LEAST_ROWS
        model.thresholds[k] = general if few else threshold(z[own], label[own], times[own])
    return model


def _trained(word: np.ndarray, prefix: np.ndarray, at: np.ndarray, label: np.ndarray, language: list[str | None], rows: np.ndarray, seed: int) -> Model:
    """A model of some rows, without thresholds."""
    n = len(label)
    draw = np.random.default_rng(seed)

    def only(some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        picked = np.concatenate([np.arange(at[i], at[i + 1]) for i in some]) if len(some) else np.zeros(0, np.int64)
        return word[picked], prefix[picked], np.concatenate([[0], np.cumsum(at[some + 1] - at[some])])

    embedding = 0.05 * draw.standard_normal((BUCKETS, DIM), np.float32)
    embedding[:, 0] += np.clip(_log_odds(*only(rows), label[rows]), -3, 6) / 2
    filters = [draw.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, : FILTERS // 2] += 1.0
    flat, weights, offset = np.full(len(WIDTHS) * FILTERS, -0.5, np.float32), np.full(len(WIDTHS) * FILTERS, 0.1, np.float32), -1.0
    memory = [np.full_like(x, 0.01) for x in (embedding, *filters, flat, weights)]
    seen = 0.01
    balance = np.where(label == 1, (label == 0).sum() / n, (label == 1).sum() / n) * 2

    for _ in range(EPOCHS):
        order = draw.permutation(rows)
        for first in range(0, len(order), BATCH):
            some = order[first : first + BATCH]
            w, p, edges = only(some)
            x = embedding[w] + embedding[p]
            pooled, places = np.zeros((len(some), len(flat)), np.float32), np.full((len(some), len(flat)), -1)
            for k, (width, f) in enumerate(zip(WIDTHS, filters, strict=True)):
                m = len(x) - width + 1
                if m <= 0:
                    continue
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                value = sum(x[j : j + m] @ f[j] for j in range(width)) + flat[cols]
                for i in range(len(some)):
                    a, b = edges[i], edges[i + 1] - width + 1
                    if b > a:
                        top = value[a:b].argmax(0)
                        high = value[a + top, np.arange(FILTERS)]
                        pooled[i, cols] = np.maximum(high, 0)
                        places[i, cols] = np.where(high > 0, a + top, -1)
            z = pooled @ weights + offset
            error = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[some]) * balance[some] / len(some)).astype(np.float32)
            down = error[:, None] * weights
            grads = [None, *[np.zeros_like(f) for f in filters], np.zeros_like(flat), pooled.T @ error]
            touched: list[np.ndarray] = []
            pushes: list[np.ndarray] = []
            for k, (width, f) in enumerate(zip(WIDTHS, filters, strict=True)):
                i, c = np.nonzero(places[:, k * FILTERS : (k + 1) * FILTERS] >= 0)
                at_, d = places[i, k * FILTERS + c], down[i, k * FILTERS + c]
                np.add.at(grads[len(filters) + 1], k * FILTERS + c, d)
                for j in range(width):
                    np.add.at(grads[1 + k], (j, slice(None), c), d[:, None] * x[at_ + j])
                    push = d[:, None] * f[j][:, c].T
                    touched += [w[at_ + j], p[at_ + j]]
                    pushes += [push, push]
            for value, grad, past in zip((*filters, flat, weights), grads[1:], memory[1:], strict=True):
                past += grad**2
                value -= RATE * grad / np.sqrt(past)
            seen += float(error.sum()) ** 2
            offset -= RATE * float(error.sum()) / np.sqrt(seen)
            if touched:
                hit, where = np.unique(np.concatenate(touched), return_inverse=True)
                grad = np.zeros((len(hit), DIM), np.float32)
                np.add.at(grad, where, np.concatenate(pushes))
                memory[0][hit] += grad**2
                embedding[hit] -= RATE * grad / np.sqrt(memory[0][hit])

    rows_of = Counter(x for x in language if x is not None)
    known = sorted(rows_of, key=lambda x: (-rows_of[x], x))
    names = sorted(known) if len(known) <= LANGUAGES else [*sorted(known[: LANGUAGES - 1]), OTHERS]
    names, place = names or [""], {x: i for i, x in enumerate(names)}
    number = np.array([-1 if x is None else place.get(x, len(names) - 1) for x in language])
    odds = np.zeros((BUCKETS, len(names)))
    for i in rows[number[rows] >= 0]:
        np.add.at(odds[:, number[i]], word[at[i] : at[i + 1]], 1)
    odds = np.log((odds + 0.5) / (odds.sum(0) + 0.5 * BUCKETS))
    odds[BUCKETS // 2 :] = 0
    return Model(embedding, filters, flat, weights, offset, names, (odds - odds.mean(1, keepdims=True)).astype(np.float32), np.zeros(len(names)))


def threshold(z: np.ndarray, label: np.ndarray, times: np.ndarray) -> float:
    """The middle of the gap between logits at which F1 is highest; of equal ones the widest gap. A logit counts ``times``."""
    order = np.argsort(z, kind="stable")
    z, toxic, times = z[order], (label * times)[order], times[order]
    gaps = np.diff(z)
    above = toxic.sum() - np.cumsum(toxic)[:-1]  # toxic rows above the gap
    flagged = times.sum() - np.cumsum(times)[:-1]
    f1 = np.where(gaps > 0, 2 * above / (flagged + toxic.sum()), -1)
    if not len(f1) or f1.max() < 0:
        return float(z.mean())
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = best[np.argmax(gaps[best])]
    return float((z[k] + z[k + 1]) / 2)


def outside_sample(docs: DataFrame, known: DataFrame, sample: DataFrame, model: Model) -> np.ndarray:
    """Columns logit, language, label and number of rows, of the labelled texts that the model hasn't been trained on.

    Counted in steps of the logit, so what comes to the driver is bounded. Of several texts under one id the shortest counts.
    All texts that are not held out are scored, and their logits joined with the labels: no text is shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rest = known.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_anti")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, made = batch["text"].to_pylist(), [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
            for a, b in slices(texts):
                word, prefix, at = word_buckets(texts[a:b])
                made.append((np.diff(at), *sent.value.logits(word, prefix, at)))
            size, z, told = (np.concatenate(x) for x in zip(*made, strict=True))
            step = np.clip(np.rint(z * STEPS), -MOST * STEPS, MOST * STEPS)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(x.astype(np.int64)) for x in (size, step, told)]], ["doc_id", "size", "step", "told"])

    each = texts.mapInArrow(run, "doc_id long, size long, step long, told long").join(rest, "doc_id").groupBy("doc_id").agg(F.min(F.struct("size", "step", "told", "toxic")).alias("x"))
    rows = each.groupBy("x.step", "x.told", "x.toxic").count().collect()
    got = np.array([tuple(r) for r in rows], np.float64).reshape(-1, 4)
    return got / np.array([STEPS, 1, 1, 1])


def held_out(doc_id: Column) -> Column:
    """Whether the crc32 of the id as text leaves 2 by 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, toxic: int = MOST_TOXIC, clean: int = MOST_CLEAN) -> Model | None:
    """A model from docs (doc_id, text, lang) and labels (doc_id, toxic), never from held-out rows.

    Trained on at most ``toxic`` and ``clean`` ids of either label, those with the smallest hash whose texts have
    MOST_BYTES together; thresholds come from all ids. An id with labels that differ is toxic; null labels and ids
    don't count; of several texts under one id the shortest counts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("bytes")).groupBy("doc_id").agg(F.min("bytes").alias("bytes")).join(known, "doc_id")
    order = [F.xxhash64(F.lit(3), "doc_id"), "doc_id"]
    parts = [sizes.where(F.col("toxic") == v).orderBy(*order).limit(n) for v, n in ((1, toxic), (0, clean))]
    upto = F.sum("bytes").over(Window.partitionBy("toxic").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    sample = written(parts[0].unionByName(parts[1]).withColumn("upto", upto).where(F.col("upto") <= MOST_BYTES).drop("upto"), "sample")
    language = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), language.alias("lang"))
    texts = texts.join(F.broadcast(sample), "doc_id")  # toxic + clean rows at most
    texts = texts.where(F.octet_length("text") == F.col("bytes")).groupBy("doc_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("x"))
    texts = texts.select("doc_id", "toxic", "x.text", "x.lang").repartition(16, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            out = []
            for a, b in slices(texts):
                word, prefix, at = word_buckets(texts[a:b])
                out += [np.stack([word[at[i] : at[i + 1]], prefix[at[i] : at[i + 1]]]).tobytes() for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["toxic"], batch["lang"], pa.array(out, pa.binary())], ["doc_id", "toxic", "lang", "buckets"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        got = pa.Table.from_batches(held).combine_chunks()
        sizes = pa.compute.binary_length(got["buckets"]).to_numpy()
        order = np.argsort(got["doc_id"].to_numpy(), kind="stable")
        at = np.concatenate([[0], np.cumsum(sizes[order] // 8)]).astype(np.int64)
        both = np.zeros((2, at[-1]), np.int32)
        for i, k in enumerate(order):
            both[:, at[i] : at[i + 1]] = np.frombuffer(got["buckets"][int(k)].as_buffer(), np.int32).reshape(2, -1)
        label, language = got["toxic"].to_numpy()[order].astype(np.int64), got["lang"].take(pa.array(order)).to_pylist()
        made = train(both[0], both[1], at, label, language)
        if made is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((*made, label))], pa.binary())], ["model"])

    # The sample is bounded, so one task holds it; the driver gets the model alone.
    buckets = texts.mapInArrow(run, "doc_id long, toxic int, lang string, buckets binary")
    made = buckets.repartition(1).mapInArrow(learn, "model binary").toArrow()["model"]
    if not len(made):
        return None
    model, z, told, label = pickle.loads(made[0].as_buffer())
    del made
    more = outside_sample(docs, known, sample, model)
    z, told, label = (np.concatenate([x, more[:, i]]) for i, x in enumerate((z, told, label)))
    return calibrate(model, z, told, label, np.concatenate([np.ones(len(z) - len(more)), more[:, 3]]))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= CUT), from the text alone.

    A null text is empty. Without a model every score is 0. Columns of these names are replaced, others, null or repeated ids
    stay as they are. One map over the rows, without a shuffle.
    """
    rows = docs.drop("score", "predicted")
    schema = rows.schema
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 30 MB at most, see LANGUAGES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, made = [t or "" for t in batch["text"].to_pylist()], [np.zeros(0)]
            for a, b in slices(texts):
                made.append(sent.value.scores(texts[a:b]) if sent.value is not None else np.zeros(b - a))
            scores = np.concatenate(made)
            more = [pa.array(scores, pa.float64()), pa.array((scores >= CUT).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "score", "predicted"])

    from pyspark.sql import types as T

    return rows.mapInArrow(run, T.StructType([*schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
