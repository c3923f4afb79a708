"""Language identification of mixed-language text.

The script of a word (from ranges of its first letter) leaves the languages that use that script; each has a score for the word,
from counts of the word itself or, for words too rare, of its character n-grams. Viterbi over a text's words, with a
penalty for every switch, labels spans; the language with most letters is the text's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import mix64, slices
from .toxicity import held_out

#: Texts of a language that are learned from, about (chosen by hash of the id), languages, words kept of each, and of all.
TEXTS, LANGUAGES, WORDS, VOCABULARY = 3000, 2000, 40_000, 1_000_000
#: Cost of a switch, most a word can say for or against a language, counts below which n-grams speak.
SWITCH, MOST, KNOWN = 6.0, 4.0, 3
GRAM_BUCKETS = 1 << 15
#: Spellings whose scores a worker keeps before it starts afresh.
KEPT = 300_000


_RUN = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters. The pattern's runs may also hold numbers that are no decimal digits (such as one half); those are parted there."""
    found = _RUN.findall(text)
    if all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]


#: First and last code point of the letters of each script; fixed values of Unicode.
SCRIPTS = [
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x400, 0x52F),
    ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("arabic", 0x750, 0x77F), ("devanagari", 0x900, 0x97F),
    ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0xAC00, 0xD7AF),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("han", 0x20000, 0x2FA1F), ("syriac", 0x700, 0x74F), ("thaana", 0x780, 0x7BF),
    ("nko", 0x7C0, 0x7FF), ("gurmukhi", 0xA00, 0xA7F), ("gujarati", 0xA80, 0xAFF), ("oriya", 0xB00, 0xB7F), ("telugu", 0xC00, 0xC7F),
    ("kannada", 0xC80, 0xCFF), ("malayalam", 0xD00, 0xD7F), ("sinhala", 0xD80, 0xDFF), ("lao", 0xE80, 0xEFF), ("tibetan", 0xF00, 0xFFF),
    ("myanmar", 0x1000, 0x109F), ("hangul", 0x1100, 0x11FF), ("ethiopic", 0x1200, 0x139F), ("cherokee", 0x13A0, 0x13FF),
    ("khmer", 0x1780, 0x17FF), ("mongolian", 0x1800, 0x18AF), ("georgian", 0x1C90, 0x1CBF), ("georgian", 0x2D00, 0x2D2F), ("latin", 0xA720, 0xA7FF),
]


def script(letter: str) -> str:
    point = ord(letter)
    return next((name for name, a, b in SCRIPTS if a <= point <= b), "other")


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of 2 to 4 characters of each word between marks, and the number of the word of each; by n, then word."""
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner, stop = np.repeat(np.arange(len(words)), size), np.repeat(np.cumsum(size), size)
    place, h = np.arange(len(points)), points.copy()
    buckets, owners = [], []
    for n in (2, 3, 4):
        h = h[:-1] * np.uint64(0x100000001B3) + points[n - 1 :] if len(h) > 1 else h[:0]
        fits = place[: len(h)] + n <= stop[: len(h)]
        buckets.append((mix64(h[fits] + np.uint64(n)) % np.uint64(GRAM_BUCKETS)).astype(np.int64))
        owners.append(owner[: len(h)][fits])
    return np.concatenate(buckets), np.concatenate(owners)


def hashes_of(words: list[str]) -> np.ndarray:
    """A 64-bit hash of each word, from its code points."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(size) - size
    power = np.cumprod(np.full(int(size.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64))
    total = np.add.reduceat(mix64(points + np.uint64(1)) * power[np.arange(len(points)) - np.repeat(begin, size)], begin) if len(words) else np.zeros(0, np.uint64)
    return mix64(total + size.astype(np.uint64))


@dataclass
class Words:
    """What known words say for each language: ``away`` for languages that a word has no entry of its own for."""

    hashes: np.ndarray  # ascending
    away: np.ndarray
    first: np.ndarray  # of each word, and the end: its entries
    language: np.ndarray
    value: np.ndarray

    def fill(self, words: list[str], out: np.ndarray) -> None:
        """Rows of ``out`` for the words known."""
        if not len(self.hashes):
            return
        wanted = hashes_of(words)
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        rows = np.flatnonzero(self.hashes[at] == wanted)
        at = at[rows]
        out[rows] = self.away[at][:, None]
        size = self.first[at + 1] - self.first[at]
        entry = np.arange(size.sum()) + np.repeat(self.first[at] - (np.cumsum(size) - size), size)
        out[np.repeat(rows, size), self.language[entry]] = self.value[entry]


@dataclass
class Model:
    languages: list[str]
    words: Words
    grams: np.ndarray  # GRAM_BUCKETS, languages
    uses: dict[str, list[int]]  # languages by script
    known: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "table": None}

    def evidence(self, words: list[str]) -> np.ndarray:
        """Score of each language for each word, those of other scripts far behind."""
        buckets, owner = grams_of(words)
        wide = len(self.languages)
        sums = np.stack([np.bincount(owner, self.grams[buckets, k], len(words)) for k in range(wide)], 1)
        size = np.array([len(w) for w in words])
        out = np.clip(sums / np.bincount(owner, minlength=len(words))[:, None] * np.sqrt(size)[:, None], -MOST, MOST).astype(np.float32)
        self.words.fill(words, out)
        for i, w in enumerate(words):
            fits = self.uses.get(script(w[0]))
            if fits and len(fits) < wide:
                away = np.ones(wide, bool)
                away[fits] = False
                out[i, away] = -10 * MOST
        return out

    def learn(self, words: list[str]) -> None:
        fresh, n = list(dict.fromkeys(words)), len(self.known)
        if self.table is None or len(self.table) < n + len(fresh):
            larger = np.zeros((2 * (n + len(fresh)), len(self.languages)), np.float32)
            larger[:n] = self.table[:n] if self.table is not None else 0
            self.table = larger
        self.table[n : n + len(fresh)] = self.evidence(fresh)
        self.known.update(zip(fresh, range(n, n + len(fresh)), strict=True))

    def labels(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The language number of every word of all texts, its letters, the offsets of each text's words."""
        if len(self.known) > KEPT:
            self.known.clear()
        found = [words_of(t.lower()) for t in texts]
        at = np.concatenate([[0], np.cumsum([len(w) for w in found])]).astype(np.int64)
        every = [w for ws in found for w in ws]
        letters = np.fromiter(map(len, every), np.int64, len(every))
        rows = list(map(self.known.get, every))
        if None in rows:
            self.learn([w for w, r in zip(every, rows, strict=True) if r is None])
            rows = list(map(self.known.get, every))
        scores = self.table[np.array(rows, np.int64)] if rows else np.zeros((0, len(self.languages)), np.float32)
        return viterbi(scores, at), letters, at


def viterbi(scores: np.ndarray, at: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of each row: sum of scores less ``switch`` for each change within a text. Ties: the smaller label.

    If no other label gains more than half a switch on the text's best one in any stretch, that one is best throughout (each
    stretch given to others needs a switch); only other texts are searched, all of a batch at once, step by step.
    """
    n, count = len(scores), len(at) - 1
    out = np.zeros(n, np.int32)
    if not n:
        return out
    wide = scores
    sums = np.zeros((n + 1, wide.shape[1]))
    np.cumsum(wide, 0, np.float64, sums[1:])
    best = np.argmax(sums[at[1:]] - sums[at[:-1]], 1)
    size = np.diff(at)
    owner = np.repeat(np.arange(count), size)
    mine = best[owner]
    out[:] = mine
    # Gains up to each row, less an offset that keeps a minimum from coming out of the text before.
    run = sums
    run -= np.concatenate([[0.0], np.cumsum(wide[np.arange(n), mine], dtype=np.float64)])[:, None]
    step = 2 * (float(np.abs(run).max()) + switch + 1)
    before = run[:-1] - (owner * step)[:, None]
    np.minimum.accumulate(before, 0, out=before)
    run[1:] -= (owner * step)[:, None]
    open_ = np.bincount(owner[((run[1:] - before).max(1)) > switch / 2], minlength=count) > 0
    some = np.flatnonzero(open_)
    if not len(some):
        return out
    some = some[np.argsort(-size[some], kind="stable")]
    lengths, begin = size[some], at[some]
    value = wide[begin].astype(np.float64)
    stays: list[np.ndarray] = []
    for t in range(1, int(lengths[0])):
        k = int(np.searchsorted(-lengths, -t, "left"))  # texts longer than t
        v = value[:k]
        top = v.argmax(1)
        moved = v[np.arange(k), top][:, None] - switch
        stay = v >= moved
        stays.append(np.where(stay, np.arange(v.shape[1]), top[:, None]).astype(np.int16))
        value[:k] = np.where(stay, v, moved) + wide[begin[:k] + t]
    now = value.argmax(1).astype(np.int32)
    for t in range(int(lengths[0]) - 1, 0, -1):
        k = len(stays[t - 1])
        out[begin[:k] + t] = now[:k]
        now[:k] = stays[t - 1][np.arange(k), now[:k]]
    out[begin] = now
    return out


def fit(docs: DataFrame, texts: int = TEXTS) -> Model | None:
    """A model of docs (doc_id, text, lang): rows with a language and an id whose crc32 doesn't leave 2 by 4.

    Of each language about ``texts`` rows, chosen by hash of their id, and of their words the WORDS most frequent ones (fewer,
    if there are so many languages that all would be more than VOCABULARY); the model's size is bounded by these. None
    if no such row has a word. More than LANGUAGES languages are refused: labels are 16-bit numbers while spans are searched.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where("id is not null and lang is not null and text is not null").where(~held_out(F.col("id")))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, texts / n))])
    part = F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(1 << 20)) / float(1 << 20)
    some = rows.where(part < F.element_at(share, F.col("lang")))
    words = some.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+)"), F.lit(1))).alias("word")).groupBy("lang", "word").count()
    most = min(WORDS, VOCABULARY // len(counts))
    top = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("count").desc(), "word"))
    table = words.withColumn("r", top).where(F.col("r") <= most).drop("r").toArrow()  # VOCABULARY rows at most
    spelled, said, often = (table[c].to_pylist() for c in ("word", "lang", "count"))
    fits = [i for i, w in enumerate(spelled) if w.isalpha()]
    if not fits:
        return None
    names = sorted(counts)
    number = {x: i for i, x in enumerate(names)}
    spelled, language = [spelled[i] for i in fits], np.array([number[said[i]] for i in fits])
    often, wide = np.array([often[i] for i in fits], np.float64), len(names)
    grams, total, scripts = np.zeros(GRAM_BUCKETS * wide), np.bincount(language, often, wide) + 1, {}
    for a in range(0, len(spelled), 50_000):
        own = slice(a, a + 50_000)
        buckets, owner = grams_of(spelled[own])
        np.add.at(grams, buckets * wide + language[own][owner], np.sqrt(often[own])[owner])
    grams = grams.reshape(-1, wide)
    for w, k, n in zip(spelled, language.tolist(), often.tolist(), strict=True):
        scripts.setdefault(script(w[0]), np.zeros(wide))[k] += n

    logs = np.log(grams / np.maximum(grams.sum(0), 1) * grams.sum() / wide + 1.0)
    log_grams = (logs - logs.mean(-1, keepdims=True)).astype(np.float32)
    # Of a word: the logarithm of its count in each language, smoothed, less their mean.
    hashed, which = np.unique(hashes_of(spelled), return_inverse=True)
    order = np.argsort(which, kind="stable")
    which, language, often = which[order], language[order], often[order]
    kept = np.bincount(which, often) >= KNOWN
    value, none = np.log(often * (total.mean() / total)[language] + 0.5), np.log(0.5)
    mean = (np.bincount(which, value) + none * (wide - np.bincount(which))) / wide
    entry = kept[which]
    first = np.concatenate([[0], np.cumsum(np.bincount(which)[kept])])
    known = Words(
        hashed[kept], np.clip(none - mean[kept], -MOST, MOST).astype(np.float32), first,
        language[entry].astype(np.int32), np.clip(value - mean[which], -MOST, MOST)[entry].astype(np.float32),
    )
    uses = {s: [i for i in range(len(names)) if n[i] >= 0.01 * total[i]] for s, n in scripts.items()}
    return Model(names, known, log_grams, {s: x for s, x in uses.items() if x})


def identify(docs: DataFrame, model: Model | None, spans: bool = False) -> DataFrame:
    """``docs`` with lang_pred, score and n_spans, and with spans (language, words: count, letters) if asked for.

    ``und`` with score 0 and no span for a null text, one without a letter, or without a model. The score is the share of
    letters in words labelled with the language; of languages with as many letters the first by code point is told. Ids, sources and languages given aren't looked at; columns of
    these names are replaced. One map over the rows, without a shuffle.
    """
    rows = docs.drop("lang_pred", "score", "n_spans", "spans")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # VOCABULARY words at most, 20 bytes or so each, and the n-gram table
    kind = "array<struct<lang: string, words: long, letters: long>>"
    span_type = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64()), ("letters", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value  # one object in a worker, with what it has learned of spellings
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            pred, score, number, listed = [], [], [], []
            for a, b in slices(texts, 1 << 21):  # type: ignore[arg-type]
                if own is None:
                    pred += ["und"] * (b - a)
                    score += [0.0] * (b - a)
                    number += [0] * (b - a)
                    listed += [[]] * (b - a)
                    continue
                label, letters, at = own.labels(texts[a:b])
                width, doc = len(own.languages), np.repeat(np.arange(b - a), np.diff(at))
                held = np.bincount(doc * width + label, letters, (b - a) * width).reshape(-1, width)
                top, total = held.argmax(1), held.sum(1)
                change = np.concatenate([[True], (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])]) if len(label) else np.zeros(0, bool)
                number += np.bincount(doc[change], minlength=b - a).tolist()
                pred += [own.languages[k] if t else "und" for k, t in zip(top, total, strict=True)]
                score += [float(held[i, k] / total[i]) if total[i] else 0.0 for i, k in enumerate(top)]
                if spans:
                    first = np.flatnonzero(change)
                    many, long = np.diff(np.append(first, len(label))), np.add.reduceat(letters, first) if len(first) else first
                    mine: list[list] = [[] for _ in range(b - a)]
                    for f, m, n in zip(first, many, long, strict=True):
                        mine[doc[f]].append({"lang": own.languages[label[f]], "words": int(m), "letters": int(n)})
                    listed += mine
            more = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(number, pa.int64())]
            names = ["lang_pred", "score", "n_spans"]
            if spans:
                more, names = [*more, pa.array(listed, span_type)], [*names, "spans"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *names])

    extra = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_spans", T.LongType())]
    if spans:
        extra.append(T.StructField("spans", T._parse_datatype_string(kind)))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *extra]))

