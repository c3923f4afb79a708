"""Full text: analysers, query syntax, and an inverted index kept as tables.

An index has three tables. ``postings``: term, document, its size, how often and where the term is in it; directories by the hash of a
term's first two characters, sorted by term, so that a query reads the directories and row groups of its own words, also
of words given by their beginning. ``terms``: the dictionary in order, with document counts. ``blocks``: for terms that many documents have, the
largest weight that the term reaches in each block of documents; blocks hold documents of about one size. A query
for the k best takes the blocks with the largest bounds first and then reads no block whose bound is below the k-th score found there.

Ranks are BM25 (K1, B); scores aren't those of any database.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.tables import new_table

K1, B = 1.2, 0.75
MODES = ("plain", "phrase", "websearch", "raw")
LANGUAGES = ("simple", "english")
BUCKETS = 64
#: Documents a term must be in to have block maxima.
COMMON = 1000
#: Postings of a query from which blocks are pruned; below, one pass reads them all.
PRUNE_FROM = 1_000_000
_ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


# Stemming: Porter's rules. Suffixes and what replaces them.
_STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP_4 = dict.fromkeys(("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"), "")


def _shape(word: str) -> str:
    """v for each vowel and c for each consonant; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _short_end(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replace(word: str, rules: dict[str, str], above: int) -> str:
    ends = [s for s in rules if word.endswith(s)]
    if ends:
        suffix = max(ends, key=len)
        stem = word[: len(word) - len(suffix)]
        if _measure(stem) > above and (suffix != "ion" or stem[-1] in "st"):
            return stem + rules[suffix]
    return word


@functools.lru_cache(1 << 16)
def stem(word: str) -> str:
    """The English stem of a word of letters a-z; other words as they are."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    elif (m := re.fullmatch("(.*)(ed|ing)", word)) and "v" in _shape(m[1]):
        word = m[1]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short_end(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(_replace(word, _STEP_2, 0), _STEP_3, 0), _STEP_4, 1)
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short_end(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def _stems(words: pa.Array) -> pa.Array:
    """Arrays of words with each word's stem; each distinct word of a batch is looked at once."""
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    coded = words.flatten().dictionary_encode()
    stems = pa.array([stem(w) for w in coded.dictionary.to_pylist()], pa.string())
    return pa.ListArray.from_arrays(_offsets(words), stems.take(coded.indices), mask=words.is_null())


def _offsets(words: pa.Array) -> pa.Array:
    sizes = pa.compute.list_value_length(words).fill_null(0).to_pylist()
    return pa.array([0, *_running(sizes)], pa.int32())


def _running(sizes: list[int]) -> Iterator[int]:
    total = 0
    for n in sizes:
        total += n
        yield total


_stems.__annotations__ = {"words": pa.Array, "return": pa.Array}


# Analysers
def content(rows: DataFrame, fields: Sequence[str]) -> Column:
    """Searchable fields that aren't empty, one a line."""
    return F.concat_ws("\n", *[F.when(F.col(f"p__{f}") != "", F.col(f"p__{f}")) for f in fields])


def tokens(text: Column, language: str = "simple") -> Column:
    """Words of letters and digits, lower case, without accents; stems of them where the language is english."""
    found = F.regexp_extract_all(F.translate(F.lower(text), *_ACCENTS), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.arrow_udf(_stems, "array<string>")(found) if language == "english" else found


def words_of(text: str, language: str = "simple") -> list[str]:
    found = re.findall(r"[^\W_]+", text.lower().translate(str.maketrans(*_ACCENTS)))
    return [stem(w) for w in found] if language == "english" else found


# Queries
@dataclass(frozen=True)
class Term:
    word: str
    prefix: bool = False

    def matches(self, term: Column) -> Column:
        return term.startswith(self.word) if self.prefix else term == self.word


@dataclass(frozen=True)
class Phrase:
    """Terms in a row; one term is a word."""

    terms: tuple[Term, ...]


@dataclass(frozen=True)
class Not:
    part: Expression


@dataclass(frozen=True)
class All:
    parts: tuple[Expression, ...]


@dataclass(frozen=True)
class Any:
    parts: tuple[Expression, ...]


Expression = Phrase | Not | All | Any


def terms_of(e: Expression, negated: bool | None = None) -> list[Term]:
    """Distinct terms in order; with ``negated`` False those alone that a match can have."""
    if isinstance(e, Phrase):
        return sorted(set(e.terms), key=lambda t: (t.word, t.prefix))
    if isinstance(e, Not):
        return [] if negated is False else terms_of(e.part)
    return sorted({t for p in e.parts for t in terms_of(p, negated)}, key=lambda t: (t.word, t.prefix))


def holds(e: Expression, phrase: Callable[[tuple[Term, ...]], Column]) -> Column:
    if isinstance(e, Phrase):
        return phrase(e.terms)
    if isinstance(e, Not):
        return ~holds(e.part, phrase)
    found = [holds(p, phrase) for p in e.parts]
    if not found:
        return F.lit(isinstance(e, All))
    return functools.reduce((lambda a, b: a & b) if isinstance(e, All) else (lambda a, b: a | b), found)


def of_nothing(e: Expression) -> bool:
    """Whether a text without any of the words matches."""
    if isinstance(e, Phrase):
        return False
    if isinstance(e, Not):
        return not of_nothing(e.part)
    return (all if isinstance(e, All) else any)(of_nothing(p) for p in e.parts)


def _phrase(text: str, language: str, prefix: bool = False) -> list[Expression]:
    found = words_of(text, "simple" if prefix else language)
    return [Phrase(tuple(Term(w, prefix and i == len(found) - 1) for i, w in enumerate(found)))] if found else []


class _Raw:
    """Words, "phrases", word*, parentheses, NOT over AND over OR; neighbours without an operator are joined by AND."""

    def __init__(self, text: str, language: str) -> None:
        self.language, self.at = language, 0
        self.parts = re.findall(r'"[^"]*"|[()]|[^\s()"]+|"', text)

    def peek(self) -> str | None:
        return self.parts[self.at] if self.at < len(self.parts) else None

    def take(self) -> str:
        self.at += 1
        return self.parts[self.at - 1]

    def either(self) -> Expression:
        found = [self.both()]
        while self.peek() == "OR":
            self.take()
            found.append(self.both())
        return found[0] if len(found) == 1 else Any(tuple(found))

    def both(self) -> Expression:
        found: list[Expression] = []
        while self.peek() not in (None, ")", "OR"):
            if self.peek() == "AND":
                self.take()
                if not found or self.peek() in (None, ")", "OR", "AND"):
                    raise QueryError("AND stands between two parts")
                continue
            found += self.one()
        if not found:
            raise QueryError("a part of the query is empty")
        return found[0] if len(found) == 1 else All(tuple(found))

    def one(self) -> list[Expression]:
        part = self.take()
        if part == "NOT":
            if self.peek() in (None, ")", "OR", "AND"):
                raise QueryError("NOT stands before a part")
            return [Not(p) for p in self.one()]
        if part == "(":
            inner = self.either()
            if self.peek() != ")":
                raise QueryError("a parenthesis isn't closed")
            self.take()
            return [inner]
        if part in (")", '"'):
            raise QueryError(f"{part} has no beginning or end")
        return _phrase(part.strip('"'), self.language) if part[0] == '"' else _phrase(part, self.language, part.endswith("*"))


def parse(query: str, mode: str = "websearch", language: str = "simple") -> Expression:
    """plain: all words. phrase: the words in a row. websearch: "quoted phrases", -not, OR (parts with nothing but -not are left out).
    raw: see _Raw; a word* is not stemmed. A query without words matches nothing."""
    if mode not in MODES:
        raise QueryError(f"mode: {mode}")
    if language not in LANGUAGES:
        raise QueryError(f"language: {language}")
    if mode == "plain":
        found = [Phrase((Term(w),)) for w in dict.fromkeys(words_of(query, language))]
        return All(tuple(found)) if found else Any(())
    if mode == "phrase":
        return Any(tuple(_phrase(query, language)))
    if mode == "raw":
        if not query.strip():
            return Any(())
        made = _Raw(query, language)
        out = made.either()
        if made.peek() is not None:
            raise QueryError("a parenthesis isn't opened")
        return out
    groups: list[list[Expression]] = [[]]
    for m in re.finditer(r'(-)?"([^"]*)"|(\S+)', query):
        minus, quoted, bare = m.groups()
        if bare == "OR":
            groups.append([])
            continue
        if bare is not None:
            minus, bare = (True, bare[1:]) if bare.startswith("-") else (False, bare)
        groups[-1] += [Not(p) if minus else p for p in _phrase(quoted if bare is None else bare, language)]
    return Any(tuple(All(tuple(g)) for g in groups if any(not isinstance(p, Not) for p in g)))


# Scores
def total(parts: list[Column]) -> Column:
    """A balanced tree of additions."""
    while len(parts) > 1:
        parts = [a + b for a, b in zip(parts[::2], parts[1::2], strict=False)] + (parts[-1:] if len(parts) % 2 else [])
    return parts[0]


def idf(n: int, df: int) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def weight(tf: Column, size: Column, average: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / F.lit(average or 1.0)))


def in_tokens(words: Column) -> Callable[[tuple[Term, ...]], Column]:
    """How a phrase is looked up in an array of words."""
    line = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))

    def phrase(terms: tuple[Term, ...]) -> Column:
        if len(terms) == 1:
            return F.exists(words, lambda x: x.startswith(terms[0].word)) if terms[0].prefix else F.array_contains(words, terms[0].word)
        return line.contains(" " + " ".join(t.word for t in terms) + ("" if terms[-1].prefix else " "))

    return phrase


# Index
def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each term of each text; the empty term stands for the text itself. The words of many texts are sorted at once, as numbers."""
    for batch in batches:
        batch = batch.filter(pa.compute.greater(pa.compute.list_value_length(batch["words"]), 0))
        sizes = pa.compute.list_value_length(batch["words"]).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, begin = np.cumsum(sizes), 0
        while begin < len(sizes):  # as many texts as have about a million words
            end = max(begin + 1, int(np.searchsorted(ends, ends[begin] - sizes[begin] + 1_000_000, "right")))
            yield from _rows(batch.slice(begin, end - begin), sizes[begin:end])
            begin = end


def _rows(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    coded = batch["words"].flatten().dictionary_encode()
    codes, text = np.asarray(coded.indices).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    both = text * max(len(coded.dictionary), 1) + codes
    order = np.argsort(both, kind="stable")
    first = np.flatnonzero(np.diff(both[order], prepend=-1))
    tf, at = np.diff(np.append(first, len(order))), text[order[first]]
    positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(place[order], pa.int32()))
    terms = coded.dictionary.take(pa.array(codes[order[first]]))
    for rows, n, term, where in (
        (np.arange(len(sizes)), sizes, pa.array([""] * len(sizes), pa.string()), pa.nulls(len(sizes), pa.list_(pa.int32()))),
        (at, tf, terms, positions),
    ):
        take = pa.array(rows)
        columns = [batch["kind"].take(take), batch["id"].take(take), pa.array(sizes[rows], pa.int32()), term, pa.array(n, pa.int32()), where]
        made = pa.RecordBatch.from_arrays(columns, ["kind", "id", "size", "term", "tf", "positions"])
        yield from (made.slice(i, 100_000) for i in range(0, len(rows), 100_000))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(term, 1, 2)), F.lit(BUCKETS)).cast("int")


class FulltextIndex:
    """An index of texts by (kind, id), in a folder that all executors reach. Search reads nothing else."""

    POSTINGS = "kind string, id string, size int, term string, tf int, positions array<int>, block int, bucket int"
    TERMS = "term string, df long, words long"
    BLOCKS = "term string, block int, top double, documents long"

    def __init__(self, spark: SparkSession, place: str) -> None:
        self.spark, self.place = spark, place
        meta = spark.read.json(f"{place}/meta", "language string, documents long, words long").first()
        self.language, self.documents, self.average = meta["language"], meta["documents"], meta["words"] / max(meta["documents"], 1)
        self.postings = spark.read.schema(self.POSTINGS).parquet(f"{place}/postings")
        self.terms = spark.read.schema(self.TERMS).parquet(f"{place}/terms")
        self.blocks = spark.read.schema(self.BLOCKS).parquet(f"{place}/blocks")

    @classmethod
    def build(cls, rows: DataFrame, fields: Sequence[str], language: str = "simple", place: str | None = None) -> FulltextIndex:
        """Indexes the fields of node rows. Texts without words aren't in it; (kind, id) should be unique."""
        if language not in LANGUAGES:
            raise QueryError(f"language: {language}")
        spark = rows.sparkSession
        place = place or new_table(spark, "fulltext")
        cls.segments(rows, fields, language).write.partitionBy("bucket").mode("overwrite").parquet(f"{place}/postings")
        postings = spark.read.schema(cls.POSTINGS).parquet(f"{place}/postings")
        terms = postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("words"))
        terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{place}/terms")
        terms = spark.read.schema(cls.TERMS).parquet(f"{place}/terms")
        every = terms.where("term = ''").first()
        n, words = (every["df"], every["words"]) if every else (0, 0)
        common = terms.where((F.col("df") >= COMMON) & (F.col("term") != "")).select("term")
        tops = postings.join(common, "term", "left_semi").groupBy("term", "block").agg(F.max(weight(F.col("tf").cast("double"), F.col("size"), words / max(n, 1))).alias("top"), F.count("*").alias("documents"))
        tops.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{place}/blocks")
        spark.createDataFrame([(language, n, words)], "language string, documents long, words long").coalesce(1).write.mode("overwrite").json(f"{place}/meta")
        return cls(spark, place)

    @staticmethod
    def segments(rows: DataFrame, fields: Sequence[str], language: str = "simple") -> DataFrame:
        """Postings of node rows. Each task sorts those of its own texts, so none is dealt to another; texts are cut into words once (a filter on the words would do it again)."""
        texts = rows.select("kind", "id", tokens(content(rows, fields), language).alias("words"))
        found = texts.mapInArrow(_postings, "kind string, id string, size int, term string, tf int, positions array<int>")
        block = F.floor(F.log2("size") * 4).cast("int") * 16 + F.pmod(F.xxhash64("kind", "id"), F.lit(16)).cast("int")
        return found.withColumn("block", block).withColumn("bucket", _bucket(F.col("term"))).sortWithinPartitions("bucket", "term", "block")

    def _read(self, terms: list[Term]) -> DataFrame:
        """Postings of the terms: their directories, and there the row groups that have them."""
        short = any(t.prefix and len(t.word) < 2 for t in terms)
        buckets = self.spark.range(1).select(*[_bucket(F.lit(t.word)).alias(str(i)) for i, t in enumerate(terms)]).first() if terms and not short else ()
        exact = [t.word for t in terms if not t.prefix]
        wanted = [F.col("term").isin(exact)] if exact else []
        wanted += [F.col("term").startswith(t.word) for t in terms if t.prefix]
        rows = self.postings if short else self.postings.where(F.col("bucket").isin(sorted(set(buckets))))
        return rows.where(functools.reduce(lambda a, b: a | b, wanted)) if wanted else rows.limit(0)

    def counts(self, terms: list[Term]) -> list[int]:
        """How many documents each term is in: dictionary rows of the terms, and a count where only a beginning is given."""
        exact = [t.word for t in terms if not t.prefix]
        known = {r["term"]: r["df"] for r in self.terms.where(F.col("term").isin(exact)).select("term", "df").collect()} if exact else {}
        return [self._read([t]).where("term <> ''").select("kind", "id").distinct().count() if t.prefix else known.get(t.word, 0) for t in terms]

    def search(self, e: Expression, k: int, min_score: float | None = None, allowed: DataFrame | None = None, offset: int = 0, prune_from: int = PRUNE_FROM) -> DataFrame:
        """kind, id, score of the k best documents after ``offset`` (ties by id, kind); of those in ``allowed`` (kind, id) where it is given."""
        terms, scored = terms_of(e), terms_of(e, False)
        everything = Term("")
        hits = self._read([*terms, everything] if of_nothing(e) else terms)
        if allowed is not None:
            hits = hits.join(allowed.select("kind", "id"), ["kind", "id"], "left_semi")
        counts = self.counts(scored)
        weights = [idf(self.documents, df) for df in counts]
        if not of_nothing(e) and not any(t.prefix for t in terms) and sum(counts) >= prune_from:
            hits = self._pruned(e, hits, scored, weights, k + offset)
        best = self._scored(e, hits, terms, scored, weights)
        if min_score is not None:
            best = best.where(F.col("score") >= min_score)
        best = best.orderBy(F.col("score").desc(), F.col("id").asc(), F.col("kind").asc())
        return (best.offset(offset) if offset else best).limit(k)

    def _scored(self, e: Expression, hits: DataFrame, terms: list[Term], scored: list[Term], weights: list[float]) -> DataFrame:
        in_rows = {t for p in _phrases(e) if len(p) > 1 for t in p}
        columns = [F.max("size").alias("size")]
        for i, t in enumerate(terms):
            mine = t.matches(F.col("term")) & (F.col("term") != "")
            columns.append(F.coalesce(F.sum(F.when(mine, F.col("tf"))), F.lit(0)).cast("double").alias(f"t{i}"))
            if t in in_rows:
                columns.append(F.flatten(F.collect_list(F.when(mine, F.col("positions")))).alias(f"p{i}"))
        at = {t: i for i, t in enumerate(terms)}

        def phrase(of: tuple[Term, ...]) -> Column:
            if len(of) == 1:
                return F.col(f"t{at[of[0]]}") > 0
            moved = [F.expr(f"transform(p{at[t]}, x -> x - {j})") for j, t in enumerate(of)]
            return F.size(functools.reduce(F.array_intersect, moved)) > 0

        met = hits.groupBy("kind", "id").agg(*columns).where(holds(e, phrase))
        parts = [F.lit(0.0), *[F.lit(w) * weight(F.col(f"t{at[t]}"), F.col("size"), self.average) for t, w in zip(scored, weights, strict=True)]]
        return met.select("kind", "id", total(parts).alias("score"))

    def bounds(self, scored: list[Term], weights: list[float]) -> tuple[dict[int, float], float]:
        """For each block a score that none of its documents exceeds, and one for blocks that aren't named: terms without block maxima may
        reach their full weight anywhere."""
        rest, out = 0.0, {}
        for t, w in zip(scored, weights, strict=True):
            tops = self.blocks.where(F.col("term") == t.word).select("block", "top").collect()  # as many as there are blocks, 2,000 or so
            rest += 0.0 if tops else w * (K1 + 1)
            for r in tops:
                out[r["block"]] = out.get(r["block"], 0.0) + w * r["top"]
        return {b: s + rest for b, s in out.items()}, rest

    def _pruned(self, e: Expression, hits: DataFrame, scored: list[Term], weights: list[float], k: int) -> DataFrame:
        bounds, rest = self.bounds(scored, weights)
        ranked = sorted(bounds, key=lambda b: (-bounds[b], b))
        for some in (4, 32):  # the likeliest blocks first, more of them where they hold fewer than k matches
            first = self._scored(e, hits.where(F.col("block").isin(ranked[:some])), terms_of(e), scored, weights).orderBy(F.col("score").desc()).limit(k)
            found = first.agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
            if found["n"] == k:
                least = found["least"] * (1 - 1e-12)  # sums may be rounded in another order
                low = [b for b in ranked if bounds[b] < least]
                return hits.where(~F.col("block").isin(low)) if rest >= least else hits.where(F.col("block").isin(ranked[: len(ranked) - len(low)]))
        return hits


def _phrases(e: Expression) -> list[tuple[Term, ...]]:
    if isinstance(e, Phrase):
        return [e.terms]
    return _phrases(e.part) if isinstance(e, Not) else [p for x in e.parts for p in _phrases(x)]
