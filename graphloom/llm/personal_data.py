"""Personal data in texts: identifiers of known form, and others that stand where such identifiers stand.

Four kinds have a form of their own: email, ip, card, phone. What matches is a base span and a seed. The words around the seeds
give lexical patterns (the word before, the two words before, the word before and the word after). Number runs and words
with an at sign that are no base span are candidates. Patterns and the distinct identifiers in their slots form a bipartite graph:
a pattern's confidence in a kind is the share of its identifiers that are of the kind, an unseen identifier's score is the noisy-or of
the confident patterns it stands in, and both are computed in turns, so identifiers found in one round support patterns in the next.
Candidates whose score reaches the bar are spans too. Copies of a passage count once, for identifiers are counted and not their occurrences.

Everything is DataFrame code. Regular expressions start only where a run of their first characters starts and never give back what they took, so
they take time in proportion to a text; they run only over texts with an at sign, a plus or a digit. Places are prefix sums over the
lengths of what lies between matches, a block of BLOCK matches at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import written

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: ``\G`` is where the last match ended, or the text begins.
FORMS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Words with an at sign, and runs of digits with up to two marks between, that no letter or digit touches.
CANDIDATE = r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]*+@[A-Za-z0-9.-]*+|(?<![A-Za-z0-9])[+(]?[0-9](?:[\x20().:/-]{0,2}+[0-9])++(?![A-Za-z0-9@])"
#: Characters before and after a span in which its context is sought.
CONTEXT = 48
BLOCK = 256


@dataclass(frozen=True)
class Bootstrap:
    """``support``: distinct seeds that a pattern needs. ``confidence``: of a pattern, identifiers of the kind over all identifiers and one more.
    ``score``: of an identifier. ``digits``: a candidate without an at sign needs so many to 19."""

    support: int = 5
    confidence: float = 0.8
    score: float = 0.8
    digits: int = 7
    rounds: int = 3


def _places(df: DataFrame, name: str, form: str, where: Column) -> DataFrame:
    """With a column ``name``: the matches of ``form`` in ``text``, leftmost and without overlap, as (start, end, token, before, after) in code points."""
    none = F.array().cast("array<string>")
    df = df.withColumn("__between", F.when(where, F.split("text", form, -1)).otherwise(none))
    df = df.withColumn("__found", F.when(where, F.regexp_extract_all("text", F.lit(form), F.lit(0))).otherwise(none))
    df = df.withColumn("__steps", F.expr("zip_with(slice(__between, 1, size(__found)), __found, (x, y) -> struct(length(x) as gap, length(y) as own))"))
    df = df.withColumn("__parts", F.expr(f"transform(filter(sequence(0, size(__steps) div {BLOCK}), c -> c * {BLOCK} < size(__steps)), c -> slice(__steps, c * {BLOCK} + 1, {BLOCK}))"))
    df = df.withColumn("__ends", F.expr("transform(__parts, p -> aggregate(p, array(0), (acc, s) -> concat(acc, array(element_at(acc, -1) + s.gap + s.own))))"))
    df = df.withColumn("__at", F.expr("aggregate(__ends, array(0), (acc, e) -> concat(acc, array(element_at(acc, -1) + element_at(e, -1))))"))
    df = df.withColumn("__spans", F.expr("flatten(transform(__parts, (p, c) -> transform(p, (s, j) -> struct(__at[c] + __ends[c][j] + s.gap as start, __at[c] + __ends[c][j] + s.gap + s.own as end))))"))
    made = F.expr(f"zip_with(__spans, sequence(1, size(__found)), (s, i) -> struct(s.start, s.end, __found[i - 1] as token, right(__between[i - 1], {CONTEXT}) as before, left(__between[i], {CONTEXT}) as after))")
    empty = F.array().cast("array<struct<start: int, end: int, token: string, before: string, after: string>>")
    return df.withColumn(name, F.when(F.size("__found") > 0, made).otherwise(empty)).drop("__between", "__found", "__steps", "__parts", "__ends", "__at", "__spans")


_VALID = {
    "email": "true",
    "ip": "forall(split(s.token, '[.]'), x -> length(trim(LEADING '0' FROM x)) <= 3 and coalesce(cast(nullif(trim(LEADING '0' FROM x), '') as int), 0) <= 255)",
    "card": "length(translate(s.token, ' -', '')) between 13 and 19 and luhn_check(translate(s.token, ' -', ''))",
    "phone": "length(translate(s.token, '+ ().-', '')) between 9 and 15",
}


def base_spans(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, one column for each kind and one, candidate, for what has none: arrays of (start, end, token, before, after)."""
    df = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text", F.octet_length("text")))
    df = df.withColumn("__digit", F.col("text").rlike("[0-9]")).withColumn("__sign", F.instr("text", "@") > 0).withColumn("__plus", F.instr("text", "+") > 0)
    digit, sign, plus = (F.col(c) for c in ("__digit", "__sign", "__plus"))
    for kind, where in zip(KINDS, (sign, digit, digit, plus & digit), strict=True):
        df = _places(df, kind, FORMS[kind], where)
        df = df.withColumn(kind, F.expr(f"filter({kind}, s -> {_VALID[kind]})"))
    return _places(df, "candidate", CANDIDATE, sign | digit).select("doc_id", "text_hash", *KINDS, "candidate")


def _slots(base: DataFrame, how: Bootstrap) -> DataFrame:
    """doc_id, text_hash, start, end, kind (null: unseen), identifier, patterns: seeds, and candidates that overlap none. Equal rows count once."""
    def kind_of(spans: Column | str, kind: str | None) -> Column:
        return F.transform(spans, lambda s: F.struct(F.lit(kind).cast("string").alias("kind"), *[s[c].alias(c) for c in ("start", "end", "token", "before", "after")]))

    unseen = F.expr(f"filter(candidate, s -> length(s.token) <= 64 and (contains(s.token, '@') or length(regexp_replace(s.token, '[^0-9]', '')) between {how.digits} and 19))")
    rows = base.select("doc_id", "text_hash", F.explode(F.concat(*[kind_of(k, k) for k in KINDS], kind_of(unseen, None))).alias("s")).select("doc_id", "text_hash", "s.*").dropDuplicates(["doc_id", "text_hash", "kind", "start", "end"])
    seed = F.col("kind").isNotNull()
    up = Window.partitionBy("doc_id", "text_hash").orderBy("start", "end", F.col("kind").asc_nulls_last())
    down = Window.partitionBy("doc_id", "text_hash").orderBy(F.col("start").desc(), F.col("end").desc(), F.col("kind").desc_nulls_first())
    earlier, later = F.max(F.when(seed, F.col("end"))), F.min(F.when(seed, F.col("start")))
    rows = rows.withColumn("__e", earlier.over(up.rowsBetween(Window.unboundedPreceding, -1))).withColumn("__l", later.over(down.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.where(seed | ((F.coalesce("__e", F.lit(0)) <= F.col("start")) & (F.col("__l").isNull() | (F.col("__l") >= F.col("end"))))).drop("__e", "__l")
    word = lambda c: F.regexp_replace(F.lower(c), "[0-9]+", "#")
    rows = rows.withColumn("__b", F.expr(r"filter(split(before, '\\s+'), x -> x <> '')")).withColumn("__a", F.expr(r"filter(split(after, '\\s+'), x -> x <> '')"))
    last, second, right = F.try_element_at("__b", F.lit(-1)), F.try_element_at("__b", F.lit(-2)), F.try_element_at("__a", F.lit(1))
    patterns = F.array(F.concat(F.lit("1 "), word(last)), F.concat(F.lit("2 "), word(second), F.lit(" "), word(last)), F.concat(F.lit("3 "), word(last), F.lit(" _ "), word(right)))
    return rows.select("doc_id", "text_hash", "start", "end", "kind", F.md5(F.lower("token").cast("binary")).alias("identifier"), F.contains("token", F.lit("@")).alias("at_sign"), F.filter(patterns, lambda p: p.isNotNull()).alias("patterns"))


def discovered(slots: DataFrame, how: Bootstrap = Bootstrap()) -> DataFrame:
    """identifier, kind, score of the unseen identifiers whose score reaches the bar, by the graph of patterns and identifiers.

    An identifier with an at sign can be an email alone, others can't. Ties between kinds go to the first by name."""
    edges = slots.select("identifier", "at_sign", F.explode("patterns").alias("pattern")).distinct()
    seeds = slots.where("kind is not null").select("identifier", "kind").distinct()
    edges = written(edges.join(seeds.groupBy("identifier").agg(F.min("kind").alias("own")), "identifier", "left"), "edges")  # by pattern and distinct identifier
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("all"), *[F.count(F.when(F.col("own") == k, 1)).alias(f"seeds_{k}") for k in KINDS])
    likely = sizes.where(" or ".join(f"seeds_{k} >= {how.support}" for k in KINDS))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"seeds_{k}").alias("seeds")) for k in KINDS])
    likely = written(likely.select("pattern", "all", F.explode(kinds).alias("k")).select("pattern", "all", "k.*").where(F.col("seeds") >= how.support), "patterns")
    open_edges = written(edges.where("own is null").join(likely.select("pattern").distinct(), "pattern", "left_semi").select("pattern", "identifier", "at_sign"), "open-edges")
    found = None
    for _ in range(how.rounds):
        more = likely.withColumn("hits", F.col("seeds").cast("double"))
        if found is not None:
            gained = open_edges.join(found, "identifier").groupBy("pattern", "kind").agg(F.sum("score").alias("gained"))
            more = likely.join(gained, ["pattern", "kind"], "left").withColumn("hits", F.col("seeds") + F.coalesce("gained", F.lit(0.0)))
        sure = more.withColumn("confidence", F.col("hits") / (F.col("all") + 1)).where(F.col("confidence") >= how.confidence).select("pattern", "kind", "confidence")
        met = open_edges.join(sure, "pattern").where((F.col("kind") == "email") == F.col("at_sign"))
        scored = met.groupBy("identifier", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(1 - 1e-9)))))).alias("score"))
        best = scored.groupBy("identifier").agg(F.max_by(F.struct("kind", "score"), F.struct("score", -F.ascii("kind"))).alias("b")).select("identifier", "b.*")
        found = written(best.where(F.col("score") >= how.score), "identifiers")
    return found


def personal_data(documents: DataFrame, how: Bootstrap = Bootstrap()) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_found: one row for each row of ``documents``.

    base_sha256: lowercase hex digest of the base spans as ``kind:start:end``, by kind in the order of KINDS, then start, joined by commas; spans: all
    spans, likewise. Code points, ends exclusive. n_found: spans that the patterns added, none of which overlaps a base span.
    A null text is empty and has none; repeated rows and null ids are treated alike; extra columns are ignored; an empty table gives none.
    """
    base = written(base_spans(documents), "spans")
    slots = written(_slots(base, how), "slots")
    added = slots.where("kind is null").drop("kind").join(discovered(slots, how), "identifier")
    added = added.groupBy(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("added"))
    own = [F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(k) for k in KINDS]
    met = base.select("doc_id", "text_hash", *own).join(added, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("text_hash") == F.col("__h")), "left")
    listed = lambda spans, k: F.transform(spans, lambda s: F.concat_ws(":", F.lit(k), s["start"].cast("string"), s["end"].cast("string")))
    every = [F.expr(f"array_sort(concat({k}, transform(filter(coalesce(added, array()), a -> a.kind = '{k}'), a -> struct(a.start, a.end))))") for k in KINDS]
    return met.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(F.concat_ws(",", *[listed(F.col(k), k) for k in KINDS]), 256).alias("base_sha256"),
        F.concat_ws(",", *[listed(e, k) for e, k in zip(every, KINDS, strict=True)]).alias("spans"), F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_found"),
    )
