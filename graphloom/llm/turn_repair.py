"""Repair of conversations whose turns got lost, emptied, cut off, repeated or given to the wrong speaker.

A conversation is well formed when the initials of its roles read ``(s?(ua)+)?``. Turns may be kept, given to another role,
deleted, or inserted with an empty text, each at a cost. The search runs in layers of increasing cost, as approximate
matching with bit vectors does: for every place between two turns there is one machine word, whose k-th nibble is the set of
grammar states from which the conversation's end is reached at a cost of at most ``base + k``. One turn moves all
layers at once by shifts. The first layer that holds the start state at the first turn is the cost; following set bits
from there, taking the least edit each time, gives the least audit of that cost.

Any state is reached from any other by a few insertions and a deletion, so costs of the states of one place differ by no more than
``Costs.layers`` and a word of that many layers is exact, however long the conversation is. A task holds two bytes for each of a conversation's
turns (and the words of one block of BLOCK turns at a time), never their texts; the audit itself is one byte a turn in one
cell. Texts meet their edits by place, and are hashed as a sorted stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import written

#: Rows in a block at most; their words are held at once.
BLOCK_BITS = 12
#: First characters of a text by which equal turns of one conversation are dealt out, where turns are equal.
LEAD = 64
SPACES = " \t\n\x0b\x0c\r"
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: A turn's code: its role's initial (s, u, a, other) and its fault.
CODES = "ABCDEFGHIJKLMNOP"
_START, _S, _U, _A = 1, 2, 4, 8


@dataclass(frozen=True)
class Costs:
    """Positive whole numbers. ``truncated`` is added where a truncated turn stays."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5

    @property
    def layers(self) -> int:
        return 2 * self.insert + 2 * self.delete + 1


class Layers:
    """The words of one place after another, from a conversation's end to its beginning."""

    def __init__(self, costs: Costs) -> None:
        self.costs, self.n = costs, costs.layers
        self.ones = int("1" * self.n, 16)
        self.full = int("f" * self.n, 16)
        self.end = self._inserted(self.ones * (_START | _A)), 0

    def _before(self, word: int, symbol: int) -> int:
        """States that lead into the word's by a turn of the role s (0), u (1) or a (2); none for another."""
        if symbol == 0:
            return (word >> 1) & self.ones
        if symbol == 1:
            return ((word >> 2) & self.ones) * (_START | _S | _A)
        return ((word >> 3) & self.ones) * _U if symbol == 2 else 0

    def _inserted(self, word: int) -> int:
        while True:
            more = word | (((self._before(word, 1) | self._before(word, 2)) << 4 * self.costs.insert) & self.full)
            if more == word:
                return word
            word = more

    def step(self, place: tuple[int, int], code: int) -> tuple[int, int]:
        """(word, base) before a turn, from those after it."""
        (word, base), c = place, self.costs
        out = word << 4 * c.delete
        symbol, fault = divmod(code, 4)
        if fault in (NONE, TRUNCATED):
            stay = self._before(word, symbol) | ((self._before(word, 1) | self._before(word, 2)) << 4 * c.rerole)
            out |= stay << (4 * c.truncated if fault == TRUNCATED else 0)
        out = self._inserted(out & self.full)
        empty = ((out & -out).bit_length() - 1) // 4  # layers below the least cost
        if empty:
            top = out >> 4 * (self.n - 1)  # every state that reaches the end, which is all of them
            out = (out >> 4 * empty) | (top * int("1" * empty, 16) << 4 * (self.n - empty))
        return out, base + empty

    def holds(self, place: tuple[int, int], state: int, cost: int) -> bool:
        word, base = place
        return cost >= base and bool(word >> 4 * min(cost - base, self.n - 1) & state)

    def least(self, place: tuple[int, int], state: int) -> int:
        """The first layer that holds the state, as a cost."""
        word, base = place
        return base + next(k for k in range(self.n) if word >> 4 * k & state)


def repair(blocks: list[str], costs: Costs = Costs()) -> tuple[int, list[str]]:
    """The least cost, and the edits of each block.

    ``blocks``: codes of a conversation's turns, each row's followed by ``|`` (a row may stand for several equal turns).
    Edits of a row end with ``|`` too: K keeps, u and a give the turn to the user or the assistant, D deletes, U and A insert a turn.
    Of all edits of the least cost, those with the ASCII-least initials (D, I, K, R).
    """
    layers = Layers(costs)
    after = [layers.end]
    for codes in reversed(blocks):
        place = after[-1]
        for ch in reversed(codes):
            if ch != "|":
                place = layers.step(place, ord(ch) - 65)
        after.append(place)
    after.reverse()
    state, left = _START, layers.least(after[0], _START)
    cost, edits = left, []
    for k, codes in enumerate(blocks):
        places = [after[k + 1]]
        for ch in reversed(codes):
            places.append(places[-1] if ch == "|" else layers.step(places[-1], ord(ch) - 65))
        places.reverse()
        said: list[str] = []
        for i, ch in enumerate(codes):
            if ch == "|":
                said.append("|")
                continue
            while True:
                edit, state, left = _edit(layers, places[i], places[i + 1], ord(ch) - 65, state, left)
                said.append(edit)
                if edit not in "UA":
                    break
        edits.append("".join(said))
    tail = ""
    while left:  # turns inserted at the end
        edit, state, left = _edit(layers, layers.end, None, 0, state, left)
        tail += edit
    if tail and edits:
        edits[-1] = edits[-1][:-1] + tail + "|"
    return cost, edits


def _edit(layers: Layers, here: tuple[int, int], there: tuple[int, int] | None, code: int, state: int, left: int) -> tuple[str, int, int]:
    """The least edit at a turn that stays within the least cost: (edit, state after it, cost left)."""
    c, (symbol, fault) = layers.costs, divmod(code, 4)
    other, name = (_A, "a") if state == _U else (_U, "u")
    if there and layers.holds(there, state, left - c.delete):
        return "D", state, left - c.delete
    if layers.holds(here, other, left - c.insert):
        return name.upper(), other, left - c.insert
    stay = c.truncated if fault == TRUNCATED else 0
    kept = _S if symbol == 0 and state == _START else other if symbol == (2 if state == _U else 1) else 0
    if kept and layers.holds(there, kept, left - stay) and fault in (NONE, TRUNCATED):
        return "K", kept, left - stay
    return name, other, left - stay - c.rerole


_PLAN = "conv_id long, first long, edits string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_AUDIT = str.maketrans("uaUA", "RRII", "|")


def _plan(costs: Costs):
    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks sorted by conversation and place -> a row with the edits of each block, and one with the conversation's figures."""
        names = [x.split()[0] for x in _PLAN.split(", ")]
        kinds = [pa.string() if x.endswith("string") else pa.int64() for x in _PLAN.split(", ")]
        last: object = batches  # no conversation yet
        held: list[tuple] = []
        out: list[tuple] = []

        def close() -> None:
            blocks = [b[1] for b in held]
            cost, edits = repair(blocks, costs)
            codes = "".join(blocks).replace("|", "")
            faults = [sum(codes.count(CODES[4 * s + f]) for s in range(4)) for f in (BLANK, DUPLICATE, TRUNCATED)]
            pairs = codes.translate(str.maketrans(CODES, "ssssuuuuaaaa????"))
            fine = sum(x + y in ("su", "ua", "au") for x, y in zip(pairs, pairs[1:], strict=False))
            turns, low, high = 0, None, None
            for _, _, n, lo, hi in held:
                if n:
                    turns += n - (high is not None and high == lo)
                    low, high = lo if low is None else low, hi
            gaps = high - low + 1 - turns if turns else 0
            out.extend((last, b[0], e) + (None,) * 7 for b, e in zip(held, edits, strict=True))
            out.append((last, None, None, gaps, *faults, max(len(pairs) - 1, 0) - fine, cost, "".join(edits).translate(_AUDIT)))

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)
            out.clear()
            return batch

        for batch in batches:
            for conv, *block in zip(*(batch[c].to_pylist() for c in ("conv_id", "first", "codes", "turns", "low", "high")), strict=True):
                if conv != last:
                    if held:
                        close()
                    last, held = conv, []
                held.append(tuple(block))
            if out:
                yield made()
        if held:
            close()
            yield made()

    return plan


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) with damage by crc32 of ``conv_id:turn`` modulo 20: 0 drops the row (no copies), 1 empties its
    text, 2 removes ``.``, ``!`` and ``?``, 3 repeats it (two copies), 4 gives it to the user. Null roles and texts are one space, as
    null ids and turns are in the key. Extra columns are left out."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


class Repair:
    """The repair of conversations (conv_id, turn, role, text, copies), rows by turn (nulls first), ties by role and text.

    ``copies``: how often a row stands there, one after another; 0: not at all, so that a conversation of such rows alone is an
    empty one. A null role or text is empty; a null conv_id is a conversation. A turn's first fault counts: blank (nothing but ``\\x20\\x09-\\x0D``), duplicate (role and text
    seen earlier in the conversation), truncated (its last other character isn't ``.``, ``!`` or ``?``). Blank and duplicate turns must go.
    An empty table gives empty results.

    Equal rows are counted before they are moved, rows are dealt by ranges of (conv_id, turn, role, first LEAD characters), and only codes of a
    byte or two a turn meet by conversation.
    """

    def __init__(self, rows: DataFrame, costs: Costs = Costs()) -> None:
        gone, fill = F.col("copies") == 0, lambda c: F.when(F.col("copies") == 0, "").otherwise(F.coalesce(F.col(c), F.lit("")))
        narrow = rows.select("conv_id", F.when(~gone, F.col("turn")).alias("turn"), fill("role").alias("role"), fill("text").alias("text"), gone.alias("gone"), "copies")
        counted = narrow.groupBy("conv_id", "turn", "role", "text", "gone").agg(F.sum("copies").alias("copies")).withColumn("digest", F.md5(F.col("text").cast("binary")))
        counted = written(counted, "turns")
        moment = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
        first = counted.where("not gone").groupBy("conv_id", "role", "digest").agg(F.min(moment).alias("first"))
        first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("first.turn").alias("first_turn"))
        met = counted.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
        solid = F.rtrim("text", F.lit(SPACES))
        fault = F.when(solid == "", BLANK).when(~F.col("turn").eqNullSafe(F.col("first_turn")), DUPLICATE).when(~F.substring(solid, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(NONE)
        initial = F.substring("role", 1, 1)
        symbol = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
        code = lambda f: F.substring(F.lit(CODES), 4 * symbol + f + 1, F.lit(1))
        again = F.when(F.col("fault") == BLANK, code(F.lit(BLANK))).otherwise(code(F.lit(DUPLICATE)))
        codes = F.when(F.col("gone"), "").otherwise(F.concat(code(F.col("fault")), F.repeat(again, (F.col("copies") - 1).cast("int"))))
        met = met.withColumn("fault", fault).select("conv_id", "turn", "role", "text", codes.alias("codes"))
        sorted_rows = met.withColumn("lead", F.substring("text", 1, LEAD)).repartitionByRange("conv_id", "turn", "role", "lead").sortWithinPartitions("conv_id", "turn", "role", "text")
        self.rows = written(sorted_rows.drop("lead").withColumn("pos", F.monotonically_increasing_id()), "sorted-turns")
        parts = self.rows.groupBy("conv_id", F.shiftright("pos", BLOCK_BITS).alias("block")).agg(
            F.min("pos").alias("first"), F.array_sort(F.collect_list(F.struct("pos", "codes"))).alias("codes"), F.size(F.collect_set("turn")).cast("long").alias("turns"), F.min("turn").alias("low"), F.max("turn").alias("high"),
        )
        joined = F.array_join(F.transform("codes", lambda x: F.concat(x["codes"], F.lit("|"))), "")
        blocks = parts.select("conv_id", "first", joined.alias("codes"), "turns", "low", "high").repartition("conv_id").sortWithinPartitions("conv_id", "first")
        self.plan = written(blocks.mapInArrow(_plan(costs), _PLAN), "edits")

    def figures(self) -> DataFrame:
        """conv_id, gaps (turn numbers missing between the least and the largest), blank, duplicate, truncated, illegal (neighbours whose initials
        aren't su, ua or au), cost, audit (initials of the edits in order): one row for each conversation."""
        return self.plan.where("first is null").drop("first", "edits")

    def repaired(self) -> DataFrame:
        """conv_id, pos, place, role, text: the turns of the repaired conversations, in order of pos and place."""
        edits = self.plan.where("first is not null").select("first", F.posexplode(F.split("edits", r"\|")).alias("at", "edits")).where("edits <> ''")
        met = self.rows.join(edits.select((F.col("first") + F.col("at")).alias("pos"), "edits"), "pos")
        each = met.select("conv_id", "pos", "role", "text", F.posexplode(F.split("edits", "")).alias("place", "edit")).where("edit in ('K', 'u', 'a', 'U', 'A')")
        role = F.when(F.col("edit") == "K", F.col("role")).when(F.lower("edit") == "u", "user").otherwise("assistant")
        return each.select("conv_id", "pos", "place", role.alias("role"), F.when(F.col("edit").isin("U", "A"), "").otherwise(F.col("text")).alias("text"))

    def digests(self) -> DataFrame:
        """``figures`` and repaired_sha256, the lowercase hex digest of the repaired ``role:text`` joined by line feeds."""
        figures = self.figures()
        own = [c for c in figures.columns if c != "conv_id"]
        turns = self.repaired().select("conv_id", "pos", "place", F.concat("role", F.lit(":"), "text").alias("said"), *[F.lit(None).cast(figures.schema[c].dataType).alias(c) for c in own])
        ends = figures.select("conv_id", F.lit((1 << 63) - 1).alias("pos"), F.lit(0).alias("place"), F.lit(None).cast("string").alias("said"), *own)
        both = turns.unionByName(ends).repartition("conv_id").sortWithinPartitions("conv_id", "pos", "place")
        kinds = ", ".join(f"{c} {figures.schema[c].dataType.simpleString()}" for c in figures.columns)
        return both.mapInArrow(_hashed, f"{kinds}, repaired_sha256 string")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest, begun = hashlib.sha256(), False
    for batch in batches:
        ends, hashes = [], []
        for i, said in enumerate(batch["said"].to_pylist()):
            if said is None:  # a conversation's figures come after its turns
                ends.append(i)
                hashes.append(digest.hexdigest())
                digest, begun = hashlib.sha256(), False
            else:
                digest.update(("\n" if begun else "").encode() + said.encode("utf-8", "surrogatepass"))
                begun = True
        if ends:
            kept = batch.drop_columns(["pos", "place", "said"]).take(pa.array(ends))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(hashes)], [*kept.schema.names, "repaired_sha256"])


ORACLE = r"""
WITH RECURSIVE crc AS (
  SELECT i AS i, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, k + 1 FROM crc WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: unicode(x)::BIGINT)) AS bytes FROM conversations),
kinds AS (SELECT conv_id, turn, role, text, xor(list_reduce(bytes, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) % 20 AS kind FROM keyed, tab),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS solid FROM hurt),
faults AS (SELECT *, substr(role, 1, 1) AS ini, CASE WHEN solid = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault FROM numbered),
pairs AS (SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair FROM faults),
convs AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
    list_prepend(['000000000', NULL, '000000005I', '000000010II'], list([ini, fault, '', ''] ORDER BY i)) AS steps FROM pairs GROUP BY conv_id),
ends AS (SELECT conv_id, gaps, blank, duplicate, truncated, illegal, list_reduce(steps, lambda a, e:
  list_transform([list_transform([list_transform(range(1, 5), lambda q: least(
      lpad((substr(a[q], 1, 9)::INT + 2)::VARCHAR, 9, '0') || substr(a[q], 10) || 'D',
      CASE WHEN e[2] IN ('-', 't') THEN list_min(list_transform(CASE q WHEN 1 THEN []::INT[] WHEN 2 THEN [1] WHEN 3 THEN [1, 2, 4] ELSE [3] END, lambda p: least(
          CASE WHEN e[1] = ['', 's', 'u', 'a'][q] THEN lpad((substr(a[p], 1, 9)::INT + CASE e[2] WHEN 't' THEN 5 ELSE 0 END)::VARCHAR, 9, '0') || substr(a[p], 10) || 'K' END,
          CASE WHEN q > 2 THEN lpad((substr(a[p], 1, 9)::INT + CASE e[2] WHEN 't' THEN 6 ELSE 1 END)::VARCHAR, 9, '0') || substr(a[p], 10) || 'R' END))) END))],
    lambda n: [n[1], n[2], least(n[3], list_min(list_transform([1, 2, 4], lambda p: lpad((substr(n[p], 1, 9)::INT + 5)::VARCHAR, 9, '0') || substr(n[p], 10) || 'I'))), n[4]])[1]],
    lambda n: [n[1], n[2], n[3], least(n[4], lpad((substr(n[3], 1, 9)::INT + 5)::VARCHAR, 9, '0') || substr(n[3], 10) || 'I')])[1]) AS best FROM convs),
audits AS (SELECT *, substr(least(best[1], best[4]), 1, 9)::BIGINT AS cost, substr(least(best[1], best[4]), 10) AS audit FROM ends),
edits AS (SELECT conv_id, unnest(string_split(audit, '')) AS e, unnest(range(1, length(audit) + 1)) AS k FROM audits WHERE audit <> ''),
placed AS (SELECT *, count(*) FILTER (e <> 'I') OVER w AS i, count(*) FILTER (e <> 'D') OVER w AS m FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
said AS (SELECT p.conv_id, p.k, p.m, p.e, f.role, CASE WHEN p.e = 'I' THEN '' ELSE f.text END AS text, max((p.e = 'K' AND p.m = 1 AND f.ini = 's')::INT) OVER (PARTITION BY p.conv_id) AS s
    FROM placed p LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i WHERE p.e <> 'D'),
digests AS (SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (m - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k)) AS h FROM said GROUP BY conv_id)
SELECT c.conv_id, coalesce(a.gaps, 0)::BIGINT AS gaps, coalesce(a.blank, 0)::BIGINT AS blank, coalesce(a.duplicate, 0)::BIGINT AS duplicate, coalesce(a.truncated, 0)::BIGINT AS truncated,
  coalesce(a.illegal, 0)::BIGINT AS illegal, coalesce(a.cost, 0)::BIGINT AS cost, coalesce(a.audit, '') AS audit, coalesce(d.h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN digests d ON d.conv_id IS NOT DISTINCT FROM c.conv_id
"""
