"""Chat formatting from event logs.

Logs are partitioned by conversation and ordered by sequence; streamed deltas, edits and regenerations are folded into
final messages (window functions, so a long log spills instead of filling memory), and messages are rendered by a
template that can be read back. Rendering streams over sorted rows and writes a conversation in parts
of bounded size, so no conversation is held as a whole.

Template of a turn: ``### role: text</turn>`` and a line feed. In texts and roles a backslash goes before a backslash,
``###`` and ``</turn>`` (in roles before a colon too); reading takes whatever follows a backslash as it is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Consecutive values of seq in a block of a log, for which one task looks for later regenerations.
BLOCK = 4096
#: Characters after which a part of a conversation ends (at the end of a turn).
PART_CHARS = 1 << 20
START, BETWEEN, STOP = "### ", ": ", "</turn>"

_CONTROL = re.compile(r"\\|###|</turn>")
_CONTROL_ROLE = re.compile(r"\\|###|</turn>|:")
_PAIR = re.compile(r"\\(.)", re.DOTALL)
_STOP = re.compile(r"\\.|</turn>", re.DOTALL)
_COLON = re.compile(r"\\.|: ", re.DOTALL)


def escape(text: str, role: bool = False) -> str:
    return (_CONTROL_ROLE if role else _CONTROL).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _PAIR.sub(r"\1", text)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn as text, and where the escaped text begins and ends in it."""
    head, body = f"{START}{escape(role, True)}{BETWEEN}", escape(text)
    return f"{head}{body}{STOP}\n", len(head), len(head) + len(body)


def _until(pattern: re.Pattern, text: str, at: int) -> tuple[int, int]:
    for m in pattern.finditer(text, at):
        if m[0][0] != "\\":
            return m.start(), m.end()
    raise ValueError("a turn has no end")


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of every turn of a rendered part."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn begins at {at}")
        colon, begin = _until(_COLON, formatted, at + len(START))
        stop, end = _until(_STOP, formatted, begin)
        yield unescape(formatted[at + len(START) : colon]), unescape(formatted[begin:stop])
        at = end + 1


def fold(events: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` from events (conv_id, seq, kind, turn, role, text).

    ``kind``: message (a new text for the turn), delta (more text at its end), edit (another text in place of it),
    regenerate (forgets this turn and all later ones as they were before; its text, if any, begins the turn anew). An event
    that comes before a regeneration of its turn or an earlier one has no effect. Of a turn, the last message, edit or regeneration and the deltas after
    it count, in order of seq (ties: kind, text); a turn with deltas alone is their text. The role is
    the last one given. Null texts are empty; events with a null kind or turn are left out. Unknown kinds count as message.
    """
    known = events.where("kind is not null and turn is not null").select("conv_id", "seq", "kind", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    # The smallest turn that a later event regenerates: of later blocks of the log, and within the event's own.
    known = known.withColumn("block", F.floor(F.coalesce("seq", F.lit(-(1 << 62))) / BLOCK))
    again = F.when(F.col("kind") == "regenerate", F.col("turn"))
    blocks = known.groupBy("conv_id", "block").agg(F.min(again).alias("again"))
    after = Window.partitionBy("conv_id").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.min("again").over(after).alias("far")).where("far is not null")
    known = known.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")), "left").drop("c", "b")
    later = Window.partitionBy("conv_id", "block").orderBy(F.col("seq").desc_nulls_last(), F.col("kind").desc(), F.col("text").desc()).rowsBetween(Window.unboundedPreceding, -1)
    alive = known.withColumn("cut", F.least("far", F.min(again).over(later))).where("cut is null or cut > turn")
    turn = Window.partitionBy("conv_id", "turn").orderBy(F.col("seq").asc_nulls_first(), "kind", "text")
    alive = alive.withColumn("n", F.row_number().over(turn))
    base = F.max(F.when(F.col("kind") != "delta", F.col("n"))).over(Window.partitionBy("conv_id", "turn"))
    kept = alive.withColumn("base", F.coalesce(base, F.lit(0))).where("n >= base")
    pieces = F.array_sort(F.collect_list(F.struct("n", "text")))
    role = F.max_by("role", F.when(F.col("role").isNotNull(), F.col("n")))
    return kept.groupBy("conv_id", "turn").agg(role.alias("role"), F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("text"))


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and place -> (conv_id, part, formatted, turns, loss)."""
    last: object = batches  # no conversation yet
    part, text, size, turns, loss = 0, [], 0, 0, []
    out: list[tuple] = []
    for batch in batches:
        for conv, role, said in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if turns and (conv != last or size >= PART_CHARS):
                out.append((last, part, "".join(text), turns, loss))
                text, size, turns, loss, part = [], 0, 0, [], part + 1
            if conv != last:
                last, part = conv, 0
            turn, begin, end = render_turn(role or "", said or "")
            if role == "assistant":
                loss.append((size + begin, size + end))
            text.append(turn)
            size += len(turn)
            turns += 1
        if out:
            yield _parts(out)
            out = []
    if turns:
        yield _parts([(last, part, "".join(text), turns, loss)])


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    spans = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), spans)
    columns = [[r[i] if i < 4 else [{"begin": a, "end": b} for a, b in r[i]] for r in rows] for i in range(5)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "part", "formatted", "turns", "loss"])


def render(messages: DataFrame) -> DataFrame:
    """``conv_id, part, formatted, turns, loss`` of messages (conv_id, turn, role, text).

    ``loss``: spans of ``formatted``, in code points, with the (escaped) texts of the role assistant. Turns are in order, nulls first, ties by role and text;
    each row is a turn. Null roles and texts are empty; rows without a conv_id are one conversation. Parts of a conversation
    follow each other in one partition. An empty table gives none; extra columns are ignored.
    """
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return rows.mapInArrow(_render, "conv_id long, part long, formatted string, turns long, loss array<struct<begin: long, end: long>>")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    last: object = batches
    n = chars = size = 0
    turns, loss = hashlib.sha256(), hashlib.sha256()
    out: list[tuple] = []

    def made() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    for batch in batches:
        for conv, formatted, spans in zip(*(batch[c].to_pylist() for c in ("conv_id", "formatted", "loss")), strict=True):
            if conv != last:
                if n:
                    out.append((last, n, turns.hexdigest(), chars, loss.hexdigest(), size))
                last, n, chars, size, turns, loss = conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            for role, text in parse(formatted):
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                n += 1
            for span in spans:
                text = unescape(formatted[span["begin"] : span["end"]])
                loss.update(text.encode("utf-8", "surrogatepass"))
                chars += len(text)
            size += len(formatted)
        if out:
            yield made()
            out.clear()
    if n:
        out.append((last, n, turns.hexdigest(), chars, loss.hexdigest(), size))
        yield made()


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, parsed from what ``render`` returns.
    A conversation's parts must come in order in one partition, as ``render`` leaves them."""
    return rendered.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def events_of(rows: DataFrame) -> DataFrame:
    """An event log (conv_id, seq, kind, turn, role, text) that folds into the rows (conv_id, turn, role, text) given:
    each row is a turn of its own, in order of turn (nulls first), role and text; repeated rows too.

    By hash of its place, a turn is said at once; or streamed in three deltas; or as a draft that is edited; or it
    and the next turn are drafted, and both regenerated and streamed anew.
    """
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")).cast("long")
    turns = rows.select("conv_id", place.alias("place"), "role", F.coalesce("text", F.lit("")).alias("text"))
    size = F.char_length("text")
    third, draft = F.floor(size / 3).cast("int"), F.lit("(draft)")
    cut = [F.substring("text", F.lit(1), third), F.substring("text", third + 1, third), F.substring("text", 2 * third + 1, size)]

    def event(i: int, kind: str, text: Column, ahead: int = 0) -> Column:
        return F.struct((F.col("place") * 8 + i).alias("seq"), F.lit(kind).alias("kind"), (F.col("place") + ahead).alias("turn"), "role", text.alias("text"))

    def streamed(i: int) -> list[Column]:
        return [event(i + k, "delta", x) for k, x in enumerate(cut)]

    ways = [
        F.array(event(0, "message", F.col("text"))),
        F.array(*streamed(0)),
        F.array(event(0, "message", draft), event(1, "delta", draft), event(2, "edit", F.col("text"))),
        F.array(event(0, "message", draft), event(1, "message", draft, 1), event(2, "regenerate", F.lit(None).cast("string")), *streamed(3)),
    ]
    way = F.pmod(F.xxhash64("conv_id", "place"), F.lit(len(ways)))
    chosen = ways[0]
    for k in range(1, len(ways)):
        chosen = F.when(way == k, ways[k]).otherwise(chosen)
    return turns.select("conv_id", F.explode(chosen).alias("e")).select("conv_id", "e.*")
