"""Exact token counts of a byte-level BPE tokenizer by compiled finite-state transducers.

Two deterministic transducers are made from the tokenizer's file:

* ``PieceSplitter`` reads character classes and marks on its transitions where a piece of the
  split pattern begins (before the character read, or before the one ahead of it). A batch of texts is cut
  into equal chunks; each chunk's map from start state to end state is found for all chunks at once, the maps
  compose by a parallel prefix scan, and the marks follow from each chunk's true start state.
* ``CountingTransducer`` reads the bytes of a piece; every transition carries the change in the number of
  tokens emitted for what has been read. A state holds, for each place where a token may still be
  open, the trie node, the token before it and the count there relative to now. That is
  finite, since a BPE encoding is the one whose neighbouring tokens are each others' encoding, so the
  last token of every prefix is determined by the last token where it begins. States are compiled when first met.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import slices

#: States and pieces kept by a worker before it starts afresh; bounds memory, never results.
KEPT_STATES, KEPT_PIECES = 200_000, 400_000

(START, LETTERS, DIGITS, OTHERS, SPACE, BLANK, SPACES, BLANKS, QUOTE, QUOTE_RV, QUOTE_L, SHORT) = range(12)
STATES = 12
(END, LETTER, NUMBER, GAP, WHITE, OTHER, APOSTROPHE, STMD, RV, L, E) = range(11)
HERE, BEHIND = 1, 2


def _step(state: int, kind: int) -> tuple[int, int]:
    """Next state and marks. The pattern: contractions 's 't 're 've 'm 'll 'd; an optional space before
    letters, numbers or others; white space up to the last one before something else; white space."""
    letter = kind in (LETTER, STMD, RV, L, E)
    white = kind in (GAP, WHITE)
    if state in (QUOTE_RV, QUOTE_L):
        if kind == (E if state == QUOTE_RV else L):
            return SHORT, 0
        then, marks = _step(LETTERS, kind)
        return then, marks | BEHIND
    if kind == END:
        return START, HERE
    fresh = LETTERS if letter else DIGITS if kind == NUMBER else OTHERS if kind == OTHER else QUOTE if kind == APOSTROPHE else SPACE if kind == GAP else BLANK
    if state == LETTERS and letter or state == DIGITS and kind == NUMBER or state == OTHERS and fresh in (OTHERS, QUOTE):
        return state, 0
    if state == QUOTE:
        if kind in (STMD, RV, L):
            return {STMD: SHORT, RV: QUOTE_RV, L: QUOTE_L}[kind], 0
        if fresh in (OTHERS, QUOTE):
            return OTHERS, 0
    if state in (SPACE, BLANK, SPACES, BLANKS):
        if white:
            return (SPACES if kind == GAP else BLANKS), 0
        if state in (SPACE, SPACES):
            return (OTHERS if fresh == QUOTE else fresh), BEHIND if state == SPACES else 0
        return fresh, HERE | BEHIND if state == BLANKS else HERE
    return fresh, HERE


@functools.cache
def character_classes() -> np.ndarray:
    """The class of every code point."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", WHITE)):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            table[a : b + 1] = kind
    table[0xD800:0xE000] = OTHER
    for chars, kind in ((" ", GAP), ("'", APOSTROPHE), ("stmd", STMD), ("rv", RV), ("l", L), ("e", E)):
        table[[ord(c) for c in chars]] = kind
    return table


class PieceSplitter:
    #: Characters of a chunk for which all start states are followed before looking whether they agree.
    WARM = 24

    def __init__(self) -> None:
        moves = np.array([[_step(s, k) for s in range(STATES)] for k in range(11)])
        self.to, self.marks = moves[:, :, 0].ravel().astype(np.uint8), moves[:, :, 1].ravel().astype(np.uint8)

    def chunk_maps(self, kinds: np.ndarray) -> np.ndarray:
        """kinds: (steps, chunks). The state map of each chunk: (chunks, states)."""
        rows = kinds.astype(np.int32) * STATES
        lanes = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (rows.shape[1], STATES))
        for t in range(min(self.WARM, len(rows))):
            lanes = self.to[rows[t][:, None] + lanes]
        if len(rows) > self.WARM:
            lanes = lanes.copy()
            agreed = (lanes == lanes[:, :1]).all(1)
            one = lanes[:, 0]
            for t in range(self.WARM, len(rows)):
                one = self.to[rows[t] + one]
            open_ = np.flatnonzero(~agreed)
            if len(open_):
                some = lanes[open_]
                for t in range(self.WARM, len(rows)):
                    some = self.to[rows[t][open_][:, None] + some]
            lanes[:] = one[:, None]
            if len(open_):
                lanes[open_] = some
        return lanes

    @staticmethod
    def scan(maps: np.ndarray) -> np.ndarray:
        """Inclusive prefix composition of state maps, in log2(chunks) rounds."""
        out, reach = maps.copy(), 1
        while reach < len(out):
            out[reach:] = np.take_along_axis(out[reach:], out[:-reach].astype(np.intp), 1) if reach else out
            reach *= 2
        return out

    def starts(self, kinds: np.ndarray) -> np.ndarray:
        """Positions where pieces begin (an END is a piece too)."""
        n = len(kinds)
        steps = max(64, 1 << max(0, (n // 1024).bit_length()))
        chunks = -(-n // steps)
        grid = np.full(chunks * steps, END, np.uint8)
        grid[:n] = kinds
        grid = np.ascontiguousarray(grid.reshape(chunks, steps).T)
        ends = self.scan(self.chunk_maps(grid))[:, START]
        state = np.concatenate([[START], ends[:-1]]).astype(np.uint8)
        marks = np.empty(grid.shape, np.uint8)
        for t in range(steps):
            at = grid[t].astype(np.int32) * STATES + state
            marks[t] = self.marks[at]
            state = self.to[at]
        marks = marks.T.ravel()[:n]
        begin = (marks & HERE).astype(bool)
        begin[:-1] |= (marks[1:] & BEHIND).astype(bool)
        return np.flatnonzero(begin)


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the tokenizer's file: printable bytes for themselves, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class CountingTransducer:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        added = {x["content"] for x in file["added_tokens"]}
        self.special = [x["content"] for x in file["added_tokens"]]
        self.rank = {}
        for i, pair in enumerate(file["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault((raw(a), raw(b)), i)
        self.vocabulary = {raw(t) for t in file["model"]["vocab"] if t not in added}
        self.prefixes = {t[:i] for t in self.vocabulary for i in range(len(t) + 1)}
        self.longest = max(map(len, self.vocabulary))
        self.fits = functools.lru_cache(1 << 18)(self._fits)
        self._reset()

    def _reset(self) -> None:
        first = ((b"", b"", 0),)
        self.number, self.states, self.moves = {first: 0}, [first], [{}]

    def merge(self, data: bytes) -> list[bytes]:
        """The encoding of a short string by its merges, lowest rank first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            pair = parts[best], parts[best + 1]
            if pair not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                if tuple(parts[i : i + 2]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _fits(self, before: bytes, token: bytes) -> bool:
        """Whether the token may follow that token (or begin, if there is none)."""
        return self.merge(before + token) == ([before, token] if before else [token])

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        tail, grown, delta = bytes([byte]), [], None
        for node, before, count in self.states[state]:
            node += tail
            if node in self.prefixes:
                grown.append((node, before, count))
                if node in self.vocabulary and self.fits(b"", node) and self.fits(before, node):
                    token, delta = node, count + 1
        if delta is None:
            raise ValueError(f"the vocabulary has no token for byte {byte}")
        key = tuple((node, before, count - delta) for node, before, count in grown) + ((b"", token, 0),)
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        self.moves[state][byte] = to, delta
        return to, delta

    def count(self, piece: bytes) -> int:
        if len(self.states) > KEPT_STATES:
            self._reset()
        state = total = 0
        for byte in piece:
            state, delta = self.moves[state].get(byte) or self.compile(state, byte)
            total += delta
            if len(self.states) > 2 * KEPT_STATES:  # a piece that long: go on from the state itself
                now = self.states[state]
                self._reset()
                state = self.number.setdefault(now, len(self.states))
                if state == len(self.states):
                    self.states.append(now)
                    self.moves.append({})
        return total


class TokenCounter:
    def __init__(self, path: str) -> None:
        self.transducer, self.splitter, self.known = CountingTransducer(path), PieceSplitter(), {}
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.transducer.special, key=len, reverse=True))) or r"(?!)")

    def counts(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text. Added tokens found in a text count as one."""
        parts: list[str] = []
        upto, extra = [], []
        for text in texts:
            own = self.special.split(text)
            parts += own
            extra.append(len(own) - 1)
            upto.append(len(parts))
        joined = "\0".join([*parts, ""])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = character_classes()[points]
        stop = np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))) - 1
        kinds[stop] = END
        begin = self.splitter.starts(kinds)
        own = kinds[begin] != END
        end = np.append(begin[1:], len(joined))
        text_of = np.searchsorted(stop[np.array(upto) - 1], begin[own])
        pieces = [joined[a:b] for a, b in zip(begin[own].tolist(), end[own].tolist(), strict=True)]
        found = list(map(self.known.get, pieces))
        if None in found:
            for i, n in enumerate(found):
                if n is None:
                    piece = pieces[i]
                    n = self.known.get(piece)
                    if n is None:
                        n = self.transducer.count(piece.encode("utf-8", "surrogatepass"))
                        if len(self.known) > KEPT_PIECES:
                            self.known.clear()
                        if len(piece) <= 64:
                            self.known[piece] = n
                    found[i] = n
        return np.bincount(text_of, weights=found, minlength=len(texts)).astype(np.int64) + np.array(extra, np.int64)


@functools.cache
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs`` (doc_id, text).

    ``path``: the tokenizer's JSON file (byte-level BPE with the pattern above), the same on every
    machine. No begin or end tokens; the file's added tokens count as one where a text has their string. A
    null text is empty and has no tokens. Rows with null or repeated ids are counted like others, no
    row is looked at twice, and other columns are ignored. One map over the rows, without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch["text"].to_pylist()]
            sizes = [len(t.encode("utf-8")) for t in texts]
            counts = [np.zeros(0, np.int64)]
            for a, b in slices(texts):  # type: ignore[arg-type]
                counts.append(counter(path).counts(texts[a:b]))
            n = np.concatenate(counts)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
