"""Benchmark decontamination by template windows.

A text is turned into template tokens: words in lower case without marks around them; numbers become
``<num>``, a unit after a number ``<unit>``, a capitalised word ``<name>``, or, where it begins a sentence, ``<name>`` or
the word. Windows of KEY template tokens (or the whole of a shorter item or window) are hashed on both sides, in every mixture of readings of
their sentence starts, so a question is found again with other numbers, names, units or full stops. What meets by hash is compared token by token along the item, and decided by runs: stretches of
an item in which one value on one side stands for one value on the other. A run counts if its values are the same, if it
holds enough words of its own, or if it is the whole item and holds one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import mix64, signed, slices, texts_of, written

#: Template tokens in a window, and words of its own (no placeholders) that a re-parameterised run must have.
WINDOW, OWN_WORDS = 8, 5
#: Units of measure that become a placeholder after a number.
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t oz lb ml cl l s sec secs min mins h hr hrs ms day days week weeks month months year years "
    "second seconds minute minutes hour hours metre metres meter meters kilometre kilometres kilometer kilometers gram grams "
    "kilogram kilograms litre litres liter liters mile miles inch inches foot feet dollar dollars euro euros cent cents usd eur "
    "percent degree degrees c f k w kw v a j kj hz n pa bar".split()
)
#: Windows and bytes of token arrays of the benchmark that each task may hold; beyond either both sides are joined by a shuffle.
HELD_WINDOWS, HELD_BYTES = 2_000_000, 64 << 20

_UNITS = frozenset(x.encode() for x in UNITS)
_CORE = regex.compile(r"[\p{L}\p{N}](?:.*[\p{L}\p{N}])?", regex.DOTALL)
_NUMBER = regex.compile(r"[+-]?\p{N}[\p{N}.,:/]*")
_ENDS = regex.compile(r"[.!?:]\W*$")
_STOPS = frozenset(".!?:")
_MARKS = "".join(c for c in map(chr, range(128)) if not c.isalnum())
NUM, NAME, UNIT, EITHER, WORD = 1, 2, 3, 4, 0
#: Tokens that are hashed together at most: a longer window holds windows of so many, and these have 2^KEY mixtures of readings at most.
KEY = 8
_CODE = mix64(np.arange(1, 6, dtype=np.uint64))
_POLY = 0x9E3779B97F4A7C15


def _hash(word: str) -> int:
    """A hash of a word that is the same in every process."""
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


def _parts(token: str) -> tuple[str, bool]:
    """The token from its first letter or number to its last, and whether a sentence ends with it."""
    core = token.strip(_MARKS)
    if core.isalpha() or (core.isascii() and core.isalnum()):  # nearly all: what else is there are ASCII marks on either side
        tail = token[token.rindex(core) + len(core) :]
        if "_" not in tail:
            return core, not _STOPS.isdisjoint(tail)
    found = _CORE.search(token)
    return found[0] if found else "", bool(_ENDS.search(token))


class Templates:
    """Tokens of texts as arrays, with what is known of each spelling kept in a table for the next."""

    KEPT = 300_000

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self._forget()

    def _forget(self) -> None:
        self.known.clear()
        self.word, self.kind, self.end = np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, bool)
        self.new: tuple[list[int], list[int], list[bool]] = ([], [], [])

    def _learn(self, spelling: bytes) -> int:
        """Row of the hash of the word, what it may become (-1: only marks), and whether a sentence ends with it."""
        words, kinds, ends = self.new
        row = len(self.word) + len(words)
        if spelling.isalpha():  # letters a-z alone
            word = spelling.lower()
            words.append(xxhash.xxh3_64_intdigest(word))
            kinds.append(UNIT if word in _UNITS else NAME if spelling[0] < 97 else WORD)
            ends.append(False)
        else:
            core, end = _parts(spelling.decode("utf-8", "replace"))
            word = core.lower()
            words.append(_hash(word))
            kinds.append(-1 if not core else NUM if not core[0].isalpha() and _NUMBER.fullmatch(core) else UNIT if word in UNITS else NAME if core[:1].isupper() else WORD)
            ends.append(end)
        if len(spelling) <= 64:
            self.known[spelling] = row
        return row

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Value hash and kind of every token of all texts, and the offsets of each text's."""
        if len(self.word) > self.KEPT:
            self._forget()
        known, learn, at, parts = self.known, self._learn, [0], []
        for text in texts:
            tokens = text.split()  # bytes split at exactly \x20 and \x09-\x0D
            rows = list(map(known.get, tokens))
            i = -1
            for _ in range(rows.count(None)):
                i = rows.index(None, i + 1)
                row = known.get(tokens[i])
                rows[i] = learn(tokens[i]) if row is None else row
            parts.append(np.array(rows, np.int64))
            at.append(at[-1] + len(rows))
        if self.new[0]:
            self.word, self.kind, self.end = (np.concatenate([old, np.array(x, old.dtype)]) for old, x in zip((self.word, self.kind, self.end), self.new, strict=True))
            self.new = ([], [], [])
        offsets, flat = np.array(at), np.concatenate([np.zeros(0, np.int64), *parts])
        word, kind, end = self.word[flat], self.kind[flat], self.end[flat]
        begins = np.zeros(len(word) + 1, bool)
        begins[1:] = end
        begins[offsets[offsets <= len(word)]] = True
        kind[(kind == NAME) & begins[:-1]] = EITHER
        after = np.concatenate([[False], kind[:-1] == NUM])
        kind[(kind == UNIT) & ~after] = WORD
        real = kind >= 0
        kept = np.concatenate([[0], np.cumsum(real)])
        return word[real], kind[real], kept[offsets]


def _reading(value: np.ndarray, kind: np.ndarray, names: bool) -> np.ndarray:
    """Codes of template tokens; first words of sentences are names or words."""
    code = _CODE[np.where(kind == EITHER, NAME, kind)]
    return np.where((kind == WORD) | ((kind == EITHER) & (not names)), value, code)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_POLY, n, 1 << 64))


def _hashes(code: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    """For each length the hashes of so many tokens from each position on, put together from those of 1, 2, 4 ... tokens."""
    doubled, step, out = {1: code}, 1, {}
    while 2 * step <= max(lengths, default=0):
        h = doubled[step]
        doubled[2 * step] = h[:-step] * _power(step) + h[step:] if len(h) > step else h[:0]
        step *= 2
    for n in lengths:
        m, have, total = max(0, len(code) - n + 1), 0, None
        for step in sorted(doubled, reverse=True):
            if n & step:
                part = doubled[step][have : have + m] if m else code[:0]
                total = part if total is None else total * _power(step) + part
                have += step
        out[n] = total
    return out


def _window_hashes(code: np.ndarray, n: int, starts: np.ndarray) -> np.ndarray:
    """Hashes of the n tokens from each of these places; of few places one by one, of many for all places at once."""
    if n * len(starts) > 3 * len(code):
        return _hashes(code, [n])[n][starts]
    total = code[starts]
    for i in range(1, n):
        total = total * _power(1) + code[starts + i]
    return total


def _mixtures(value: np.ndarray, kind: np.ndarray, n: int, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(starts, hashes) of the windows of n tokens from these places in every mixture of readings of their
    sentence starts: all as words and all as names first, then those between of windows that have two or more."""
    if not len(starts):
        return
    words = _window_hashes(_reading(value, kind, False), n, starts)
    yield starts, words
    free = np.flatnonzero(kind == EITHER)
    before = np.concatenate([[0], np.cumsum(kind == EITHER)])
    many = before[starts + n] - before[starts]
    some = starts[many > 0]
    yield some, _window_hashes(_reading(value, kind, True), n, some)
    change = _CODE[NAME] - value[free]
    power = np.array([pow(_POLY, n - 1 - i, 1 << 64) for i in range(n)], np.uint64)
    for j in range(2, n + 1):
        every = np.flatnonzero(many == j)
        for c in range(0, len(every), 1 << 16):
            rows = every[c : c + (1 << 16)]
            at = starts[rows]
            place = before[at][:, None] + np.arange(j)
            step = change[place] * power[free[place] - at[:, None]]
            h, mask = words[rows], 0
            for i in range(1, 1 << j):  # Gray code: one reading changes at a time
                bit = (i & -i).bit_length() - 1
                mask ^= 1 << bit
                h = h + step[:, bit] if mask >> bit & 1 else h - step[:, bit]
                if mask != (1 << j) - 1:
                    yield at, h


def _pairs(value: np.ndarray, kind: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, hashes) of each token and the next in all their readings."""
    word, name = _reading(value, kind, False), _reading(value, kind, True)
    either = kind == EITHER
    every = np.arange(max(0, len(word) - 1))
    for one, two, where in ((word, word, None), (name, word, either[:-1]), (word, name, either[1:]), (name, name, either[:-1] & either[1:])):
        at = every if where is None else np.flatnonzero(where)
        yield at, one[at] * _power(1) + two[at + 1]


def _consistent(one: np.ndarray, two: np.ndarray, kind: np.ndarray, own_words: int) -> bool:
    """Whether the values of two windows of one template map onto each other one to one (all the same, if few words are its own)."""
    slots = kind != WORD
    if (one[slots] == two[slots]).all():
        return True
    if (~slots).sum() < own_words:
        return False
    pairs = set(zip(one[slots].tolist(), two[slots].tolist(), strict=True))
    return len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def _stretches(fit: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Where ``fit`` holds ``least`` times in a row or more."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], fit, [False]]).view(np.int8)))
    return [(a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b - a >= least]


def _one_to_one(pairs: set[tuple[int, int]]) -> bool:
    return len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def _runs(pairs: list[tuple[int, int] | None], least: int) -> list[tuple[int, int]]:
    """The longest stretches, ``least`` or more, whose pairs of values (None: a word of its own) are one to one."""
    if _one_to_one({x for x in pairs if x}):
        return [(0, len(pairs))]
    out, left = [], 0
    to: dict[int, list[int]] = {}
    back: dict[int, list[int]] = {}  # value: partner, times
    for right, pair in enumerate(pairs):
        if not pair:
            continue
        x, y = pair
        first = left
        while to.get(x, [y])[0] != y or back.get(y, [x])[0] != x:
            if left == first and right - left >= least:
                out.append((left, right))
            if gone := pairs[left]:
                for side, k in zip((to, back), gone, strict=True):
                    side[k][1] -= 1
                    if not side[k][1]:
                        del side[k]
            left += 1
        to.setdefault(x, [y, 0])[1] += 1
        back.setdefault(y, [x, 0])[1] += 1
    return [*out, (left, len(pairs))] if len(pairs) - left >= least else out


class Items:
    """Token arrays of benchmark items, and tables of the hashes of their windows by length."""

    def __init__(self, values: list[bytes], kinds: list[bytes], window: int, own_words: int) -> None:
        self.value, self.kind = np.frombuffer(b"".join(values), np.uint64), np.frombuffer(b"".join(kinds), np.int8)
        sizes = np.array([len(k) for k in kinds], np.int64)
        self.at, self.window, self.own_words = np.concatenate([[0], np.cumsum(sizes)]), window, own_words
        owner = np.repeat(np.arange(len(sizes)), sizes)
        place, length = np.arange(len(owner)), np.minimum(sizes, min(window, KEY))[owner]
        starts = np.flatnonzero(place + length <= self.at[owner + 1])
        lengths = np.unique(length).tolist()
        rows: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {n: [] for n in lengths}
        for n in lengths:
            for own, h in _mixtures(self.value, self.kind, n, starts[length[starts] == n]):
                rows[n].append((h, own))
        # A window of a text can be an item's only if each two tokens in a row are two in a row of an item, in some reading.
        both = np.concatenate([h for _, h in _pairs(self.value, self.kind)])
        self.pair_mask = np.uint64((1 << min(25, max(16, (32 * len(both)).bit_length()))) - 1)
        self.pairs = np.zeros(int(self.pair_mask) + 1, bool)
        self.pairs[(both & self.pair_mask).view(np.int64)] = True
        self.tables = {}
        for n, parts in rows.items():
            h, own = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
            order = np.lexsort((own, h))
            h, own = h[order], own[order]
            once = np.concatenate([[True], (h[1:] != h[:-1]) | (own[1:] != own[:-1])])
            h, own = h[once], own[once]
            mask = (1 << min(25, max(16, (16 * len(h)).bit_length()))) - 1
            near = np.zeros(mask + 1, bool)
            near[(h & np.uint64(mask)).view(np.int64)] = True
            self.tables[n] = h, own, owner[own], near, np.uint64(mask)

    def met(self, made) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(window length, starts in the texts, first and last row of the table) of windows whose hash the items have."""
        value, kind, at = made
        fits = np.zeros(max(0, len(value) - 1), bool)
        for places, h in _pairs(value, kind):
            fits[places] |= self.pairs[(h & self.pair_mask).view(np.int64)]
        in_a_row = np.concatenate([[0], np.cumsum(fits)])
        for n, (held, _, _, near, mask) in self.tables.items():
            starts = np.arange(max(0, len(value) - n + 1))
            starts = starts[in_a_row[starts + n - 1] - in_a_row[starts] == n - 1]
            for c in range(0, len(starts), 1 << 16):
                own, every = self._readings(value, kind, n, starts[c : c + (1 << 16)])
                hits = np.flatnonzero(near[(every & mask).view(np.int64)])
                low, high = (np.searchsorted(held, every[hits], side) for side in ("left", "right"))
                hits = own[hits]
                text = np.searchsorted(at, hits, "right") - 1
                sure = (high > low) & (hits + n <= at[text + 1])  # windows that run over the end of a text are none
                yield n, hits[sure], low[sure], high[sure]

    def _readings(self, value: np.ndarray, kind: np.ndarray, n: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows of n tokens in those readings in which each two tokens in a row are two in a row of an item."""
        word, either = _reading(value, kind, False), kind == EITHER
        at, total, last = starts, np.zeros(len(starts), np.uint64), None
        for i in range(n):
            free = np.flatnonzero(either[at + i])
            code = np.concatenate([word[at + i], np.full(len(free), _CODE[NAME])])
            at, total = np.concatenate([at, at[free]]), np.concatenate([total, total[free]])
            if last is not None:
                last = np.concatenate([last, last[free]])
                fits = np.flatnonzero(self.pairs[((last * _power(1) + code) & self.pair_mask).view(np.int64)])
                at, total, code = at[fits], total[fits], code[fits]
            total, last = total * _power(1) + code, code
        return at, total

    def find(self, made) -> list[tuple[int, int, int]]:
        """(text, item, windows of the text that are in runs that count)."""
        at, lines = made[2], set()
        for n, hits, low, high in self.met(made):
            _, own, owner, _, _ = self.tables[n]
            text = np.searchsorted(at, hits, "right") - 1
            for i, j, a, b in zip(text.tolist(), hits.tolist(), low.tolist(), high.tolist(), strict=True):
                lines.update((i, k, j - p) for k, p in zip(owner[a:b].tolist(), own[a:b].tolist(), strict=True))
        found: dict[tuple[int, int], set[int]] = defaultdict(set)
        for i, k, shift in lines:
            if got := self._along(made, i, k, shift):
                found[i, k].update(got)
        return [(i, k, len(x)) for (i, k), x in found.items()]

    def _along(self, made, i: int, k: int, shift: int) -> list[int]:
        """Starts of the windows of text i in runs that count, where item k lies ``shift`` tokens before it."""
        value, kind, at = made
        size = int(self.at[k + 1] - self.at[k])
        begin, end = max(int(at[i]), int(self.at[k]) + shift), min(int(at[i + 1]), int(self.at[k + 1]) + shift)
        one, two = self.value[begin - shift : end - shift], value[begin:end]
        own_kind, its_kind = self.kind[begin - shift : end - shift], kind[begin:end]
        is_name = ((own_kind == NAME) | (own_kind == EITHER)) & ((its_kind == NAME) | (its_kind == EITHER))
        same = one == two
        own = same & ((own_kind == WORD) | (own_kind == EITHER) | (its_kind == WORD) | (its_kind == EITHER))
        out, least = [], min(self.window, size)
        slot = np.where(own, WORD, NUM)  # for _consistent: what is no word of its own is a placeholder
        strict = (own_kind != WORD) | (its_kind != WORD)
        for a, b in _stretches(same | is_name | ((own_kind == its_kind) & ((own_kind == NUM) | (own_kind == UNIT))), least):
            pairs = [(x, y) if s else None for x, y, s in zip(one[a:b].tolist(), two[a:b].tolist(), strict[a:b].tolist(), strict=True)]
            good: list[tuple[int, int]] = []
            for c, d in _runs(pairs, least):
                run = slice(a + c, a + d)
                if _consistent(one[run], two[run], slot[run], 1 if d - c == size else self.own_words):
                    good.append((c, d))
                else:
                    good += [(c + x, c + y) for x, y in _stretches(same[run], least)]
            taken: set[tuple[int, int]] = set()
            for c, d in sorted(good, key=lambda x: x[0] - x[1]):  # one mapping for the stretch: that of its longest run
                if _one_to_one(both := taken | {x for x in pairs[c:d] if x}):
                    taken = both
                    out += range(begin + a + c, begin + a + d - least + 1)
        return out


def _rows_of(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))], names)


def _tokens(window: int):
    """(id, text) -> (id, number of windows, values, kinds)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        for batch in batches:
            ids, texts = batch["id"].to_pylist(), texts_of(batch["text"])
            for a, b in slices(texts):
                value, kind, at = templates.of(texts[a:b])
                spans = [(ids[a + i], slice(at[i], at[i + 1])) for i in range(b - a) if at[i + 1] > at[i]]
                sizes = [max(1, int(x.stop - x.start) - window + 1) for _, x in spans]
                columns = [pa.array([i for i, _ in spans], pa.int64()), pa.array(sizes, pa.int64()), *[pa.array([y[x].tobytes() for _, x in spans], pa.binary()) for y in (value, kind)]]
                yield pa.RecordBatch.from_arrays(columns, ["id", "windows", "values", "kinds"])

    return run


_FOUND = "doc_id long, row long, item_id long, item_row long, windows long"


def _held_join(items: "pa.Table", window: int, own_words: int):
    """Documents (id, row, text) against items held in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        held = Items(items["values"].to_pylist(), items["kinds"].to_pylist(), window, own_words)
        names, keys = items["id"].to_pylist(), items["item_row"].to_pylist()
        for batch in batches:
            ids, rows, texts, out = batch["id"].to_pylist(), batch["row"].to_pylist(), texts_of(batch["text"]), []
            for a, b in slices(texts):
                out += [(ids[a + i], rows[a + i], names[k], keys[k], n) for i, k, n in held.find(templates.of(texts[a:b]))]
            yield _rows_of(out, ["doc_id", "row", "item_id", "item_row", "windows"])

    return run


def _item_hashes(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch["item_row"].to_pylist()
            tables = Items(batch["values"].to_pylist(), batch["kinds"].to_pylist(), window, 1).tables
            for n, (h, _, owner, _, _) in tables.items():
                yield _rows_of(list(zip(signed(h).tolist(), [n] * len(h), [keys[k] for k in owner.tolist()], strict=True)), ["hash", "n", "item_row"])

    return run


def _text_hashes(lengths: list[int]):
    """(id, row, text) -> (hash, n, id, row) of every window in all its readings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        for batch in batches:
            ids, rows, texts = batch["id"], batch["row"].to_numpy(), texts_of(batch["text"])
            for a, b in slices(texts):
                value, kind, at = templates.of(texts[a:b])
                every = ((n, own, h) for n in lengths for own, h in _mixtures(value, kind, n, np.arange(max(0, len(value) - n + 1))))
                for n, own, h in every:
                    text = np.searchsorted(at, own, "right") - 1
                    sure = np.flatnonzero(own + n <= at[text + 1])
                    for c in range(0, len(sure), 50_000):
                        some = sure[c : c + 50_000]
                        columns = [pa.array(signed(h[some])), pa.array(np.full(len(some), n)), ids.take(pa.array(a + text[some])), pa.array(rows[a + text[some]])]
                        yield pa.RecordBatch.from_arrays(columns, ["hash", "n", "id", "row"])

    return run


def _checked(window: int, own_words: int):
    """Rows sorted by item_row: one item and one text that share a window's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates, last, held = Templates(), None, None
        for batch in batches:
            out, columns = [], [batch[c].to_pylist() for c in ("id", "row", "item_id", "item_row", "values", "kinds")]
            for text, doc, row, item, key, value, kind in zip(texts_of(batch["text"]), *columns, strict=True):
                if key != last:
                    last, held = key, Items([value], [kind], window, own_words)
                out += [(doc, row, item, key, n) for _, _, n in held.find(templates.of([text]))]
            yield _rows_of(out, ["doc_id", "row", "item_id", "item_row", "windows"])

    return run


def _found(docs: DataFrame, benchmark: DataFrame, window: int, own_words: int, held: int) -> DataFrame:
    """``doc_id, row, item_id, item_row, windows`` of pairs of a distinct document row and a distinct item row; null ids
    are ids like others. ``row`` is the hash of the text."""
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("row"), text.alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), text.alias("text")).distinct()
    items = written(items.mapInArrow(_tokens(window), "id long, windows long, values binary, kinds binary"), "items")
    items = items.withColumn("item_row", F.xxhash64("id", "values", "kinds"))
    size = items.agg(F.sum("windows"), F.sum(F.octet_length("values") + F.octet_length("kinds"))).head()
    if (size[0] or 0) <= held and (size[1] or 0) <= HELD_BYTES:
        own = items.select("id", "item_row", "values", "kinds").toArrow()  # HELD_BYTES at most
        return texts.mapInArrow(_held_join(own, window, own_words), _FOUND).distinct()
    own = items.mapInArrow(_item_hashes(window), "hash long, n long, item_row long").distinct()
    lengths = sorted(r[0] for r in own.select("n").distinct().collect())  # as many as a window has tokens at most
    near = texts.select("id", "row", "text").mapInArrow(_text_hashes(lengths), "hash long, n long, id long, row long")
    near = near.join(own, ["hash", "n"]).select("id", "row", "item_row").distinct().select(F.col("id").alias("d"), F.col("row").alias("r"), "item_row")
    once = texts.dropDuplicates(["id", "row"])
    pairs = near.join(once, (F.col("r") == F.col("row")) & F.col("d").eqNullSafe(F.col("id"))).drop("d", "r")
    pairs = pairs.join(items.select(F.col("id").alias("item_id"), "item_row", "values", "kinds").dropDuplicates(["item_row"]), "item_row")
    columns = ["id", "row", "item_id", "item_row", "values", "kinds", "text"]
    return pairs.select(*columns).sortWithinPartitions("item_row").mapInArrow(_checked(window, own_words), _FOUND)


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, own_words: int = OWN_WORDS, least: int = 1, held: int = HELD_WINDOWS) -> DataFrame:
    """``doc_id, item_id, windows``: the documents that repeat a benchmark item, and how many of their windows do.

    docs (doc_id, text), benchmark (item_id, text). Every window of ``window`` template tokens of every text is looked up; an
    item of fewer tokens is one window of its own length. A text without tokens has none. A null id is an id
    like others (``decontaminate`` drops such rows too); repeated rows and items add nothing, windows of several texts under
    one id add up. The benchmark's windows and bytes are counted, and its items held by each task if they are ``held``
    and HELD_BYTES at most; otherwise hashes of both sides are joined first, and texts and items that share one
    compared in the same way, with the same results. Empty tables give none; extra columns are ignored.
    """
    pairs = _found(docs, benchmark, window, own_words, held)
    return pairs.groupBy("doc_id", "item_id").agg(F.sum("windows").alias("windows")).where(F.col("windows") >= least)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, own_words: int = OWN_WORDS, least: int = 1, held: int = HELD_WINDOWS) -> DataFrame:
    """``docs`` without the rows whose text repeats a benchmark item in ``least`` windows or more. Rows are told apart by
    id and text: another text under the same id stays, and rows with a null id are judged like others."""
    pairs = _found(docs, benchmark, window, own_words, held)
    go = pairs.groupBy("doc_id", "row", "item_row").agg(F.sum("windows").alias("n")).where(F.col("n") >= least)
    go = go.select(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).distinct()
    same = (F.xxhash64(F.col("text").cast("string")) == F.col("__row")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__id"))
    return docs.join(go, same, "left_anti")
