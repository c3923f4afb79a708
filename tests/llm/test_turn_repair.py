import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import pytest

from graphloom.llm.turn_repair import CODES, Costs, Repair, damage, repair

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def cheapest(codes, costs):
    """(cost, audit, roles by edit) by Dijkstra over (turn, state), the least audit first among equal costs."""
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, q, kept = heapq.heappop(heap)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == len(codes) and q in (0, 3):
            heap_best = [x for x in heap if x[0] == cost and x[2] == len(codes) and x[3] in (0, 3) and x[1] < audit]
            return min([(cost, audit, kept), *[(x[0], x[1], x[4]) for x in heap_best]])
        for symbol in "ua":
            if (q, symbol) in NEXT:
                heapq.heappush(heap, (cost + costs.insert, audit + "I", i, NEXT[q, symbol], (*kept, (None, symbol))))
        if i < len(codes):
            symbol, fault = divmod(CODES.index(codes[i]), 4)
            heapq.heappush(heap, (cost + costs.delete, audit + "D", i + 1, q, kept))
            if fault in (0, 3):
                stay = cost + costs.truncated * (fault == 3)
                own = "sua?"[symbol]
                if (q, own) in NEXT:
                    heapq.heappush(heap, (stay, audit + "K", i + 1, NEXT[q, own], (*kept, (i, own))))
                for to in "ua":
                    if (q, to) in NEXT:
                        heapq.heappush(heap, (stay + costs.rerole, audit + "R", i + 1, NEXT[q, to], (*kept, (i, to))))
    raise AssertionError


@pytest.mark.parametrize("costs", [Costs(), Costs(1, 4, 1, 1), Costs(3, 2, 1, 9), Costs(5, 5, 1, 1), Costs(2, 7, 3, 2)])
def test_layers_find_the_least_audit(costs):
    r = random.Random(costs.delete)
    for _ in range(600):
        codes = "".join(r.choice("EIA" if r.random() < 0.5 else CODES) for _ in range(r.randrange(9)))
        cuts = sorted(r.randrange(len(codes) + 1) for _ in range(r.randrange(3)))
        blocks = [codes[a:b] for a, b in zip([0, *cuts], [*cuts, len(codes)], strict=True)]
        cost, edits = repair(["".join(c + "|" for c in b) for b in blocks if b], costs)
        audit = "".join(edits).replace("|", "").translate(str.maketrans("uaUA", "RRII"))
        want = cheapest(codes, costs)
        if not codes:
            assert (cost, audit) == (0, "")
        else:
            assert (cost, audit) == want[:2], codes


def test_long_conversation_is_linear():
    cost, edits = repair(["I|E|" * 2048] * 50)
    assert cost == 4 and "".join(edits).replace("|", "") == "D" + "K" * 204798 + "D"


def plain(rows):
    """Figures and digest of each conversation (conv_id, turn, role, text), row by row."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        space = lambda x: " " if x is None else x
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        by[conv] += []
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        by[conv] += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        codes, seen = "", set()
        for _, role, text in turns:
            solid = text.rstrip(" \t\n\x0b\x0c\r")
            fault = 1 if not solid else 2 if (role, text) in seen else 3 if solid[-1] not in ".!?" else 0
            seen.add((role, text))
            codes += CODES[4 * ("sua".find(role[:1]) if role[:1] and role[:1] in "sua" else 3) + fault]
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        cost, audit, kept = cheapest(codes, Costs()) if codes else (0, "", ())
        said = "\n".join(("user" if to == "u" else "assistant") + ":" if i is None else (turns[i][1] if "sua?"[CODES.index(codes[i]) // 4] == to else "user" if to == "u" else "assistant") + ":" + turns[i][2] for i, to in kept)
        faults = [sum(CODES.index(c) % 4 == f for c in codes) for f in (1, 2, 3)]
        out[conv] = (gaps, *faults, illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest())
    return out


SCHEMA = "conv_id long, turn long, role string, text string, pos long, edits string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "clash") for r in rows], SCHEMA)


def test_against_a_plain_loop(spark):
    r = random.Random(5)
    said = ["Yes.", "No!", "and so", "", None, " \t", "Why? ", "é日.", "b\nc", "x" * 50000 + ".", "x" * 50000]
    rows = [(r.choice([None, 1, 2, *range(10, 30)]), r.choice([None, *range(9)]), r.choice(["user", "assistant", "system", None, "", "tool", "usher"]), r.choice(said)) for _ in range(260)]
    rows += rows[:40]
    got = {x[0]: tuple(x)[1:] for x in Repair(damage(table(spark, rows))).digests().collect()}
    assert got == plain(rows)


def test_empty_and_dropped(spark):
    assert Repair(damage(table(spark, []))).digests().collect() == []
    gone = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    found = Repair(damage(table(spark, [(1, gone, "user", "Hi.")]))).digests().collect()
    assert [tuple(x) for x in found] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_one_conversation_over_many_blocks(spark, monkeypatch):
    """A conversation that several partitions and blocks share, half of it one turn repeated."""
    from graphloom.llm import turn_repair

    monkeypatch.setattr(turn_repair, "BLOCK_BITS", 3)
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"Turn {i}.") for i in range(150)] + [(1, i, "user", "Same.") for i in range(100)] + [(2, 0, "user", "Hi.")]
    got = {x[0]: tuple(x)[1:] for x in Repair(damage(table(spark, rows).repartition(7))).digests().collect()}
    assert got == plain(rows)


def test_repaired_turns(spark):
    rows = [(1, 1, "user", "Hi.", 1), (1, 2, "user", "Hello!", 1), (1, 3, "user", "Hi.", 2), (2, 1, "tool", "A.", 1), (2, 2, "assistant", "B.", 1)]
    made = Repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies long"))
    got = sorted(((x.conv_id, x.pos, x.place, x.role, x.text) for x in made.repaired().collect()))
    assert [(x[0], x[3], x[4]) for x in got] == [(1, "user", "Hi."), (1, "assistant", "Hello!"), (2, "user", "A."), (2, "assistant", "B.")]
