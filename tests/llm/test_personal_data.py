import hashlib
import math
import random
import re
from collections import defaultdict

from graphloom.llm.personal_data import BLOCK, KINDS, Bootstrap, personal_data

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
OPEN = re.compile(r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]*@[A-Za-z0-9.-]*|(?<![A-Za-z0-9])[+(]?[0-9](?:[\x20().:/-]{0,2}+[0-9])++(?![A-Za-z0-9@])")


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def valid(kind, token):
    digits = re.sub("[^0-9]", "", token)
    if kind == "ip":
        return all(int(x) <= 255 for x in token.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def plain(rows, how=Bootstrap()):
    """(doc_id, counts, base hash, spans, added) of each (doc_id, text), by a plain loop over a graph in dictionaries."""
    base, slots = [], {}
    for doc, text in rows:
        text = text or ""
        spans = {k: [(m.start(), m.end()) for m in p.finditer(text) if valid(k, m[0])] for k, p in PLAIN.items()}
        base.append(spans)
        every = [(a, b, k) for k in KINDS for a, b in spans[k]]
        for m in OPEN.finditer(text):
            fits = len(m[0]) <= 64 and ("@" in m[0] or how.digits <= len(re.sub("[^0-9]", "", m[0])) <= 19)
            if fits and not any(a < m.end() and m.start() < b for a, b, _ in every if _):
                every.append((m.start(), m.end(), None))
        for a, b, kind in every:
            words = [re.sub("[0-9]+", "#", w.lower()) for w in _before(text, a, kind, spans).split()]
            after = [re.sub("[0-9]+", "#", w.lower()) for w in _after(text, b, kind, spans).split()]
            patterns = {("1", *words[-1:])} if words else set()
            patterns |= {("2", *words[-2:])} if len(words) > 1 else set()
            patterns |= {("3", words[-1], after[0])} if words and after else set()
            slots[doc, text, a, b, kind] = (text[a:b].lower(), patterns)
    own = {}
    for (*_, kind), (identifier, _) in slots.items():
        if kind:
            own[identifier] = min(kind, own.get(identifier, kind))
    edges = defaultdict(set)
    for identifier, patterns in slots.values():
        for p in patterns:
            edges[p].add(identifier)
    score = {}
    for _ in range(how.rounds):
        sure = {}
        for p, members in edges.items():
            for kind in KINDS:
                seeds = sum(own.get(i) == kind for i in members)
                if seeds >= how.support:
                    confidence = (seeds + sum(score[i][1] for i in members if i in score and score[i][0] == kind)) / (len(members) + 1)
                    if confidence >= how.confidence:
                        sure[p, kind] = confidence
        miss = defaultdict(dict)
        for (p, kind), confidence in sure.items():
            for i in edges[p]:
                if i not in own and (kind == "email") == ("@" in i):
                    miss[i][kind] = miss[i].get(kind, 1.0) * (1 - min(confidence, 1 - 1e-9))
        best = {i: max(((k, 1 - m) for k, m in by.items()), key=lambda x: (x[1], -ord(x[0][0]))) for i, by in miss.items()}
        score = {i: b for i, b in best.items() if b[1] >= how.score - 1e-12}
    out = []
    for (doc, text), spans in zip(rows, base, strict=True):
        added = {k: [] for k in KINDS}
        for (d, t, a, b, kind), (identifier, _) in slots.items():
            if (d, t) == (doc, text or "") and kind is None and identifier in score:
                added[score[identifier][0]].append((a, b))
        said = lambda found: ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(found[k]))
        out.append((doc, *[len(spans[k]) for k in KINDS], hashlib.sha256(said(spans).encode()).hexdigest(), said({k: spans[k] + added[k] for k in KINDS}), sum(map(len, added.values()))))
    return sorted(out, key=repr)


def _matches(text, kind):
    return [(m.start(), m.end()) for m in (PLAIN[kind] if kind else OPEN).finditer(text)]


def _before(text, at, kind, spans):
    return text[max([b for _, b in _matches(text, kind) if b <= at], default=0) : at][-48:]


def _after(text, end, kind, spans):
    return text[end : min([a for a, _ in _matches(text, kind) if a >= end], default=len(text))][:48]


def found(documents, rows, how=Bootstrap()):
    return sorted((tuple(r) for r in personal_data(documents(rows), how).collect()), key=repr)


def test_forms(documents):
    texts = [
        "a.b@c.d@e.f", "x@y.z.@q.r", "1.2.3.4.5.6.7.8 and 256.1.1.1 and 001.2.03.255 9.9.9", "4111 1111 1111 1111, 4111-1111-1111-1112 and 4111111111111111 0", "+1 (555) 123-4567. +12 3 +1+2+345678901", "é日𝒳 me@host.org 日本",
        "a" * 5000 + "@", "1" * 40000, "1 " * 20000, "." * 3000 + "a@b.c", "+1" + " (" * 9000, "a@" * 4000, "@a.b", "x@-.-", "", None, " \n", "5" * 16, "+4111 1111 1111 1111 1.2.3.4",
    ]
    rows = list(enumerate(texts)) + [(None, "a@b.c"), (None, "a@b.c"), (3, "a@b.c")]
    assert found(documents, rows) == plain(rows)
    assert found(documents, []) == []


def test_random_texts(documents):
    r = random.Random(3)
    bits = ["a", "b.c", "@", ".", "1", "25", "+", "+1", " ", "-", "(", ")", "4111", "1111", "é", "x@y.z", "1.2.3.4", ",", "\n", "256", "0"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randrange(60)))) for i in range(400)]
    assert found(documents, rows) == plain(rows)


def test_many_matches_in_one_text(documents):
    rows = [(1, "é " + "a1@b.c, " * (3 * BLOCK + 5)), (2, "a1@b.c " * BLOCK)]
    assert found(documents, rows) == plain(rows)


def test_patterns_discover_identifiers(documents):
    r = random.Random(1)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    card = lambda: next(x for x in iter(lambda: digits(16), None) if luhn(x))
    bad = next(x for x in iter(lambda: digits(16), None) if not luhn(x))
    rows = [(i, f"please call Tel: +49 171 {digits(7)} now, pay by card no {card()} today") for i in range(12)]
    rows += [(100, "Tel: 030 1234567 now"), (101, f"card no {bad} today"), (102, "order of 12345678 pieces"), (103, "write to me@localhost soon")]
    rows += [(200 + i, f"mail: user{i}@example.org.") for i in range(9)] + [(300, "mail: admin@intranet and 12.5 kg"), (301, "elsewhere admin@intranet is named")]
    got = found(documents, rows)
    assert got == plain(rows)
    by = {x[0]: x for x in got}
    assert by[100][6] == "phone:5:16" and by[101][6] == "card:8:24" and by[300][6] == "email:6:20" and by[301][6] == "email:10:24" and by[102][6] == by[103][6] == ""
    assert all(by[d][1:5] == (0, 0, 0, 0) for d in (100, 101, 300))


def test_copies_are_no_support(documents):
    rows = [(i, "Fax: +49 171 5556667 ok") for i in range(40)] + [(99, "Fax: 030 1234567 ok")]
    assert {x[0]: x[6] for x in found(documents, rows)}[99] == ""
    assert math.isclose(Bootstrap().score, 0.8)
