import hashlib
import pickle
import random
import unicodedata
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import chat_format as chat
from graphloom.llm import decontaminate as dc
from graphloom.llm import fixity as fx
from graphloom.llm import language_id as li
from graphloom.llm import toxicity as tx

ITEM = "In the village Anna Berg sold 12 kg of apples to her friend Otto for 30 euros. How many apples did she keep after the market closed?"
OTHER = "In the village Maria Lund sold 45 kg of apples to her friend Karl for 99 euros. How many apples did she keep after the market closed?"


def found(df, bench, **how):
    return {(r["doc_id"], r["item_id"]) for r in dc.contaminated(df, bench, **how).collect()}


def test_decontamination(spark, documents):
    filler = " ".join(f"word{i}" for i in range(40))
    rows = [(1, filler + " " + ITEM + " " + filler), (2, f"{filler} {OTHER}"), (3, filler), (4, None), (5, ""), (None, ITEM), (6, ITEM.upper().lower()), (7, ITEM.replace(" ", "*** ")), (8, ITEM), (8, filler)]
    bench = spark.createDataFrame([(10, ITEM, "x"), (10, ITEM, "x"), (11, None, "x"), (12, "too short", "x"), (None, ITEM, "x")], "item_id long, text string, doc_id string")
    want = {(d, 10) for d in (1, 2, 7, 8)}
    assert found(documents(rows), bench) >= want and not {d for d, _ in found(documents(rows), bench)} & {3, 4, 5}
    assert found(documents(rows), bench, held=0) == found(documents(rows), bench)
    assert found(documents([]), bench) == set() and found(documents(rows), bench.limit(0)) == set()
    kept = dc.decontaminate(documents(rows), bench)
    ids = sorted((r[0] for r in kept.select("doc_id").collect()), key=repr)
    assert set(ids) >= {3, 4, 5, 8} and None not in ids and ids.count(8) == 1 and kept.columns == documents([]).columns


def windows(df, bench, **how):
    return sorted(tuple(r) for r in dc.contaminated(df, bench, **how).collect())


def test_number_dense_items_and_first_names(spark, documents):
    items = ["John paid 15 dollars for 3 books and 2 pens.", "Calculate 12 + 7 * 3 - 4 / 5 + 8 * 6 - 1 .", "The river runs past seven mills and farms"]
    texts = ["Mary paid 40 dollars for 6 books and 5 pens.", "so Calculate 15 + 9 * 2 - 7 / 11 + 3 * 20 - 8 . then", "text without an end The river runs past seven mills and farms", "Mary paid 40 dollars for 6 books and a coat."]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = documents(list(enumerate(texts)))
    assert windows(df, bench) == windows(df, bench, held=0) == [(0, 0, 3), (1, 1, 2), (2, 2, 1)]


def test_short_items(spark, documents):
    bench = spark.createDataFrame([(1, "What is the capital of France?"), (2, "Add 3 and 4"), (3, "7 8")], "item_id long, text string")
    df = documents([(1, "so What is the capital of France? we ask"), (2, "is the capital of France? we ask"), (3, "please add 5 and 9"), (4, "1 2"), (5, "x 7 8 y"), (6, "What is"), (7, "the capital of France?")])
    assert windows(df, bench) == windows(df, bench, held=0) == [(1, 1, 1), (3, 2, 1), (5, 3, 1)]


def slow_windows(text, item, window, own_words):
    """Windows of a text in runs that count, over all alignments with the item in which one window of eight tokens reads the same."""
    templates = dc.Templates()
    made = templates.of([text.encode()])
    value, kind, _ = templates.of([item.encode()])
    items = dc.Items([value.tobytes()], [kind.tobytes()], window, own_words)

    def alike(i, j):
        a, b = kind[i], made[1][j]
        word = a in (dc.WORD, dc.EITHER) and b in (dc.WORD, dc.EITHER) and value[i] == made[0][j]
        return word or (a in (dc.NAME, dc.EITHER) and b in (dc.NAME, dc.EITHER)) or (a == b and a in (dc.NUM, dc.UNIT))

    n, found = min(len(kind), window, dc.KEY), set()
    for shift in range(-len(kind), len(made[1])):
        fit = [0 <= i + shift < len(made[1]) and alike(i, i + shift) for i in range(len(kind))]
        if n and any(all(fit[i : i + n]) for i in range(len(kind) - n + 1)):
            found.update(items._along(made, 0, 0, shift))
    return len(found)


@pytest.mark.parametrize("window", [3, 8, 11])
def test_every_reading_of_sentence_starts(spark, documents, window):
    """Items and texts of few words with random full stops and capitals, against all alignments one by one."""
    r = random.Random(window)
    words = ["yes", "no", "anna", "bought", "12", "kg", "pears", "the", "7", "why", "old"]

    def said(tokens):
        return " ".join((w.title() if r.random() < 0.5 else w) + r.choice(["", "", ".", "!"]) for w in tokens)

    items = [[r.choice(words) for _ in range(r.choice([4, 9, 14]))] for _ in range(12)]
    bench = [(k, said(item)) for k, item in enumerate(items)]
    texts = [(100 + i, said([r.choice(words) for _ in range(5)] + items[i % 12][i % 3 :] + [r.choice(words)])) for i in range(40)]
    df, b = documents(texts), spark.createDataFrame(bench, "item_id long, text string")
    want = sorted((d, k, n) for d, text in texts for k, item in bench if (n := slow_windows(text, item, window, 5)))
    assert want and windows(df, b, window=window) == windows(df, b, window=window, held=0) == want


def test_full_stops_hide_nothing(spark, documents):
    bench = spark.createDataFrame([(1, "Yes. No. Why. So. Go. Up. On. It. end"), (2, "yesterday old Anna bought red pears the next")], "item_id long, text string")
    df = documents([(1, "Yes. No. Why. so Go. Up. On. It. end"), (2, "... old. Yesterday old. Anna bought red pears. The next")])
    assert windows(df, bench) == windows(df, bench, held=0) == [(1, 1, 2), (2, 2, 1)]


def test_windows_of_repeated_rows(spark, documents):
    bench = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, ITEM)], "item_id long, text string")
    df = documents([(1, ITEM), (1, ITEM), (1, "so " + OTHER), (2, ITEM), (3, ITEM + " " + ITEM)])
    one = windows(documents([(2, ITEM)]), bench)[0][2]
    assert windows(df, bench) == windows(df, bench, held=0) == [(d, i, n * one) for d, n in ((1, 2), (2, 1), (3, 2)) for i in (1, 2)]


def test_one_mapping_along_an_item(spark, documents):
    item = "In the village Anna Berg sold 12 kg of apples to her friend Otto for 30 euros and then Anna went home to the other village by train"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    whole, parted = item.replace("Anna", "Maria"), item.replace("Anna", "Maria", 1).replace("Anna", "Lisa")
    df = documents([(1, whole), (2, parted)])
    size = len(item.split()) - dc.WINDOW + 1
    got = windows(df, bench)
    assert got == windows(df, bench, held=0) and got[0] == (1, 1, size) and got[1][2] < size


@settings(max_examples=400, deadline=None)
@given(st.text(min_size=1, max_size=8) | st.text("aZé7½²_.!?:,-+ß中٣ \u0301", min_size=1, max_size=6))
def test_parts_of_a_token(token):
    """The short way gives what the patterns give."""
    found = dc._CORE.search(token)
    core = found[0] if found else ""
    assert dc._parts(token) == (core, bool(dc._ENDS.search(token)))
    assert bool(core) and (not core[0].isalpha() and bool(dc._NUMBER.fullmatch(core))) == bool(dc._NUMBER.fullmatch(core)) or not core


def test_slots_must_agree():
    kinds = np.array([0, 0, 0, 0, 0, 1, 1, 2], np.int8)
    a = np.array([1, 2, 3, 4, 5, 6, 6, 7], np.uint64)
    assert dc._consistent(a, np.array([1, 2, 3, 4, 5, 9, 9, 8], np.uint64), kinds, 5)
    assert not dc._consistent(a, np.array([1, 2, 3, 4, 5, 9, 10, 8], np.uint64), kinds, 5)
    assert not dc._consistent(a, np.array([1, 2, 3, 4, 5, 9, 9, 8], np.uint64), kinds, 6) and dc._consistent(a, a, kinds, 6)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=12) | st.sampled_from(["assistant", "user: ", "\\"]), st.text(max_size=30) | st.sampled_from(["\\", "</turn>", "\\</turn>", "### user: ", "\\\\###"])), max_size=6))
def test_template_reads_back(turns):
    out, spans = "", []
    for role, text in turns:
        made, a, b = chat.render_turn(role, text)
        spans.append((len(out) + a, len(out) + b))
        out += made
    assert list(chat.parse(out)) == turns
    assert [chat.unescape(out[a:b]) for a, b in spans] == [t for _, t in turns]


def test_fold_events(spark):
    log = [
        (1, 1, "message", 1, "user", "Hi"), (1, 2, "delta", 2, "assistant", "Hel"), (1, 3, "delta", 2, "assistant", "lo"), (1, 4, "edit", 1, "user", "Hey"), (1, 5, "regenerate", 2, "assistant", None),
        (1, 6, "delta", 2, "assistant", "Good "), (1, 7, "delta", 2, "assistant", "day"), (2, 1, "message", 1, "user", "a"), (2, 2, "message", 2, "assistant", "b"), (2, 3, "message", 3, "user", "c"),
        (2, 4, "regenerate", 2, "assistant", "B"), (3, 1, None, 1, "user", "x"), (3, 1, "message", None, "user", "x"), (4, 1, "message", 1, None, None), (4, 2, "delta", 1, "assistant", "late"), (None, 1, "message", 1, "user", "n"),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, kind string, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): (r["role"], r["text"]) for r in chat.fold(events).collect()}
    assert got == {(1, 1): ("user", "Hey"), (1, 2): ("assistant", "Good day"), (2, 1): ("user", "a"), (2, 2): ("assistant", "B"), (4, 1): ("assistant", "late"), (None, 1): ("user", "n")}


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_fold_in_blocks(spark, monkeypatch, block):
    """The fold agrees with a plain replay of the log, however the log is cut into blocks."""
    monkeypatch.setattr(chat, "BLOCK", block)
    r, log = random.Random(7), []
    for conv in (1, 2, None):
        for seq in range(60):
            kind = r.choice(["message", "delta", "delta", "edit", "regenerate"])
            log.append((conv, seq, kind, r.randint(0, 6), r.choice(["user", "assistant"]), r.choice(["a", "bc", None])))
    want = {}
    for conv, _, kind, turn, role, text in log:
        if kind == "regenerate":
            for key in [k for k in want if k[0] == conv and k[1] >= turn]:
                del want[key]
        old = want.get((conv, turn))
        want[conv, turn] = (role, (old[1] if kind == "delta" and old else "") + (text or ""))
    events = spark.createDataFrame(r.sample(log, len(log)), "conv_id long, seq long, kind string, turn long, role string, text string")
    assert {(x["conv_id"], x["turn"]): (x["role"], x["text"]) for x in chat.fold(events).collect()} == want


def test_conversations(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_CHARS", 40)
    r = random.Random(2)
    rows = [(r.randint(0, 6), i, r.choice(["user", "assistant", "system"]), r.choice(["a\\b", "</turn>", "### x: y", "", "é" * 30])) for i in range(80)]
    rows += [(9, 0, None, None), (9, 0, "assistant", "tie"), (9, 0, "assistant", "tie"), (None, 1, "assistant", "alone")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit("clash")).withColumn("kind", F.lit(3))
    out = {x["conv_id"]: x for x in chat.read_back(chat.render(chat.fold(chat.events_of(df)))).collect()}
    for conv in {x[0] for x in rows}:
        own = sorted(((t, role or "", text or "") for c, t, role, text in rows if c == conv), key=lambda x: x)
        said = "".join(t for _, role, t in own if role == "assistant")
        assert out[conv]["n_turns"] == len(own) and out[conv]["loss_chars"] == len(said)
        assert out[conv]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        assert out[conv]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert chat.read_back(chat.render(chat.fold(chat.events_of(df.limit(0))))).count() == 0


def test_fixity(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "h" * (i * 37 % 900)) for i in range(300)] + [(5000, None, None), (None, "u", "v"), (7, "http://x/7", "again"), (7, "http://x/7", "again")], "page_id long, url string, html string").withColumn("file", F.lit("clash"))
    assert {r["status"] for r in fx.fixity(pages, pages).collect()} == {"intact"}
    bad = pages.where("page_id is null or page_id <> 20").withColumn("html", F.when(F.col("page_id") == 33, "other").otherwise(F.col("html"))).unionByName(spark.createDataFrame([(299_999, "new", "x", "clash")], "page_id long, url string, html string, file string"))
    rows = fx.audit(fx.manifest(pages), fx.manifest(bad)).collect()
    assert {(r["page_id"], r["status"]) for r in rows} == {(20, "missing"), (33, "corrupt"), (299_999, "extra")}
    out = fx.fixity(pages, bad).collect()
    assert len(out) == 303 and {(r["page_id"]) for r in out if r["status"] != "intact"} == {20, 33}
    at = 0
    files = defaultdict(list)
    for r in out:
        files[r["file"]].append(r)
    assert [(r["nodes"], r["visited"]) for r in files[1]][:1] == [(11 + 3 + 1 + 1, 1)] and files[0][0]["visited"] < files[0][0]["nodes"] / 3
    for r in sorted(files[0], key=lambda r: r["warc_offset"]):
        assert r["warc_offset"] == at
        at += r["warc_length"] * r["n"]
    assert fx.fixity(pages.limit(0), pages.limit(0)).count() == 0


def test_fixity_of_hot_ids_and_long_records(spark):
    """Very many records under one id and without one, and a record far longer than others; damage is found among them."""
    rows = [(5, "u", f"text {i}") for i in range(400)] + [(None, "u", f"other {i}") for i in range(300)] + [(6, "u", "x" * 2_000_000), (9, None, "after")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    bad = pages.where("html <> 'text 7'").withColumn("html", F.when(F.col("html") == "other 9", "changed").otherwise(F.col("html")))
    found = {(r["page_id"], r["status"]) for r in fx.audit(fx.manifest(pages), fx.manifest(bad)).collect()}
    assert (5, "missing") in found and {s for p, s in found if p is None} <= {"missing", "extra", "corrupt"} and {p for p, _ in found} == {5, None}
    at = 0
    for r in sorted((r for r in fx.manifest(pages).collect() if r["file"] == 0), key=lambda r: (r["page_id"], r["record_sha256"])):
        assert r["warc_offset"] == at
        at += r["warc_length"] * r["n"]


def best_path(scores, switch):
    value, back = scores[0].astype(float), []
    for row in scores[1:]:
        step = value[:, None] - switch * (1 - np.eye(len(value)))
        back.append(step.argmax(0))
        value = step.max(0) + row
    return value.max()


def test_viterbi_is_optimal():
    r = np.random.default_rng(1)
    for _ in range(60):
        at = np.concatenate([[0], np.cumsum(r.integers(0, 25, 6))])
        scores = np.clip(r.normal(0, 2.5, (at[-1], 3)), -4, 4).astype(np.float32)
        label = li.viterbi(scores, at, 6.0)
        for a, b in zip(at, at[1:], strict=False):
            if b > a:
                own = label[a:b]
                assert abs(scores[np.arange(a, b), own].sum() - 6 * (own[1:] != own[:-1]).sum() - best_path(scores[a:b], 6.0)) < 1e-3


WORDS = {"aa": "the of and with house river".split(), "bb": "der die und mit haus fluss".split(), "cc": "дом река и с этот".split()}


def speech(lang, n, r):
    return " ".join(r.choice(WORDS[lang]) + r.choice(["", "", "ing" if lang == "aa" else "ung" if lang == "bb" else "ов"]) for _ in range(n))


def test_languages(documents):
    r = random.Random(1)
    train = [(i, speech(lang := r.choice(list(WORDS)), 40, r), lang) for i in range(300)] + [(None, "zzz", "aa"), (900, None, "aa"), (901, "1 2 3", None)]
    model = li.fit(documents(train))
    mixed = speech("aa", 60, r) + " " + speech("bb", 40, r)
    rows = [(1, speech("aa", 30, r)), (2, speech("bb", 30, r)), (3, speech("cc", 30, r)), (4, None), (5, ""), (6, "12 !?"), (7, mixed), (None, speech("bb", 5, r)), (8, "中文 字"), (9, speech("cc", 20_000, r))]
    out = li.identify(documents(rows), model, spans=True).collect()
    assert [x["lang_pred"] for x in out][:7] == ["aa", "bb", "cc", "und", "und", "und", "aa"]
    assert [s["lang"] for s in out[6]["spans"]] == ["aa", "bb"] and out[6]["n_spans"] == 2 and abs(out[6]["spans"][1]["words"] - 40) <= 2
    assert out[8]["lang_pred"] in WORDS and out[9]["lang_pred"] == "cc" and all(0 <= x["score"] <= 1 for x in out)
    assert li.identify(documents([]), model).count() == 0 and li.fit(documents([])) is None
    assert {x["lang_pred"] for x in li.identify(documents(rows), None).collect()} == {"und"}


def test_many_languages(documents):
    """More languages than a byte can number, each with words of its own."""
    r = random.Random(5)
    own = {f"l{k:03}": [f"{a}{chr(97 + k % 26)}{chr(97 + k // 26)}{b}" for a in "bdfg" for b in "aeo"] for k in range(150)}
    rows = [(i, " ".join(r.choice(own[lang]) for _ in range(25)), lang) for i, lang in enumerate(list(own) * 6)]
    out = li.identify(documents(rows), li.fit(documents(rows))).collect()
    assert not [x for x, (_, _, lang) in zip(out, rows, strict=True) if x["lang_pred"] != lang]


def test_words_are_runs_of_letters():
    kinds = ["aé ßЯ漢ª", "½²Ⅷ①", "09٣", " _-.\n"]
    texts = ["".join(kinds[(i * 7 + j * j) % 4][(i + j) % 4 % len(kinds[(i * 7 + j * j) % 4])] for j in range(30)) for i in range(200)]
    for text in [*texts, "", "a½b", "x" * 100_000]:
        parts, run = [], ""
        for c in text + " ":
            if unicodedata.category(c).startswith("L"):
                run += c
            elif run:
                parts.append(run)
                run = ""
        assert li.words_of(text) == parts


def test_letters_and_ties(documents):
    """Numbers of any kind are no letters; of languages with as many letters the first is told."""
    model = li.fit(documents([(i, "uno dos" if lang == "xx" else "one two", lang) for i, lang in enumerate(["xx", "yy"] * 40)]))
    rows = [(1, "½ ² ①"), (2, "ⅷ 12 _"), (3, "uno " * 20 + "one " * 20), (4, "one " * 20 + "uno " * 20), (5, "½uno")]
    out = li.identify(documents(rows), model).collect()
    assert [x["lang_pred"] for x in out] == ["und", "und", "xx", "xx", "xx"] and [x["score"] for x in out[:3]] == [0, 0, 0.5]


def test_many_languages_share_one_class():
    """A thousand languages don't make the model larger than its bound."""
    r = random.Random(2)
    texts = [" ".join(r.choice(["scum", "moron"] if i % 2 else ["fine", "good"]) + f" w{i % 1000}" for _ in range(5)) for i in range(1200)]
    word, prefix, at = tx.word_buckets(texts)
    language = [f"l{i % 1000}" if i % 3 else "en" for i in range(1200)]
    model, z, told = tx.train(word, prefix, at, np.array([i % 2 for i in range(1200)]), language)
    assert len(model.languages) == tx.LANGUAGES and model.languages[-1] == tx.OTHERS and "en" in model.languages and told.max() < tx.LANGUAGES
    assert len(pickle.dumps(model)) < 4 * tx.BUCKETS * (tx.DIM + tx.LANGUAGES) + (1 << 20) and z[1::2].mean() > z[::2].mean()


def test_toxicity(spark, documents):
    r = random.Random(2)
    clean, bad = [f"w{i}" for i in range(300)], ["vile", "nasty", "foul"]
    rows, labels = [], []
    for i in range(900):
        words = [r.choice(clean) for _ in range(r.randint(1, 80))]
        if toxic := i % 5 == 0:
            words[r.randrange(len(words))] = r.choice(bad)
        rows.append((i, " ".join(words), r.choice(["en", None])))
        labels.append((i, int(toxic)))
    labels += [(None, 1), (5, None), (0, 0), (77_777, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = tx.fit(documents(rows), marks)
    more = [*rows, (None, None), (1, ""), (2, "foul " * 3), (3, "w1 " * 50_000), (4, "..., !!")]
    out = tx.score(documents(more), model).collect()
    known = dict(x for x in labels if x[0] is not None and x[1] is not None)
    wrong = sum(x["predicted"] != (x["doc_id"] % 5 == 0) for x in out[:900])
    assert wrong <= 18 and known and all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.3) for x in out)
    assert [x["predicted"] for x in out[900:]] == [0, 0, 1, 0, 0]
    assert tx.fit(documents(rows), marks.limit(0)) is None and {x["score"] for x in tx.score(documents(more), None).collect()} == {0.0}
    assert tx.score(documents([]), model).count() == 0


def test_thresholds_from_all_labels(spark, documents, monkeypatch):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(1200):
        lang = "xx" if i % 6 == 0 else "yy"
        words = [f"{lang}{r.randrange(60)}" for _ in range(r.randint(5, 30))]
        if toxic := r.random() < 0.1:
            words[0] = "vile"
        rows.append((i, " ".join(words), lang))
        labels.append((i, int(toxic)))
    seen = []
    monkeypatch.setattr(tx, "threshold", lambda z, label, times, f=tx.threshold: seen.append((sum(times), sum(times * label))) or f(z, label, times))
    df, marks = documents(rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = tx.fit(df, marks, 40, 50)
    free = {x[0] for x in marks.where(~tx.held_out(F.col("doc_id"))).collect()}
    used = [(x, t) for (i, _, x), (_, t) in zip(rows, labels, strict=True) if i in free]
    assert seen == [(len(used), sum(t for _, t in used)), *[(len(own), sum(own)) for own in ([t for x, t in used if x == k] for k in model.languages)]]
