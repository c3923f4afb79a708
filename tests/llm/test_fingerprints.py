import hashlib
import random

from pyspark.sql import functions as F

from graphloom.llm import fingerprints as fp


def expected_edits(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    out = []
    for i, (d, t) in enumerate(order):
        t, following = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(df, **how):
    return sorted((tuple(r) for r in fp.fingerprint_edits(df, **how).select("doc_id", "n_chars", "edited_sha256").collect()), key=repr)


def test_edits_against_plain_python(documents):
    r = random.Random(1)
    rows = [(i * 3, "".join(r.choice("ab é中😀\n") for _ in range(r.randint(0, 60)))) for i in range(80)] + [(7, "x y"), (7, "x z"), (11, None), (None, "no id"), (None, "none")]
    for ranges in (1, 3, 40):
        assert run(documents(rows), ranges=ranges) == expected_edits(rows)


def test_few_rows(documents):
    assert run(documents([])) == []
    assert run(documents([(1, "abc def")])) == expected_edits([(1, "abc def")])
    assert run(documents([(5, "a"), (5, "a"), (5, "a")])) == expected_edits([(5, "a")] * 3)


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_estimates(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    a = [r.choice(words) for _ in range(3000)]
    b = a[:2000] + [r.choice(words) for _ in range(1000)]
    df = spark.createDataFrame([(" ".join(a), " ".join(b))], "a string, b string")
    x, y = fp.sketch(F.col("a"), 512), fp.sketch(F.col("b"), 512)
    row = df.select(fp.resemblance(x, y, 512), fp.containment(x, y, 512), fp.distinct_shingles(x, 512), fp.resemblance(x, x, 512)).first()
    sa, sb = shingles(" ".join(a)), shingles(" ".join(b))
    assert abs(row[0] - len(sa & sb) / len(sa | sb)) < 0.08
    assert abs(row[1] - len(sa & sb) / len(sa)) < 0.12
    assert abs(row[2] / len(sa) - 1) < 0.15 and row[3] == 1


def test_small_sets_are_exact_and_parts_merge(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "c d e f g"), (2, ""), (3, None), (3, "one two")], "k int, t string").withColumn("s", fp.sketch(F.col("t")))
    merged = {r[0]: r[1] for r in fp.merge_sketches(df, "k", "s").collect()}
    sizes = {r["t"]: len(r["s"]) for r in df.collect()}
    assert sizes == {"a b c d e f": 2, "c d e f g": 1, "": 0, None: 0, "one two": 1}
    assert {k: len(v) for k, v in merged.items()} == {1: 3, 2: 0, 3: 1}
    assert df.select(F.min(fp.resemblance(F.col("s"), F.col("s")))).first()[0] == 1
