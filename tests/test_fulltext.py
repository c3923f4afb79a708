import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.errors import QueryError
from graphloom.model import GraphDef, NodeKind, struct
from graphloom.operators import fulltext as ft
from graphloom.operators.fulltext import All, Any, Not, Phrase, Term, parse, stem, terms_of
from graphloom.operators.search import StoreSearch
from graphloom.store import GraphStore

# From the published description of the algorithm.
STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat",
    "troubled": "troubl", "sized": "size", "hopping": "hop", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat",
    "conditional": "condit", "rational": "ration", "digitizer": "digit", "radically": "radic", "vietnamization": "vietnam", "operator": "oper", "feudalism": "feudal", "hopefulness": "hope", "formality": "formal",
    "triplicate": "triplic", "formative": "form", "electrical": "electr", "goodness": "good", "revival": "reviv", "inference": "infer", "airliner": "airlin", "adjustable": "adjust", "irritant": "irrit",
    "replacement": "replac", "adoption": "adopt", "communism": "commun", "effective": "effect", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "by": "by", "yes": "ye",
}


def test_stems():
    assert {w: stem(w) for w in STEMS} == STEMS
    assert [stem(w) for w in ("", "a", "é", "naïve", "x25s", "日本")] == ["", "a", "é", "naïve", "x25s", "日本"]


def word(x, prefix=False):
    return Phrase((Term(x, prefix),))


def test_syntax():
    assert parse('(a OR b*) NOT c AND "d e"', "raw") == All((Any((word("a"), word("b", True))), Not(word("c")), Phrase((Term("d"), Term("e")))))
    assert parse("a b OR c", "raw") == Any((All((word("a"), word("b"))), word("c"))) and parse("NOT NOT a", "raw") == Not(Not(word("a")))
    assert parse('x -"y z" OR -w', "websearch") == Any((All((word("x"), Not(Phrase((Term("y"), Term("z")))))),))
    assert terms_of(parse("a -b OR d"), False) == [Term("a"), Term("d")] and parse("", "plain") == parse(" ", "raw") == Any(())
    assert parse("Running runs", "plain", "english") == All((word("run"),))
    for bad in ("(a", "a)", "AND a", "a AND", "NOT", "a OR", "()", '"a', "a AND OR b"):
        with pytest.raises(QueryError):
            parse(bad, "raw")
    for bad in ({"mode": "x"}, {"language": "x"}):
        with pytest.raises(QueryError):
            parse("a", **bad)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30), st.sampled_from(ft.MODES))
def test_any_text_is_a_query_or_refused(text, mode):
    try:
        ft.terms_of(parse(text, mode))
    except QueryError:
        assert mode == "raw"


WORDS = ["red", "reds", "redding", "blue", "Bluish", "é", "of", "the", "tree", "trees", "x1", "running", "runs"]
QUERIES = [
    ("red", "plain"), ("the tree", "plain"), ("of the", "phrase"), ("red -blue OR tree", "websearch"), ('"of the" red', "websearch"), ("re* AND (tree* OR x1)", "raw"), ("NOT the", "raw"), ("red OR NOT (of OR the)", "raw"),
    ('"the re*"', "raw"), ("r*", "raw"), ("missing OR red", "raw"), ("missing", "plain"), ("", "plain"), ("runs tree", "plain"), ("the of red blue", "plain"), ("NOT (the OR NOT red)", "raw"),
]


@pytest.fixture(scope="module")
def library(spark):
    r = random.Random(4)
    rows = [(str(i), " ".join(r.choice(WORDS) for _ in range(r.choice([0, 1, 5, 30]))), None if i % 5 else "the red note", i % 3) for i in range(300)]
    rows += [("long", "the " * 3000 + "tree red", None, 0), ("none", None, None, 0), ("marks", "?! --", "", 1)]
    graph = GraphDef("library", [NodeKind("Text", struct("body string, note string, shelf int"), searchable=("body", "note")), NodeKind("Plain", struct("n int"))], [])
    return GraphStore(spark, graph, {"Text": spark.createDataFrame(rows, "id string, body string, note string, shelf int").coalesce(2), "Plain": spark.createDataFrame([], "id string, n int")}, {})


@pytest.mark.parametrize("language", ["simple", "english"])
def test_index_and_scan_agree(library, language):
    """The index gives what a scan of the texts gives, pruned by blocks or not."""
    indexed = library.snapshot()
    indexed.indexes = {}
    StoreSearch(indexed).rebuild_fulltext("Text", language)
    for i, (query, mode) in enumerate(QUERIES if language == "simple" else QUERIES[::3]):
        how = {"mode": mode, "language": language, "where": (lambda n: n.shelf.eq(1)) if i % 3 == 1 else None, "limit": 7, "offset": 2}
        want = [(x.id, round(x.score, 9), x.ord) for x in StoreSearch(library).fulltext("Text", query, **how).collect()]
        got = [(x.id, round(x.score, 9), x.ord) for x in StoreSearch(indexed).fulltext("Text", query, **how).collect()]
        assert got == want, (query, mode)


def test_blocks_prune_without_loss(library, monkeypatch):
    monkeypatch.setattr(ft, "COMMON", 20)
    index = StoreSearch(library.snapshot()).rebuild_fulltext("Text")
    assert index.blocks.count() > 10
    for query in ("the red", "the OR of OR tree", "redding OR reds OR blue", "the OR missing"):
        e = parse(query, "raw")
        for k in (1, 20):
            whole, pruned = ([(x.id, round(x.score, 9)) for x in index.search(e, k, prune_from=n).collect()] for n in (1 << 60, 0))
            assert whole == pruned
    bounds, rest = index.bounds(terms_of(parse("the")), [1.0])
    assert rest == 0.0 and index.search(parse("the"), 1).first()["score"] / ft.idf(index.documents, index.counts([Term("the")])[0]) <= max(bounds.values()) + 1e-9


def test_index_reads_only_its_directories(library, spark, tmp_path):
    place = str(tmp_path / "index")
    StoreSearch(library.snapshot()).rebuild_fulltext("Text", place=place)
    fresh = library.snapshot()
    fresh.indexes = {}
    index = StoreSearch(fresh).open_fulltext("Text", place)
    plan = index.search(parse("red tree"), 5)._jdf.queryExecution().toString()
    assert "bucket#" in plan.split("PartitionFilters:")[1].split("]")[0] and "In(term, [red,tree])" in plan and plan.count("FileScan") == 1
    assert StoreSearch(fresh).fulltext("Text", "red tree", 3).count() == 3
    assert index.documents == StoreSearch(library).fulltext("Text", "red OR NOT red", 1000, mode="raw").count()


def test_empty_and_wrong(library, spark):
    nothing = GraphStore(spark, library.graph, {"Text": library.frames["Text"].limit(0)}, {})
    StoreSearch(nothing).rebuild_fulltext("Text")
    assert StoreSearch(nothing).fulltext("Text", "red").collect() == [] and nothing.indexes
    for call in (lambda: StoreSearch(library).fulltext("Plain", "x"), lambda: StoreSearch(library).rebuild_fulltext("Plain"), lambda: StoreSearch(library).fulltext("Text", "x", 0), lambda: StoreSearch(library).rebuild_fulltext("Text", "klingon")):
        with pytest.raises(QueryError):
            call()
