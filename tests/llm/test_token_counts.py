import random

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphloom.llm.token_counts import PieceSplitter, TokenCounter, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY, COUNTER = Tokenizer.from_file(PATH), TokenCounter(PATH)


def library(texts):
    return [len(x) for x in LIBRARY.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(), min_size=1, max_size=5))
def test_any_text(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert COUNTER.counts(texts).tolist() == library(texts)


def test_hard_pieces():
    r = random.Random(4)
    parts = ["'", "'s", "'re", "'r", "'ll", "'l", "'v", " ", "  ", "\n", "\t", "a", "s", "e", "1", "½", "!", "é", "中", "😀", "\u3000", "\x85", "\x1c", "<|endoftext|>", " world", "ing", "\x00"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(3000)] + ["a" * 4000, "'" * 500, " " * 700, "ab" * 900]
    assert COUNTER.counts(texts).tolist() == library(texts)


def test_chunks_compose():
    s, r = PieceSplitter(), np.random.default_rng(2)
    kinds = r.integers(0, 11, 5000).astype(np.uint8)
    state, marks = 0, []
    for k in kinds:
        marks.append(s.marks[k * 12 + state])
        state = s.to[k * 12 + state]
    begin = [i for i in range(len(kinds)) if marks[i] & 1 or i + 1 < len(kinds) and marks[i + 1] & 2]
    assert s.starts(kinds).tolist() == begin


def test_table(documents):
    rows = [(1, "Hello world"), (1, "Hello world"), (None, None), (2, ""), (3, "x " * 600), (4, "Ünï <|endoftext|>")]
    made = token_counts(documents(rows), PATH).collect()
    want = [(d, len((t or "").encode()), n, n > 512) for (d, t), n in zip(rows, library([t or "" for _, t in rows]), strict=True)]
    assert sorted(map(tuple, made), key=repr) == sorted(want, key=repr)
    assert token_counts(documents([]), PATH).count() == 0
