import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidebook.llm import tokens as tk

pytestmark = pytest.mark.skipif(not os.path.exists(tk.DEFAULT_RANKS), reason="no rank file")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'sre 1\n\t\ré中あ\U0001f600!.,  \x1c\x85"), max_size=60), st.integers(1, 8))
def test_parts_have_the_ids_of_the_whole(text, size):
    enc = tk.encoding(tk.DEFAULT_RANKS)
    cut = list(tk.parts(text, size))
    assert "".join(cut) == text
    assert [i for p in cut for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_round_trip(text):
    assert tk.decode(tk.encode(text)) == text


def test_special_strings_are_text():
    ids = tk.encode("a <|endoftext|> b")
    assert 50256 not in ids and tk.decode(ids) == "a <|endoftext|> b"


def test_broken_bytes():
    assert tk.decode(tk.encode("\U0001f600")[:1]) == "�"


def test_long_texts():
    rnd = random.Random(1)
    text = " ".join(rnd.choice(["alpha", "be-ta", "4711", "\n\n", "中文"]) for _ in range(60_000))
    assert len(text) > 2 * tk.LONG
    assert tk.encode(text) == tk.encoding(tk.DEFAULT_RANKS).encode_ordinary(text)
    run = "x" * 300_000
    assert tk.decode(tk.encode(run)) == run


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'sre 1\n\t\ré中あ\U0001f600!.,  \x1c\x85\u0301"), max_size=60))
def test_pieces_have_the_ids_of_the_whole(text):
    assert tk.by_pieces(text) == tk.encoding(tk.DEFAULT_RANKS).encode_ordinary(text)


@pytest.mark.parametrize("unit", [" ", "\n", "a", "\u0301", "中", "中。", " \n"])
def test_runs_of_millions(unit):
    short = "b" + unit * 40_000 + "a"
    assert tk.by_pieces(short) == tk.encoding(tk.DEFAULT_RANKS).encode_ordinary(short) == tk.encode(short)
    text = "b" + unit * (2_000_000 // len(unit)) + "a"
    assert tk.decode(tk.encode(text)) == text


def test_rows(spark):
    rows = [(1, "two words", "k"), (2, None, None), (3, "", "k"), (1, "two words", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(tk.with_ids(df, ["doc_id"]).collect())
    assert [(r.doc_id, r.ids) for r in got] == [(1, tk.encode("two words"))] * 2 + [(2, []), (3, [])]
    assert [tuple(r) for r in sorted(tk.with_counts(df, ["doc_id"]).collect())] == [(1, 2), (1, 2), (2, 0), (3, 0)]
    assert tk.with_ids(df.limit(0), ["doc_id"]).count() == 0
    back = tk.with_texts(tk.with_ids(df, ["doc_id"]), ["doc_id"]).collect()
    assert sorted(map(tuple, back)) == [(1, "two words"), (1, "two words"), (2, ""), (3, "")]
