from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm.splitting import cut, oversized, paragraphs, split_texts, tokenizer_size
from factloom.llm.tokens import load_tokenizer, tokenizer_file

TEXTS = st.lists(st.sampled_from(["word", "a", "longerwordhere", " ", "  ", ". ", "\n", "\n\n", "\r\n", "\r", "!", "。", "x" * 70, "é", "\t"]), max_size=120).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(20, 60), st.integers(0, 15))
def test_pieces_cover_and_overlap(text, limit, overlap):
    pieces = cut(text, limit, overlap)
    if not text:
        assert pieces == []
        return
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(0 < b - a <= limit for a, b, _ in pieces)
    for (a, b, _), (c, d, _) in zip(pieces, pieces[1:]):
        assert a < c and b < d and c <= b - overlap and (b - c < 2 * overlap or b - c == overlap or overlap == 0)


@pytest.mark.parametrize("text, limit, overlap", [("wordwordaaa wordwordword", 20, 11), ("aaaaaaaaa bbbbbbbbbbbb cc", 12, 11), ("a" * 30 + " " * 30 + "b" * 30, 20, 15), ("é " * 50, 20, 19)])
def test_tight_overlaps(text, limit, overlap):
    pieces = cut(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and all(0 < b - a <= limit for a, b, _ in pieces)
    assert all(a < c <= b - overlap and b < d for (a, b, _), (c, d, _) in zip(pieces, pieces[1:]))


SIZE, ENCODING = tokenizer_size(tokenizer_file()), load_tokenizer(tokenizer_file())


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(16, 60), st.integers(0, 8))
def test_token_limits(text, limit, overlap):
    pieces = cut(text, limit, overlap, size=SIZE)
    assert not text or (pieces[0][0] == 0 and pieces[-1][1] == len(text))
    # Tokens may join across the parts that sizes are taken of, and only then are fewer.
    assert all(len(ENCODING.encode_ordinary(text[a:b])) <= limit for a, b, _ in pieces)
    assert all(a < c <= b and b < d for (a, b, _), (c, d, _) in zip(pieces, pieces[1:]))


def test_natural_boundaries():
    text = "First sentence here. Second one there.\n\nNext paragraph of words. And more words follow."
    first = cut(text, 50, 5)[0]
    assert first[2] == "paragraph" and text[: first[1]].endswith("there.")
    assert cut("a b c d e f g h i j k l m n o p", 10, 2)[0][2] in {"word", "line"}
    assert cut("x" * 100, 40, 10) == [(0, 40, "hard"), (30, 70, "hard"), (60, 100, "end")]


def test_paragraphs():
    assert paragraphs("a\nb\r\n \t\r\n\n c \rd") == [(0, 3), (10, 15)]
    assert paragraphs("") == [] and paragraphs(" \n\t") == []
    assert paragraphs("\n\nx\n") == [(2, 3)]


def test_frames(spark):
    rnd = random.Random(3)
    long = " ".join("w" * rnd.randrange(1, 12) for _ in range(150_000))
    rows = [(1, None, 0), (2, "", 0), (3, "short", 0), (4, "y" * 5000, 0), (5, long, 0), (4, "z" * 4097, 1), (None, "n" * 5000, 2)]
    df = spark.createDataFrame(rows, "id int, text string, piece_no int")
    got = split_texts(df, "id", "text").collect()
    assert {r.id for r in got} == {3, 4, 5, None}
    assert all(len(r.text) <= 4096 for r in got)
    five = sorted((r for r in got if r.id == 5), key=lambda r: r.piece_no)
    assert five[0].piece_start == 0 and five[-1].piece_end == len(long) and all(long[r.piece_start : r.piece_end] == r.text for r in five)
    assert {r.forced_paragraphs for r in got if r.id == 4} == {1} and {r.forced_paragraphs for r in got if r.id == 3} == {0}
    assert {r.id for r in oversized(df, "text").collect()} == {4, 5, None}
    assert split_texts(df.limit(0), "id", "text").count() == 0
    with pytest.raises(ValueError):
        split_texts(df, "id", "text", 100, 100)
