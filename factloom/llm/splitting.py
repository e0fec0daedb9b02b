"""Splitting oversized texts at natural boundaries.

A text is a row of tokens, stretches of blanks and of other characters. Per text there are the prefix sums of the tokens'
sizes, in the unit of the limit (characters, or tokens of a public tokenizer), and for each kind of natural boundary (ends of
paragraphs, lines, sentences and words) the sorted places of its tokens. A piece ends at the last boundary of the
best kind under the limit, found by binary search; the next one begins ``overlap`` units before that end, at the start of
the token there. Where no boundary lies under the limit the text is cut hard, within a token if need be.

The cuts of one text depend on each other, so they are made per row; texts are independent and
stay where the scan put them: no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.tokens import load_tokenizer

KINDS = ("paragraph", "line", "sentence", "word", "hard")
_LINE_END = re.compile(r"\r\n|\n|\r")
_SENTENCE = re.compile(r"[.!?…]+[\"'”’»)\]]*(?=\s)|[。！？]+[”’」』]*")
_TOKEN = re.compile(r"\S+")


def lines(text: str) -> list[tuple[int, int, int]]:
    """(start, end without line end, end with it) of each line."""
    out, at = [], 0
    for m in _LINE_END.finditer(text):
        out.append((at, m.start(), m.end()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text), len(text)))
    return out


def paragraphs(text: str) -> list[tuple[int, int]]:
    """Maximal runs of lines that are not blank, from the first to the last character."""
    out: list[tuple[int, int]] = []
    open_ = False
    for start, stop, _ in lines(text):
        if not text[start:stop].strip():
            open_ = False
        elif open_:
            out[-1] = (out[-1][0], stop)
        else:
            out.append((start, stop))
            open_ = True
    return out


def boundaries(text: str) -> list[np.ndarray]:
    """Sorted end offsets per kind, from paragraphs to words."""
    ends = [
        [stop for _, stop in paragraphs(text)],
        [stop for _, stop, _ in lines(text)],
        [m.end() for m in _SENTENCE.finditer(text)],
        [m.end() for m in _TOKEN.finditer(text)],
    ]
    return [np.asarray(e, np.int64) for e in ends]


def characters(parts: list[str]) -> list[int]:
    """Size of each part of a text in characters."""
    return [len(p) for p in parts]


def tokenizer_size(path: str) -> Callable[[list[str]], list[int]]:
    """Size of parts in tokens of a vocabulary file. A cut word may take more tokens than the whole: parts of one
    character count a token for each byte, so that no piece exceeds the limit."""
    known: list = []

    def size(parts: list[str]) -> list[int]:
        if not known:
            known.append(load_tokenizer(path))
        return [len(p.encode()) if len(p) == 1 else len(known[0].encode_ordinary(p)) for p in parts]

    return size


def token_sums(text: str, ends: list[np.ndarray], most: int, size: Callable[[list[str]], list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(start offsets of the tokens and the text's end, prefix sums of their sizes).

    Tokens are cut at every boundary, and those larger than ``most`` into their characters.
    """
    edges = np.unique(np.concatenate([[0, len(text)], [m.start() for m in _TOKEN.finditer(text)], *ends]).astype(np.int64))
    parts = [text[a:b] for a, b in zip(edges, edges[1:])]
    sizes = np.asarray(size(parts), np.int64)
    large = np.flatnonzero(sizes > most)
    if len(large):
        extra = np.concatenate([np.arange(edges[i] + 1, edges[i + 1]) for i in large])
        own = np.concatenate([np.asarray(size(list(parts[i])), np.int64) for i in large])
        at = np.concatenate([np.arange(edges[i], edges[i + 1]) for i in large])
        starts = np.concatenate([np.delete(edges[:-1], large), at])
        order = np.argsort(starts, kind="stable")
        sizes = np.concatenate([np.delete(sizes, large), own])[order]
        edges = np.union1d(edges, extra)
    return edges, np.concatenate([[0], np.cumsum(sizes)])


def cut(text: str, limit: int, overlap: int, least_share: float = 0.5, size: Callable[[list[str]], list[int]] = characters) -> list[tuple[int, int, str]]:
    """(start, end, kind of the end) of the pieces of one text.

    A better kind of boundary wins if it leaves at least ``least_share`` of the limit in the piece;
    failing that, the last boundary of the best kind that lets the next piece share ``overlap`` and still get
    further; failing that, a hard cut.
    """
    if not text:
        return []
    return _pieces(text, boundaries(text), limit, overlap, least_share, size)[0]


def _pieces(text: str, ends: list[np.ndarray], limit: int, overlap: int, least_share: float, size: Callable[[list[str]], list[int]]) -> tuple[list[tuple[int, int, str]], np.ndarray, np.ndarray]:
    """The pieces, and the edges and prefix sums of the tokens they were made of."""
    # With tokens of at most half of what a piece brings anew, some edge always lies where a piece may end.
    most = max(1, min((limit - overlap) // 2, overlap or limit))
    edges, sums = token_sums(text, ends, most, size)
    places = [np.searchsorted(edges, e) for e in ends]
    starts = np.searchsorted(edges, np.asarray([m.start() for m in _TOKEN.finditer(text)], np.int64))
    out, start, done = [], 0, 0
    while sums[-1] - sums[start] > limit:
        last = int(np.searchsorted(sums, sums[start] + limit, side="right")) - 1
        first = max(done + 1, int(np.searchsorted(sums, sums[start + 1] + overlap)))
        stop, kind = last, "hard"
        for least in (max(first, int(np.searchsorted(sums, sums[start] + int(limit * least_share), side="right"))), first):
            for name, at in zip(KINDS, places):
                i = int(np.searchsorted(at, last, side="right")) - 1
                if i >= 0 and at[i] >= least:
                    stop, kind = int(at[i]), name
                    break
            if kind != "hard":
                break
        out.append((int(edges[start]), int(edges[stop]), kind))
        back = int(np.searchsorted(sums, sums[stop] - overlap, side="right")) - 1
        i = int(np.searchsorted(starts, back, side="right")) - 1
        natural = int(starts[i]) if i >= 0 else back
        room = sums[min(stop + 1, len(sums) - 1)] - sums[natural] <= limit
        start = natural if start < natural and sums[stop] - sums[natural] < 2 * overlap and room else back
        done = stop
    out.append((int(edges[start]), len(text), "end"))
    return out, edges, sums


def _forced(text: str, cuts: list[int], upto: Callable, limit: int) -> int:
    """Paragraphs that have a cut within and exceed the limit by themselves."""
    if not cuts:
        return 0
    opened, closed = np.asarray(paragraphs(text), np.int64).T
    of = np.searchsorted(opened, cuts) - 1
    of = np.unique(of[(of >= 0) & (closed[of] > cuts)])
    return int((upto(closed[of]) - upto(opened[of]) > limit).sum())


def _split(limit: int, overlap: int, least_share: float, tokenizer: str | None, with_text: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = tokenizer_size(tokenizer) if tokenizer else characters
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"], batch["text"]):
                if not text:
                    continue
                if not tokenizer and len(text) <= limit:
                    rows.append((key, 1, 0, len(text), "end", text if with_text else None, len(text), 0, 1))
                    continue
                ends = boundaries(text)
                pieces, edges, sums = _pieces(text, ends, limit, overlap, least_share, size)
                upto = lambda offsets: sums[np.searchsorted(edges, np.asarray(offsets, np.int64))]  # noqa: B023, E731
                forced = _forced(text, [b for _, b, _ in pieces[:-1]], upto, limit)
                for no, (a, b, kind) in enumerate(pieces, 1):
                    rows.append((key, no, a, b, kind, text[a:b] if with_text else None, int(upto(b) - upto(a)), forced, len(pieces)))
            yield pd.DataFrame(rows, columns=["id", "piece_no", "piece_start", "piece_end", "cut", "text", "units", "forced_paragraphs", "n_pieces"])

    return run


def split_texts(df: DataFrame, item_id: str, text: str, limit: int = 4096, overlap: int = 200, least_share: float = 0.5, tokenizer: str | None = None, with_text: bool = True) -> DataFrame:
    """Pieces of at most ``limit`` units that together cover each text; units are characters (code points), or tokens of
    the vocabulary file ``tokenizer``.

    Columns: id, piece_no (from 1), piece_start, piece_end (offsets in the text in characters, end exclusive), cut (kind
    of boundary the piece ends at; ``end`` for the last), text (NULL unless ``with_text``), units (the piece's size),
    forced_paragraphs (how many of the text's paragraphs were cut within because they exceed the limit by themselves),
    n_pieces. Consecutive pieces share at least ``overlap`` units: that many, or more up to the start of a token, but
    less than twice as many. A text within the limit is one piece; NULL and empty texts give none. Repeated ids are
    split row by row.
    """
    if not 0 <= overlap < limit or (tokenizer and limit - overlap < 8):
        raise ValueError("overlap must be smaller than the limit, by 8 tokens at least")
    kind = dict(df.dtypes)[item_id]
    rows = df.select(F.col(item_id).alias("id"), F.col(text).alias("text")).where("text IS NOT NULL")
    return rows.mapInPandas(
        _split(limit, overlap, least_share, tokenizer, with_text), f"id {kind}, piece_no int, piece_start int, piece_end int, cut string, text string, units long, forced_paragraphs long, n_pieces int"
    )


def oversized(df: DataFrame, text: str | Column, limit: int = 4096) -> DataFrame:
    """Rows whose text exceeds the limit."""
    return df.where(F.length(text) > limit)
