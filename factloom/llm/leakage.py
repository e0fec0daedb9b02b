"""Evaluation texts inside a training corpus: size-partitioned MinHash containment search.

Test items are short and documents long, so containment is measured on the item's side. Two searches share one scan of
the corpus, in which a document meets the sketches of all items of a block:

- Parts of items (:func:`leaked_items`): a leak is a run of ``run_words`` consecutive words. Every window of that many
  words is a set of five-word shingles, and its MinHash is the row of minima of the shingles' hashes under ``r`` hash
  functions. Equal windows have equal minima, so recall is one. Documents are partitioned by size: long ones have more windows and
  so more chance matches; their partition's larger ``r`` keeps those rare. Items are sketched once for each ``r``.
- Whole items (:func:`contained_items`): an item's sketch is its ``k`` least shingle hashes, with ``k`` by its size partition, and
  its containment in a document is estimated by the share of the sketch that the document has.

Candidates are verified where the document's text is: by the words of the run, or by exact shingle containment. Only ids
and results leave the scan. Items are the query set: they are broadcast in blocks of bounded size, and the corpus is
scanned once for each block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.textarrays import mixed, normalised, runs, slices, word_hashes

SHINGLE = 5
#: (least words of a document, minima per MinHash), from the smallest partition to the largest.
PARTITIONS = ((0, 2), (512, 3), (8192, 4))
#: (least shingles of an item, size of its sketch); a sketch larger than its item is the whole item.
SKETCHES = ((0, 64), (512, 128), (8192, 256))
#: Characters of items that are broadcast at once.
BLOCK_CHARS = 1 << 25
_SEEDS = tuple(np.uint64(s) for s in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89))
_WORD = re.compile(r"[^\W_]+")


def _window_minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive hashes, by doubling."""
    done, out = 1, hashes
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def _window_keys(words: np.ndarray, run_words: int, widths: list[int]) -> dict[int, np.ndarray]:
    """For each number of minima, the MinHash of the window that begins at each word."""
    m = len(words) - run_words + 1
    shingles = np.zeros(len(words) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        shingles = mixed(shingles * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(shingles)])
    keys, key = {}, np.zeros(m, np.uint64)
    for r in range(1, max(widths) + 1):
        key = mixed(key ^ _window_minima(mixed(shingles ^ _SEEDS[r - 1]), run_words - SHINGLE + 1)[:m])
        keys[r] = key
    return {r: keys[r] for r in widths}


class _Index:
    """Sorted numbers and the passages that have each."""

    def __init__(self, numbers: np.ndarray, passages: np.ndarray) -> None:
        order = np.lexsort((passages, numbers))
        numbers, passages = numbers[order], passages[order]
        fresh = np.ones(len(numbers), bool)
        fresh[1:] = (numbers[1:] != numbers[:-1]) | (passages[1:] != passages[:-1])
        self.passages, self.numbers = passages[fresh], numbers[fresh]

    def hits(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``numbers``, passage) for each number that is there."""
        first = np.searchsorted(self.numbers, numbers)
        there = np.flatnonzero(self.numbers[np.minimum(first, len(self.numbers) - 1)] == numbers) if len(self.numbers) else np.zeros(0, np.int64)
        last = np.searchsorted(self.numbers, numbers[there], side="right")
        many = last - first[there]
        place = np.repeat(there, many)
        at = np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[there], many)
        return place, self.passages[at]


def _longest_run(doc: np.ndarray, passage: np.ndarray, least: int) -> tuple[int, int]:
    """(words, first word in the passage) of the longest run of ``least`` words or more that both have; (0, 0) without one."""
    zero = np.zeros(max(len(doc), len(passage)), np.int64)
    a, at_a = runs(doc, zero[: len(doc)], least)
    b, at_b = runs(passage, zero[: len(passage)], least)
    place, at = _Index(a, at_a).hits(b)
    if not len(place):
        return 0, 0
    i, j = at_b[place], at
    order = np.lexsort((i, j - i))
    i, shift = i[order], (j - i)[order]
    opens = np.flatnonzero(np.concatenate(([True], (shift[1:] != shift[:-1]) | (i[1:] != i[:-1] + 1))))
    lengths = np.diff(np.concatenate((opens, [len(i)])))
    best = int(lengths.argmax())
    return int(lengths[best]) + least - 1, int(i[opens[best]])


def _leaks(shared, run_words: int):
    """Verified (id, item, shared_words) of each batch of documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, texts, words, indexes = shared.value
        spoken: dict = {}
        for batch in batches:
            docs, body = batch["id"].tolist(), [normalised(t) for t in batch["text"]]
            found = []
            for a, b in slices(body):
                own, owner = word_hashes(body[a:b])
                m = len(own) - run_words + 1
                if m < 1:
                    continue
                whole = owner[:m] == owner[run_words - 1 :]
                sizes = np.bincount(owner, minlength=b - a)
                width = np.zeros(b - a, np.int64)
                for least, r in PARTITIONS:
                    width[sizes >= least] = r
                upto = np.searchsorted(owner, np.arange(b - a + 1))
                for r, keys in _window_keys(own, run_words, sorted(set(width.tolist()))).items():
                    at = np.flatnonzero(whole & (width[owner[:m]] == r))
                    place, passage = indexes[r].hits(keys[at])
                    for d, p in sorted(set(zip(owner[at[place]].tolist(), passage.tolist()))):
                        n, first = _longest_run(own[upto[d] : upto[d + 1]], words[p], run_words)
                        if n and p not in spoken:
                            spoken[p] = _WORD.findall(texts[p].lower())
                        if n and f" {' '.join(spoken[p][first : first + n])} " in f" {' '.join(_WORD.findall(body[a + d].lower()))} ":
                            found.append((docs[a + d], ids[p], n))
            yield pd.DataFrame(found, columns=["id", "item", "shared_words"])

    return run


def _containments(shared, threshold: float, margin: float):
    """Verified (id, item, estimate, containment) of each batch of documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, shingles, sketch_sizes, index = shared.value
        for batch in batches:
            docs, body = batch["id"].tolist(), [normalised(t) for t in batch["text"]]
            found = []
            for a, b in slices(body):
                own, first = runs(*(words_owner := word_hashes(body[a:b])), SHINGLE)
                of = words_owner[1][first] if len(first) else first
                upto = np.searchsorted(of, np.arange(b - a + 1))
                place, passage = index.hits(own)
                hits = np.unique(np.stack([of[place], passage, own[place].view(np.int64)]), axis=1) if len(place) else np.zeros((3, 0), np.int64)
                pairs, shared_hashes = np.unique(hits[:2], axis=1, return_counts=True)
                for (d, p), n in zip(pairs.T.tolist(), shared_hashes.tolist()):
                    estimate = n / sketch_sizes[p]
                    if estimate >= threshold - margin:
                        exact = float(np.isin(shingles[p], own[upto[d] : upto[d + 1]]).mean())
                        if exact >= threshold:
                            found.append((docs[a + d], ids[p], estimate, exact))
            yield pd.DataFrame(found, columns=["id", "item", "estimate", "containment"])

    return run


def _blocks(passages: DataFrame, item_id: str, passage: str) -> Iterator[tuple[list, list[str]]]:
    """(item ids, normalised passages) of the items, block by block."""
    items = passages.select(F.col(item_id).cast("string").alias("id"), F.col(passage).alias("text")).where("text <> ''")
    chars = items.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    n = -(-chars // BLOCK_CHARS) or 1
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).collect()
        yield [r["id"] for r in rows], [normalised(r["text"]) for r in rows]


def _scan(docs: DataFrame, passages: DataFrame, doc_id: str, text: str, item_id: str, passage: str, step, columns: str) -> DataFrame:
    """What ``step`` finds for each block of items, ids in their own types."""
    kinds = dict(docs.dtypes)[doc_id], dict(passages.dtypes)[item_id]
    rows = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text")).where("text IS NOT NULL")
    out = None
    for ids, texts in _blocks(passages, item_id, passage):
        part = rows.mapInPandas(step(ids, texts), f"id string, item string, {columns}")
        out = part if out is None else out.unionByName(part)
    return out.withColumns({"id": F.col("id").cast(kinds[0]), "item": F.col("item").cast(kinds[1])}).withColumnsRenamed({"id": doc_id, "item": item_id})


def leaked_items(docs: DataFrame, passages: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", run_words: int = 12) -> DataFrame:
    """Documents that hold at least ``run_words`` consecutive words of a passage.

    One row for each (doc_id, item_id) with shared_words, the longest shared run over the passages
    of the item. Words are maximal runs of letters or digits in lower case after NFKC, without
    invisible characters, tags read as blanks. An item may have several passages, a row each; NULL,
    empty and shorter passages and texts share nothing. Repeated documents are reported each;
    ids repeated in several rows count as one document with all their texts.
    """
    if run_words < SHINGLE:
        raise ValueError(f"run_words must be {SHINGLE} at least")
    spark = docs.sparkSession
    widths = sorted({r for _, r in PARTITIONS})

    def step(ids: list, texts: list[str]):
        of_each = [word_hashes([t])[0] for t in texts]
        keys = [(p, _window_keys(w, run_words, widths)) for p, w in enumerate(of_each) if len(w) >= run_words]
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        index = {r: _Index(*((np.concatenate(x) for x in zip(*[(k[r], np.full(len(k[r]), p)) for p, k in keys])) if keys else none)) for r in widths}
        return _leaks(spark.sparkContext.broadcast((ids, texts, of_each, index)), run_words)

    found = _scan(docs, passages, doc_id, text, item_id, passage, step, "shared_words int")
    return found.groupBy(doc_id, item_id).agg(F.max("shared_words").alias("shared_words"))


def contained_items(
    docs: DataFrame, passages: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", threshold: float = 0.8, margin: float = 0.25
) -> DataFrame:
    """Documents that hold at least ``threshold`` of the five-word shingles of a passage, wherever they stand.

    One row for each (doc_id, item_id) with estimate, the share of the item's sketch that the document has, and
    containment, the exact share, of the passage with most of it. Pairs whose estimate is below the threshold by more than ``margin``
    are not verified; the estimate of an item that fits its sketch is exact. Passages shorter than a shingle are contained nowhere.
    Words, NULL and repeated rows as in :func:`leaked_items`.
    """
    spark = docs.sparkSession

    def step(ids: list, texts: list[str]):
        sets = []
        for t in texts:
            words, owner = word_hashes([t])
            sets.append(np.unique(runs(words, owner, SHINGLE)[0]))
        sketches = [s[: next(k for least, k in reversed(SKETCHES) if len(s) >= least)] for s in sets]
        numbers = np.concatenate(sketches) if sketches else np.zeros(0, np.uint64)
        index = _Index(numbers, np.repeat(np.arange(len(sketches)), [len(s) for s in sketches]))
        return _containments(spark.sparkContext.broadcast((ids, sets, [len(s) for s in sketches], index)), threshold, margin)

    found = _scan(docs, passages, doc_id, text, item_id, passage, step, "estimate double, containment double")
    best = F.max(F.struct("containment", "estimate"))
    return found.groupBy(doc_id, item_id).agg(best.alias("b")).select(doc_id, item_id, "b.estimate", "b.containment")
