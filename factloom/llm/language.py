"""Language of each document and of each stretch of a mixed one.

Multinomial naive Bayes over hashed character n-grams. The n-gram counts of the labelled texts are
summed by Spark over all of them; what reaches the driver is one row per (language, bucket), at
most languages x buckets, from which the log-probability matrix is built and broadcast. Batches of
texts are scored in numpy: n-gram hashes index rows of the matrix, and sums per sentence are taken
without a Python step per n-gram. Scoring needs no shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Usual spellings of a language label beside its two-letter code: three letters and English names (fixed values).
SPELLINGS = {
    "en": ("eng", "english"),
    "de": ("deu", "ger", "german"),
    "fr": ("fra", "fre", "french"),
    "es": ("spa", "spanish", "castilian"),
    "pt": ("por", "portuguese"),
    "nl": ("nld", "dut", "dutch", "flemish"),
    "zh": ("zho", "chi", "chinese", "mandarin"),
    "it": ("ita", "italian"),
    "pl": ("pol", "polish"),
    "ru": ("rus", "russian"),
    "ja": ("jpn", "japanese"),
    "ko": ("kor", "korean"),
}
ORDERS = (1, 2, 3, 4)
_MULTIPLIERS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F))
_WINDOW = 1 << 19
_MOST_AGAINST = 40.0


@dataclass(frozen=True)
class Model:
    """``logp`` [buckets, languages]: log P(bucket | language); bucket 0 is no n-gram and scores 0."""

    languages: tuple[str, ...]
    logp: np.ndarray
    bits: int
    switch_cost: float


_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def _codes(text: str) -> np.ndarray:
    """Code points in lower case, everything but letters as blank."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_letter_table()[codes], codes, np.uint32(32))


def _buckets(codes: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each place; 0 where it holds only blanks or the text ends."""
    m = len(codes) - order + 1
    out = np.zeros(len(codes), np.uint32)
    if m <= 0:
        return out
    h = np.full(m, order * 0x3C6EF372 & 0xFFFFFFFF, np.uint32)
    some = np.zeros(m, bool)
    for k in range(order):
        part = codes[k : k + m]
        h = (h ^ part) * _MULTIPLIERS[k]
        h ^= h >> np.uint32(15)
        some |= part != 32
    h = (h * _MULTIPLIERS[0]) >> np.uint32(32 - bits)
    out[:m] = np.where(some, np.maximum(h, 1), 0)
    return out


def _without_accents(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def _ngram_counts(bits: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for lang, text in zip(batch["lang"], batch["text"]):
                for form in dict.fromkeys((text, _without_accents(text))):
                    codes = _codes(f" {form} ")
                    for n in ORDERS:
                        b, k = np.unique(_buckets(codes, n, bits), return_counts=True)
                        parts.append(pd.DataFrame({"lang": lang, "bucket": b.astype(np.int64), "n": k.astype(np.int64)}))
            if parts:
                yield pd.concat(parts).groupby(["lang", "bucket"], as_index=False)["n"].sum()

    return count


def train(samples: DataFrame, text: str = "text", lang: str = "lang", bits: int = 16, smoothing: float = 0.1, switch_cost: float = 8.0) -> Model:
    """Fit on all labelled rows. Rows with a NULL or empty text or label are left out.

    Each text counts as written and, if different, without its accents, so that texts that lost
    their accents are scored by the same matrix. The driver receives at most
    languages x 2**bits counts, whatever the number of rows.
    """
    rows = samples.select(canonical_language(F.col(lang)).alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
    counts = rows.mapInPandas(_ngram_counts(bits), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(counts["lang"].unique()))
    size = 1 << bits
    matrix = np.full((size, max(1, len(languages))), smoothing, np.float64)
    for j, name in enumerate(languages):
        own = counts[counts["lang"] == name]
        matrix[own["bucket"].to_numpy(), j] += own["n"].to_numpy()
    matrix[0] = 0
    logp = np.log(np.maximum(matrix, 1e-300)) - np.log(matrix.sum(axis=0, keepdims=True))
    logp[0] = 0
    return Model(languages, logp.astype(np.float32), bits, switch_cost)


_SENTENCE = re.compile(r"(?:[.!?…]+[\"'”’»)\]]*(?=\s|$)|[。！？]+[”’」』]*|\n[^\S\n]*\n)")


_MARKUP = re.compile(r"<[^<>]*>|[\u200b-\u200f\u2060-\u2064\ufeff\xad]")


def without_markup(text: str) -> str:
    """Tags and invisible characters as blanks, so that offsets stay."""
    if text.isascii() and "<" not in text:
        return text
    return _MARKUP.sub(lambda m: " " * len(m[0]), text)


def sentence_ends(text: str) -> list[int]:
    """Offsets at which sentences end: after closing punctuation before white space, after full-width
    punctuation, at blank lines, and at the end of the text."""
    ends = [m.end() for m in _SENTENCE.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return ends


def _sentence_scores(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(scores [sentence, language], letters per sentence, whether they are the larger part of what is not blank, document of
    each, end offset of each)."""
    ends = [sentence_ends(t) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(e) for e in ends])
    local = np.concatenate([np.asarray(e, np.int64) for e in ends]) if ends else np.zeros(0, np.int64)
    lengths = np.asarray([len(t) for t in texts], np.int64)
    base = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    stops = base[owner] + local
    starts = np.concatenate(([0], stops[:-1]))
    new = np.concatenate(([True], owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, bool)
    starts[new] = base[owner[new]]
    lowered = [t.lower() for t in texts]
    lowered = [a if len(a) == len(t) else "".join(c.lower() if len(c.lower()) == 1 else c for c in t) for a, t in zip(lowered, texts)]
    codes = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters, marks = _letter_table()[codes], codes > 32
    codes = np.where(letters, codes, np.uint32(32))
    k = model.logp.shape[1]
    scores, count, others = np.zeros((len(stops), k), np.float64), np.zeros(len(stops), np.int64), np.zeros(len(stops), np.int64)
    for lo in range(0, len(codes), _WINDOW):
        hi = min(lo + _WINDOW, len(codes))
        first, last = np.searchsorted(stops, lo, side="right"), np.searchsorted(starts, hi, side="left")
        if first >= last:
            continue
        cuts = np.maximum(starts[first:last], lo) - lo
        total = None
        for n in ORDERS:
            b = _buckets(codes[lo : min(hi + n - 1, len(codes))], n, model.bits)[: hi - lo]
            part = np.add.reduceat(model.logp[b], np.minimum(cuts, hi - lo - 1), axis=0)
            total = part if total is None else total + part
        some = stops[first:last] > starts[first:last]
        scores[first:last] += np.where(some[:, None], total, 0)
        for into, what in ((count, letters[lo:hi]), (others, marks[lo:hi] & ~letters[lo:hi])):
            into[first:last] += np.where(some, np.add.reduceat(what.astype(np.int64), np.minimum(cuts, hi - lo - 1)), 0)
    return scores, count, count >= others, owner, local


def _stretches(scores: np.ndarray, cost: float) -> list[tuple[int, int, int]]:
    """(first, last, language) of the best division in which each stretch has two sentences or more.

    A sentence speaks against a language by at most ``_MOST_AGAINST``, so one foreign sentence, however clear,
    costs less inside a stretch than a stretch that takes in a neighbour for it.
    """
    scores = np.maximum(scores - scores.max(axis=1, keepdims=True), -_MOST_AGAINST)
    n, k = scores.shape
    if n < 4 or len(set(scores.argmax(axis=1))) == 1:
        whole = [(0, n, int(scores.sum(axis=0).argmax()))]
        return whole
    new, long = scores[0].copy(), np.full(k, -np.inf)
    back_new, back_long = np.zeros((n, k), np.int64), np.zeros((n, k), bool)
    for i in range(1, n):
        order = np.argsort(long)[::-1][:2]
        best = np.where(np.arange(k) == order[0], order[1] if k > 1 else order[0], order[0])
        begin = long[best] - cost + scores[i]
        stay = np.where(long >= new, long, new) + scores[i]
        back_new[i], back_long[i] = best, long >= new
        new, long = begin, stay
    lang, i, last, out = int(long.argmax()), n - 1, n, []
    in_long = True
    while i > 0:
        if in_long:
            in_long = bool(back_long[i, lang])
            i -= 1
        else:
            out.append((i, last, lang))
            last, lang, in_long = i, int(back_new[i, lang]), True
            i -= 1
    out.append((0, last, lang))
    return out[::-1]


def _detect(shared, min_letters: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from factloom.llm.textarrays import slices

        model = shared.value
        for batch in batches:
            ids, texts = batch["id"].tolist(), [without_markup(t or "") for t in batch["text"]]
            out: list[tuple] = []
            for a, b in slices(texts):
                scores, letters, wordy, owner, local = _sentence_scores(model, texts[a:b])
                bounds = np.searchsorted(owner, np.arange(b - a + 1))
                for d in range(b - a):
                    s = np.arange(bounds[d], bounds[d + 1])
                    telling = s[(letters[s] >= min_letters) & wordy[s]]
                    s = telling if len(telling) else s[letters[s] > 0]
                    if letters[s].sum() < 2:
                        continue
                    parts = _stretches(scores[s], model.switch_cost) if len(telling) else [(0, len(s), int(scores[s].sum(axis=0).argmax()))]
                    begin = 0
                    for no, (first, last, lang) in enumerate(parts, 1):
                        own = s[first:last]
                        tempered = scores[own].sum(axis=0) / (len(ORDERS) * np.sqrt(max(1, letters[own].sum())))
                        weights = np.exp(tempered - tempered.max())
                        stop = int(local[own[-1]]) if no < len(parts) else len(texts[a + d])
                        out.append((ids[a + d], no, model.languages[lang], float(weights[lang] / weights.sum()), begin, stop, len(own), len(parts)))
                        begin = stop
            yield pd.DataFrame(out, columns=["id", "seg_no", "lang", "confidence", "char_start", "char_end", "n_sentences", "n_segments"])

    return run


def detect_languages(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", min_letters: int = 8) -> DataFrame:
    """One row per document and maximal stretch in one language.

    Columns: doc_id, seg_no (from 1), lang (two letters), confidence (0 to 1), char_start, char_end,
    n_sentences, n_segments. A stretch has two sentences or more unless it is the whole document;
    sentences with fewer than ``min_letters`` letters, or with fewer letters than digits and marks, belong to the
    stretch around them and decide nothing; where a document has no other, all its letters, of
    which there must be two, make one stretch. NULL, empty and letterless texts have no language and
    give no row; tags and invisible characters count as blanks; the stretches of a document cover it from its first to its last character.
    Repeated ids are scored row by row. Ties go to the alphabetically first language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[doc_id]
    if not model.languages:
        docs = docs.limit(0)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("text IS NOT NULL")
    schema = f"id {kind}, seg_no long, lang string, confidence double, char_start long, char_end long, n_sentences long, n_segments long"
    return rows.mapInPandas(_detect(shared, min_letters), schema).withColumnRenamed("id", doc_id)


def canonical_language(label: Column) -> Column:
    """Two-letter code of a label in a usual spelling (case, three letters, country, English name);
    other labels in lower case without their country; NULL for NULL, blank, ``und`` and ``unknown``."""
    bare = F.regexp_replace(F.lower(F.trim(label)), r"[-_ (].*$", "")
    known = F.create_map(*[F.lit(x) for code, names in SPELLINGS.items() for name in names for x in (name, code)])
    code = F.coalesce(F.try_element_at(known, bare), bare)
    return F.when(bare.isin("", "und", "unknown", "none", "null", "mul", "zxx", "n/a"), None).otherwise(code)


def language_cases(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Stretches of documents whose label is missing, no language or not that of the text, and of all
    documents in several languages. Columns as :func:`detect_languages` plus ``label``."""
    labelled = docs.select(F.struct(F.col(doc_id).alias("key"), F.col(lang).alias("label")).alias("row"), F.col(text).alias("text"))
    found = detect_languages(labelled, model, "row", "text")
    known = canonical_language(F.col("row.label"))
    return found.where((F.col("n_segments") > 1) | known.isNull() | (known != F.col("lang"))).select(
        F.col("row.key").alias(doc_id), "seg_no", "lang", "confidence", "char_start", "char_end", "n_sentences", "n_segments", F.col("row.label").alias("label")
    )
