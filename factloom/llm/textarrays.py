"""Words of many texts as numpy arrays, without a Python step per word.

A batch of texts becomes one array of code points; a word is a maximal run of letters or digits in
lower case, and its 64 bit hash is the sum of a random number for each character times an odd one for its place, taken
with ``np.add.reduceat``.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_TAG = re.compile(r"<[^<>]*>")
#: Zero-width space, non-joiner, joiner, direction marks, word joiner, invisible operators, BOM, soft hyphen (fixed values).
_INVISIBLE = dict.fromkeys([0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0x2061, 0x2062, 0x2063, 0x2064, 0xFEFF, 0x00AD, 0x180E])
_INVISIBLE_RE = re.compile("[" + "".join(map(chr, _INVISIBLE)) + "]")
_alnum: np.ndarray | None = None
_letters: np.ndarray | None = None


def alnum_table() -> np.ndarray:
    """For each code point, whether it is a letter or digit."""
    global _alnum
    if _alnum is None:
        _alnum = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
    return _alnum


def letter_table() -> np.ndarray:
    """A random 64 bit number for each code point."""
    global _letters
    if _letters is None:
        _letters = mixed(np.arange(1, 0x110001, dtype=np.uint64) * _M1)
    return _letters


def normalised(text: str | None) -> str:
    """Compatibility form without invisible characters, tags read as blanks."""
    if not text:
        return ""
    if not text.isascii():
        text = _INVISIBLE_RE.sub("", unicodedata.normalize("NFKC", text))
    return _TAG.sub(" ", text) if "<" in text else text


def mixed(x: np.ndarray) -> np.ndarray:
    """A well mixing bijection of 64 bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def slices(texts: list[str], most: int = 1 << 20):
    """(first, last) ranges of texts with about ``most`` characters each, so that arrays stay small."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def _place_table(n: int) -> np.ndarray:
    """An odd random number for each place in a word."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * _M3) | np.uint64(1)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of its text), in order. Texts are lowered here."""
    joined = "\n".join(texts).lower() if len(texts) != 1 else texts[0].lower()
    lengths = [len(t) for t in texts]
    if len(joined) != sum(lengths) + max(0, len(texts) - 1):  # lower() changed a length
        texts = [t.lower() for t in texts]
        lengths = [len(t) for t in texts]
        joined = "\n".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = alnum_table()[codes]
    if not inside.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, stops = edge[::2], edge[1::2]
    sizes = stops - starts
    offsets = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    place = np.arange(len(codes))[: offsets[-1] + sizes[-1]] - np.repeat(offsets, sizes)
    values = letter_table()[codes[inside]] * _place_table(int(sizes.max()))[place]
    words = mixed(np.add.reduceat(values, offsets))
    ends = np.cumsum(np.asarray(lengths) + 1)
    return words, np.searchsorted(ends, starts, side="right")


def runs(words: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of ``n`` words within one text, index of its first word)."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(words) - n + 1
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = mixed(out * _M1 + words[k : k + m])
    first = np.flatnonzero(owner[:m] == owner[n - 1 :])
    return out[first], first
