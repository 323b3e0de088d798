"""Words of texts: ASCII white space splits them, A-Z is lower-cased where asked.

Two forms of one definition (``[^\\x20\\x09-\\x0D]+``): Spark expressions for
the native operators, and numpy over a batch of texts for the others.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def n_words(c: Column) -> Column:
    """Number of words as long; null counts 0."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTE = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown as needed."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: neighbouring inputs give unrelated outputs."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over bytes, modulo 2**64; length + 1 entries."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * _power(_BASE, len(buf)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``buf[start:end]`` spans; equal bytes hash alike at any place."""
    raw = (prefix[ends] - prefix[starts]) * _power(_BASE_INV, len(prefix))[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Texts:
    """A batch of texts as one byte buffer with word spans.

    ``buf`` holds the bytes with a NUL between texts, ``begin``/``end`` the
    span of each text, ``start``/``stop`` the word spans, ``doc`` the text
    of each word and ``first`` the index of each text's first word (one
    entry more than texts).  Nulls are empty texts.
    """

    def __init__(self, texts: Iterable[str | None], fold: bool = True):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.n = len(raw)
        self.end = np.cumsum(size + 1) - 1
        self.begin = self.end - size
        self.buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8) if raw else np.zeros(0, np.uint8)
        if fold:
            self.buf = _FOLD[self.buf]
        space = _SPACE[self.buf]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
        self.start, self.stop = edge[0::2], edge[1::2]
        self.doc = np.searchsorted(self.end, self.start, side="right")
        self.first = np.searchsorted(self.start, np.concatenate((self.begin, [len(self.buf)])))

    def word_hash(self) -> np.ndarray:
        """A 64-bit hash per word."""
        return span_hash(prefix_hash(self.buf), self.start, self.stop)

    def words_of(self, i: int) -> list[bytes]:
        return self.buf[self.begin[i]:self.end[i]].tobytes().split()


def batches(frames: Iterable, column: str = "text", chars: int = 1_000_000) -> Iterable:
    """Join and cut pandas batches to about ``chars`` characters of text each.

    A single longer text is a batch of its own: texts are never cut.
    """
    import pandas as pd

    held, size = [], 0
    for pdf in frames:
        lens = pdf[column].str.len().fillna(0).to_numpy().astype(np.int64)
        at = 0
        for i, n in enumerate(lens):
            if size and size + n > chars:
                held.append(pdf.iloc[at:i])
                yield pd.concat(held, ignore_index=True)
                held, size, at = [], 0, i
            size += int(n)
        held.append(pdf.iloc[at:])
    if held and sum(map(len, held)):
        yield pd.concat(held, ignore_index=True)
