"""Vectorised word and n-gram hashing over byte buffers.

Words are maximal runs of ASCII letters and digits and of bytes from 0x80 on, with A-Z lowered. As every byte of a
multi-byte character is at least 0x80, working on UTF-8 bytes gives the same words as working on characters.
"""

from __future__ import annotations

import numpy as np

from inkstone.llm.common import Texts

U = np.uint64
_LOW = np.zeros(256, np.uint8)
for _b in range(256):
    if 0x30 <= _b <= 0x39 or 0x61 <= _b <= 0x7A or _b >= 0x80:
        _LOW[_b] = _b
    elif 0x41 <= _b <= 0x5A:
        _LOW[_b] = _b + 32


def spread(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (the finaliser of MurmurHash3)."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def powers(n: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    out = np.full(n, base, dtype=U)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_POW = powers(1 << 12)
_MIX = spread(np.arange(1, 257, dtype=U))


def _pow(n: int) -> np.ndarray:
    global _POW
    if n > len(_POW):
        _POW = powers(1 << int(n).bit_length())
    return _POW


def run_hashes(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, mixed: np.ndarray = _MIX) -> np.ndarray:
    """64-bit hash of each run codes[starts[i] : starts[i] + lengths[i]]; runs are disjoint, in order and not empty."""
    if not len(starts):
        return np.zeros(0, U)
    total = int(lengths.sum())
    begin = np.cumsum(lengths) - lengths
    within = np.arange(total, dtype=np.int64) - np.repeat(begin, lengths)
    at = within + np.repeat(starts, lengths)
    terms = mixed[codes[at]] * _pow(int(lengths.max()))[within]
    return spread(np.add.reduceat(terms, begin) + lengths.astype(U))


class Words:
    """Words of a group of texts: starts, lengths (bytes), hash and text number of each, and words per text."""

    def __init__(self, texts: Texts):
        low = _LOW[texts.data]
        self.low = low
        is_word = low != 0
        first = is_word.copy()
        if len(low):
            first[1:] &= ~is_word[:-1]
            heads = texts.starts[texts.starts < len(low)]
            first[heads] = is_word[heads]
            last = is_word.copy()
            last[:-1] &= ~is_word[1:]
            tails = texts.ends[texts.ends > 0] - 1
            last[tails] = is_word[tails]
            self.starts = np.flatnonzero(first)
            self.lengths = np.flatnonzero(last) + 1 - self.starts
        else:
            self.starts = self.lengths = np.zeros(0, np.int64)
        self.hash = run_hashes(low, self.starts, self.lengths)
        self.counts = np.diff(np.concatenate(([0], np.searchsorted(self.starts, texts.ends))))
        self.text = np.repeat(np.arange(len(texts)), self.counts)

    def word(self, i: int) -> bytes:
        return self.low[self.starts[i] : self.starts[i] + self.lengths[i]].tobytes()


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive word hashes; entry i covers words i to i+n-1 (of the whole group: bounds are the caller's)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    q = powers(n, 0xD6E8FEB86659FD93)
    out = np.zeros(m, U)
    for k in range(n):
        out += words[k : k + m] * q[k]
    return spread(out)


def within_text(counts: np.ndarray, n: int) -> np.ndarray:
    """Which starts of n-word windows stay inside their own text."""
    total = int(counts.sum())
    if total < n:
        return np.zeros(0, bool)
    ends = np.repeat(np.cumsum(counts), counts)
    return np.arange(total - n + 1) + n <= ends[: total - n + 1]
