"""What is left of a text's vocabulary when a tenth of its words go, by draws that are functions of md5: in one pass, nothing shuffled."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from inkstone.plans.catalogue import builder
from inkstone.sources.tables import table

DRAWS = 30
AT_ONCE = 1 << 14
_WORD = re.compile(r"[a-z']+")
_SHIFTS = [s for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in row * 4]
_SINES = [int(abs(np.sin(i + 1)) * 2**32) for i in range(64)]
_PLACES = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *((7 * i) % 16 for i in range(16))]


def first_words(blocks: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The first four bytes, as a number, of md5 of messages of at most 31 bytes: rows of 32 bytes, closed by 0x80; bits: their lengths."""
    m = np.ascontiguousarray(blocks.view("<u4").T)
    used = int(bits.max(initial=0)) // 32 + 1
    start = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
    a, b, c, d = (np.full(len(blocks), x, np.uint32) for x in start)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(61):  # b of this step is a of the last, and a alone is asked
        if i < 16:
            np.bitwise_and(np.bitwise_xor(c, d, out=f), b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_and(np.bitwise_xor(b, c, out=f), d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(np.bitwise_xor(b, c, out=f), d, out=f)
        else:
            np.bitwise_or(np.invert(d, out=f), b, out=f)
            np.bitwise_xor(f, c, out=f)
        f += a
        f += np.uint32(_SINES[i])
        place = _PLACES[i]
        if place < used:
            f += m[place]
        elif place == 14:
            f += bits
        np.right_shift(f, np.uint32(32 - _SHIFTS[i]), out=t)
        np.left_shift(f, np.uint32(_SHIFTS[i]), out=f)
        np.bitwise_or(f, t, out=f)
        f += b
        a, b, c, d, f = d, f, b, c, a
    b += np.uint32(start[0])
    return b.byteswap()


def _messages(doc_id: int, low: int, high: int, out: np.ndarray, bits: np.ndarray) -> None:
    """Puts 'draw:doc_id:place' for each draw and place from low to high, padded, into out, draws x places x 32 bytes; bits: their lengths."""
    for n in range(len(str(low)), len(str(high)) + 1):
        a, z = max(10 ** (n - 1) if n > 1 else 0, low), min(10**n, high)
        if a >= z:
            continue
        shown = (np.arange(a, z)[:, None] // 10 ** np.arange(n - 1, -1, -1) % 10 + 48).astype(np.uint8)
        for k, draws in ((0, range(min(10, len(out)))), (10, range(10, len(out)))):
            if draws:
                heads = np.frombuffer("".join(f"{draw}:{doc_id}:" for draw in draws).encode(), np.uint8).reshape(len(draws), -1)
                width = heads.shape[1]
                part = out[k : k + len(draws), a - low : z - low]
                part[:, :, :width] = heads[:, None]
                part[:, :, width : width + n] = shown
                part[:, :, width + n] = 0x80
                bits[k : k + len(draws), a - low : z - low] = 8 * (width + n)


def hashes(docs: list[tuple[int, int]], draws: int = DRAWS) -> list[np.ndarray]:
    """For each (doc_id, n) draws x n numbers of 32 bits; many short texts go together, a long one in strips, so that all stays in a core's cache."""
    out = [np.empty((draws, n), np.uint32) for _, n in docs]
    strip = max(1, AT_ONCE // draws)
    parts = [(k, low, min(n, low + strip)) for k, (_, n) in enumerate(docs) for low in range(0, n, strip)]
    while parts:
        taken, size = [], 0
        while parts and (not taken or size + draws * (parts[-1][2] - parts[-1][1]) <= AT_ONCE):
            taken.append(parts.pop())
            size += draws * (taken[-1][2] - taken[-1][1])
        rows, bits, at = np.zeros((size, 32), np.uint8), np.empty(size, np.uint32), 0
        for k, low, high in taken:
            span = slice(at, at := at + draws * (high - low))
            _messages(docs[k][0], low, high, rows[span].reshape(draws, high - low, 32), bits[span].reshape(draws, high - low))
        found, at = first_words(rows, bits), 0
        for k, low, high in taken:
            out[k][:, low:high] = found[at : (at := at + draws * (high - low))].reshape(draws, -1)
    return out


def shares_left(hashed: np.ndarray, words: list[str]) -> np.ndarray:
    """By draw: share of the different words that are left when the tenth with the least hashes, then places, is gone."""
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    draws, n, kinds, gone = len(hashed), len(words), len(number), len(words) // 10
    keys = hashed.astype(np.uint64) << np.uint64(32) | np.arange(n, dtype=np.uint64)
    keys.partition(gone - 1, axis=1)
    lost = ids[(keys[:, :gone] & np.uint64(0xFFFFFFFF)).astype(np.int64)] + np.arange(draws)[:, None] * kinds
    lost = np.bincount(lost.ravel(), minlength=draws * kinds).reshape(draws, kinds)
    return (kinds - (lost == np.bincount(ids, minlength=kinds)).sum(axis=1)) * 1.0 / kinds


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def told(held: list) -> pa.RecordBatch:
        found = hashes([(doc_id, len(words)) for doc_id, words in held])
        left = [float(np.cumsum(shares_left(h, words))[-1]) / DRAWS for h, (_, words) in zip(found, held, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([d for d, _ in held], pa.int64()), pa.array([DRAWS] * len(held), pa.int64()), pa.array(left, pa.float64())], ["doc_id", "draws", "kept"])

    held, n = [], 0
    for batch in batches:
        for doc_id, text in zip(*batch.columns, strict=True):
            words = _WORD.findall(text.as_py() or "")
            if len(words) >= 10:
                held.append((doc_id.as_py(), words))
                n += len(words)
            if n * DRAWS >= 8 * AT_ONCE:
                yield told(held)
                held, n = [], 0
    if held:
        yield told(held)


@builder("deletion_shares", "")  # Spark alone reads it
def _deletion_shares(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id", F.lower("text").alias("text"))
    return docs.mapInArrow(_left, "doc_id long, draws long, kept double")
