"""Lexical and rhythmic measures of a text in one pass: a row per document, nothing shuffled, each text whole in one task.

Words are runs of a-z and ' in the lowered text, sentences those of functions/text.py. Null texts and texts without
words give nulls; a very long text takes some 100 bytes a word.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from inkstone.functions.lexicons import CONNECTIVES
from inkstone.plans.catalogue import builder
from inkstone.sources.tables import table

_WORD = re.compile(r"[a-z']+")
_VOWELS = re.compile(r"[aeiouy]+")
# \s and \S of the engine that splits sentences elsewhere: ASCII white space only
_SENTENCE = re.compile(r"""(?<=[.!?])[ \t\n\x0b\f\r]+(?=[A-Z"'])|\n\n+""")
_SAID = re.compile(r"[^ \t\n\x0b\f\r]")
WINDOW = 50

_MARKERS: dict[str, list[list[str]]] = {}
for _c in CONNECTIVES:
    _MARKERS.setdefault(_c.split()[0], []).append(_c.split())


@cache
def syllables(word: str) -> int:
    """Vowel groups, less a final e that is one of several, but one at least."""
    groups = len(_VOWELS.findall(word))
    return max(1, groups - (word[-1] == "e" and groups > 1))


def moving_ratio(ids: np.ndarray, window: int = WINDOW) -> float:
    """Mean share of different words over all windows: each place counts in the windows in which it is its word's first."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    before = np.full(n, -1)
    same = ids[order][1:] == ids[order][:-1]
    before[order[1:][same]] = order[:-1][same]
    if n < window:
        return int((before < 0).sum()) * 1.0 / n
    at = np.arange(n)
    starts = np.minimum(at, n - window) - np.maximum(np.maximum(before + 1, at - window + 1), 0) + 1
    return int(np.maximum(starts, 0).sum()) / (float(window) * (n - window + 1))


def connective_hits(words: list[str]) -> int:
    hits = 0
    for i, w in enumerate(words):
        if w in _MARKERS:
            hits += sum(words[i : i + len(m)] == m for m in _MARKERS[w])
    return hits


def spread_of(values: list[float]) -> tuple[float, float | None]:
    """Mean and sample variance (null for one value)."""
    mean = math.fsum(values) / len(values)
    return mean, math.fsum((v - mean) ** 2 for v in values) / (len(values) - 1) if len(values) > 1 else None


_NAMES = ["n", "v", "squares", "bits", "mattr", "hits", "s_n", "s_mean", "s_var", "s_min", "s_max", "g_mean", "g_var", "g_min", "g_max"]
_LONG = {"n", "v", "squares", "hits", "s_n", "s_min", "s_max"}


def measures(text: str | None) -> dict:
    """All measures of one text; those that it does not have are missing."""
    if text is None:
        return {}
    words = _WORD.findall(text.lower())
    if not words:
        return {}
    counts, n = Counter(words), len(words)
    number = {w: i for i, w in enumerate(counts)}
    out = {"n": n, "v": len(counts), "squares": sum(c * c for c in counts.values()), "bits": -math.fsum(c / n * math.log2(c / n) for c in counts.values())}
    out |= {"mattr": moving_ratio(np.fromiter(map(number.__getitem__, words), np.int64, n)), "hits": connective_hits(words)}
    sizes, grades = [], []
    for s in _SENTENCE.split(text):
        own = _WORD.findall(s.lower()) if _SAID.search(s) else ()
        if own:
            sizes.append(len(own))
            grades.append(0.39 * len(own) + 11.8 * sum(map(syllables, own)) / len(own) - 15.59)
    if sizes:
        (s_mean, s_var), (g_mean, g_var) = spread_of(sizes), spread_of(grades)
        out |= {"s_n": len(sizes), "s_mean": s_mean, "s_var": s_var, "s_min": min(sizes), "s_max": max(sizes), "g_mean": g_mean, "g_var": g_var, "g_min": min(grades), "g_max": max(grades)}
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measures(t.as_py()) for t in batch.column(3)]
        columns = [pa.array([r.get(c) for r in rows], pa.int64() if c in _LONG else pa.float64()) for c in _NAMES]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["doc_id", "source", "lang", *_NAMES])


@builder("measures", "")  # Spark alone reads it; the relations that it serves have SQL of their own for the oracle
def _measures(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.col("text"))
    kinds = ", ".join(f"{c} {'long' if c in _LONG else 'double'}" for c in _NAMES)
    return docs.mapInArrow(_measured, f"doc_id long, source string, lang string, {kinds}")
