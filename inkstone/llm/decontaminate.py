"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Training texts are scanned once, in Arrow batches: words are hashed in place, each window of 13 words looks its hash up
in the set (a bitmap first, then the sorted hashes), hits are compared word by word, and the words of confirmed windows
are marked. Nothing is shuffled. An item of fewer than 13 words is one window.

What is broadcast is flat: the normalised words of the items as bytes, where each word stands, and per window its sorted
hash, first word and item, some 13 bytes for each byte of text at most. A benchmark of more than MOST_BYTES of text is cut
into parts that keep this bound, items longer than a part with it (pieces overlap by all but one word of a window), and
the documents are scanned once per part; the marks are united.

Cases: null and empty texts have no words and are never contaminated; null and empty items have no window; an item without
an id marks words like any other and is told as the item "null"; repeated items count under each item_id, items of one
item_id once; repeated documents are judged alike; a very long text is scanned whole, in memory of some 40 times its size;
an empty table gives no row, an empty benchmark no hit; extra columns of any name are ignored by report() and kept by remove().
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from inkstone.llm.common import Texts, cut_table, free, lists, text_groups
from inkstone.llm.kernels import U, Words, gram_hashes, within_text

N = 13
MOST_BYTES = 8 << 20
CHAINED = 6  # parts that scan one after the other before what they marked is written
SHARE = 20  # a document is contaminated from one hit word in so many


class WindowSet:
    """Windows of the benchmark by length: sorted hashes, a bitmap before them, and where each window's words stand."""

    def __init__(self, items: list[tuple[object, str | None, bool]], n: int = N):
        """items: (id, text, whether it is a piece of a longer item, which has no short window)."""
        parts, self.names, hashes, firsts, of = [], [], {}, {}, {}
        starts, ends, at, words_so_far = [], [], 0, 0
        for item_id, text, is_piece in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            words = Words(Texts(raw, np.array([len(raw)]), None))
            count = len(words.starts)
            k = n if is_piece else min(n, count)
            if not count or count < k:
                continue
            grams = gram_hashes(words.hash, k)
            hashes.setdefault(k, []).append(grams)
            firsts.setdefault(k, []).append(np.arange(words_so_far, words_so_far + len(grams), dtype=np.int32))
            of.setdefault(k, []).append(np.full(len(grams), len(self.names), np.int32))
            self.names.append("null" if item_id is None else str(item_id))
            said = b" ".join(words.word(i) for i in range(count))
            sizes = words.lengths + 1
            starts.append(at + np.cumsum(sizes) - sizes)
            ends.append(starts[-1] + words.lengths)
            parts.append(said)
            at += len(said) + 1
            words_so_far += count
        self.said = b"\n".join(parts)
        self.starts = np.concatenate(starts).astype(np.int32) if starts else np.zeros(0, np.int32)
        self.ends = np.concatenate(ends).astype(np.int32) if ends else np.zeros(0, np.int32)
        self.lengths = {}
        for k in hashes:
            h, first, item = (np.concatenate(x[k]) for x in (hashes, firsts, of))
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << 20, bool)
            bits[(h >> U(44)).astype(np.int64)] = True
            self.lengths[k] = (h[order], bits, first[order], item[order])

    @property
    def size(self) -> int:
        return sum(len(v[0]) for v in self.lengths.values())

    def hits(self, words: Words) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, length, items) of each confirmed window."""
        for k, (hashes, bits, first, item) in self.lengths.items():
            grams = gram_hashes(words.hash, k)
            maybe = np.flatnonzero(bits[(grams >> U(44)).astype(np.int64)] & within_text(words.counts, k)) if len(grams) else []
            if not len(maybe):
                continue
            low, high = (np.searchsorted(hashes, grams[maybe], side=s) for s in ("left", "right"))
            there = high > low
            for i, a, b in zip(maybe[there].tolist(), low[there].tolist(), high[there].tolist(), strict=True):
                said = b" ".join(words.word(j) for j in range(i, i + k))
                names = [self.names[item[x]] for x in range(a, b) if self.said[self.starts[first[x]] : self.ends[first[x] + k - 1]] == said]
                if names:
                    yield i, k, names


def pieces(text: str, most: int, n: int = N) -> Iterator[str]:
    """A long text in pieces of about `most` characters that hold each of its n-word windows."""
    words = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    begins: deque[int] = deque(maxlen=n)  # of the last words
    start, last = 0, 0
    for m in words.finditer(text):
        if m.end() - start > most and len(begins) == n and begins[1] > start:
            yield text[start:last]
            start = begins[1]
        begins.append(m.start())
        last = m.end()
    yield text[start:]


def window_sets(benchmark: DataFrame, n: int = N, most: int = MOST_BYTES) -> Iterator[WindowSet]:
    """The benchmark's windows in sets of bounded size; items come to the driver one partition at a time, never all."""
    part, held = [], 0
    for item_id, text in benchmark.select("item_id", "text").toLocalIterator():
        cut = [text] if text is None or len(text) <= most else list(pieces(text, most, n))
        for piece in cut:
            if held and held + len(piece or "") > most:
                yield WindowSet(part, n)
                part, held = [], 0
            part.append((item_id, piece, len(cut) > 1))
            held += len(piece or "")
    yield WindowSet(part, n)


def _marker(shared):
    def scan(batches):
        windows = shared.value
        for texts in text_groups(batches):
            words = Words(texts)
            hit = np.zeros(len(words.starts), bool)
            items: dict[int, set] = {}
            for i, k, ids in windows.hits(words):
                hit[i : i + k] = True
                items.setdefault(int(words.text[i]), set()).update(ids)
            where = np.flatnonzero(hit)
            edges = np.searchsorted(where, np.concatenate(([0], np.cumsum(words.counts))))
            before = np.repeat(np.cumsum(words.counts) - words.counts, np.diff(edges))
            spans = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array((where - before).astype(np.int32)))
            ids = pa.array([sorted(items.get(d, ())) for d in range(len(texts))], type=pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*texts.rows.columns, pa.array(words.counts.astype(np.int64)), spans, ids], [*texts.rows.schema.names, "n_words", "hit_words", "items"])

    return scan


def mark(docs: DataFrame, benchmark: DataFrame, n: int = N, keep_text: bool = False) -> DataFrame:
    """doc_id (and text), n_words, hit_words (numbers of words in an occurring window), items (ids of items that occur)."""
    spark = docs.sparkSession
    base = docs.select("doc_id", "text")
    fields = "doc_id {}, text string, n_words long, hit_words array<int>, items array<string>".format(dict(base.dtypes)["doc_id"])
    marked = None
    for k, windows in enumerate(window_sets(benchmark, n)):
        if k and k % CHAINED == 0:
            marked = cut_table(marked)
        one = base.mapInArrow(_marker(spark.sparkContext.broadcast(windows)), fields)
        if k == 0:
            marked = one
        else:  # a further part of a large benchmark scans what the parts before it have marked
            scan = _marker(spark.sparkContext.broadcast(windows))
            again = marked.select("doc_id", "text", F.col("hit_words").alias("_h"), F.col("items").alias("_i")).mapInArrow(scan, fields.replace("n_words", "_h array<int>, _i array<string>, n_words"))
            marked = again.select("doc_id", "text", "n_words", F.array_sort(F.array_union("_h", "hit_words")).alias("hit_words"), F.array_sort(F.array_union("_i", "items")).alias("items"))
    return marked if keep_text else marked.drop("text")


def report(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = F.size("hit_words").cast("long")
    return mark(docs, benchmark, n).select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), ((hit > 0) & (SHARE * hit >= F.col("n_words"))).alias("contaminated"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """docs without contaminated documents; in the rest, the words of occurring windows are cut out with what lies between them.

    The hits of all parts of a large benchmark are united before a document is judged and cut. All columns of docs stay, in
    order; a text that loses words is rebuilt, any other is kept byte for byte.
    """
    spark, names, schema = docs.sparkSession, docs.columns, docs.schema
    hits = free(docs, "_hits_of_parts")
    parts = window_sets(benchmark, n)
    windows, k = next(parts), 0
    while windows is not None:
        following = next(parts, None)
        last, k = following is None, k + 1
        if k % CHAINED == 0:
            docs = cut_table(docs)
        docs = docs.mapInArrow(_remover(spark.sparkContext.broadcast(windows), last, hits), schema if last else StructType([*schema.fields, StructField(hits, ArrayType(IntegerType()))]))
        windows = following
    return docs.select(*names)




def _remover(shared, last: bool, named: str):
    """Words that the parts up to this one hit go on in a column of their own; the last part judges and cuts by all of them."""

    def scan(batches):
        windows = shared.value
        for texts in text_groups(batches):
            words = Words(texts)
            hit = np.zeros(len(words.starts), bool)
            firsts = np.cumsum(words.counts) - words.counts
            rows, at = texts.rows, texts.rows.schema.get_field_index(named)
            if at >= 0:
                before = rows.column(at)
                hit[np.repeat(firsts, before.value_lengths().to_numpy()) + before.flatten().to_numpy()] = True
                rows = rows.remove_column(at)
            for i, k, _ in windows.hits(words):
                hit[i : i + k] = True
            per = np.bincount(words.text[hit], minlength=len(texts))
            if not last:
                yield rows.append_column(named, lists(np.flatnonzero(hit) - np.repeat(firsts, per), per, pa.int32()))
                continue
            if not hit.any():
                yield rows
                continue
            keep = ~((per > 0) & (SHARE * per >= words.counts))
            at = rows.schema.get_field_index("text")
            column = rows.column(at).to_pylist()
            for d in np.flatnonzero(keep & (per > 0)).tolist():
                raw, out, done = texts.data[texts.starts[d] : texts.ends[d]].tobytes(), [], 0
                inside = np.flatnonzero(hit[firsts[d] : firsts[d] + words.counts[d]]) + firsts[d]
                for run in np.split(inside, np.flatnonzero(np.diff(inside) > 1) + 1):
                    a, b = words.starts[run[0]] - texts.starts[d], words.starts[run[-1]] + words.lengths[run[-1]] - texts.starts[d]
                    out.append(raw[done:a])
                    done = b
                column[d] = b"".join([*out, raw[done:]]).decode()
            rows = rows.set_column(at, rows.schema.field(at), pa.array(column, type=rows.schema.field(at).type))
            yield rows.filter(pa.array(keep))

    return scan


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
