"""N-gram Jaccard join: MinHash banding, then exact verification on full shingle sets.

Words are those of kernels.py; a text's shingles are its distinct runs of five words (a shorter text is one shingle).
Two texts are linked if their sets' Jaccard similarity is at least 0.8, decided in whole numbers.

1. Equal texts form one node with a copy count, so copies never become pairs.
2. Each node's MinHash signature is cut into bands; bands and rows follow from the wanted recall at the threshold. Nodes
   are shuffled on (band, hash). A bucket of more than one node is a unit; one of more than BLOCK nodes is dealt over
   blocks by salt, and each pair of blocks is a unit of its own, so that a task holds two blocks at most.
3. A unit is screened on signatures and set sizes alone: a pair is a candidate in the first band in which it meets, so it
   is one in a single unit, and only if the sizes allow the threshold. Nodes that are in no candidate pair go no further.
4. The sets (hashed shingles, no texts) of the others go to their units, where candidate pairs are verified by set
   products. What leaves a task is a row per node: its links (counting copies) and the least node that it is tied to.
5. Components over the verified ties are the classes; unverified pairs tie nothing.

A pair of similarity s meets with probability 1 - (1 - s**rows)**bands, at least RECALL from the threshold on. The work
in a group of m different near texts grows with m * m / 2 comparisons, as all links are counted, but no pair becomes a
row. Cases: null and empty texts and texts without words have no shingle and are linked only to equal texts; a null
doc_id is a document like any other, but gives no class its name; repeated rows are copies; texts of one doc_id are told
apart by their hashes; among equal doc_ids the least hash comes first; a very long text is one set of eight bytes a
shingle; an empty table gives no row; extra columns of any name are ignored by join() and kept by keep_one().
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import aside, blobs, cut_table, lists, partitions, restored, text_groups, whole_units
from inkstone.llm.components import components
from inkstone.llm.kernels import U, Words, gram_hashes, spread, within_text

SHINGLE = 5
THRESHOLD = (4, 5)
RECALL = 0.999
PERMUTATIONS = 128
BLOCK = 384
SLACK = 2  # sizes for the screen count 48 bits of a shingle's hash


def bands_and_rows(threshold: float = 0.8, recall: float = RECALL, most: int = PERMUTATIONS) -> tuple[int, int]:
    """The most selective banding (most rows a band) that finds a pair at the threshold with the wanted recall."""
    best = (most, 1)
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def shingle_hashes(words: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text, text by text, and how many each text has (with repeats)."""
    counts = np.where(words.counts >= n, words.counts - n + 1, (words.counts > 0).astype(np.int64))
    grams = gram_hashes(words.hash, n)[within_text(words.counts, n)]
    if (short := (words.counts > 0) & (words.counts < n)).any():
        out = np.empty(int(counts.sum()), U)
        at = np.cumsum(counts) - counts
        first = np.cumsum(words.counts) - words.counts
        is_short = np.zeros(len(out), bool)
        is_short[at[short]] = True
        out[~is_short] = grams
        for d in np.flatnonzero(short).tolist():
            out[at[d]] = gram_hashes(words.hash[first[d] : first[d] + words.counts[d]], int(words.counts[d]))[0]
        grams = out
    return grams, counts


def _signer(bands: int, rows: int):
    odd = spread(np.arange(1, bands * rows + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)

    def run(batches):
        for texts in text_groups(batches):
            grams, counts = shingle_hashes(Words(texts))
            some = np.flatnonzero(counts)
            begin = (np.cumsum(counts) - counts)[some]
            keys = np.zeros((len(some), bands), U)
            for b in range(bands):
                for r in range(rows):
                    mixed = grams * odd[b * rows + r]
                    mixed ^= mixed >> U(29)
                    least = np.minimum.reduceat(mixed * U(0xC4CEB9FE1A85EC53), begin) if len(some) else keys[:, 0]
                    keys[:, b] = spread(keys[:, b] ^ least)
            of = np.zeros(len(texts), np.int64)
            of[some] = bands
            size = np.zeros(len(texts), np.int64)  # of the set: repeated shingles count once
            if len(some):
                told = np.sort(np.repeat(np.arange(len(texts), dtype=U), counts) << U(48) | grams >> U(16))
                size[some] = np.add.reduceat(np.append(True, told[1:] != told[:-1]).astype(np.int64), begin)
            yield pa.RecordBatch.from_arrays([*(texts.rows.column(c) for c in ("doc_id", "node")), pa.array(size), lists(keys.ravel().view(np.int64), of, pa.int64())], ["doc_id", "node", "size", "bands"])

    return run


UNIT = ("band", "h", "i", "j")
_UNIT = "band int, h long, i int, j int"


def _signatures(rows: pa.Table) -> np.ndarray:
    flat = rows.column("bands").combine_chunks().flatten().to_numpy()
    return flat.reshape(len(rows), -1)


def candidates(band: int, bands: np.ndarray, size: np.ndarray, own: np.ndarray, crossing: bool, threshold: tuple[int, int]) -> np.ndarray:
    """Which two nodes of a unit are a candidate pair here: this is the first band in which they meet, their sizes allow the threshold, and, between two blocks, they are of different ones."""
    num, den = threshold
    ok = (np.minimum(size[:, None], size[None, :]) + SLACK) * den >= num * np.maximum(size[:, None], size[None, :])
    for b in range(band):
        ok &= bands[:, b, None] != bands[None, :, b]
    if crossing:
        ok &= own[:, None] != own[None, :]
    np.fill_diagonal(ok, False)
    return ok


def _screen(threshold: tuple[int, int]):
    """The rows of units that are in a candidate pair there."""

    def run(batches):
        for rows, edges in whole_units(batches, UNIT):
            band, size, own, i, j = (rows.column(c).to_numpy() for c in ("band", "size", "block", "i", "j"))
            bands, needed = _signatures(rows), np.zeros(len(rows), bool)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b - a > 1:
                    needed[a:b] = candidates(int(band[a]), bands[a:b], size[a:b], own[a:b], i[a] != j[a], threshold).any(axis=1)
            if needed.any():
                yield from rows.select([*UNIT, "block", "node"]).filter(pa.array(needed)).to_batches()

    return run


def _set_of(batches):
    """The distinct shingle hashes of each text, packed."""
    for texts in text_groups(batches):
        grams, counts = shingle_hashes(Words(texts))
        sets = [np.unique(g).tobytes() for g in np.split(grams, np.cumsum(counts)[:-1])]
        yield pa.RecordBatch.from_arrays([texts.rows.column(c) for c in ("node", "copies", "size", "bands")] + [blobs(b"".join(sets), np.array([len(x) for x in sets]))], ["node", "copies", "size", "bands", "grams"])


def similar(own: list[np.ndarray], maybe: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """Which two sets reach the threshold, of those that maybe allows."""
    num, den = threshold
    k, sizes = len(own), np.array([len(s) for s in own])
    if maybe.sum() <= 2 * k:  # few pairs: one by one
        shared = np.zeros((k, k))
        for a, b in zip(*np.nonzero(np.triu(maybe)), strict=True):
            shared[a, b] = shared[b, a] = len(np.intersect1d(own[a], own[b], assume_unique=True))
    else:
        values, inverse = np.unique(np.concatenate(own), return_inverse=True)
        of = np.repeat(np.arange(k), sizes)
        again = np.bincount(inverse)[inverse] > 1  # shingles of one set only are in no intersection
        order = np.argsort(inverse[again], kind="stable")
        column, row = inverse[again][order], of[again][order]
        column = np.unique(column, return_inverse=True)[1]
        shared, width = np.zeros((k, k)), 4096
        edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + width + 1, width))
        for c, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            m = np.zeros((k, width), np.float32)
            m[row[a:b], column[a:b] - c * width] = 1
            shared += m @ m.T
    return maybe & (shared * den >= num * (sizes[:, None] + sizes[None, :] - shared))


def _verifier(threshold: tuple[int, int]):
    schema = pa.schema([("node", pa.binary()), ("links", pa.int64()), ("tied", pa.binary())])

    def roots_of(linked: np.ndarray) -> list[int]:
        roots = list(range(len(linked)))

        def root(x):
            while roots[x] != x:
                roots[x] = roots[roots[x]]
                x = roots[x]
            return x

        for a, b in zip(*np.nonzero(np.triu(linked)), strict=True):
            a, b = root(int(a)), root(int(b))
            if a != b:
                roots[max(a, b)] = min(a, b)
        return [root(x) for x in range(len(linked))]

    def run(batches):
        for rows, edges in whole_units(batches, UNIT):
            band, size, own, i, j, copies = (rows.column(c).to_numpy() for c in ("band", "size", "block", "i", "j", "copies"))
            bands, nodes = _signatures(rows), rows.column("node").to_pylist()
            grams = [np.frombuffer(g.as_buffer(), U) for g in rows.column("grams")]
            found, links, tied = [], [], []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                maybe = candidates(int(band[a]), bands[a:b], size[a:b], own[a:b], i[a] != j[a], threshold)
                linked = similar(grams[a:b], maybe, threshold)
                if not linked.any():
                    continue
                n, roots = linked @ copies[a:b], roots_of(linked)
                for x in np.flatnonzero(n).tolist():
                    found.append(nodes[a + x])
                    links.append(int(n[x]))
                    tied.append(nodes[a + roots[x]])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(links, pa.int64()), pa.array(tied, pa.binary())], schema=schema)

    return run


def _classes(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """doc_id, text and node (a text's hash) per document; node, copies, rep (its least doc_id), links and root (its class) per distinct text."""
    n = partitions(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("node", F.unhex(F.md5("text")))
    bands, rows = bands_and_rows(threshold[0] / threshold[1], recall)
    signed = base.mapInArrow(_signer(bands, rows), "doc_id long, node binary, size long, bands array<long>")
    texts = cut_table(signed.groupBy("node").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"), F.first("size").alias("size"), F.first("bands").alias("bands")))

    banded = texts.select("node", F.posexplode("bands").alias("band", "h"))
    buckets = cut_table(banded.groupBy("band", "h").agg(F.count("*").alias("n")).where("n > 1"))  # a table: the join below may split hot buckets
    met = banded.join(buckets, ["band", "h"]).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    dealt = met.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = dealt.select("band", "h", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node").join(texts.select("node", "size", "bands"), "node")
    by_unit = lambda df: df.repartition(n, *UNIT).sortWithinPartitions(*UNIT)
    needed = cut_table(by_unit(units).mapInArrow(_screen(threshold), f"{_UNIT}, block int, node binary"))

    members = needed.select("node").distinct().join(texts, "node")
    own = base.join(members, (base["node"] == members["node"]) & F.col("doc_id").eqNullSafe(F.col("rep"))).select(base["node"], "text", "copies", "size", "bands")
    own = own.groupBy("node", "copies", "size", "bands").agg(F.first("text").alias("text"))  # repeated rows of one document
    sets = own.select("node", "copies", "size", "bands", "text").mapInArrow(_set_of, "node binary, copies long, size long, bands array<long>, grams binary")
    verified = cut_table(by_unit(needed.join(sets, "node")).mapInArrow(_verifier(threshold), "node binary, links long, tied binary"))

    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(verified.select(F.col("node").alias("a"), F.col("tied").alias("b")))
    nodes = texts.select("node", "copies", "rep").join(links, "node", "left").join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return base, nodes


def join(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, class_id (the least doc_id of its class), n_links (documents that it is linked to, copies included), class_size."""
    base, nodes = _classes(docs, threshold, recall, block)
    named = nodes.groupBy("root").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("class_size"))
    told = nodes.join(named, "root").select("node", "class_id", "class_size", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return base.select("doc_id", "node").join(told, "node").select("doc_id", "class_id", "n_links", "class_size")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each class: that of the least doc_id (of its repeated rows, one); all columns stay.

    What is kept is told by text and doc_id, so that unrelated texts of one doc_id, or of none, all stay; a class in which
    no document has an id keeps the text of the least hash.
    """
    _, nodes = _classes(docs)
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "node")).alias("f")
    kept = nodes.groupBy("root").agg(first).select(F.col("f.rep").alias("rep"), F.col("f.node").alias("node"))
    told = aside(docs).withColumn("own", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    lone = told.join(kept, (F.col("own") == F.col("node")) & F.col("doc_id").cast("long").eqNullSafe(F.col("rep")))
    return restored(lone.dropDuplicates(["own"]), docs.columns)
