"""Document fingerprints by a randomised edit embedding.

A walk reads the characters of a text: at step j it notes the character under it and stays or moves on by a random bit
that depends on j and that character alone, the same for all texts. Two texts of small edit distance soon walk in step
again after an edit, so their notes differ in few places (Hamming distance). A fingerprint samples the notes: the first 32
steps whole, then 32 steps of each span twice as long as the one before, four bits of a hash of each note. Weighted by
what each sample stands for, the share of equal samples estimates the share of equal notes: the likeness, 0 to 1.

Classes: sampled notes of the two octaves below a print's last make up the keys of bands; a print whose last octave has
just begun has those of the octave before as well, as an edit may have made it longer. Prints of one key are a unit (a
large one is dealt over blocks by salt, each pair of blocks is a unit); all pairs of a unit are verified by likeness, and
components over the verified pairs are the classes. Equal prints count as one, so copies never become pairs.

Documents and their followers come together by Spark's range partitioning on (doc_id descending, hash of the text, row),
with compressed texts, so each text is shuffled once and a repeated id or row is dealt over several tasks. A task streams its
rows, holds about TOGETHER characters at a time and leaves its first and last row to a small join of the ranges' edges.
Walks of many documents go in step in numpy, and the few longest are finished one by one.

Cases: a null text is empty; an empty text has the empty fingerprint, whose likeness to itself is 1 and to others 0, and
its own class of empty texts; doc_ids that repeat follow each other by a hash of their texts; null doc_ids come last, and a
class of them alone has no name; repeated rows follow each other; one document follows itself; a very long text is walked
whole, a character at a time at the end; an empty table gives no row; extra columns of any name are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstone.llm.common import cut_table, partitions, whole_units
from inkstone.llm.components import components
from inkstone.llm.kernels import U, spread

SAMPLES = 32
OCTAVES = 26
PERIOD = 4096  # random bits recur after so many steps
FEW = 48
TOGETHER = 12_000_000  # characters walked in step
ABSENT = 255
BLOCK = 384
#: A pair of likeness s meets in 1 - (1 - s**9)**18 of cases (0.92 at 0.8, 0.99 at 0.86); unlike texts agree in a note in about one case of nine.
BANDS, BAND_SAMPLES = 18, 9

_BITS = ((spread(np.arange(PERIOD * 256, dtype=U) + U(0x5BD1E995)) >> U(17)) & U(1)).astype(np.int64).reshape(PERIOD, 256)
_ROWS = [bytes(r.astype(np.uint8)) for r in _BITS]


def _steps() -> np.ndarray:
    """Sampled steps: the first octave whole, then SAMPLES steps of each."""
    rng = np.random.default_rng(11)
    out = [np.arange(SAMPLES)]
    for k in range(1, OCTAVES):
        span = SAMPLES << (k - 1)
        out.append(span + np.sort(rng.choice(span, SAMPLES, replace=False)) if span < 1 << 22 else span + np.sort(rng.integers(0, span, SAMPLES)))
    return np.concatenate(out)


STEPS = _steps()
WEIGHTS = np.repeat([1.0] + [float(1 << (k - 1)) for k in range(1, OCTAVES)], SAMPLES)


def classes_of(codes: np.ndarray) -> np.ndarray:
    """A byte for each character: its four lower bits are what is noted."""
    return (spread(codes.astype(U) + U(0x1234567)) >> U(40)).astype(np.uint8)


_LATIN = classes_of(np.arange(0x250))


def character_classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _LATIN[np.minimum(codes, 0x24F)]
    high = np.flatnonzero(codes >= 0x250)
    if len(high):
        out[high] = classes_of(codes[high])
    return out


def walk(texts: list[np.ndarray]) -> np.ndarray:
    """Sampled notes of each text (a row each); ABSENT after a walk's end."""
    sizes = np.array([len(t) for t in texts], np.int64)
    notes = np.full((len(texts), len(STEPS)), ABSENT, np.uint8)
    if not sizes.sum():
        return notes
    pad = 64
    begin = np.cumsum(sizes + pad) - (sizes + pad)
    flat = np.zeros(int((sizes + pad).sum()), np.uint8)
    for b, t in zip(begin.tolist(), texts, strict=True):
        flat[b : b + len(t)] = t
    who = np.flatnonzero(sizes)
    at, end = begin[who].copy(), (begin + sizes)[who]
    j, s = 0, 0
    while len(who) > FEW:
        for _ in range(pad):
            c = flat[at]
            if STEPS[s] == j:
                on = at < end
                notes[who[on], s] = c[on] & 15
                s += 1
            at += _BITS[j % PERIOD][c]
            j += 1
        on = at < end
        if not on.all():
            who, at, end = who[on], at[on], end[on]
    for w, i, stop in zip(who.tolist(), at.tolist(), end.tolist(), strict=True):  # the longest few
        raw, k, n = flat[begin[w] : stop].tobytes(), i - int(begin[w]), stop - int(begin[w])
        now, t = j, s
        while k < n:
            until = int(STEPS[t])
            while now < until and k < n:
                k += _ROWS[now % PERIOD][raw[k]]
                now += 1
            if k < n:
                notes[w, t] = raw[k] & 15
                t += 1
    return notes


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weighted share of equal samples of two sets of notes, row by row; 1 if neither has any."""
    there = (a != ABSENT) | (b != ABSENT)
    weights = WEIGHTS[: there.shape[1]]
    total = there @ weights
    return np.where(total > 0, ((a == b) & there) @ weights / np.maximum(total, 1), 1.0)


def packed(notes: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Notes four bits each, and how many samples there are: those of a walk come without a gap, as steps ascend."""
    sizes = (notes != ABSENT).sum(axis=1)
    nibbles = np.where(notes == ABSENT, 0, notes)
    raw = (nibbles[:, ::2] << 4 | nibbles[:, 1::2]).astype(np.uint8)
    return [raw[i, : (n + 1) // 2].tobytes() for i, n in enumerate(sizes.tolist())], sizes


def unpacked(prints: list[bytes], sizes: list[int]) -> np.ndarray:
    """The notes of packed prints, as wide as the longest."""
    out = np.full((len(prints), max([*sizes, 1])), ABSENT, np.uint8)
    for i, (p, n) in enumerate(zip(prints, sizes, strict=True)):
        raw = np.frombuffer(p, np.uint8)
        out[i, :n] = np.stack((raw >> 4, raw & 15), axis=1).ravel()[:n]
    return out


def as_text(print_: str, size: str):
    """The column of a packed print as hexadecimal digits, filled with - to the end of its last octave."""
    return F.rpad(F.substring(F.lower(F.hex(print_)), F.lit(1), F.col(size)), (F.ceil(F.col(size) / SAMPLES) * SAMPLES).cast("int"), F.lit("-"))


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = "doc_id long, n_chars long, edited_sha256 binary, print binary, size int, edited binary, edited_size int, near_edited double, near_next double"
_EDGE = _RESULT + ", kind int, part int, text binary"
_RESULT_NAMES = [c.split()[0] for c in _RESULT.split(", ")]
_KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.float64(), pa.float64()]
INNER, FIRST, LAST = 0, 1, 2


def _results(ids: list, texts: list[str]) -> list[pa.Array]:
    """Columns of _RESULT for all but the last of texts, each followed by the next."""
    changed = [edited(t, f) for t, f in zip(texts[:-1], texts[1:], strict=True)]
    notes = walk([character_classes(t) for t in [*texts, *changed]])
    mine, after, new = notes[: len(ids)], notes[1 : len(ids) + 1], notes[len(texts) :]
    (own, own_size), (other, other_size) = packed(mine), packed(new)
    values = [ids, [len(t) for t in texts[:-1]], [hashlib.sha256(c.encode()).digest() for c in changed], own, own_size, other, other_size, likeness(mine, new), likeness(mine, after)]
    return [pa.array(v, k) for v, k in zip(values, _KINDS, strict=True)]


def _small(batches):
    """Texts compressed each for itself, to travel."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([pack((t or "").encode()) for t in batch.column(3).to_pylist()], pa.binary())], ["doc_id", "th", "nth", "text"])


def _whole(raw: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(raw).decode()


def _followed(batches):
    """The rows of one range in order: each but the last with its follower; its first and last row go on as edges."""
    part = TaskContext.get().partitionId()
    schema = pa.schema([*zip(_RESULT_NAMES, _KINDS, strict=True), ("kind", pa.int32()), ("part", pa.int32()), ("text", pa.binary())])
    ids, texts, size, begun, last = [], [], 0, False, None

    def edge(kind: int, doc, raw: bytes):
        row = {n: None for n in schema.names} | {"doc_id": doc, "kind": kind, "part": part, "text": raw}
        return pa.RecordBatch.from_pylist([row], schema=schema)

    def out():
        n = len(ids) - 1
        return pa.RecordBatch.from_arrays([*_results(ids[:-1], texts), pa.array([INNER] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.nulls(n, pa.binary())], schema=schema)

    for batch in batches:
        for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not begun:
                begun = True
                yield edge(FIRST, doc, raw)
            ids.append(doc)
            texts.append(_whole(raw))
            last, size = raw, size + len(texts[-1])
            if size > TOGETHER and len(ids) > 1:
                yield out()
                ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])
    if len(ids) > 1:
        yield out()
    if begun:
        yield edge(LAST, ids[-1], last)


def _joined(batches):
    """The last row of each range with the first of the next."""
    for batch in batches:
        for doc, own, following in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            yield pa.RecordBatch.from_arrays(_results([doc], [_whole(own), _whole(following)]), _RESULT_NAMES)


def followed(docs: DataFrame) -> DataFrame:
    """The columns of _RESULT for each document and its follower, as a table."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.monotonically_increasing_id().alias("nth"), "text")
    order = [F.col("doc_id").desc_nulls_last(), "th", "nth"]
    rows = base.mapInArrow(_small, "doc_id long, th long, nth long, text binary").repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    every = cut_table(rows.select("doc_id", "text").mapInArrow(_followed, _EDGE))
    lasts, firsts = every.where(F.col("kind") == LAST), every.where(F.col("kind") == FIRST)
    ring = Window.orderBy("part")  # a row a range
    after = firsts.select("part").select("part", F.coalesce(F.lead("part").over(ring), F.min("part").over(Window.partitionBy(F.lit(1)))).alias("next"))
    pairs = lasts.select("doc_id", "text", "part").join(after, "part").join(firsts.select(F.col("part").alias("next"), F.col("text").alias("following")), "next")
    return every.where(F.col("kind") == INNER).select(*_RESULT_NAMES).unionByName(pairs.select("doc_id", "text", "following").mapInArrow(_joined, _RESULT))


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, class_id."""
    rows = followed(docs).withColumn("node", _node())
    told = rows.join(class_of(rows), "node", "left")
    return told.select(
        "doc_id", "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), as_text("print", "size").alias("fingerprint"), as_text("edited", "edited_size").alias("edited_fingerprint"),
        "near_edited", "near_next", F.when(F.col("shared"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
    )


def _node():
    return F.unhex(F.md5(F.concat("print", F.col("size").cast("string").cast("binary"))))


def _printer(batches):
    for batch in batches:
        prints, sizes = packed(walk([character_classes(t) for t in batch.column(1).to_pylist()]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary()), pa.array(sizes, pa.int32())], ["doc_id", "print", "size"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, print (packed), size (samples)."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return base.mapInArrow(_printer, "doc_id long, print binary, size int")


def _verifier(threshold: float):
    def run(batches):
        # rows of a unit come by node, so that units of one dense group tie it to the same few least nodes
        for rows, edges in whole_units(batches, ("h", "i", "j")):
            own, i, j, sizes = (rows.column(c).to_numpy() for c in ("block", "i", "j", "size"))
            prints, nodes = rows.column("print").to_pylist(), rows.column("node").to_pylist()
            found = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                notes, root = unpacked(prints[a:b], sizes[a:b].tolist()), np.arange(b - a)
                mine, crossing = own[a:b], i[a] != j[a]
                for within in (True, False) if crossing else (True,):  # what a block ties by itself is another unit's to tell
                    for x in range(b - a - 1):  # pairs that are in one class already are not compared
                        to = np.flatnonzero((root[x + 1 :] != root[x]) & (not crossing or ((mine[x + 1 :] == mine[x]) if within else (mine[x + 1 :] != mine[x])))) + x + 1
                        if not len(to):
                            continue
                        near = np.unique(root[to[likeness(notes[x : x + 1], notes[to]) >= threshold]])
                        if len(near):
                            if not (crossing and within):
                                found += [(nodes[a + root[x]], nodes[a + r]) for r in near.tolist()]
                            root[np.isin(root, near)] = root[x]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*found, strict=True)], ["a", "b"])

    return run


def band_keys(notes: np.ndarray, sizes: np.ndarray, bands: int, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of each print in each band: level, band and sampled notes of two octaves below the level."""
    rng = np.random.default_rng(5)
    picks = [sorted(rng.choice(2 * SAMPLES, samples, replace=False).tolist()) for _ in range(bands)]
    octaves = -(-sizes // SAMPLES)
    filled = sizes - (octaves - 1) * SAMPLES  # samples of the last octave
    wide = np.concatenate((notes, np.full((len(notes), 2 * SAMPLES), ABSENT, np.uint8)), axis=1)
    rows, keys = [], []
    for back in (1, 2):
        own = np.arange(len(sizes)) if back == 1 else np.flatnonzero((octaves >= 2) & (filled <= SAMPLES * 0.4))
        level = np.maximum(octaves[own] - back, 0)
        start = np.maximum((level - 2) * SAMPLES, 0)
        for b, pick in enumerate(picks):
            key = spread(level.astype(U) * U(64) + U(b))
            for p in pick:
                key = spread(key ^ (wide[own, np.minimum(start + p, wide.shape[1] - 1)].astype(U) + U(1)))
            rows.append(own)
            keys.append(key)
    return np.concatenate(rows), np.concatenate(keys)


def _keyer(bands: int, samples: int):
    def run(batches):
        for batch in batches:
            sizes = batch.column(2).to_numpy().astype(np.int64)
            for at in range(0, len(sizes), 2000):
                own = slice(at, at + 2000)
                notes = unpacked(batch.column(1)[own].to_pylist(), sizes[own].tolist())
                row, key = band_keys(notes, sizes[own], bands, samples)
                yield pa.RecordBatch.from_arrays([batch.column(0)[own].take(pa.array(row)), pa.array(key.view(np.int64))], ["nid", "h"])

    return run


def class_of(prints: DataFrame, threshold: float = 0.8, bands: int = BANDS, samples: int = BAND_SAMPLES, block: int = BLOCK) -> DataFrame:
    """node, class_id (the least doc_id of the class), shared, for prints (node, doc_id, print, size) that are not alone."""
    n = partitions(prints.sparkSession)
    own = cut_table(prints.groupBy("node").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"), F.first("print").alias("print"), F.first("size").alias("size")))
    keyed = own.where("size > 0").select(F.xxhash64("node").alias("nid"), "print", "size").mapInArrow(_keyer(bands, samples), "nid long, h long")
    buckets = cut_table(keyed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    dealt = keyed.join(buckets, "h").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int"))
    units = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("h", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "nid")
    with_prints = units.join(own.select(F.xxhash64("node").alias("nid"), "node", "print", "size"), "nid")  # two nodes of one nid only share a unit
    ties = cut_table(with_prints.repartition(n, "h", "i", "j").sortWithinPartitions("h", "i", "j", "node").mapInArrow(_verifier(threshold), "a binary, b binary"))
    rooted = own.select("node", "copies", "rep").join(components(ties), "node", "left").where("copies > 1 or root is not null").withColumn("root", F.coalesce("root", "node"))
    named = rooted.groupBy("root").agg(F.min("rep").alias("class_id"))
    return rooted.join(named, "root").select("node", "class_id", F.lit(True).alias("shared"))


def classes(docs: DataFrame, threshold: float = 0.8, bands: int = BANDS, samples: int = BAND_SAMPLES, block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, class_id (the least doc_id of its class)."""
    prints = cut_table(fingerprints(docs)).withColumn("node", _node())
    told = prints.join(class_of(prints, threshold, bands, samples, block), "node", "left")
    return told.select("doc_id", F.when(F.col("shared"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))
