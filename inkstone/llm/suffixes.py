"""Suffix-array deduplication of bytes across documents.

A byte goes if a SPAN-byte string over it also starts in a document with a smaller doc_id. Strings are judged on the
input. The suffix arrays are built by linear grouping (grouping.py), on just the bytes that need one:

1. Each SPAN-byte string is keyed by its minimizer, the least hash among its 16-byte strings, so equal strings have equal
   keys wherever they stand. Consecutive strings with one key form a segment. Segments travel as packed columns (key,
   hash of the bytes, place), dealt by key; a task first keeps one copy of equal segments, with the smallest doc_id.
2. Per key: a segment equal to one of a smaller doc_id is settled (all its strings go). If a key is left with different
   segments, these need a suffix array. If its segments are in one document, nothing is shared.
3. The bytes of the segments that need it are fetched from their documents and dealt by key. Per key, what cannot lie in
   a shared string (too short an agreement with every other segment around the common 16 bytes) is cut off first; the
   rest is set end to end, its suffix array is built, and neighbours that agree on SPAN bytes form a run; each member of
   a run goes unless its doc_id is the run's smallest.
4. Each document gets the union of its settled and found spans.

A hot passage collapses to a row a task in step 1, so no task sees all copies. Cases: a null text is empty; documents
shorter than SPAN bytes lose nothing; a null doc_id is not smaller than any other and has no smaller one: its document
loses nothing and takes nothing; rows of one doc_id do not take from each other; repeated rows get equal results; an
empty table gives no row; extra columns are ignored. A text is handled whole, in memory of some 60 times its size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import blobs, cut_table, partitions, text_groups
from inkstone.llm.grouping import suffix_array
from inkstone.llm.kernels import U, spread

SPAN = 50
GRAM = 16
MOST = 64  # strings in a segment
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=U)
SEGMENT_GROUP = 1 << 19  # bytes of text at a time: temporaries stay in the cache
FLUSH = 1 << 20  # segments that a task gathers before it deals them out


def gram_hash(eight: np.ndarray, n: int) -> np.ndarray:
    return spread(eight[:n] * U(0x9E3779B97F4A7C15) ^ (eight[8 : n + 8] * U(0xD6E8FEB86659FD93)) >> U(1))


def segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, span: int = SPAN):
    """(key, hash, first string, strings) of the segments of texts set end to end."""
    n = len(data)
    none = np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n < span:
        return none
    eight = np.ndarray((n + MOST + span,), "<u8", np.concatenate((data, np.zeros(MOST + span + 8, np.uint8))), 0, (1,))
    width, least, done = span - GRAM + 1, gram_hash(eight, n - GRAM + 1), 1
    while done * 2 <= width:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if width > done:
        least = np.minimum(least[: done - width], least[width - done :])
    whole = ends - starts >= span
    inside = np.zeros(n + 1, np.int8)
    inside[starts[whole]] += 1
    inside[ends[whole] - span + 1] -= 1
    inside = np.cumsum(inside[: len(least)], dtype=np.int8) > 0
    first = np.empty(len(least), bool)
    first[0] = True
    np.not_equal(least[1:], least[:-1], out=first[1:])
    first[starts[starts < len(least)]] = True
    at = np.flatnonzero(first & inside)
    if not len(at):
        return none
    stop = np.flatnonzero(inside & np.append(first[1:] | ~inside[1:], True)) + 1
    size = stop - at
    if (size > MOST).any():  # only in periodic texts
        parts = -(-size // MOST)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        at, stop = np.repeat(at, parts) + nth * MOST, np.repeat(stop, parts)
        size = np.minimum(stop - at, MOST)
    length = size + span - 1
    told = length.astype(U) * U(0x9E3779B97F4A7C15)
    low = int(length.min()) // 8 * 8
    for k in range(0, int(length.max()), 8):
        if k < low:
            told = (told ^ eight[at + k]) * U(0xFF51AFD7ED558CCD)
            told ^= told >> U(32)
        else:
            own = np.flatnonzero(length > k)
            told[own] = (told[own] ^ (eight[at[own] + k] & _MASKS[np.minimum(length[own] - k, 8)])) * U(0xFF51AFD7ED558CCD)
            told[own] ^= told[own] >> U(32)
    return spread(least[at]), spread(told), at, size


_KINDS = {"doc": "<i8", "th": "<u4", "key": "<u8", "told": "<u8", "at": "<u4", "size": "u1"}
SEGMENT, OPEN, SETTLED = tuple(_KINDS), ("doc", "th", "key", "at", "size"), ("doc", "th", "at", "size")
#: A row holds all that a task has for one bucket (a partition): open and settled segments, each packed into one blob.
PACKED = "bucket int, open binary, settled binary"
SPANS = "bucket int, spans binary"


def encode(c: dict[str, np.ndarray], names: tuple[str, ...]) -> bytes:
    """Columns as byte planes (all first bytes, all second bytes, ...): the planes of high bytes compress away."""
    return b"".join(c[x].astype(_KINDS[x]).view(np.uint8).reshape(-1, np.dtype(_KINDS[x]).itemsize).T.tobytes() for x in names)


def decode(packs: list[bytes], names: tuple[str, ...]) -> dict[str, np.ndarray]:
    widths = [np.dtype(_KINDS[x]).itemsize for x in names]
    got: dict[str, list] = {x: [np.zeros(0, _KINDS[x])] for x in names}
    for pack in packs:
        n, at = len(pack) // sum(widths), 0
        for x, w in zip(names, widths, strict=True):
            planes = np.frombuffer(pack, np.uint8, n * w, at).reshape(w, n)
            got[x].append(np.ascontiguousarray(planes.T).view(_KINDS[x]).ravel())
            at += n * w
    return {x: np.concatenate(v) for x, v in got.items()}


def _bucket(mixed: np.ndarray, buckets: int) -> np.ndarray:
    """Even ranges of mixed 64-bit values."""
    return ((mixed >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def _of_doc(doc: np.ndarray, buckets: int) -> np.ndarray:
    return _bucket(spread(doc.astype(np.int64).view(U)), buckets)


def _dealt(buckets: int, schema: pa.Schema, **kinds):
    """One batch: a row per bucket that has anything; kinds: name=(bucket of each row, columns, names of columns)."""
    packs: dict[str, list] = {}
    for kind, (bucket, c, names) in kinds.items():
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
        c = {x: c[x][order] for x in names}
        packs[kind] = [encode({x: v[i:j] for x, v in c.items()}, names) if i < j else None for i, j in zip(edges[:-1], edges[1:], strict=True)]
    used = [b for b in range(buckets) if any(p[b] for p in packs.values())]
    if used:
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *[pa.array([packs[f][b] for b in used], pa.binary()) for f in schema.names[1:]]], schema=schema)


_PACKED = pa.schema([("bucket", pa.int32()), ("open", pa.binary()), ("settled", pa.binary())])
_SPAN_ROWS = pa.schema([("bucket", pa.int32()), ("spans", pa.binary())])


def _blobs(batches, *names: str) -> list[list[bytes]]:
    out: list[list[bytes]] = [[] for _ in names]
    for batch in batches:
        for own, name in zip(out, names, strict=True):
            own += batch.column(batch.schema.get_field_index(name)).drop_null().to_pylist()
    return out


def _first_copies(c: dict[str, np.ndarray]):
    """Order by (key, told, doc); whether a row begins a key, begins a (key, told), and is settled by a smaller doc."""
    order = np.lexsort((c["doc"], c["told"], c["key"]))
    c = {k: v[order] for k, v in c.items()}
    new_key = np.append(True, c["key"][1:] != c["key"][:-1])
    new_copy = new_key | np.append(True, c["told"][1:] != c["told"][:-1])
    smallest = c["doc"][new_copy][np.cumsum(new_copy) - 1]
    return c, new_key, new_copy, c["doc"] > smallest


PER_DOC = "doc long, th long, spans binary"
_PER_DOC = pa.schema([("doc", pa.int64()), ("th", pa.int64()), ("spans", pa.binary())])
_SPANS = np.dtype([("at", "<u4"), ("size", "<u2"), ("key", "<u8")])


def _per_document(names: tuple[str, ...]):
    """Whole buckets of documents: a row per document, with its spans as one blob."""

    def run(batches):
        c = decode(_blobs(batches, "spans")[0], names)
        if not len(c["doc"]):
            return
        order = np.lexsort((c["at"], c["th"], c["doc"]))
        doc, th = c["doc"][order], c["th"][order].astype(np.int64)
        flat = np.zeros(len(order), _SPANS)
        for f in _SPANS.names:
            if f in c:
                flat[f] = c[f][order]
        first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])))
        for part in np.array_split(first, max(1, len(first) // 5000)):
            end = first[np.searchsorted(first, part[-1], side="right")] if part[-1] != first[-1] else len(flat)
            sizes = np.diff(np.append(part, end)) * _SPANS.itemsize
            yield pa.RecordBatch.from_arrays([pa.array(doc[part]), pa.array(th[part]), blobs(flat[part[0] : end].tobytes(), sizes)], schema=_PER_DOC)

    return run


def _segmenter(buckets: int, span: int):
    def deal(parts):
        c, _, _, settled = _first_copies({k: np.concatenate([p[k] for p in parts]) for k in _KINDS})
        gone = {k: v[settled] for k, v in c.items()}  # a copy with a smaller id is in this very task
        c = {k: v[~settled] for k, v in c.items()}
        yield from _dealt(buckets, _PACKED, open=(_bucket(c["key"], buckets), c, SEGMENT), settled=(_of_doc(gone["doc"], buckets), gone, SETTLED))

    def run(batches):
        parts, held = [], 0
        for texts in text_groups(batches, most=SEGMENT_GROUP):
            docs, ths = texts.rows.column("doc_id").to_numpy(), texts.rows.column("th").to_numpy()
            key, told, at, size = segments(texts.data, texts.starts, texts.ends, span)
            of = np.searchsorted(texts.ends, at, side="right")
            parts.append({"doc": docs[of], "th": ths[of], "key": key, "told": told, "at": (at - texts.starts[of]).astype(np.uint32), "size": size.astype(np.uint8)})
            held += len(key)
            if held > FLUSH:
                yield from deal(parts)
                parts, held = [], 0
        if held:
            yield from deal(parts)

    return run


def _settle(buckets: int):
    """Packed segments of whole keys: what is settled and what is open, packed by document."""

    def run(batches):
        segs, early = _blobs(batches, "open", "settled")
        gone, c = decode(early, SETTLED), decode(segs, SEGMENT)
        left = {k: v[:0] for k, v in c.items()}
        if len(c["key"]):
            c, new_key, new_copy, settled = _first_copies(c)
            heads = np.flatnonzero(new_key)
            key = np.cumsum(new_key) - 1
            shared = np.minimum.reduceat(c["doc"], heads) < np.maximum.reduceat(c["doc"], heads)
            different = np.add.reduceat(new_copy.astype(np.int64), heads) > 1
            is_open = (shared & different)[key] & ~settled
            gone = {k: np.concatenate((gone[k], c[k][settled])) for k in SETTLED}
            left = {k: v[is_open] for k, v in c.items()}
        yield from _dealt(buckets, _PACKED, open=(_of_doc(left["doc"], buckets), left, OPEN), settled=(_of_doc(gone["doc"], buckets), gone, SETTLED))

    return run


CONTEXTS = "bucket int, doc long, th long, at long, size int, key long, bytes binary"


def _fetch(buckets: int, span: int):
    def run(batches):
        for batch in batches:
            out = {c: [] for c in ("bucket", "doc", "th", "at", "size", "key", "bytes")}
            for doc, th, text, blob in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                raw = text.encode()
                own = np.frombuffer(blob, _SPANS)
                n = len(own)
                out["doc"] += [doc] * n
                out["th"] += [th] * n
                out["at"] += own["at"].tolist()
                out["size"] += own["size"].tolist()
                out["key"] += own["key"].astype(np.int64).tolist()
                out["bytes"] += [raw[a : a + s + span - 1] for a, s in zip(own["at"].tolist(), own["size"].tolist(), strict=True)]
            out["bucket"] = _bucket(np.array(out["key"], np.int64).view(U), buckets).astype(np.int32)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("bucket", pa.int32()), ("doc", pa.int64()), ("th", pa.int64()), ("at", pa.int64()), ("size", pa.int32()), ("key", pa.int64()), ("bytes", pa.binary())]))

    return run


def trim(raws: list[bytes], key: int, span: int) -> list[tuple[int, int]]:
    """The part (from, to) of each segment that can lie in a string shared with another one; empty if none can.

    Segments of one key have their key's 16 bytes in common. Sorted by what follows these (by what precedes them,
    backwards), a segment agrees best with a neighbour; no shared string reaches beyond its best agreement to either side.
    """
    n = len(raws)
    flat = np.frombuffer(b"".join(raws) + bytes(GRAM + 8), np.uint8)
    sizes = np.array([len(r) for r in raws])
    begin = np.cumsum(sizes) - sizes
    eight = np.ndarray((len(flat) - 7,), "<u8", flat, 0, (1,))
    total = int(sizes.sum())
    equal = spread(gram_hash(eight, total)) == U(key & 0xFFFFFFFFFFFFFFFF)
    where = np.flatnonzero(equal)
    of = np.searchsorted(begin, where, side="right") - 1
    where, of = where[where + GRAM <= begin[of] + sizes[of]], of[where + GRAM <= begin[of] + sizes[of]]
    if len(where) != n or (of != np.arange(n)).any():
        return [(0, len(r)) for r in raws]  # periodic: leave whole
    gram = (where - begin).tolist()
    after = [r[g + GRAM :] for r, g in zip(raws, gram, strict=True)]
    before = [r[:g][::-1] for r, g in zip(raws, gram, strict=True)]
    best = []
    for parts in (before, after):
        order = sorted(range(n), key=parts.__getitem__)
        reach = [0] * n
        for a, b in zip(order[:-1], order[1:], strict=True):
            x, y = parts[a], parts[b]
            m = min(len(x), len(y))
            if x[:m] != y[:m]:
                m = next(k for k in range(m) if x[k] != y[k])
            reach[a], reach[b] = max(reach[a], m), max(reach[b], m)
        best.append(reach)
    return [(g - b, g + GRAM + a) if a + b + GRAM >= span else (0, 0) for g, b, a in zip(gram, *best, strict=True)]


def shared_strings(raws: list[bytes], docs: list[int], key: int, span: int = SPAN) -> list[tuple[int, int]]:
    """(segment, offset) of each span-byte string that is also in a segment of a smaller doc."""
    text: list[int] = []
    of: list[int] = []
    at: list[int] = []
    for i, (a, b) in enumerate(trim(raws, key, span)):
        if b - a >= span:
            text += [c + 1 for c in raws[i][a:b]]
            text.append(0)
            of += [i] * (b - a + 1)
            at += [*range(a, b - span + 1), *[-1] * span]
    if not text:
        return []
    out, run, said = [], [], None
    for p in suffix_array(text):
        if at[p] < 0:
            continue
        raw = raws[of[p]][at[p] : at[p] + span]
        if raw != said:
            if len(run) > 1:
                least = min(docs[of[q]] for q in run)
                out += [(of[q], at[q]) for q in run if docs[of[q]] > least]
            run, said = [], raw
        run.append(p)
    if len(run) > 1:
        least = min(docs[of[q]] for q in run)
        out += [(of[q], at[q]) for q in run if docs[of[q]] > least]
    return out


def _group(span: int, buckets: int):
    def run(batches):
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        t = pa.Table.from_batches(rows)
        key = t.column("key").to_numpy()
        order = np.argsort(key, kind="stable")
        key = key[order]
        docs, ths, ats = (t.column(c).to_numpy()[order] for c in ("doc", "th", "at"))
        raws = t.column("bytes").combine_chunks().take(pa.array(order))
        edges = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key)).tolist()
        found_row, found_at = [], []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            own = raws[a:b].to_pylist()
            for i, offset in shared_strings(own, docs[a:b].tolist(), int(key[a]), span):
                found_row.append(a + i)
                found_at.append(offset)
        if not found_row:
            return
        r, o = np.array(found_row), np.array(found_at)
        order = np.lexsort((o, r))
        r, o = r[order], o[order]
        first = np.append(True, (r[1:] != r[:-1]) | (o[1:] != o[:-1] + 1))  # consecutive strings as one span
        heads = np.flatnonzero(first)
        size = np.diff(np.append(heads, len(r)))
        c = {"doc": docs[r[heads]], "th": ths[r[heads]], "at": ats[r[heads]] + o[heads], "size": size}
        yield from _dealt(buckets, _SPAN_ROWS, spans=(_of_doc(c["doc"], buckets), c, SETTLED))

    return run


def _finish(span: int):
    def run(batches):
        for texts in text_groups(batches):
            n_bytes, n_removed, n_spans, digests, kept = [], [], [], [], []
            spans = texts.rows.column("spans").to_pylist()
            for i, blob in enumerate(spans):
                raw = texts.data[texts.starts[i] : texts.ends[i]]
                n_bytes.append(len(raw))
                if blob:
                    own = np.frombuffer(blob, _SPANS)
                    edge = np.zeros(len(raw) + 1, np.int64)
                    np.add.at(edge, own["at"], 1)
                    np.subtract.at(edge, own["at"].astype(np.int64) + own["size"] + span - 1, 1)
                    gone = np.cumsum(edge[:-1]) > 0
                    n_removed.append(int(gone.sum()))
                    n_spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                    left = raw[~gone].tobytes()
                else:
                    n_removed.append(0)
                    n_spans.append(0)
                    left = raw.tobytes()
                kept.append(left)
                digests.append(hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays([texts.rows.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(digests), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def deduplicate(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes)."""
    spark = docs.sparkSession
    n = partitions(spark)  # also the number of buckets: keys and documents are dealt evenly, by partition number
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("th", F.xxhash64("text").bitwiseAND(0xFFFFFFFF))  # tells rows of one doc_id apart
    packed = base.where("doc_id is not null").mapInArrow(_segmenter(n, span), PACKED)
    dealt = cut_table(packed.repartitionById(n, F.col("bucket")).mapInArrow(_settle(n), PACKED))
    of_doc = lambda rows, names: rows.repartitionById(n, F.col("bucket")).mapInArrow(_per_document(names), PER_DOC)
    opened = of_doc(dealt.where("open is not null").select("bucket", F.col("open").alias("spans")), OPEN)
    with_open = base.join(opened, (F.col("doc_id") == F.col("doc")) & (base["th"] == opened["th"])).select("doc_id", base["th"], "text", "spans")
    contexts = with_open.mapInArrow(_fetch(n, span), CONTEXTS)
    found = contexts.repartitionById(n, F.col("bucket")).mapInArrow(_group(span, n), SPANS)
    gone = of_doc(dealt.where("settled is not null").select("bucket", F.col("settled").alias("spans")).unionByName(found), SETTLED)
    last = base.join(gone, (F.col("doc_id") == F.col("doc")) & (base["th"] == gone["th"]), "left").select("doc_id", "text", "spans")
    return last.mapInArrow(_finish(span), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def report(docs: DataFrame, span: int = SPAN) -> DataFrame:
    return deduplicate(docs, span).drop("kept")
