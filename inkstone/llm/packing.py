"""Packing of tokenised documents into windows by Karmarkar-Karp multiway differencing.

A document's ids are cut into full windows and a rest; rests are cut into items of at most ITEM ids. Items are packed in
blocks, each within the task that tokenised it, so no token is shuffled. In a block the items start as partial
partitions into k windows; the two with the largest imbalance are merged again and again, the fullest window of one with
the emptiest of the other, which leaves near-equal windows. k starts at what the ids need and rises by one whenever a
window comes out above the capacity.

Cases: a null or empty text is its end id alone; equal rows are packed each for itself; a text of any length is cut into
as many windows as it fills; an empty table gives no piece; extra columns are ignored. sequence_id is unique: the task's
number in the upper bits, a counter in the lower ones.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import blobs, text_groups
from inkstone.llm.tokens import encoder

CAPACITY = 1024
ITEM = 256
BLOCK = 1024
END = 0


def differencing(sizes: list[int], k: int) -> np.ndarray:
    """Window (0 to k-1) of each item: k-way Karmarkar-Karp. Windows are kept as chains of items, so a merge is O(k log k)."""
    n = len(sizes)
    if k == 1:
        return np.zeros(n, np.int64)
    follow = np.full(n + 1, -1, np.int64)
    # (-imbalance, number, loads by descending size, first and last item of each window; n stands for none)
    heap = [(-s, i, None, None, None) for i, s in enumerate(sizes)]
    heapq.heapify(heap)

    def opened(entry):
        if entry[2] is not None:
            return entry[2:]
        loads, heads = np.zeros(k, np.int64), np.full(k, n, np.int64)
        loads[0], heads[0] = -entry[0], entry[1]
        return loads, heads, heads.copy()

    count = n
    while len(heap) > 1:
        la, ha, ta = opened(heapq.heappop(heap))
        lb, hb, tb = opened(heapq.heappop(heap))
        lb, hb, tb = lb[::-1], hb[::-1], tb[::-1]  # opposing imbalances
        follow[ta] = np.where(hb == n, -1, hb)
        heads, tails, loads = np.where(ha == n, hb, ha), np.where(tb == n, ta, tb), la + lb
        order = np.argsort(-loads, kind="stable")
        loads = loads[order]
        heapq.heappush(heap, (-int(loads[0] - loads[-1]), count, loads, heads[order], tails[order]))
        count += 1
    heads = opened(heap[0])[1]
    out = np.empty(n, np.int64)
    for w, item in enumerate(heads.tolist()):
        while item not in (-1, n):
            out[item] = w
            item = int(follow[item])
    return out


def pack(sizes: list[int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Windows of items, and how many: the least count from the ids' need on at which differencing keeps the capacity."""
    if not sizes:
        return np.zeros(0, np.int64), 0
    k = -(-sum(sizes) // capacity)
    while True:
        at = differencing(sizes, k)
        if np.bincount(at, weights=sizes, minlength=k).max() <= capacity:
            return at, k
        k += 1


class _Block:
    """Items that wait for their windows."""

    def __init__(self):
        self.docs, self.rows, self.ids = [], [], []

    def add(self, doc, start: int, ids: np.ndarray, tokens: int) -> None:
        self.docs.append(doc)
        self.rows.append((start, len(ids), tokens))
        self.ids.append(ids)

    def flush(self, first: int, capacity: int):
        """Columns of the block's pieces, and how many windows they take."""
        rows = np.array(self.rows, np.int64).reshape(-1, 3)
        at, k = pack(rows[:, 1].tolist(), capacity)
        order = np.argsort(at, kind="stable")
        sizes, windows = rows[order, 1], at[order]
        upto = np.cumsum(sizes) - sizes
        head = np.concatenate(([True], windows[1:] != windows[:-1]))
        offsets = upto - np.repeat(upto[head], np.diff(np.append(np.flatnonzero(head), len(windows))))
        order = order.tolist()
        return [self.docs[i] for i in order], rows[order], [self.ids[i] for i in order], windows + first, offsets, k


def _packer(paths, capacity: int, item: int, block_items: int, kind: pa.DataType, batch_ids: int = 1 << 20):
    schema = pa.schema([("doc_id", kind), *[(n, pa.int64()) for n in ("start", "length")], ("ids", pa.binary()), *[(n, pa.int64()) for n in ("doc_tokens", "sequence_id", "offset")]])

    def batch(docs, rows, ids, windows, offsets):
        flat = np.concatenate(ids).astype("<u4").tobytes()
        columns = [pa.array(docs, type=kind), pa.array(rows[:, 0]), pa.array(rows[:, 1]), blobs(flat, rows[:, 1] * 4), pa.array(rows[:, 2]), pa.array(windows), pa.array(offsets)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches):
        code = encoder(*paths)
        task = TaskContext.get()
        used = (task.partitionId() if task else 0) << 33
        block = _Block()
        for texts in text_groups(batches):
            ids, counts = code.encode(texts.data, texts.ends)
            docs = texts.rows.column("doc_id").to_pylist()
            full_docs, full_rows, full_ids, at = [], [], [], 0
            for doc, n in zip(docs, counts.tolist(), strict=True):
                own = np.append(ids[at : at + n], END).astype(np.uint32)
                at += n
                whole = len(own) // capacity * capacity
                for start in range(0, whole, capacity):
                    full_docs.append(doc)
                    full_rows.append((start, capacity, len(own)))
                    full_ids.append(own[start : start + capacity])
                for start in range(whole, len(own), item):
                    block.add(doc, start, own[start : start + item], len(own))
                if len(block.docs) >= block_items:
                    *columns, k = block.flush(used, capacity)
                    used += k
                    yield batch(*columns)
                    block = _Block()
            if full_docs:
                k = len(full_docs)
                yield batch(full_docs, np.array(full_rows, np.int64), full_ids, np.arange(used, used + k), np.zeros(k, np.int64))
                used += k
        if block.docs:
            yield batch(*block.flush(used, capacity)[:-1])

    return run


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, item: int = ITEM, block: int = BLOCK, paths: tuple = (None, None, None)) -> DataFrame:
    """A row per piece: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    name = dict(base.dtypes)["doc_id"]
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(base.schema["doc_id"].dataType)
    return base.mapInArrow(_packer(paths, capacity, item, block, kind), f"doc_id {name}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def pieces(docs: DataFrame) -> DataFrame:
    """pack_documents with the ids' checksum in their place."""
    return pack_documents(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
