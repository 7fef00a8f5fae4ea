"""Shared plumbing: table access, durable lineage cuts, Arrow text access."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018  only glibc has it
except (OSError, AttributeError):
    _LIBC = None

#: Texts are handled in groups of about so many bytes; numpy temporaries take some 40 times that.
CHUNK_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where none is configured and the master is local (tests)."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = getattr(sc, "_inkstone_checkpoints", None)
        if path is None:
            path = sc._inkstone_checkpoints = "file://" + tempfile.mkdtemp(prefix="inkstone-ckpt-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and goes on from there, so that a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Texts:
    """A group of texts as one byte buffer: text i is data[ends[i-1] if i else 0 : ends[i]]."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, rows: pa.RecordBatch):
        self.data, self.ends, self.rows = data, ends, rows
        self.starts = np.concatenate(([0], ends[:-1])).astype(np.int64)

    def __len__(self) -> int:
        return len(self.ends)


def give_back() -> None:
    """Freed memory goes back to the system: workers are reused, and idle ones would hold it beside the JVM's tasks."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def text_groups(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[Texts]:
    """Arrow batches as Texts of about `most` bytes (one text at least); a null text counts as an empty one."""
    for batch in batches:
        text = batch.column(batch.schema.get_field_index(column))
        if len(text) == 0:
            continue
        if text.null_count:
            text = text.fill_null("")
        kind = np.int64 if pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type) else np.int32
        offsets = np.frombuffer(text.buffers()[1], dtype=kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        raw = text.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
        i = 0
        while i < len(text):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
            yield Texts(data[offsets[i] : offsets[j]], offsets[i + 1 : j + 1] - offsets[i], batch.slice(i, j - i))
            i = j
        del batch, text, raw, data
    give_back()


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column: row i takes the next counts[i] values."""
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def blobs(data: bytes, sizes: np.ndarray) -> pa.Array:
    """A binary column: row i takes the next sizes[i] bytes."""
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    if len(sizes) and offsets[-1] < 2**31 - 1:
        return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data)])
    return pa.array([data[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)], type=pa.binary())


def cut_table(df: DataFrame) -> DataFrame:
    """Like cut, as a compressed table in the shared folder."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._inkstone_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Removes tables of cut_table that nothing reads any more: what was made of them is written itself."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._inkstone_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free(docs: DataFrame, name: str) -> str:
    """name, with as many underscores after it as no column of docs has the name (in any case)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def aside(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, text, and all other columns in one struct `row`, so that no name of the input meets one used inside."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(key, "text", F.struct(*others).alias("row"))


def restored(rows: DataFrame, names: list[str]) -> DataFrame:
    """The columns that aside() has put away, in their old order, with rows' text."""
    return rows.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names])


def whole_units(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Sorted Arrow batches as tables of whole units (rows of one key), with the edges of the units."""

    def edges_of(rows: pa.Table) -> list[int]:
        new = np.zeros(len(rows), bool)
        new[:1] = True
        for k in keys:
            values = rows.column(k).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return [*np.flatnonzero(new).tolist(), len(rows)]

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        edges = edges_of(rows)
        if len(edges) > 2:
            yield rows.slice(0, edges[-2]).combine_chunks(), edges[:-1]
        held = rows.slice(edges[-2])
    if held is not None:
        yield held.combine_chunks(), [0, len(held)]
