"""All pairs of the vectors of a label, a tile of two blocks at a time: blocks of vectors travel, never values or pairs.

A block holds some SIDE vectors of a label, dealt by a hash of vec_id. Two blocks meet in one task, which multiplies them
in strips; what a task holds does not grow with the input, while the work grows with the square of a label. Vectors of
different lengths are compared over the places that they share, as in the SQL; missing values count as nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkstone.plans.catalogue import builder
from inkstone.plans.shared import written
from inkstone.sources.tables import table

SIDE = 4096
STRIP = 128


def unit_block(vectors: list) -> np.ndarray:
    """Rows of length 1, filled up with zeros; a vector of zeros has no direction (NaN)."""
    out = np.zeros((len(vectors), max(map(len, vectors))))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = np.asarray(v, np.float64)
    np.nan_to_num(out, copy=False, posinf=np.inf, neginf=-np.inf)
    with np.errstate(invalid="ignore"):
        return out / np.sqrt((out * out).sum(axis=1))[:, None]


def blocks(spark: SparkSession, sf_dir: str, side: int) -> DataFrame:
    """label, block, blocks (of the label), ids and x (bytes): ids ascend within a block."""
    rows = table(spark, sf_dir, "embeddings").where("label IS NOT NULL AND vec_id IS NOT NULL AND size(embedding) > 0").select("label", "vec_id", "embedding")
    sizes = rows.groupBy("label").agg(F.ceil(F.count("*") / side).cast("int").alias("blocks"))
    dealt = rows.join(F.broadcast(sizes), "label").withColumn("block", F.expr("CAST(pmod(xxhash64(vec_id), blocks) AS INT)"))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id")
        return pd.DataFrame({"label": part["label"].iloc[:1], "block": part["block"].iloc[:1], "blocks": part["blocks"].iloc[:1], "ids": [part["vec_id"].to_numpy(np.int64).tobytes()], "x": [unit_block(part["embedding"].to_list()).tobytes()]})

    return written(dealt.groupBy("label", "block").applyInPandas(pack, f"label {dict(rows.dtypes)['label']}, block int, blocks int, ids binary, x binary"))


def tiles(packed: DataFrame, of: Callable, schema: str) -> DataFrame:
    """of(label, ids, x, other ids, other x, whether both are one block), which yields record batches, for each two blocks of a label."""
    n = packed.agg(F.sum(F.expr("(blocks + 1) / 2"))).first()[0]  # a label with n blocks has n rows here, n (n + 1) / 2 tiles
    met = packed.select("label", "ids", "x", "block", F.expr("explode(sequence(0, blocks - 1)) AS other"))
    met = met.select("label", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "ids", "x")
    met = met.repartition(max(1, math.ceil(n or 0)), "label", "p", "q").sortWithinPartitions("label", "p", "q", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None
        for batch in batches:
            for row in range(batch.num_rows):
                label, (p, q, block, ids, x) = batch.column(0)[row], (c[row].as_py() for c in batch.columns[1:])
                ids = np.frombuffer(ids, np.int64)
                here = (ids, np.frombuffer(x, np.float64).reshape(len(ids), -1))
                if p == q:
                    yield from of(label, *here, *here, True)
                elif block == p:
                    first = here
                elif first is not None:  # a block that no hash fell to has no row
                    yield from of(label, *first, *here, False)
                    first = None

    return met.mapInArrow(run, schema)


def strips(x: np.ndarray, y: np.ndarray, rows: int = STRIP) -> Iterator[tuple[slice, np.ndarray]]:
    shared = min(x.shape[1], y.shape[1])
    x, y = x[:, :shared], np.ascontiguousarray(y[:, :shared].T)
    for a in range(0, len(x), rows):
        yield slice(a, a + rows), x[a : a + rows] @ y


def every_pair(packed: DataFrame) -> DataFrame:
    """label, i, j, cosine of each pair i < j."""
    label_type = packed.schema["label"].dataType

    def of(label, ids, x, others, y, same):
        for at, g in strips(x, y):
            i, j = np.broadcast_arrays(ids[at, None], others[None, :])
            keep = i < j if same else i != j
            i, j, g = i[keep], j[keep], g[keep]
            yield pa.RecordBatch.from_arrays([pa.repeat(label, len(g)), pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j)), pa.array(g)], ["label", "i", "j", "cosine"])

    return tiles(packed, of, f"label {label_type.simpleString()}, i long, j long, cosine double")


def nearest(packed: DataFrame, k: int) -> DataFrame:
    """label, i, j, g: of each vector i at least its k best of each block, by cosine of seven digits and then the least j."""

    def best(label, ids, x, others, y):
        for at, g in strips(x, y):
            g = np.round(g, 7)
            own = ids[at]
            g[own[:, None] == others[None, :]] = -np.inf
            for _ in range(min(k, len(others))):
                top = g.argmax(axis=1)  # the first of equals, which has the least id
                value = g[np.arange(len(own)), top]
                keep = value > -np.inf
                yield pa.RecordBatch.from_arrays([pa.repeat(label, int(keep.sum())), pa.array(own[keep]), pa.array(others[top[keep]]), pa.array(value[keep])], ["label", "i", "j", "g"])
                g[np.arange(len(own)), top] = -np.inf

    def of(label, ids, x, others, y, same):
        yield from best(label, ids, x, others, y)
        if not same:
            yield from best(label, others, y, ids, x)

    return tiles(packed, of, f"label {packed.schema['label'].dataType.simpleString()}, i long, j long, g double")


# --- spread and middle of all pairs ---------------------------------------------------------------------------------

_BINS = 1 << 16


def _digits(g: np.ndarray, path: tuple[int, ...]) -> np.ndarray:
    """The next 16 bits of the place in [-1, 1] of those values whose first bits are path; all steps are exact."""
    r = (g + 1) * (_BINS // 2)
    for d in path:
        digit = np.clip(np.floor(r), 0, _BINS - 1)
        r = (r[digit == d] - d) * _BINS
    return np.clip(np.floor(r), 0, _BINS - 1).astype(np.int64)


def homogeneity(packed: DataFrame) -> DataFrame:
    """label, n, and of all pairs i < j: mean, sd, least, p50; modes: effective number of directions.

    The two middle values are found to 48 bits by three passes, each of which counts by the next 16 bits.
    """
    spark, label = packed.sparkSession, f"label {packed.schema['label'].dataType.simpleString()}"

    def sums(key, ids, x, others, y, same):
        counts = np.zeros(_BINS, np.int64)
        n, mean, m2, least, squares, trace = 0, 0.0, 0.0, math.inf, 0.0, 0.0
        for at, g in strips(x, y):
            squares += float((g * g).sum()) * (1 if same else 2)
            if same:
                trace += float(g[ids[at, None] == others[None, :]].sum())
                g = g[ids[at, None] < others[None, :]]
            g = g.ravel()
            if not len(g):
                continue
            m = float(g.mean())
            d, n = m - mean, n + len(g)
            m2 += float(np.square(g - m).sum()) + d * d * (n - len(g)) * len(g) / n
            mean += d * len(g) / n
            least = min(least, float(g.min()))
            counts += np.bincount(_digits(g[~np.isnan(g)], ()), minlength=_BINS)
        at = np.flatnonzero(counts)
        stats = [float(len(ids)) if same else 0.0, n * mean, m2, n * mean * mean, least, squares, trace]
        yield pa.RecordBatch.from_arrays([pa.repeat(key, 1), pa.array([-1]), pa.array([n]), pa.array([stats], pa.list_(pa.float64()))], ["label", "bin", "c", "v"])
        yield pa.RecordBatch.from_arrays([pa.repeat(key, len(at)), pa.array(at), pa.array(counts[at]), pa.nulls(len(at), pa.list_(pa.float64()))], ["label", "bin", "c", "v"])

    told = written(tiles(packed, sums, f"{label}, bin long, c long, v array<double>"))
    total = told.where("bin < 0").groupBy("label").agg(F.sum("c").alias("pairs"), *(F.sum(F.col("v")[k]).alias(c) for k, c in ((0, "n"), (1, "s"), (2, "m2"), (3, "q"), (5, "squares"), (6, "trace"))), F.min(F.col("v")[4]).alias("least"))
    total = written(total)
    ranks = total.where("pairs > 0").select("label", F.explode(F.array(F.expr("(pairs - 1) div 2"), F.expr("pairs div 2"))).alias("r"))
    targets = [(r.label, r.r, ()) for r in ranks.collect()]
    counts = told.where("bin >= 0").groupBy("label", "bin").agg(F.sum("c").alias("c")).withColumn("path", F.lit(""))

    for step in range(3):
        if step:
            wanted: dict = {}
            for key, _, path in targets:
                wanted.setdefault(key, set()).add(path)

            def place(key, ids, x, others, y, same, wanted=wanted):
                found = {path: np.zeros(_BINS, np.int64) for path in wanted.get(key.as_py(), ())}
                for at, g in strips(x, y):
                    g = g[ids[at, None] < others[None, :]] if same else g.ravel()
                    for path, c in found.items():
                        c += np.bincount(_digits(g, path), minlength=_BINS)
                for path, c in found.items():
                    at = np.flatnonzero(c)
                    yield pa.RecordBatch.from_arrays([pa.repeat(key, len(at)), pa.array([",".join(map(str, path))] * len(at), pa.string()), pa.array(at), pa.array(c[at])], ["label", "path", "bin", "c"])

            counts = tiles(packed, place, f"{label}, path string, bin long, c long").groupBy("label", "path", "bin").agg(F.sum("c").alias("c"))
        order = Window.partitionBy("label", "path").orderBy("bin")
        asked = spark.createDataFrame([(key, r, ",".join(map(str, path))) for key, r, path in targets], f"{label}, r long, path string")
        hit = counts.withColumn("under", F.sum("c").over(order) - F.col("c")).join(F.broadcast(asked), ["label", "path"]).where("under <= r AND r < under + c")
        targets = [(h.label, h.r - h.under, (*(int(d) for d in h.path.split(",") if d), h.bin)) for h in hit.collect()]
    values = [(key, -1 + (path[0] + (path[1] + (path[2] + 0.5) / _BINS) / _BINS) / (_BINS // 2)) for key, _, path in targets]
    middle = spark.createDataFrame(values, f"{label}, p50 double").groupBy("label").agg(F.avg("p50").alias("p50"))
    sd = "CASE WHEN pairs > 1 THEN sqrt(greatest(m2 + q - s * s / pairs, 0D) / (pairs - 1)) END AS sd"
    return total.join(middle, "label", "left").selectExpr("label", "CAST(n AS BIGINT) AS n", "CASE WHEN pairs > 0 THEN s / pairs END AS mean", sd, "CASE WHEN pairs > 0 THEN least END AS least", "p50", "trace * trace / squares AS modes")


builder("every_cosine", "")(lambda spark, sf_dir: every_pair(blocks(spark, sf_dir, SIDE)))
builder("nearest_cosines", "")(lambda spark, sf_dir: nearest(blocks(spark, sf_dir, SIDE), 3))
builder("cosine_spread", "")(lambda spark, sf_dir: homogeneity(blocks(spark, sf_dir, SIDE)))
