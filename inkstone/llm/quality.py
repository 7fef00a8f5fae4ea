"""Quality classifier: supervised subword embeddings.

Each lowered word and each run of 3 and 4 characters of a text is hashed to a row of a learned embedding table; a document is
the average of its rows; a softmax over two classes sits on top. Table and output weights are trained together by plain
numpy stochastic gradient descent. Nothing but the text enters a score.

Training takes at most PER_CLASS labelled documents of each class (a documented bound), chosen by a hash of the id from
those whose crc32(id as text) mod 5 is not 0. Their feature counts, not their texts, come to the driver. As the output
layer is linear, each row of the table then stands for one number, and scoring is one gather and one mean per document:
a single pass over the texts without a shuffle.

Cases: null and empty texts have no feature and get the score of the bias alone; a very long text is averaged whole, in
memory of some 40 times its size; labels other than 0 and 1 and labels of unknown documents are ignored; of documents
with one doc_id the least text trains, and of labels of one doc_id the lesser counts; with one class or none the score is the share of class 1 (0.5 without labels); repeated
rows score alike; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from inkstone.llm.common import Texts, free, text_groups
from inkstone.llm.kernels import U, Words

BITS = 17  # words and character runs have 2**BITS rows each
DIM = 8
EPOCHS = 12
RATE = 0.6
PER_CLASS = 1200
CUT = 0.3


def features(texts: Texts) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Table rows of all features of a group of texts, text by text, and how many each text has."""
    words = Words(texts)
    rows, of = [(words.hash >> U(64 - BITS)).astype(np.int32)], [words.counts]
    codes = np.frombuffer(texts.data.tobytes().decode().encode("utf-32-le"), np.uint32)
    begins = np.concatenate(([0], np.cumsum((texts.data & 0xC0) != 0x80)))
    ends = begins[texts.ends]  # in characters
    sizes = ends - begins[texts.starts]
    n = len(codes)
    for k, odd in ((3, 0x9E3779B1), (4, 0x85EBCA77)):
        inside = np.ones(n, bool)
        for back in range(1, k):
            inside[(ends - back)[sizes >= back]] = False
        mixed = codes.copy()
        for step in range(1, k):  # a polynomial of the next characters; places that lack them are not inside
            mixed *= np.uint32(0x01000193)
            mixed[: max(n - step, 0)] += codes[step:]
        hashed = (mixed * np.uint32(odd)) >> np.uint32(32 - BITS)
        rows.append(hashed[inside].astype(np.int32) + (1 << BITS))
        of.append(np.maximum(sizes - k + 1, 0))
    return rows, of


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of the next counts[i] values, for each i."""
    out = np.zeros(len(counts))
    some = counts > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(counts) - counts)[some])
    return out


def _count_features(batches):
    for texts in text_groups(batches):
        rows, of = features(texts)
        at = [np.concatenate(([0], np.cumsum(c))) for c in of]
        ids, counts = [], []
        for d in range(len(texts)):
            own = np.concatenate([r[a[d] : a[d + 1]] for r, a in zip(rows, at, strict=True)])
            i, c = np.unique(own, return_counts=True)
            ids.append(i.astype("<i4").tobytes())
            counts.append(c.astype("<i4").tobytes())
        yield pa.RecordBatch.from_arrays([texts.rows.column("label"), texts.rows.column("rank"), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], ["label", "rank", "ids", "counts"])


@dataclass
class Model:
    """What scoring needs: a number for each table row, and the bias; kept with the trained layers."""

    rows: np.ndarray
    bias: float
    embedding: np.ndarray | None = None
    output: np.ndarray | None = None


def train(samples: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Model:
    """SGD over (label, feature rows, their counts), one document a step, with a linearly falling rate."""
    rng = np.random.default_rng(seed)
    embedding = rng.uniform(-1 / DIM, 1 / DIM, (2 << BITS, DIM)).astype(np.float32)
    output, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    labels = [s[0] for s in samples]
    if len(set(labels)) < 2:
        share = min(max(sum(labels) / len(labels), 0.01), 0.99) if labels else 0.5
        return Model(np.zeros(2 << BITS, np.float32), float(np.log(share / (1 - share))))
    weights = [(c / c.sum()).astype(np.float32) if len(c) else c.astype(np.float32) for _, _, c in samples]
    step, steps = 0, epochs * len(samples)
    for _ in range(epochs):
        for i in rng.permutation(len(samples)).tolist():
            label, rows, _ = samples[i]
            hidden = weights[i] @ embedding[rows] if len(rows) else np.zeros(DIM, np.float32)
            z = output @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            p *= rate * (1 - step / steps)
            back = p @ output
            output -= np.outer(p, hidden)
            bias -= p * np.float32(0.1)
            if len(rows):
                # the average spreads the gradient over the document's rows; each moves by its share of a full step
                embedding[rows] -= np.outer(weights[i] * np.float32(min(len(rows), 50)), back)
            step += 1
    return Model((embedding @ (output[1] - output[0])).astype(np.float32), float(bias[1] - bias[0]), embedding, output)


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Feature counts of at most per_class labelled documents of each class outside the held-out fold."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("quality").alias("label"), F.xxhash64("doc_id", F.lit("order")).alias("rank"))
    chosen = [known.where(F.col("label") == c).orderBy("rank", "doc_id").limit(per_class) for c in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]).groupBy("doc_id", "rank").agg(F.min("label").alias("label")))  # 2 * per_class rows at most
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(ids, "doc_id").groupBy("doc_id", "label", "rank").agg(F.min("text").alias("text")).select("label", "rank", "text")
    counted = rows.mapInArrow(_count_features, "label int, rank long, ids binary, counts binary").orderBy("rank").collect()
    return [(r[0], np.frombuffer(r[2], "<i4"), np.frombuffer(r[3], "<i4")) for r in counted]


def _scorer(shared, name: str):
    def run(batches):
        model = shared.value
        for texts in text_groups(batches):
            rows, of = features(texts)
            total = sum(sums(model.rows[r].astype(np.float64), c) for r, c in zip(rows, of, strict=True))
            z = total / np.maximum(sum(of), 1) + model.bias
            score = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([*texts.rows.columns, pa.array(score)], [*texts.rows.schema.names, name])

    return run


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    model = train(sample(docs, labels, per_class))
    return Model(model.rows, model.bias)


def with_score(docs: DataFrame, model: Model) -> DataFrame:
    """docs, all columns kept, with the score in a further column named by score_name(docs)."""
    name = score_name(docs)
    return docs.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(model), name), StructType([*docs.schema.fields]).add(name, DoubleType()))


def score_name(docs: DataFrame) -> str:
    """_score, or a name like it that no column of docs has."""
    return free(docs, "_score")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    scored = with_score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the classifier rejects; all columns stay."""
    return with_score(docs, fit(docs, labels)).where(F.col(score_name(docs)) >= CUT).drop(score_name(docs))
