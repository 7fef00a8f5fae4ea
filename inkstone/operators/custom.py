"""Operators with no relational form: Arrow UDFs over texts, word lists, pairs and vectors; no oracle SQL, brute-force tests.

Null texts and too short inputs give null results; empty tables give no rows.
"""

from __future__ import annotations

import difflib
import lzma
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkstone.functions.text import words
from inkstone.operators import keyness  # noqa: F401  registers relations
from inkstone.plans import catalogue
from inkstone.sources.tables import table


# --- lexical diversity with reset -----------------------------------------------------------------------------------


def factors(tokens, limit: float = 0.72) -> float:
    """Stretches over which the share of different words falls to the limit; a last open stretch counts in part."""
    found, start, kinds, share = 0.0, 0, set(), 1.0
    for i, word in enumerate(tokens, 1):
        kinds.add(word)
        share = len(kinds) / (i - start)
        if share <= limit and i - start > 1:
            found, start, kinds, share = found + 1, i, set(), 1.0
    return found + min(1.0, (1 - share) / (1 - limit))


def diversity(tokens) -> float | None:
    """Mean length of such stretches, read both ways; without any stretch the length of the text."""
    n = len(tokens)
    if not n:
        return None
    return sum(n / f if f else float(n) for f in (factors(tokens), factors(tokens[::-1]))) / 2


def mtld(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("double")
    def of(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda t: None if t is None else diversity(list(t))).astype("float64")

    return table(spark, sf_dir, "documents").select("doc_id", F.round(of(words(F.col("text"))), 6).alias("mtld"))


# --- compression distance -------------------------------------------------------------------------------------------



def packed_size(data: bytes) -> int:
    """Bytes of raw LZMA2 at the highest preset. The dictionary is no larger than the data need, which saves clearing 64 MiB."""
    window = min(1 << 26, max(1 << 16, 1 << len(data).bit_length()))
    return len(lzma.compress(data, format=lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "preset": 9 | lzma.PRESET_EXTREME, "dict_size": window}]))


def compression_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extra compressed bytes of a document after the previous one of its source (by doc_id); null for the first."""

    @F.pandas_udf("long")
    def extra(before: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else packed_size((a + b).encode()) - packed_size(a.encode()) for a, b in zip(before, text, strict=True)], dtype="Int64")

    order = Window.partitionBy("source").orderBy("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    before = docs.select(F.col("doc_id").alias("target"), F.lag("doc_id").over(order).alias("prior")).where("prior is not null")
    text = table(spark, sf_dir, "documents").select("doc_id", "text")  # texts stay out of the window
    pairs = before.join(text.select(F.col("doc_id").alias("prior"), F.col("text").alias("before")), "prior").join(text.withColumnRenamed("doc_id", "target"), "target")
    return pairs.select(F.col("target").alias("doc_id"), "prior", extra("before", "text").alias("extra_bytes"))


# --- Fisher's exact test --------------------------------------------------------------------------------------------


def fisher_score(a: int, b: int, target_total: int, reference_total: int) -> float:
    """-log10 of the one-sided p of a in the target and b in the reference, on the side to which the rates differ."""
    drawn, total = a + b, target_total + reference_total
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    term = lambda k: choose(target_total, k) + choose(reference_total, drawn - k) - choose(total, drawn)
    more = a * reference_total >= b * target_total
    ks = range(a, min(drawn, target_total) + 1) if more else range(a, max(0, drawn - reference_total) - 1, -1)
    logs = []
    for k in ks:
        logs.append(term(k))
        if logs[-1] < logs[0] - 60:  # the tail falls ever faster from here
            break
    return max(0.0, -(logs[0] + math.log(sum(math.exp(x - logs[0]) for x in logs))) / math.log(10))


def keyness_fisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series, ta: pd.Series, tb: pd.Series) -> pd.Series:
        return pd.Series([fisher_score(int(w), int(x), int(y), int(z)) for w, x, y, z in zip(a, b, ta, tb, strict=True)], dtype="float64")

    counts = catalogue.run(spark, sf_dir, "SELECT word, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(ta AS BIGINT) AS ta, CAST(tb AS BIGINT) AS tb FROM {key_counts} WHERE a + b >= 5")
    return counts.select("word", F.round(score("a", "b", "ta", "tb"), 4).alias("fisher"))


# --- greedy cover by reference spans --------------------------------------------------------------------------------


def longest_matches(target: DataFrame, reference: DataFrame, k: int = 8) -> DataFrame:
    """(doc_id, pos, size): the longest run of words from pos on that also stands in one reference text, from k words on.

    target and reference: (doc_id, pos, gram) of k-word grams. Equal grams are joined, runs are islands on a diagonal.
    """
    hits = target.join(reference.select(F.col("doc_id").alias("item"), F.col("pos").alias("at"), "gram"), "gram")
    hits = hits.select("doc_id", "pos", "item", (F.col("pos") - F.col("at")).alias("diagonal"))
    along = Window.partitionBy("doc_id", "item", "diagonal").orderBy("pos")
    islands = hits.withColumn("island", F.col("pos") - F.row_number().over(along))
    last = Window.partitionBy("doc_id", "item", "diagonal", "island")
    return islands.withColumn("size", F.max("pos").over(last) - F.col("pos") + k).groupBy("doc_id", "pos").agg(F.max("size").alias("size"))


def greedy_cover(matches: DataFrame) -> DataFrame:
    """Per document: spans and words taken from left to right, each the longest match at the first free word."""
    fold = """aggregate(array_sort(collect_list(struct(pos, size))), struct(cast(0 as bigint) as free, cast(0 as bigint) as n, cast(0 as bigint) as covered),
      (s, x) -> if(x.pos >= s.free, struct(cast(x.pos + x.size as bigint) as free, s.n + 1 as n, cast(s.covered + x.size as bigint) as covered), s))"""
    return matches.groupBy("doc_id").agg(F.expr(fold).alias("s")).select("doc_id", F.col("s.n").alias("n_spans"), F.col("s.covered").alias("covered_words"))


def originality_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    def grams(name: str, key: str) -> DataFrame:
        w = table(spark, sf_dir, name).select(F.col(key).alias("doc_id"), words(F.col("text"), r"[\p{L}\p{N}_]+").alias("w")).where(F.size("w") >= 8)
        return w.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - 7), lambda i: F.array_join(F.slice("w", i, 8), " "))).alias("pos", "gram"))

    return greedy_cover(longest_matches(grams("documents", "doc_id"), grams("benchmark", "item_id")))


# --- ordered overlap of discourse skeletons -------------------------------------------------------------------------


def sequence_overlap(pairs: DataFrame) -> DataFrame:
    """pairs (a, b, symbols_a, symbols_b) with the Ratcliff-Obershelp ratio of the two sequences."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, list(p), list(q), autojunk=False).ratio() for p, q in zip(x, y, strict=True)], dtype="float64")

    return pairs.select("a", "b", F.round(ratio("symbols_a", "symbols_b"), 6).alias("overlap"))


def skeleton_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the next one of its source; a symbol is a sentence's length tercile and its last mark."""
    symbols = catalogue.run(spark, sf_dir, """
WITH s AS (SELECT x.doc_id, x.snum, @COUNT(lower(x.sent);;[a-z']+)@ AS w, right(rtrim(x.sent), 1) AS mark FROM {sents} x),
t AS (SELECT doc_id, snum, ntile(3) OVER (PARTITION BY doc_id ORDER BY w, snum) AS third, mark FROM s)
SELECT doc_id, transform(array_sort(collect_list(struct(snum, concat(third, CASE WHEN mark IN ('.', '!', '?') THEN mark ELSE '-' END) AS symbol))), r -> r.symbol) AS symbols FROM t GROUP BY doc_id""")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    after = docs.select(F.col("doc_id").alias("a"), F.lead("doc_id").over(Window.partitionBy("source").orderBy("doc_id")).alias("b")).where("b is not null")
    pairs = after.join(symbols.select(F.col("doc_id").alias("a"), F.col("symbols").alias("symbols_a")), "a").join(symbols.select(F.col("doc_id").alias("b"), F.col("symbols").alias("symbols_b")), "b")
    return sequence_overlap(pairs)


# --- intrinsic dimension --------------------------------------------------------------------------------------------


def tree_length(points: np.ndarray) -> float:
    """Sum of the edges of the least spanning tree (Prim, one row of distances to the points outside the tree at a time)."""
    if len(points) < 2:
        return 0.0
    at, rest = points[0], np.array(points[1:], np.float64)
    near, apart, total = np.full(len(rest), np.inf), np.empty_like(rest), 0.0
    for left in range(len(rest), 0, -1):
        d = np.subtract(rest[:left], at, out=apart[:left])
        np.minimum(near[:left], np.einsum("ij,ij->i", d, d), out=near[:left])
        i = int(near[:left].argmin())
        total += math.sqrt(near[i])
        at = rest[i].copy()
        rest[i], near[i] = rest[left - 1], near[left - 1]
    return total


NEAR = 64
ROWS = 256


def distances(points: np.ndarray, some: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Squared distances of some rows to all, by one product; exact ones are taken by differences where an edge is told."""
    d = points[some] @ points.T
    d *= -2
    d += squares
    d += squares[some][:, None]
    return d


def apart(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = points[a] - points[b]
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def nearest_of(points: np.ndarray, squares: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each point's k nearest others, in order, and their distances."""
    ids, far = np.empty((len(points), k), np.int32), np.empty((len(points), k))
    for low in range(0, len(points), ROWS):
        some = np.arange(low, min(len(points), low + ROWS))
        d = distances(points, some, squares)
        d[np.arange(len(some)), some] = np.inf
        found = np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(points) - 1 else np.argsort(d, axis=1)[:, :k]
        exact = apart(points, np.repeat(some, k), found.ravel()).reshape(found.shape)
        order = np.argsort(exact, axis=1, kind="stable")
        ids[some], far[some] = np.take_along_axis(found, order, 1), np.take_along_axis(exact, order, 1)
    return ids, far


def spanning_length(points: np.ndarray, squares: np.ndarray, chosen: np.ndarray, ids: np.ndarray, far: np.ndarray) -> float:
    """tree_length of the chosen points, from the nearest neighbours in the whole cloud.

    In each round every part but the largest takes its shortest edge outwards (Boruvka). What is not among a point's
    neighbours is no nearer than the last of them, so that a point is held against all others only where that says too little.
    """
    m = len(chosen)
    local = np.full(len(points), -1, np.int32)
    local[chosen] = np.arange(m, dtype=np.int32)
    own, cloud = points[chosen], squares[chosen]
    near, far, reach = local[ids[chosen]], far[chosen], far[chosen][:, -1].copy()
    if ids.shape[1] >= len(points) - 1:
        reach[:] = np.inf  # all others are listed
    part, total, edges = np.arange(m), 0.0, 0
    live = np.arange(m)  # points whose list may still lead outwards
    while edges < m - 1:
        best, to = np.full(m, np.inf), np.full(m, -1)
        out = (near[live] >= 0) & (part[near[live]] != part[live][:, None])
        has, first = out.any(axis=1), out.argmax(axis=1)
        live, first = live[has], first[has]
        best[live], to[live] = far[live, first], near[live, first]
        largest = np.bincount(part, minlength=m).argmax()
        least = np.full(m, np.inf)
        np.minimum.at(least, part, best)
        unsure = np.isinf(best) & (part != largest)
        rows = np.flatnonzero(unsure & (reach < least[part]))
        for low in range(0, len(rows), ROWS):
            some = rows[low : low + ROWS]
            some = some[reach[some] < least[part[some]]]
            if not len(some):
                continue
            d = distances(own, some, cloud)
            d[part[some][:, None] == part[None, :]] = np.inf
            at = d.argmin(axis=1)
            best[some], to[some] = apart(own, some, at), at
            reach[some] = best[some]
            np.minimum.at(least, part[some], best[some])
        order = np.lexsort((best, part))
        heads = order[np.r_[True, part[order][1:] != part[order][:-1]]]
        heads = heads[(part[heads] != largest) & np.isfinite(best[heads])]
        if not len(heads):
            return math.nan  # places that are no numbers
        heads = heads[np.argsort(best[heads], kind="stable")]
        up = {}

        def top(x: int, up=up) -> int:
            while x in up:
                x = up[x]
            return x

        for a, b, d in zip(part[heads].tolist(), part[to[heads]].tolist(), best[heads].tolist(), strict=True):
            x, y = top(a), top(b)
            if x != y:
                up[x] = y
                total, edges = total + d, edges + 1
        names = np.arange(m)
        for x in list(up):
            names[x] = top(x)
        part = names[part]
    return total


def dimension(points: np.ndarray, shares=(0.25, 0.4, 0.55, 0.7, 0.85, 1.0), draws: int = 5) -> float | None:
    """1 / (1 - slope) of log mean tree length over log size, by `draws` seeded subsets a size.

    Null below 8 points, where the trees have no length, and where the slope is 1 or more (no finite dimension).
    Neighbours are sought once, for the trees of all subsets.
    """
    sizes = sorted({int(len(points) * s) for s in shares})
    sizes = [n for n in sizes if n >= 2]
    if len(points) < 8 or len(sizes) < 3:
        return None
    points = points - points.mean(axis=0)
    squares = np.einsum("ij,ij->i", points, points)
    ids, far = nearest_of(points, squares, min(NEAR, len(points) - 1))
    subset = lambda n, k: np.random.default_rng((n, k)).choice(len(points), n, replace=False)
    lengths = [float(np.mean([spanning_length(points, squares, subset(n, k), ids, far) for k in range(draws if n < len(points) else 1)])) for n in sizes]
    if not min(lengths) > 0 or not all(map(math.isfinite, lengths)):
        return None
    slope = float(np.polyfit(np.log(sizes), np.log(lengths), 1)[0])
    return 1 / (1 - slope) if slope < 1 else None


def persistent_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per label: dimension of all its vectors, whose subsets are drawn by their order by md5 of vec_id.

    A label is one task. Its memory grows with its vectors; one pass over all pairs, a product of matrices, grows with their square.
    """
    order = Window.partitionBy("label").orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id")
    every = table(spark, sf_dir, "embeddings").where("embedding is not null").select("label", "embedding", F.row_number().over(order).alias("k"))

    def of(cloud: pd.DataFrame) -> pd.DataFrame:
        cloud = cloud.sort_values("k")
        value = dimension(np.stack(cloud["embedding"].to_list()).astype(np.float64))
        return pd.DataFrame({"label": [cloud["label"].iloc[0]], "n": [len(cloud)], "phd": [None if value is None else round(value, 6)]})

    return every.groupBy("label").applyInPandas(of, "label int, n long, phd double")


# --- spectrum of a series -------------------------------------------------------------------------------------------


def spectrum(values: np.ndarray, low: float = 0.1) -> tuple[float | None, ...]:
    """Centroid, share of energy below `low` of the frequencies, flatness and peak of the centred magnitude spectrum."""
    if len(values) < 4:
        return None, None, None, None
    size = np.abs(np.fft.rfft(values - values.mean()))[1:]
    at = np.fft.rfftfreq(len(values))[1:]
    energy = size**2
    if energy.sum() <= 1e-18:
        return None, None, None, None
    flat = float(np.exp(np.log(energy + 1e-18).mean()) / (energy.mean() + 1e-18))
    return float((at * size).sum() / size.sum()), float(energy[at <= low].sum() / energy.sum()), flat, float(at[int(size.argmax())])


def series_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user, over the user's values by time."""

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ts", "event_id"])
        values = spectrum(rows["value"].to_numpy(np.float64))
        return pd.DataFrame([[rows["user_id"].iloc[0], len(rows), *[None if v is None else round(v, 6) for v in values]]], columns=["user_id", "n", "centroid", "low_share", "flatness", "peak"])

    events = table(spark, sf_dir, "events").where("value is not null AND user_id is not null").select("user_id", "ts", "event_id", "value")
    return events.groupBy("user_id").applyInPandas(of, "user_id long, n long, centroid double, low_share double, flatness double, peak double")


QUERIES = {f.__name__: f for f in (mtld, compression_distance, keyness_fisher, originality_cover, skeleton_overlap, persistent_dimension, series_spectrum)}
