"""Operators without oracle SQL against brute force and by hand."""

import hashlib
import lzma
import math
import random

import numpy as np
from pyspark.sql import functions as F

from inkstone.operators import components, custom

SF = "/root/testdata/sf0.001"


def test_diversity_by_hand():
    assert custom.diversity([]) is None
    assert custom.diversity(["a"]) == 1.0
    assert custom.diversity(list("abcdef")) == 6.0
    # a a: the share falls to 0.5 at the second word, a factor each two words
    assert custom.diversity(list("aaaa")) == 2.0
    part = (1 - 3 / 4) / (1 - 0.72)
    assert math.isclose(custom.diversity(list("abca")), 4 / part)


def test_fisher_by_hand():
    def tail(a, b, ta, tb):
        all_ = math.comb(ta + tb, a + b)
        return sum(math.comb(ta, k) * math.comb(tb, a + b - k) for k in range(a, min(a + b, ta) + 1)) / all_

    for case in ((8, 2, 50, 60), (5, 5, 40, 400), (10, 0, 10, 10)):
        assert math.isclose(custom.fisher_score(*case), -math.log10(tail(*case)), rel_tol=1e-9)
    assert custom.fisher_score(0, 30, 500, 500) > 8


def brute_cover(target, refs, k=8):
    n_spans = covered = i = 0
    while i < len(target):
        best = 0
        for r in refs:
            for j in range(len(r)):
                m = 0
                while i + m < len(target) and j + m < len(r) and target[i + m] == r[j + m]:
                    m += 1
                best = max(best, m)
        if best >= k:
            n_spans, covered, i = n_spans + 1, covered + best, i + best
        else:
            i += 1
    return n_spans, covered


def test_greedy_cover(spark):
    rng = random.Random(5)
    docs = [[rng.choice("ab") for _ in range(60)] for _ in range(6)] + [["x"] * 20]
    refs = [[rng.choice("ab") for _ in range(60)] for _ in range(3)]
    grams = lambda texts: spark.createDataFrame([(i, p, " ".join(t[p : p + 8])) for i, t in enumerate(texts) for p in range(len(t) - 7)], "doc_id long, pos int, gram string")
    got = {r.doc_id: (r.n_spans, r.covered_words) for r in custom.greedy_cover(custom.longest_matches(grams(docs), grams(refs))).collect()}
    want = {i: brute_cover(t, refs) for i, t in enumerate(docs)}
    assert got == {i: w for i, w in want.items() if w[0]}


def test_components(spark):
    edges = [(i, i + 1) for i in range(20, 60)] + [(5, 3), (3, 9), (100, 100), (7, 8)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 20 for i in range(20, 61)}, 3: 3, 5: 3, 9: 3, 7: 7, 8: 7}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_tree_and_dimension():
    assert custom.tree_length(np.array([[0.0], [1.0], [3.0]])) == 3.0
    flat = np.random.default_rng(3).random((600, 2))
    assert 1.6 < custom.dimension(flat) < 2.5
    assert custom.dimension(flat[:5]) is None and custom.dimension(np.zeros((20, 2))) is None


def brute_tree(points):
    inside, total = {0}, 0.0
    while len(inside) < len(points):
        d, j = min((math.dist(points[i], points[j]), j) for i in inside for j in range(len(points)) if j not in inside)
        inside.add(j)
        total += d
    return total


def test_dimension_takes_the_whole_cloud(spark, tmp_path):
    rng = np.random.default_rng(7)
    for cloud in (rng.random((40, 3)), rng.integers(0, 3, (40, 2)).astype(float)):
        assert math.isclose(custom.tree_length(cloud), brute_tree(cloud.tolist()))
    assert custom.tree_length(np.full((30, 4), 0.1)) == 0.0
    rows = [(i, int(i >= 1300), rng.random(3).tolist()) for i in range(1310)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.label: (r.n, r.phd) for r in custom.persistent_dimension(spark, str(tmp_path)).collect()}
    order = sorted(range(1300), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    assert got[0] == (1300, round(custom.dimension(np.array([rows[i][2] for i in order])), 6)) and got[1][0] == 10


def test_spectrum():
    t = np.arange(64)
    centroid, low, flat, peak = custom.spectrum(np.sin(2 * np.pi * t / 4))
    assert peak == 0.25 and abs(centroid - 0.25) < 1e-6 and low < 1e-6 and flat < 1e-3
    assert custom.spectrum(np.ones(10)) == (None,) * 4 and custom.spectrum(np.ones(2)) == (None,) * 4


def test_queries_run(spark):
    for name, f in custom.QUERIES.items():
        assert f(spark, SF).count() > 0, name
    pairs = spark.createDataFrame([(1, 2, ["a", "b"], ["a", "b"]), (1, 3, ["a"], ["b"])], "a long, b long, symbols_a array<string>, symbols_b array<string>")
    assert [r.overlap for r in custom.sequence_overlap(pairs).orderBy(F.col("b")).collect()] == [1.0, 0.0]


def test_packed_size_is_that_of_the_full_dictionary():
    rng = random.Random(1)
    for n in (0, 1, 500, 70_000, 200_000):
        data = bytes(rng.choice(b"abcdefgh ") for _ in range(n)) * 2
        full = lzma.compress(data, format=lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "preset": 9 | lzma.PRESET_EXTREME}])
        assert custom.packed_size(data) == len(full)
