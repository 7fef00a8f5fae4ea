"""Queries at size: what a task holds and what travels is bounded, with the results of plain loops."""

import hashlib
import math
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from inkstone.functions import counts, tiles
from inkstone.operators import custom, dedup
from inkstone.plans import catalogue
from inkstone.queries import QUERIES


@pytest.fixture
def corpus(spark, tmp_path):
    def write(rows):
        spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
        return str(tmp_path)

    return write


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_trigrams_are_counted_in_tasks(spark, corpus):
    sf = corpus([(0, "Abcabc abcd", "en", "s"), (1, "ab", "en", "s"), (2, None, "en", "s"), (3, "éabc", None, "s")])
    for name in ("char_trigrams_top", "char_ngram_delta_by_lang"):
        assert "Generate" not in plan(QUERIES[name](spark, sf))  # no row a character, taken from the text's start each time
    t = "abcabc abcd"
    want = Counter((("en", t[i : i + 3]) for i in range(len(t) - 2))) + Counter({(None, "éab"): 1, (None, "abc"): 1})
    assert {(r.lang, r.gram): r.n for r in QUERIES["char_trigrams_top"](spark, sf).collect()} == want
    docs = spark.read.parquet(sf + "/documents.parquet")
    few = counts.counted(docs.selectExpr("lang", "lower(text)"), counts.runs(3), "gram", held=2)
    assert {(r.lang, r.gram): r.c for r in few.collect()} == want


def test_pairs_of_vectors_by_tiles(spark, tmp_path):
    rng = np.random.default_rng(3)
    vectors = [(i, i % 2, rng.normal(size=3 + i % 2).round(2).tolist()) for i in range(40)]
    vectors += [(40 + i, 2, [1.0, 2.0]) for i in range(9)] + [(60, 3, [1.0]), (61, 3, []), (62, None, [1.0]), (63, 3, None)]
    spark.createDataFrame(vectors, "vec_id long, label int, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    packed = tiles.blocks(spark, str(tmp_path), 4)
    assert packed.where("label = 0").count() > 2
    units = {i: (label, [x / math.hypot(*v) for x in v]) for i, label, v in vectors if v and label is not None}
    dot = lambda i, j: sum(x * y for x, y in zip(units[i][1], units[j][1], strict=False))
    pairs = {(i, j): dot(i, j) for i in units for j in units if i < j and units[i][0] == units[j][0]}
    got = {(r.i, r.j): r.cosine for r in tiles.every_pair(packed).collect()}
    assert got.keys() == pairs.keys() and all(math.isclose(got[k], pairs[k], abs_tol=1e-12) for k in pairs)
    found = {}
    for r in tiles.nearest(packed, 3).collect():
        found.setdefault(r.i, []).append((-r.g, r.j))
    for i, best in found.items():
        want = sorted((-round(pairs[min(i, j), max(i, j)], 7), j) for j in units if j != i and units[j][0] == units[i][0])[:3]
        assert [j for _, j in sorted(best)[:3]] == [j for _, j in want]
    assert found.keys() == units.keys() - {60}
    spread = {r.label: r for r in tiles.homogeneity(packed).collect()}
    for label in (0, 1, 2):
        values = [g for (i, _), g in pairs.items() if units[i][0] == label]
        r, n = spread[label], sum(u[0] == label for u in units.values())
        want = (n, np.mean(values), np.std(values, ddof=1), min(values), np.median(values), n * n / (n + 2 * sum(g * g for g in values)))
        assert all(math.isclose(a, b, abs_tol=1e-7) for a, b in zip((r.n, r.mean, r.sd, r.least, r.p50, r.modes), want, strict=True))
    assert (spread[3].n, spread[3].mean, spread[3].p50, spread[3].modes) == (1, None, None, 1.0)
    for name in ("cosine_pairs", "embedding_neighbours", "embedding_homogeneity"):
        assert "posexplode" not in plan(QUERIES[name](spark, str(tmp_path)))  # no row a value, which is joined for each pair


def test_deletions_in_one_pass(spark, corpus):
    text = " ".join(f"w{chr(97 + i % 26)} w{chr(97 + i % 7)}{chr(97 + i % 5)}" for i in range(70))
    sf = corpus([(12, text, "en", "s"), (-3, "a b a b a b a b a b", "en", "s"), (4, "too short", "en", "s"), (5, None, "en", "s")])
    df = QUERIES["token_cohesiveness"](spark, sf)
    assert "Exchange" not in plan(df)  # no row a word and draw
    got = {r.doc_id: (r.draws, r.cohesiveness) for r in df.collect()}
    for doc_id, said in ((12, text), (-3, "a b a b a b a b a b")):
        words, shares = said.split(), []
        for draw in range(30):
            order = sorted(range(len(words)), key=lambda p: (hashlib.md5(f"{draw}:{doc_id}:{p}".encode()).hexdigest()[:8], p))
            shares.append(len({words[p] for p in order[len(words) // 10 :]}) / len(set(words)))
        assert got.pop(doc_id) == (30, round(1 - sum(shares) / 30, 6))
    assert not got


def test_kickers_take_time_of_the_line(spark, corpus):
    long = "word " * 60_000  # no mark: each start in it was tried to its end
    sf = corpus([(0, f"{long}\nOne. Two three.\nNo end\nAt 5.\nThe End.\n. . !\n\t.", "en", "s")])
    start = time.time()
    r = QUERIES["kicker_density"](spark, sf).collect()[0]
    assert (r.paragraphs, r.kickers) == (7, 1) and time.time() - start < 30


@pytest.mark.parametrize("name", ["delta_pairs", "controls_triangulation", "chapter_distinctiveness", "feature_clusters", "writer_profile", "overall_delta", "top_deviations", "imposters", "collocations_lr", "collocations_pmi"])
def test_words_do_not_travel(spark, name):
    """No row a token, which is shuffled or sorted, and no document measured again for each place that reads a count."""
    text = plan(QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "posexplode" not in text and not ("documents.parquet" in text and "Window" in text)


def test_counters_are_sent_on(spark, corpus):
    sf = corpus([(i, f"a b a b c{i % 3}", "en" if i % 2 else None, "s") for i in range(20)])
    docs = spark.read.parquet(sf + "/documents.parquet")
    want = Counter()
    for i in range(20):
        w = f"a b a b c{i % 3}".replace("0", "").replace("1", "").replace("2", "").split()
        want.update((("en" if i % 2 else None), *p) for p in zip(w, w[1:], strict=False))
    for held in (1, 1000):
        got = counts.counted(docs.select("lang", "text"), counts.pairs, "word", "nxt", held=held)
        assert {(r.lang, r.word, r.nxt): r.c for r in got.collect()} == want
    sizes = [b.num_rows for b in counts.counter(counts.runs(5), ["gram", "c"], 0, 50)(iter([pa.RecordBatch.from_pydict({"text": [f"{i:09d}" for i in range(100)]})]))]
    assert sum(sizes) > 50 and max(sizes) <= 55  # a task holds no more than that and one text's


def test_median_from_bins(spark, corpus, tmp_path):
    texts = [" ".join(f"w{chr(97 + (i * j) % 17)}" for j in range(5 + i)) + "." for i in range(31)]
    sf = corpus([(i, t, "en", "s") for i, t in enumerate(texts)])
    spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(sf + "/labels.parquet")
    scores = {}
    for r in catalogue.run(spark, sf, "SELECT signal, score FROM {scored}").collect():
        scores.setdefault(r.signal, []).append(r.score)
    got = {r.signal: r.cutoff for r in catalogue.run(spark, sf, "SELECT signal, cutoff FROM {score_medians}").collect()}
    assert got.keys() == scores.keys() and all(math.isclose(got[s], np.median(v), rel_tol=1e-12, abs_tol=1e-15) for s, v in scores.items())
    text = plan(QUERIES["bootstrap_fixed_threshold"](spark, sf))
    assert "percentile(score" not in text and "SortMergeJoin" not in text[text.index("draw") :]  # no map of a signal's values in a task, no draws dealt by signal


def test_phrases_travel_as_hashes(spark, corpus):
    sf = corpus([(i, "one two three four five six", "en", "s") for i in range(4)] + [(4, "zero one two three four five", "en", "s"), (5, None, "en", "s")])
    df = QUERIES["phrase_survival"](spark, sf)
    assert "array_join" not in plan(df)
    assert {r.doc_id: r.phrases for r in df.collect()} == dict.fromkeys(range(5), 1)


def test_prefixes_meet_in_any_order_of_buckets(spark, corpus):
    rng = np.random.default_rng(5)
    for n in (1, 4, 5, 9, 10, 37):
        sizes = rng.integers(0, 9, dedup.BUCKETS).astype(np.uint32)
        for _ in range(40):
            a = rng.choice(2**40, n, replace=False) - 2**39
            b = np.concatenate([a[: n - n // 10], rng.choice(2**40, n // 10, replace=False) + 2**41])  # likeness 0.8 or more
            assert set(dedup.prefix_of(a, sizes)) & set(dedup.prefix_of(b[rng.permutation(n)], sizes))
    few = dedup.prefix_of(np.arange(10), np.where(np.arange(dedup.BUCKETS) < 5, 7, 0).astype(np.uint32))
    assert few.tolist() == [5, 6, 7]  # common ones come last
    sf = corpus([(i, " ".join(f"w{(i // 2) * 40 + j + (j > 30) * (i % 2)}" for j in range(40)), "en", "s") for i in range(6)])
    df = QUERIES["near_dup_pairs"](spark, sf)
    assert "Window" not in plan(df) and {(r.a, r.b) for r in df.collect()} <= {(0, 1), (2, 3), (4, 5)}


def test_spanning_trees_from_neighbours(monkeypatch):
    rng = np.random.default_rng(11)
    clouds = [rng.random((300, 12)), np.repeat(rng.random((30, 3)), 9, axis=0), np.concatenate([rng.normal(size=(90, 4)) * 0.01 + 5 * c for c in range(4)]), rng.integers(0, 4, (250, 3)).astype(float)]
    calls = []
    monkeypatch.setattr(custom, "tree_length", calls.append)
    for k, cloud in enumerate(clouds):
        monkeypatch.undo()
        squares = (cloud * cloud).sum(axis=1)
        for near in (3, 64):
            ids, far = custom.nearest_of(cloud, squares, near)
            for n in (20, 150, len(cloud)):
                chosen = rng.choice(len(cloud), n, replace=False)
                assert math.isclose(custom.spanning_length(cloud, squares, chosen, ids, far), custom.tree_length(cloud[chosen]), rel_tol=1e-9), (k, near, n)
        monkeypatch.setattr(custom, "tree_length", calls.append)
        assert custom.dimension(cloud) is not None and not calls  # no walk over all pairs for each of 26 trees
    assert custom.dimension(np.full((20, 2), np.nan)) is None


def test_moves_are_counted_where_texts_lie(spark, corpus):
    sf = corpus([(0, "However, it rained. It was for example wet. But first, we ran! Ébut nothing.", "en", "s"), (1, " . ", "en", "s"), (2, None, "en", "s")])
    df = QUERIES["move_sequence"](spark, sf)
    assert "Exchange" not in plan(df) and "RLIKE" not in plan(df)  # no regular expression that is tried at each place for each marker
    r = df.collect()[0]
    assert (r.doc_id, r.sentences, r.marked_sentences, round(r.entropy, 4)) == (0, 3, 3, 0.9183)  # contrast twice, exemplification; no sentence begins at a letter beyond A-Z
    d = QUERIES["discourse_moves"](spark, sf).collect()
    assert len(d) == 1 and (d[0].n_words, d[0].contrast, d[0].sequencing) == (14, round(2000 / 14, 4), round(1000 / 14, 4))
