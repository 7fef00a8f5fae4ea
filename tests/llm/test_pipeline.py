"""Each stage of the pipeline against brute force on what it gets, and run() against the stages."""

from collections import defaultdict

import numpy as np

import corpus_pipeline
from inkstone.llm import quality
from tests.llm.test_pairs import brute_join, brute_lines
from tests.llm.test_scans import brute_hits, library, words_of

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        kept[name] = (docs, stage(spark, docs, SF))
        out = str(tmp_path / str(k))
        kept[name][1].write.parquet(out)
        docs = spark.read.parquet(out)
        kept[name] = (kept[name][0], docs)
        if name != "packing":
            assert docs.columns == names
    pairs = lambda df: {r.doc_id: r.text for r in df.collect()}

    before, after = map(pairs, kept["quality_classifier"])
    scored = {r.doc_id: r.predicted for r in quality.score(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert after == {d: t for d, t in before.items() if scored[d]}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(d in after for d, q in labels.items() if q == 1) >= 0.95 * sum(labels.values())

    before, after = map(pairs, kept["line_dedup"])
    want = {d: v for (d, _), v in brute_lines(list(before.items())).items()}
    assert after == {d: v[0] for d, v in want.items() if not v[2] or v[0].strip(' ')}

    before, after = map(pairs, kept["ngram_jaccard_join"])
    assert set(after) == {c for _, c, _ in brute_join(list(before.items()))}

    before, after = map(pairs, kept["benchmark_decontamination"])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for d, t in before.items():
        words, hit, _ = brute_hits(t, items)
        if hit and 20 * len(hit) >= len(words):
            assert d not in after
        else:
            assert words_of(after[d]) == [w for i, w in enumerate(words) if i not in hit]

    before, pieces = pairs(kept["packing"][0]), kept["packing"][1].collect()
    got = defaultdict(dict)
    for r in pieces:
        got[r.doc_id][r.start] = np.frombuffer(r.ids, "<u4").tolist()
    assert got.keys() == before.keys()
    for d, ids in zip(before, library(before.values()), strict=True):
        assert [i for s in sorted(got[d]) for i in got[d][s]] == ids
    assert sorted((r.doc_id, r.start, r.length) for r in corpus_pipeline.run(spark, SF).collect()) == sorted((r.doc_id, r.start, r.length) for r in pieces)


def written(spark, folder, rows, more=()):
    """A folder with documents (and further columns), labels and benchmark."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in more:
        docs = docs.selectExpr("*", f"'x' AS {c}")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"bench{i}" for i in range(20))), (None, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


GOOD, BAD = "the quiet river ran on and on past the old mill number", "BUY NOW $$$ ### WIN"


def test_cases_of_all_stages(spark, tmp_path):
    """Null and repeated ids, unlike texts of one id, empty and null texts, repeated rows, clashing columns, a long text."""
    unlike = [f"{GOOD} {k} " + " ".join(f"{GOOD.split()[j % 11]}{k}x{j}" for j in range(30)) for k in range(6)]
    long = " ".join(f"word{i}" for i in range(40_000))
    rows = [(i, f"{GOOD} {i}" if i % 2 else f"{BAD} {i}", "en", "s", 1) for i in range(20)]
    rows += [(None, unlike[0], "en", "s", 1), (None, unlike[1], "en", "s", 1), (70, unlike[2], "en", "s", 1), (70, unlike[3], "en", "s", 1), (71, unlike[4], "en", "s", 1), (71, unlike[4], "en", "s", 1), (72, None, None, None, None), (73, "", "en", "s", 0), (74, long, "en", "s", 1)]
    sf = written(spark, tmp_path, rows, ("did", "th", "gone", "_keep", "_score", "_removed", "node", "row", "text_", "own", "_hits_of_parts", "label", "bands"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == names, name
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        texts = {r.text for r in docs.collect()}
        assert set(unlike[:5]) <= texts, name  # none of the unlike texts is lost, whatever its id
        assert long in texts
    assert {c for r in docs.select("_keep", "did", "_score").collect() for c in r} == {"x"}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_empty_tables(spark, tmp_path):
    sf = written(spark, tmp_path, [])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0, name
    assert corpus_pipeline.run(spark, sf).count() == 0
