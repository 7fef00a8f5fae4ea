"""Manifest scan and validation, readers and writers, on cases made by hand."""

import json

import pytest
from pyspark.sql import functions as F

from inkstone.sources import manifest, sinks, tables


def entry(**more):
    return {"id": "a", "path": "a.txt", "ai_status": "pre_ai_human", "used": ["baseline"], "era": "pre_chatgpt", "split": "baseline"} | more


CASES = [
    ({}, []),
    ({"ai_status": None}, [("error", "ai_status", "missing")]),
    ({"used": None}, [("error", "use", "missing")]),
    ({"ai_status": "robot"}, [("warning", "ai_status", "unknown_value")]),
    ({"register": "social_media_facebook"}, [("error", "register", "retired")]),
    ({"register": "sonnet"}, [("warning", "register", "unknown_value")]),
    ({"source_family": "myspace"}, [("error", "source_family", "unknown_value")]),
    ({"used": ["validation"]}, [("error", "use", "validation_in_baseline_split")]),
    ({"split": "test"}, [("warning", "use", "baseline_outside_its_split")]),
    ({"register": "message.imessage"}, [("error", "use", "profile_only_register")]),
    ({"used": ["idiolect"]}, [("warning", "privacy", "voice_not_private")]),
    ({"used": ["idiolect"], "privacy": "private"}, []),
    ({"editing_status": "coauthored"}, [("warning", "ai_status", "coauthored_human")]),
    ({"ai_status": "mixed"}, [("warning", "ai_status", "mixed_without_states")]),
    ({"ai_status": "mixed", "composite_states": 2}, []),
    ({"language_status": "learner"}, [("warning", "language_status", "learner_baseline")]),
    ({"word_count": -1.0}, [("error", "word_count", "negative")]),
    ({"used": ["baseline", "fun"]}, [("warning", "use", "unknown_value")]),
    ({"era": None}, [("warning", "era", "baseline_without_era")]),
    ({"era": "post_ai_widespread"}, [("warning", "ai_status", "late_human")]),
    ({"corpus_role": "impostor", "n_impostor_for": 1, "register_match": "high", "topic_match": "low", "consent_status": "undocumented", "acquired_via": " "}, [("error", "acquired_via", "impostor_without"), ("warning", "consent_status", "undocumented_impostor")]),
]


def test_rules(spark):
    rows = [entry(id=str(i), path=f"{i}.txt", **more) for i, (more, _) in enumerate(CASES)]
    kinds = ", ".join(f"{c} {t}" for c, t in manifest.COLUMNS.items())
    found = {}
    for r in manifest.issues(spark.createDataFrame([tuple(r.get(c) for c in manifest.COLUMNS) for r in rows], kinds)).collect():
        found.setdefault(r.id, []).append((r.severity, r.field, r.issue))
    for i, (more, want) in enumerate(CASES):
        assert sorted(found.get(str(i), [])) == sorted(want), more


def test_repeats(spark):
    rows = spark.createDataFrame([("a", "x", "unknown", ["exclude"]), ("a", "y", "unknown", ["exclude"]), ("b", "y", "unknown", ["exclude"]), (None, "z", "unknown", ["exclude"])], "id string, path string, ai_status string, used array<string>")
    got = {(r.severity, r.id, r.field, r.issue) for r in manifest.issues(rows).collect()}
    assert got == {("error", "a", "id", "repeated"), ("warning", "a", "path", "shared"), ("error", None, "id", "missing")}
    assert manifest.issues(rows.limit(0)).count() == 0


def test_strict_rows(spark, tmp_path):
    lines = ["# a comment", '{"id": "é", "n": 1}', "", '{"id": 1, "id": 2}', '{"x": NaN}', "[1]", "{broken", '﻿{"id": 3}', '{"z": {"k": 1, "k": 1}}', '{"ok": [1e5]}']
    (tmp_path / "m.jsonl").write_bytes("\n".join(lines).encode() + b'\n{"bad": "\xff"}\n')
    got = {r.line: (r.entry, r.problem) for r in manifest.strict_rows(spark, str(tmp_path)).collect()}
    assert set(got) == {2, 4, 5, 6, 7, 8, 9, 10, 11}
    assert got[2] == ('{"id": "é", "n": 1}', None) and json.loads(got[10][0]) == {"ok": [1e5]}
    assert [got[k][1] for k in (4, 5, 6, 8, 9, 11)] == ["repeated key", "NaN is no number", "no object", "byte-order mark", "repeated key", "no UTF-8"] and got[7][1]


def test_line_numbers_over_splits(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text("".join(json.dumps({"n": i}) + "\n" for i in range(1, 3001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = manifest.strict_rows(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 3000 and all(json.loads(r.entry)["n"] == r.line for r in rows)


def test_filters_and_conflicts(spark):
    rows = spark.createDataFrame([("a", ["x", "y"], 1), ("b", ["y"], 2)], "id string, use array<string>, n int")
    assert [r.id for r in manifest.filtered(rows, "use=x, n=1").collect()] == ["a"] and manifest.filtered(rows, "").count() == 2
    for bad in ("use", "=x", "use=", "color=red"):
        with pytest.raises(ValueError):
            manifest.filtered(rows, bad)
    files = spark.createDataFrame([(p,) for p in ("a/b.txt", "a/b (1).txt", "a/b (Ann's conflicted copy 2020-01-01).md", "a/b.sync-conflict-20200101-101010-ABC.txt", "a (1)/b.txt")], "path string")
    assert {r.path for r in manifest.conflict_copies(files).collect()} == {"a/b (1).txt", "a/b (Ann's conflicted copy 2020-01-01).md", "a/b.sync-conflict-20200101-101010-ABC.txt"}


def test_readers(spark, tmp_path):
    (tmp_path / "t").mkdir()
    for name in ("a.txt", "b.md", "README.md", ".hidden.txt", "c.csv"):
        (tmp_path / "t" / name).write_text(f"text of {name}\nline two")
    got = {r.path.split("/")[-1]: r.text for r in tables.text_folder(spark, str(tmp_path / "t")).collect()}
    assert got == {"a.txt": "text of a.txt\nline two", "b.md": "text of b.md\nline two"}
    (tmp_path / "d.csv").write_text("doc_a,doc_b,metric,value\nx,y,delta,0.5\n")
    assert [tuple(r) for r in tables.long_distances(spark, str(tmp_path / "d.csv")).collect()] == [("x", "y", "delta", 0.5)]
    (tmp_path / "w.csv").write_text("doc_id,the,of.it\nx,1,0.25\ny,2,\n")
    assert sorted((r.doc_id, r.feature, r.value) for r in tables.wide_frequencies(spark, str(tmp_path / "w.csv")).where("value is not null").collect()) == [("x", "of.it", 0.25), ("x", "the", 1.0), ("y", "the", 2.0)]
    (tmp_path / "f.xml").write_text("<feed><entry><id>1</id><title>One</title></entry><entry><id>2</id><title>Two</title></entry></feed>")
    assert sorted(r.title for r in tables.bundled_feed(spark, str(tmp_path / "f.xml")).collect()) == ["One", "Two"]
    (tmp_path / "m.jsonl").write_text('# c\n{"id": "a"}\n\n{"id": 5x}\n')
    rows = tables.manifest(spark, str(tmp_path / "m.jsonl"), spark.createDataFrame([], "id string").schema).collect()
    assert sorted((r.id or "", r._bad is not None) for r in rows) == [("", True), ("a", False)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("h1", 1.0), ("h1", 1.0), ("h2", 2.0)], "content_hash string, v double")
    assert sinks.append_new(rows, str(tmp_path / "p")).count() == 2
    more = rows.unionByName(spark.createDataFrame([("h3", 3.0)], rows.schema))
    sinks.append_new(more, str(tmp_path / "p"))
    assert sorted(r.content_hash for r in spark.read.parquet(str(tmp_path / "p")).collect()) == ["h1", "h2", "h3"]
    sinks.csv_cells(rows, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 3
    with pytest.raises(Exception):
        sinks.csv_cells(rows, str(tmp_path / "c"))
    out = [json.loads(r.value) for r in sinks.envelope(rows, "s").collect()]
    assert out[0]["schema_version"] == "1.0" and out[0]["task_surface"] == "s" and json.loads(out[0]["results"])["v"] == 1.0
    with pytest.raises(Exception, match="non-finite"):
        sinks.envelope(rows.withColumn("v", F.lit(float("nan"))), "s").collect()


def test_publication_ledgers_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    sinks.publish(rows, str(tmp_path / "out"))
    with pytest.raises(FileExistsError):
        sinks.publish(rows, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2 and [p.name for p in tmp_path.iterdir()] == ["out"]
    ledger, more = str(tmp_path / "ledger"), spark.createDataFrame([("b", 3), ("c", 4)], rows.schema)
    sinks.append_ledger(rows, ledger, "k")
    with pytest.raises(ValueError):
        sinks.append_ledger(more, ledger, "k")
    assert sorted(map(tuple, sinks.append_ledger(more, ledger, "k", replace=True).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    text = sinks.markdown_report(spark.createDataFrame([("x|y", None), ("z", 1.5)], "a string, b double").orderBy("a"), "T", 1)
    assert text.split("\n")[:5] == ["# T", "", "| a | b |", "|---|---|", "| x\\|y |  |"] and "first 1 of 2" in text


def test_pool(spark):
    entries = spark.createDataFrame([(1, "inline", None), (2, None, "texts/a.txt"), (3, None, "./b.txt"), (4, None, "gone.txt")], "id int, text string, text_path string")
    files = spark.createDataFrame([("file:/x/texts/a.txt", "A"), ("file:/x/other/a.txt", "no"), ("file:/x/b.txt", "B")], "path string, text string")
    assert {r.id: r.text for r in tables.pool(entries, files).collect()} == {1: "inline", 2: "A", 3: "B", 4: None}
