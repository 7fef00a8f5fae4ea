"""Operators 1 and 5 against brute force."""

import random

import duckdb
import pytest

from inkstone.llm import jaccard, lines, queries
from inkstone.llm.components import components
from tests.llm.helpers import clashing, frame, invented
from tests.llm.test_scans import words_of

SF = "/root/testdata/sf0.01"


def shingles(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_join(rows):
    """(class_id, n_links) of each row of (doc_id, text)."""
    sets = [shingles(t) for _, t in rows]
    n = len(rows)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * n
    for i in range(n):
        for j in range(i):
            a, b = sets[i], sets[j]
            shared = len(a & b)
            if (rows[i][1] or "") == (rows[j][1] or "") or a and b and 5 * shared >= 4 * (len(a) + len(b) - shared):
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted(((str(rows[i][0]), least.get(find(i)), links[i]) for i in range(n)), key=str)


def near_texts(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    base = [word() for _ in range(60)]
    texts = invented()
    for k in range(30):
        own = list(base)
        for _ in range(k % 5):
            own[r.randrange(len(own))] = word()
        texts.append(" ".join(own[k % 3 :]))
    return [*texts, *texts[-5:], "a b", "A, b", "a b c", "a b c d e", "a b c d e"]


def test_banding():
    bands, rows = jaccard.bands_and_rows()
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.999


@pytest.mark.parametrize("block", [384, 7])
def test_join(spark, block):
    texts = near_texts()
    rows = list(enumerate(texts))
    out = jaccard.join(clashing(frame(spark, texts)), block=block).collect()
    assert sorted(((str(r.doc_id), r.class_id, r.n_links) for r in out), key=str) == brute_join(rows)


def test_join_nulls_repeats_empty(spark):
    texts = ["a b c d e f g", "a b c d e f g", None, "", "a b c d e f g h", "x"]
    ids = [None, 7, 8, 8, 7, None]
    out = jaccard.join(frame(spark, texts, ids=ids)).collect()
    assert sorted(((str(r.doc_id), r.class_id, r.n_links) for r in out), key=str) == brute_join(list(zip(ids, texts, strict=True)))
    assert jaccard.join(frame(spark, [])).count() == 0


def test_join_on_small_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = queries.op1_ngram_jaccard_join(spark, SF).collect()
    assert sorted(((str(r.doc_id), r.class_id, r.n_links) for r in out), key=str) == brute_join(rows)


def test_keep_one(spark):
    docs = clashing(frame(spark, near_texts()))
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert {c for c, in set(map(tuple, kept.select("_keep").collect()))} == {"x"}
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == {c for _, c, _ in brute_join(list(enumerate(near_texts())))}


def test_keep_one_by_text(spark):
    r = random.Random(8)
    clean = [" ".join(str(r.random()) for _ in range(20)) for _ in range(8)]
    texts = [clean[0], clean[0], clean[1], *clean[2:6], clean[5], None, "", clean[6], clean[7], clean[7]]
    ids = [3, 5, 5, None, None, None, None, None, None, None, 9, 9, 9]
    kept = jaccard.keep_one(clashing(frame(spark, texts, ids=ids))).collect()
    want = [(3, clean[0]), (5, clean[1]), *((None, t) for t in clean[2:6]), (None, ""), (9, clean[6]), (9, clean[7])]
    assert sorted(((str(x.doc_id), x.text or "") for x in kept)) == sorted((str(d), t) for d, t in want)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    out = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(out[i] == 0 for i in range(41)) and out[100] == out[95] == out[90] == 90


def brute_lines(rows, least=lines.LEAST):
    """(doc_id, text): what is left, lines, removed, runs, longest run; every run of lines is compared with all earlier ones."""
    seen, out = {}, {}
    runs = lambda own: ((p, q) for p in range(len(own)) for q in range(p, len(own)) if sum(map(len, own[p : q + 1])) >= least)
    order = sorted(dict.fromkeys((d, t) for d, t in rows if d is not None and t is not None))
    for d, t in order:
        own = t.split("\n")
        for p, q in runs(own):
            seen.setdefault(tuple(own[p : q + 1]), (d, t, p))
    for d, t in rows:
        own = [] if t is None else t.split("\n")
        gone = set()
        if d is not None:
            for p, q in runs(own):
                if seen[tuple(own[p : q + 1])] != (d, t, p):
                    gone.update(range(p, q + 1))
        sizes, n = [], 0
        for p in range(len(own)):
            n = n + 1 if p in gone else 0
            sizes.append(n)
        left = None if t is None else "\n".join(x for p, x in enumerate(own) if p not in gone)
        out[d, t] = (left, len(own), len(gone), sum(p - 1 not in gone for p in gone), max(sizes, default=0))
    return out


def line_texts(seed=4):
    r = random.Random(seed)
    pool = ["alpha", "beta", "gamma", "", "delta", "the common line", "x"]
    texts = ["\n".join(r.choice(pool) if r.random() < 0.5 else str(r.random()) for _ in range(r.randint(1, 30))) for _ in range(40)]
    long = "\n".join(str(r.random()) for _ in range(100))
    return [*texts, long, long + "\nend", "start\n" + long, "a\na\na\na\na", "", None, "one", "one", texts[3], "\n\n"]


@pytest.mark.parametrize("least", [1, 12, 30, 60])
def test_lines(spark, least):
    texts = line_texts()
    want = brute_lines(list(enumerate(texts)), least)
    for r in lines.report(clashing(frame(spark, texts)), least).collect():
        assert (r.text, r.n_lines, r.n_removed, r.n_runs, r.longest_run) == want[r.doc_id, texts[r.doc_id]]


def test_lines_lone_paragraph_and_short_lines(spark):
    paragraph = "a passage that is one long line between different neighbours, and repeats"
    texts = ["x\n" + paragraph + "\ny", "p\n" + paragraph + "\nq", paragraph, "short line\nother line", "short line\nother line", "short line\n" * 9, "a\n" + "short line\n" * 9 + "b"]
    out = {r.doc_id: (r.text, r.n_removed) for r in lines.report(frame(spark, texts)).collect()}
    assert out[1] == ("p\nq", 1) and out[2] == ("", 1) and out[3][1] == out[4][1] == 0 and out[0][1] == 0
    assert out[6] == ("a\nb", 9)


def test_lines_runs_have_their_source(spark):
    long = "\n".join(f"line number {i}" for i in range(40))
    runs = lines.deleted_runs(frame(spark, [long, "x\n" + long + "\ny", long[:200]], ids=[7, 8, 9])).collect()
    assert {(r.did, r.a, r.z, r.source) for r in runs} == {(8, 1, 40, 7), (9, 0, long[:200].count("\n") - 1, 7)}


def test_lines_nulls_repeats_names_empty(spark):
    long = "\n".join(str(i) * 3 for i in range(100))
    docs = clashing(frame(spark, [long, long + "\nx"]))
    kept = lines.keep(docs)
    assert kept.columns == [*docs.columns, "_lines", "_removed_", "_runs", "_longest", "_source"]
    out = {r.doc_id: r for r in kept.collect()}
    assert (out[1]._longest, out[1]._removed_, out[1].text, out[0]._removed_, out[1]._source) == (100, 100, "x", 0, "0")
    rows = lines.report(frame(spark, ["a" * 40 + "\n" + "b" * 40] * 4 + [None], ids=[None, 2, 2, 3, 4])).collect()
    assert sorted((str(r.doc_id), len(r.text or "")) for r in rows) == [("2", 81), ("2", 81), ("3", 0), ("4", 0), ("None", 81)]
    assert lines.report(frame(spark, [])).count() == 0


def test_lines_of_a_very_long_text(spark):
    r = random.Random(6)
    own = [str(r.random()) for _ in range(60_000)]
    texts = ["\n".join(own), "\n".join(own[20_000:50_000]), "\n".join(["new"] + own[:30_000] + [""] * 3000)]
    out = {x.doc_id: x for x in lines.report(frame(spark, texts)).collect()}
    assert (out[0].n_removed, out[1].n_removed, out[2].n_removed, out[2].n_runs) == (0, 30_000, 30_000, 1)


def test_lines_equal_the_oracle(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.sql(lines.ORACLE).fetchall())
    got = sorted(tuple(r) for r in queries.op5_line_dedup(spark, SF).collect())
    assert got == want and sum(r[3] for r in got) > 0
