"""Operator 7 against brute force."""

import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from inkstone.llm import queries, suffixes
from inkstone.llm.grouping import suffix_array
from tests.llm.helpers import clashing, frame, invented

SF = "/root/testdata/sf0.01"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_linear_grouping_gives_the_suffix_array(text):
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_linear_grouping_of_periodic_texts():
    for text in ([1] * 300, [0, 1] * 150, [2, 1, 0] * 70, [*range(50), *range(50)]):
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def brute(rows, span=50):
    """rows: (doc_id, text); the result by (doc_id, text)."""
    least = {}
    for d, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - span + 1):
            s = raw[i : i + span]
            if d is not None and d < least.get(s, d + 1):
                least[s] = d
    out = {}
    for d, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - span + 1):
            if d is not None and least[raw[i : i + span]] < d:
                gone[i : i + span] = b"\1" * span
        spans = sum(1 for i in range(len(raw)) if gone[i] and (i == 0 or not gone[i - 1]))
        left = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[d, t or ""] = (len(raw), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return out


def assert_same(df, rows):
    want = brute(rows)
    got = df.collect()
    assert len(got) == len(rows)
    texts = {}
    for d, t in rows:
        texts.setdefault(d, set()).add(t or "")
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) in [want[r.doc_id, t] for t in texts[r.doc_id]]


def test_fixture(spark):
    r = random.Random(5)
    texts = invented()
    base = "".join(r.choice("abcdefgh ") for _ in range(400))
    texts += ["a" * 400, "b" + "a" * 120, "ab" * 200, base, base[:180] + "X" + base[180:], base[100:160] + "é" + base[:90], base[:49], base[:50], base[10:61], base + base]
    order = list(range(len(texts)))
    r.shuffle(order)
    df = clashing(frame(spark, texts, ids=order))
    assert_same(suffixes.report(df), list(zip(order, texts, strict=True)))


def test_ties_nulls_and_empty(spark):
    t = "the same passage of more than fifty bytes stands in every row of this table"
    ids = [None, 3, 3, 3, 5, 5, None]
    texts = [t, t, t, "x" + t, t, t + t, t]
    assert_same(suffixes.report(frame(spark, texts, ids=ids)), list(zip(ids, texts, strict=True)))
    assert suffixes.report(frame(spark, [])).count() == 0


def test_small_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert_same(queries.op7_lyndon_grouping_dedup(spark, "/root/testdata/sf0.001"), rows)
