"""Operator 9 against a plain walk."""

import hashlib
import random

import numpy as np
import pytest

from inkstone.llm import editprints, queries
from tests.llm.helpers import clashing, frame, invented

SF = "/root/testdata/sf0.001"


def plain_walk(text):
    """Every note of the walk, one character at a time."""
    c = editprints.character_classes(text).tolist()
    out, i, j = [], 0, 0
    while i < len(c):
        out.append(c[i] & 15)
        i += int(editprints._BITS[j % editprints.PERIOD][c[i]])
        j += 1
    return out


def plain_print(text):
    notes = plain_walk(text)
    out = []
    for k in range(editprints.OCTAVES):
        part = [f"{notes[s]:x}" if s < len(notes) else "-" for s in editprints.STEPS[k * 32 : k * 32 + 32].tolist()]
        out.append("".join(part))
    while out and set(out[-1]) == {"-"}:
        out.pop()
    return "".join(out)


def plain_likeness(x, y):
    """The weighted share of equal samples, sample by sample."""
    a, b = plain_walk(x), plain_walk(y)
    total = same = 0.0
    for k, step in enumerate(editprints.STEPS.tolist()):
        weight = 1.0 if k < 32 else float(2 ** (k // 32 - 1))
        own, other = (w[step] if step < len(w) else None for w in (a, b))
        if own is not None or other is not None:
            total += weight
            same += weight * (own == other)
    return same / total if total else 1.0


def check(out, rows):
    """rows: (doc_id, text) with different ids."""
    order = sorted(rows, key=lambda r: -r[0])
    after = {order[i][0]: order[(i + 1) % len(order)][1] or "" for i in range(len(order))}
    text = {d: t or "" for d, t in rows}
    assert len(out) == len(rows)
    for r in out:
        t, new = text[r.doc_id], editprints.edited(text[r.doc_id], after[r.doc_id])
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert r.fingerprint == plain_print(t) and r.edited_fingerprint == plain_print(new)
        assert r.near_edited == pytest.approx(plain_likeness(t, new)) and r.near_next == pytest.approx(plain_likeness(t, after[r.doc_id]))
        if t == new:
            assert r.near_edited == 1


def test_fixture(spark):
    texts = invented(n=120)
    check(editprints.report(clashing(frame(spark, texts))).collect(), list(enumerate(texts)))


def test_small_table_and_separation(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = queries.op9_edit_embedding(spark, SF).collect()
    check(out, rows)
    long = [r for r in out if r.n_chars > 300]
    assert np.mean([r.near_edited for r in long]) > 0.4 > 0.25 > np.mean([r.near_next for r in long])


def test_one_empty_nulls_repeats(spark):
    one = editprints.report(frame(spark, ["abc"])).collect()[0]
    assert one.near_next == 1 and one.edited_sha256 == hashlib.sha256(b"aba").hexdigest()
    assert editprints.report(frame(spark, [])).count() == 0
    out = editprints.report(frame(spark, ["x"] * 6 + [None], ids=[1, 1, 1, None, None, 4, 2])).collect()
    assert len(out) == 7 and len({r.fingerprint for r in out}) == 2


def test_edits_keep_texts_near():
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghijk") for _ in range(5)) for _ in range(200)]
    a = " ".join(r.choice(words) for _ in range(300))
    b = a[:400] + "xy" + a[400:900] + a[903:]
    other = " ".join(r.choice(words) for _ in range(300))
    na, nb, no = editprints.walk([editprints.character_classes(t) for t in (a, b, other)])
    near, far = editprints.likeness(na[None], nb[None])[0], editprints.likeness(na[None], no[None])[0]
    assert near > 0.75 > 0.3 > far


def edits(text, rate, r):
    """text with about rate * len(text) single-character edits."""
    out = list(text)
    for _ in range(max(1, int(rate * len(text)))):
        at, kind = r.randrange(len(out)), r.random()
        if kind < 0.4:
            out[at] = r.choice("abcdefghijk ")
        elif kind < 0.7:
            out.insert(at, r.choice("abcdefghijk "))
        elif len(out) > 2:
            del out[at]
    return "".join(out)


def test_classes_find_planted_edits(spark):
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghijk") for _ in range(r.randint(2, 8))) for _ in range(400)]
    base = [" ".join(r.choice(words) for _ in range(r.randint(30, 500))) for _ in range(150)]
    near = [edits(t, 0.003, r) for t in base]
    texts = base + near + [base[0], "", None]
    out = {x.doc_id: x.class_id for x in editprints.classes(clashing(frame(spark, texts))).collect()}
    wanted = [i for i in range(150) if plain_likeness(base[i], near[i]) >= 0.8]
    found = sum(out[i + 150] == out[i] for i in wanted)
    assert len(wanted) >= 100 and found >= 0.9 * len(wanted)
    assert out[300] == out[0] and out[301] == out[302] == 301
    apart = {out[i] for i in range(150)}
    assert len(apart) == 150  # unlike texts stay apart


@pytest.mark.parametrize("block", [384, 3])
def test_classes_verify_all_pairs_of_a_bucket(spark, block):
    head = "0" * 96  # all band keys are of this part; the last octave is half of the weight
    prints = [head + "f" * 32, head + "0" * 32, head + "0" * 31 + "1", head + "f" * 32] + [head + c * (31 - k) + "9" * (k + 1) for c in "ab" for k in range(6)] + ["", ""]
    rows = [(i, bytes.fromhex(p), len(p)) for i, p in enumerate(prints)]
    df = spark.createDataFrame(rows, "doc_id long, print binary, size int").withColumn("node", editprints._node())
    notes, root = editprints.unpacked([bytes.fromhex(p) for p in prints[:-2]], [len(p) for p in prints[:-2]]), list(range(len(prints)))
    for a in range(len(notes)):
        for b in range(a):
            if editprints.likeness(notes[a : a + 1], notes[b : b + 1])[0] >= 0.8:
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    root[-1] = root[-2]  # empty prints are equal
    told = {r.node: r.class_id for r in editprints.class_of(df, block=block).collect()}
    got = {r.doc_id: told.get(r.node, r.doc_id) for r in df.collect()}
    assert got == dict(enumerate(root)) and (got[0], got[1], got[2], got[3]) == (0, 1, 1, 0)


def test_one_id_over_several_tasks(spark):
    r = random.Random(2)
    texts = ["".join(r.choice("abc ") for _ in range(r.randint(0, 60))) for _ in range(200)]
    ids = [7] * 120 + [None] * 60 + list(range(20))
    out = editprints.report(frame(spark, texts, ids=ids)).collect()
    key = lambda d: -1 if d is None else d
    assert sorted(key(x.doc_id) for x in out) == sorted(map(key, ids))
    assert sorted(x.n_chars for x in out) == sorted(map(len, texts))


def test_a_very_long_text():
    r = random.Random(3)
    a = "".join(r.choice("abcdefgh ") for _ in range(400_000))
    b = a[:1000] + "x" + a[1000:399_000]
    na, nb = editprints.walk([editprints.character_classes(t) for t in (a, b)])
    assert editprints.likeness(na[None], nb[None])[0] > 0.9
