"""Incremental text deduplication over batches, and operators over judgements by hand."""

from datetime import datetime

import pytest

from inkstone.queries import QUERIES
from inkstone.streaming.events import new_texts

KIND = "doc_id long, text string"


def test_new_texts_over_batches(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))

    def drain():
        docs = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(source)
        return sorted(r.doc_id for r in new_texts(docs, out, progress).collect())

    spark.createDataFrame([(5, "a"), (3, "a"), (4, None), (6, "")], KIND).coalesce(1).write.parquet(source)
    assert drain() == [3, 4, 6]
    spark.createDataFrame([(1, "a"), (7, "b"), (2, None), (8, "b")], KIND).coalesce(1).write.mode("append").parquet(source)
    assert drain() == [3, 4, 6, 7]
    assert drain() == [3, 4, 6, 7]  # nothing new


@pytest.fixture(scope="module")
def judged(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("judged")
    rows = [(i, datetime(2024, 1, 1 + i), w, t, v) for i, (w, t, v) in enumerate([(0, "a", 10.0), (1, "a", 30.0), (2, "a", 50.0), (2, "b", 65.0), (1, "b", None)])]
    rows += [(10 + i, datetime(2024, 2, 1 + i), 4, "c" if i < 5 else f"d{i // 3}", 1.0) for i in range(16)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(str(folder / "events.parquet"))
    return str(folder)


def test_contributions_by_hand(spark, judged):
    # signal a: side 0 is (10 + 50) / 2 = 30 and side 1 is 30, so that no contribution is defined
    got = {(r.work, r.signal): (r.contribution, r.side) for r in QUERIES["decision_contributions"](spark, judged).collect()}
    assert got[0, "a"] == got[1, "a"] == (None, "none") and got[2, "b"] == (None, "none")
    assert {r.work: r.flag for r in QUERIES["decision_preflag"](spark, judged).collect()}[0] == "too_few"
    assert {r.axis: (r.present, r.partial, r.absent) for r in QUERIES["axis_coverage"](spark, judged).where("axis < 'c'").collect()} == {"a": (0, 2, 1), "b": (1, 0, 0)}


def test_pairs_are_kept_in_order_up_to_their_caps(spark, judged):
    got = {r.a: r.state for r in QUERIES["position_pairs"](spark, judged).where("work = 4").collect()}
    # question c has pairs from 10 to 13; d1 holds event 15 alone; d2, d3, d4 have two pairs each; d5 one event
    kept, per = [], {}
    questions = {10: "c", 11: "c", 12: "c", 13: "c", 16: "d2", 17: "d2", 19: "d3", 20: "d3", 22: "d4", 23: "d4"}
    want = {}
    for a, q in questions.items():
        if per.get(q, 0) >= 2:
            want[a] = "question_cap"
        elif len(kept) >= 5:
            want[a] = "work_cap"
            per[q] = per.get(q, 0) + 1
        else:
            kept.append(a)
            per[q], want[a] = per.get(q, 0) + 1, "kept"
    assert got == want


def test_certainty_by_hand(spark, tmp_path):
    text = "Rates could fall by 3 points. Rates fall. Perhaps all of it holds. Clearly this is so. Suppose that it is so. It could fall because of that. Méall is a name."
    spark.createDataFrame([(1, text, "en", "s", len(text)), (2, None, "en", "s", 0), (3, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.certainty, r.support, r.defence, r.alignment): r.n for r in QUERIES["certainty_crosstab"](spark, str(tmp_path)).collect()}
    assert got == {
        ("tentative", "substantiated", "none", "underclaim"): 1,
        ("assertive", "none", "defended_elsewhere", "aligned"): 1,
        ("measured", "none", "none", "aligned"): 1,
        ("assertive", "none", "none", "overclaim"): 2,
        ("assertive", "none", "defended_stipulated", "aligned"): 1,
        ("tentative", "gestured", "none", "aligned"): 1,
    }
