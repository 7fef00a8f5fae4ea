"""The catalogue's queries against their oracle SQL on the smallest tables, and a few by hand."""

import duckdb
import pytest

from inkstone.operators import custom, prose
from inkstone.plans import catalogue
from inkstone.queries import ORACLES, QUERIES
from inkstone.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
SOME = ["yules_k", "mattr50", "fkgl_stats", "connective_density", "compression_verdict", "near_dup_pairs", "benchmark_contamination", "rank_turbulence", "keyness_g2", "roc_auc_by_signal", "embedding_homogeneity", "ordinal_entropy", "transcript_screen", "strip_html", "stratified_shards", "register_inventory", "near_dup_components", "bootstrap_mean_gap", "bootstrap_fixed_threshold", "token_cohesiveness", "stream_daily_counts", "stream_sliding_counts", "stream_user_sessions", "stream_first_events", "stream_new_texts", "conformal_p", "threshold_at_fpr", "midrank_percentile", "decision_bundles", "position_pairs", "green_list_z", "sampling_curvature", "dedup_manifest", "near_dup_degrees", "remediation_decisions", "topic_pairing", "code_switching", "confusion_counts", "overlapping_windows", "chapter_split", "dialogue_turns", "collocations_lr", "overall_delta", "imposters", "register_classifier", "move_sequence", "tpr_at_budgets", "signal_regressions", "draft_best_pairs", "label_arcs"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    want = con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in order)) for r in df.collect())
    assert got == sorted(repr(tuple(r[want.columns.index(c)] for c in order)) for r in want.fetchall())


def test_every_query_has_an_oracle():
    assert QUERIES.keys() - ORACLES.keys() == custom.QUERIES.keys() | prose.QUERIES.keys()


def test_by_hand(spark, tmp_path):
    rows = [(0, "the cat sat. The cat ran.", "en", "s", 25), (1, "a b a b a b", "en", "s", 11), (2, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    k = {r.doc_id: r for r in QUERIES["yules_k"](spark, str(tmp_path)).collect()}
    assert k[0].n_tokens == 6 and k[0].yules_k == round(1e4 * ((4 + 4 + 1 + 1) - 6) / 36, 6)
    assert {r.doc_id: r.mattr for r in QUERIES["mattr50"](spark, str(tmp_path)).collect()} == {0: round(4 / 6, 6), 1: round(2 / 6, 6)}
    assert {r.doc_id: r.bits for r in QUERIES["shannon_entropy"](spark, str(tmp_path)).collect()}[1] == 1.0
    assert {r.doc_id: r.n_sentences for r in QUERIES["sentence_count"](spark, str(tmp_path)).collect()} == {0: 2, 1: 1}


def test_rendering():
    assert catalogue.render("@COUNT(x;;a (b)@", catalogue._DUCK) == "CAST(len(regexp_extract_all(x, 'a (b')) AS BIGINT)"
    assert catalogue._counts("count_if(a = '(' AND (b))") == "count(*) FILTER (WHERE a = '(' AND (b))"
    assert catalogue._doubles("1.5 * x || '2.5'") == "1.5D * x || '2.5'"


def test_near_pairs_stand_for_copies(spark, tmp_path):
    words = [f"w{i}" for i in range(60)]
    a, b, c = " ".join(words), " ".join([*words[:-1], "changed"]), " ".join(reversed(words))
    texts = [b, a, a, c, "one two", "one two", None, a]
    spark.createDataFrame([(i, t, "en", "s", 0 if t is None else len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    get = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    assert [(r.a, r.b, r.shared, r.in_all) for r in get("near_dup_pairs")] == [(0, 1, 55, 57)]
    assert {r.doc: r.partners for r in get("near_dup_degrees")} == {0: 3, 1: 3, 2: 3, 7: 3, 4: 1, 5: 1}
    assert {r.doc_id: r.component for r in get("near_dup_components")} == {0: 0, 1: 0, 2: 0, 7: 0, 4: 4, 5: 4}
    assert {r.doc_id: r.keeper for r in get("dedup_keepers")} == {0: True, 1: False, 2: False, 7: False, 4: True, 5: False}  # text 0 is the longest
    assert {r.doc_id for r in get("dedup_manifest") if r.status == "kept"} == {0, 3, 4, 6}


def test_syllables_and_confusion_by_hand(spark, tmp_path):
    text = "Agree. The table is here. Rhythm."  # agree 1, the 1 (one group), table 1 (a, e: less the final e), is 1, here 1, rhythm 1
    spark.createDataFrame([(0, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    r = QUERIES["fkgl_stats"](spark, str(tmp_path)).collect()[0]
    grades = [0.39 * 1 + 11.8 - 15.59, 0.39 * 4 + 11.8 - 15.59, 0.39 * 1 + 11.8 - 15.59]
    assert (r.least, r.most, r.mean) == (round(min(grades), 5), round(max(grades), 5), round(sum(grades) / 3, 5))
