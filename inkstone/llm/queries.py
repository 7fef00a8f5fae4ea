"""The registered queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from inkstone.llm import decontaminate, editprints, jaccard, licenses, lines, packing, quality, secrets, sharding, suffixes
from inkstone.llm.common import table


def op1_ngram_jaccard_join(spark, sf_dir):
    return jaccard.join(table(spark, sf_dir, "documents"))


def op2_hash_tree_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op3_differencing_packing(spark, sf_dir):
    return packing.pieces(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark, sf_dir):
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_line_dedup(spark, sf_dir):
    return lines.report(table(spark, sf_dir, "documents"))


def op6_secret_ledger(spark, sf_dir):
    return secrets.findings(table(spark, sf_dir, "documents"))


def op7_lyndon_grouping_dedup(spark, sf_dir):
    return suffixes.report(table(spark, sf_dir, "documents"))


def op8_license_sentences(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_edit_embedding(spark, sf_dir):
    return editprints.report(table(spark, sf_dir, "documents"))


def op10_benchmark_decontamination(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_hash_tree_sharding, op3_differencing_packing, op4_quality_classifier, op5_line_dedup, op6_secret_ledger, op7_lyndon_grouping_dedup, op8_license_sentences, op9_edit_embedding, op10_benchmark_decontamination)}
ORACLES = {"op5_line_dedup": lines.ORACLE}
