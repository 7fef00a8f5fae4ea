"""The pipeline over documents: quality, line dedup, n-gram Jaccard join, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns the columns of documents, but for
the last, which returns packed pieces. run() writes each stage's rows to the shared folder and goes on from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm import decontaminate, jaccard, lines, packing, quality
from inkstone.llm.common import cut_table, table


def _measured(docs: DataFrame, names: list[str]) -> DataFrame:
    """docs in their old columns; n_chars follows the text where there is such a column."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*names) if "n_chars" in names else docs.select(*names)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; a document that loses all it says is left out."""
    kept = lines.keep(docs).where((F.col(lines.removed_name(docs)) == 0) | (F.trim("text") != "") | F.col("text").isNull())
    return _measured(kept, docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return jaccard.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated; lesser hits are cut out of the rest."""
    return _measured(decontaminate.remove(docs, table(spark, sf_dir, "benchmark")), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of at most 1024 ids."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: SQL can express neither the classifier nor the packing; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
