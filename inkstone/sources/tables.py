"""Readers for the corpus tables; Catalyst prunes columns and pushes filters into each scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def manifest(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSONL manifest: blank and comment lines are skipped; a line that does not fit the schema is kept in _bad."""
    lines = spark.read.text(path).where("trim(value) <> '' AND NOT startswith(trim(value), '#')")
    full = StructType([*schema.fields]).add("_bad", "string")
    return lines.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*")


def text_folder(spark: SparkSession, path: str) -> DataFrame:
    """One row per .txt or .md file, without README and hidden files: path, text."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(name.rlike(r"\.(txt|md)$") & ~F.lower(name).startswith("readme") & ~name.startswith("."))


def long_distances(spark: SparkSession, path: str) -> DataFrame:
    """Oracle distances: doc_a, doc_b, metric, value."""
    return spark.read.csv(path, header=True, schema="doc_a string, doc_b string, metric string, value double")


def wide_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """A wide frequency table (doc_id, then a column per feature) as doc_id, feature, value."""
    wide = spark.read.csv(path, header=True, inferSchema=True)
    rest = [c for c in wide.columns if c != "doc_id"]
    return wide.select("doc_id", *[F.col(f"`{c}`").cast("double").alias(c) for c in rest]).unpivot("doc_id", [F.col(f"`{c}`") for c in rest], "feature", "value")


def bundled_feed(spark: SparkSession, path: str, row_tag: str = "entry") -> DataFrame:
    """Entries of an Atom export."""
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


def pool(entries: DataFrame, files: DataFrame) -> DataFrame:
    """entries (with text, text_path or both) with the text of a file where they hold none; files: path, text. Paths match by their ends."""
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("path").alias("found"), F.col("text").alias("of_file"))
    wanted = entries.withColumn("name", F.element_at(F.split("text_path", "/"), -1))
    near = F.endswith(F.col("found"), F.concat(F.lit("/"), F.ltrim(F.col("text_path"), F.lit("./"))))
    joined = wanted.join(named, (wanted["name"] == named["name"]) & near, "left")
    return joined.select(*[F.coalesce("text", "of_file").alias("text") if c == "text" else F.col(c) for c in entries.columns])
