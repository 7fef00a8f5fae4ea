"""Writers: idempotent append by content hash, ledgers by key, publication, CSV cells, Markdown reports and JSON envelopes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_new(df: DataFrame, path: str, key: str = "content_hash") -> DataFrame:
    """Appends the rows whose key the table at path does not have yet; returns them."""
    spark = df.sparkSession
    fresh = df.dropDuplicates([key])
    if spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
    fresh.write.mode("append").parquet(path)
    return fresh


def _place(spark: SparkSession, path: str):
    """The file system of a path, and the path as it names it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def publish(df: DataFrame, path: str) -> None:
    """Writes df beside path and renames it into place when it is whole; what is there already is never overwritten."""
    spark = df.sparkSession
    files, target = _place(spark, path)
    if files.exists(target):
        raise FileExistsError(path)
    aside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.parquet(aside)
    if files.exists(target) or not files.rename(_place(spark, aside)[1], target):
        files.delete(_place(spark, aside)[1], True)
        raise FileExistsError(path)


def append_ledger(df: DataFrame, path: str, key: str, replace: bool = False) -> DataFrame:
    """Adds rows to the ledger at path, kept as one generation of files after another; the ledger after that.

    A key that the ledger has is refused, or, if asked for, its rows are replaced. Generations are named by number; the
    newest whole one counts, so that a run that breaks off leaves the ledger as it was.
    """
    spark = df.sparkSession
    files, folder = _place(spark, path)
    names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    whole = sorted(int(n[4:]) for n in names if n.startswith("gen-") and n[4:].isdigit() and files.exists(_place(spark, f"{path}/{n}/_SUCCESS")[1]))
    rows = df
    if whole:
        old = spark.read.parquet(f"{path}/gen-{whole[-1]}")
        if not replace and not old.join(df.select(key).distinct(), key, "left_semi").isEmpty():
            raise ValueError(f"the ledger has some of these values of {key}")
        rows = old.join(df.select(key).distinct(), key, "left_anti").select(df.columns).unionByName(df)
    following = f"{path}/gen-{(whole[-1] if whole else 0) + 1}"
    rows.write.mode("overwrite").parquet(following)
    return spark.read.parquet(following)


def markdown_report(df: DataFrame, title: str, most: int = 50) -> str:
    """A table of at most `most` rows, in the order of df, with how many there are; for results that are small."""
    rows = df.limit(most + 1).collect()
    show = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(map(show, r)) + " |" for r in rows[:most]]
    return "\n".join([*lines, *([f"\nThe first {most} of {df.count()} rows."] if len(rows) > most else [])]) + "\n"


def csv_cells(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").csv(path, header=True)


def envelope(df: DataFrame, surface: str, version: str = "1.0") -> DataFrame:
    """A JSON envelope per row; NaN and infinite numbers are refused."""
    doubles = [c for c, t in df.dtypes if t in ("double", "float")]
    bad = F.lit(False)
    for c in doubles:
        bad = bad | F.isnan(c) | F.abs(F.col(c)).isin(float("inf"))
    result = F.when(bad, F.raise_error(F.lit("non-finite value in a result"))).otherwise(F.to_json(F.struct(*df.columns)))
    return df.select(F.to_json(F.struct(F.lit(version).alias("schema_version"), F.lit(surface).alias("task_surface"), result.alias("results"))).alias("value"))
