"""Structured Streaming over the event table and over documents, run to the end of what is there (availableNow).

Each function takes a stream (so the same plan runs for ever elsewhere); the queries drain it and return the batch table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.plans.shared import new_path

LATE = "2 hours"


def stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    # as a pattern, since a stream's path may not be a single file
    df = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/[{name[0]}]{name[1:]}.parquet")
    for field, kind in df.dtypes:
        if kind == "timestamp_ntz":  # watermarks need instants; read as UTC, whatever the session's time zone
            df = df.withColumn(field, F.expr(f"timestampadd(MICROSECOND, timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {field}), timestamp'1970-01-01 00:00:00Z')"))
    return df


def tumbling_counts(events: DataFrame, width: str = "1 day", slide: str | None = None) -> DataFrame:
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", LATE).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.unix_micros("w.start").alias("start"), "event_type", "n", "total")


def user_sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", LATE).groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.unix_micros("w.start").alias("start"), "n")


def first_events(events: DataFrame) -> DataFrame:
    """Events without those that come again (by event_id) while the watermark holds them."""
    return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["event_id"])


def drain(df: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs df to the end of its source into a table of the shared folder, and reads that."""
    spark = df.sparkSession
    out = new_path(spark, "stream")
    spark.createDataFrame([], df.schema).write.parquet(out)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    df.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", new_path(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def new_texts(docs: DataFrame, out: str | None = None, progress: str | None = None) -> DataFrame:
    """Drains a stream of documents into a table of first copies (by SHA-256 of the text), batch by batch.

    A batch keeps the least doc_id of each text that no earlier batch has; null texts count as one text. A batch that is
    run again writes its own folder anew and does not see itself, so the table is the same. With out and progress given,
    a later call goes on from there.
    """
    spark = docs.sparkSession
    out, progress = out or new_path(spark, "texts"), progress or new_path(spark, "progress")
    hashed = docs.select("doc_id", F.sha2(F.coalesce(F.concat(F.lit("t"), "text"), F.lit("")), 256).alias("text_sha"))
    kinds = ", ".join(f"{n} {t}" for n, t in hashed.dtypes)

    def seen() -> DataFrame:
        return spark.read.schema(f"{kinds}, batch long").parquet(out)

    def keep(batch: DataFrame, number: int) -> None:
        first = batch.groupBy("text_sha").agg(F.min("doc_id").alias("doc_id"))
        if number > 0:
            first = first.join(seen().where(F.col("batch") < number), "text_sha", "left_anti")
        first.select("doc_id", "text_sha").write.mode("overwrite").parquet(f"{out}/batch={number}")

    spark.createDataFrame([], kinds).write.mode("overwrite").parquet(f"{out}/batch=-1")
    hashed.writeStream.foreachBatch(keep).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    return seen().select("doc_id", "text_sha")


QUERIES = {
    "stream_new_texts": lambda spark, sf_dir: new_texts(stream(spark, sf_dir, "documents")),
    "stream_daily_counts": lambda spark, sf_dir: drain(tumbling_counts(stream(spark, sf_dir))),
    "stream_sliding_counts": lambda spark, sf_dir: drain(tumbling_counts(stream(spark, sf_dir), "2 days", "1 day")),
    "stream_user_sessions": lambda spark, sf_dir: drain(user_sessions(stream(spark, sf_dir))),
    "stream_first_events": lambda spark, sf_dir: drain(first_events(stream(spark, sf_dir)), "append").select("event_id", "user_id", "event_type"),
}
_DAY = 86_400_000_000
ORACLES = {
    "stream_new_texts": "SELECT min(doc_id) AS doc_id, text_sha FROM (SELECT doc_id, sha256(coalesce('t' || text, '')) AS text_sha FROM documents) GROUP BY text_sha",
    "stream_daily_counts": f"SELECT CAST(epoch_us(ts) // {_DAY} * {_DAY} AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "stream_sliding_counts": f"SELECT CAST(epoch_us(ts) // {_DAY} * {_DAY} - b * {_DAY} AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events, (VALUES (0), (1)) AS v(b) GROUP BY 1, 2",
    "stream_user_sessions": """WITH g AS (SELECT user_id, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 21600000000, TRUE) AS fresh FROM events),
s AS (SELECT user_id, ts, sum(CAST(fresh AS INT)) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
    "stream_first_events": "SELECT event_id, any_value(user_id) AS user_id, any_value(event_type) AS event_type FROM events GROUP BY event_id",
}
