"""Streaming extension: sessions of events and counts in windows, with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.registry import Registry
from ..plans.runtime import new_path

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of parquet files in a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """``user_id, start, end, n_events``: visits as sessions without a pause longer than ``gap``; events later than ``late`` are dropped. Works on streams and tables."""
    t = events.withColumn("t", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        t = t.withWatermark("t", late)
    g = t.groupBy("user_id", F.session_window("t", gap).alias("w")).agg(F.count("*").alias("n_events"))
    return g.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n_events")


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """``event_type, start, n_events, total``: tumbling windows per event type."""
    t = events.withColumn("t", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        t = t.withWatermark("t", late)
    g = t.groupBy("event_type", F.window("t", width).alias("w")).agg(F.count("*").alias("n_events"), F.sum("value").alias("total"))
    return g.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n_events", "total")


def run_once(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all that is there, in append mode with a checkpoint in the shared folder, and returns its output."""
    spark = stream.sparkSession
    out, state = new_path(spark, name), new_path(spark, f"{name}-state")
    stream.writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


R = Registry()


@R.query("event_sessions", """WITH o AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), g AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n_events FROM g GROUP BY user_id, k""")
def event_sessions(spark, sf_dir: str) -> DataFrame:
    """The sessions of the whole events table, by the operator that also runs on streams."""
    return sessions(spark.read.parquet(f"{sf_dir}/events.parquet"))


@R.query("event_windows", "SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS start, count(*) AS n_events, sum(value) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir: str) -> DataFrame:
    return windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet"))
