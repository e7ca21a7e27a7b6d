"""The tables that queries read, and how they map to the engine's own inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as steps: a playbook per user, in time order; an error is a quiet period."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return e.select(
        F.col("user_id").alias("playbook_id"), F.row_number().over(order).alias("ordinal"), F.when(F.col("event_type") == "error", "quiet_period").otherwise("keyframe").alias("trigger"),
        F.col("value").alias("diff_score"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").alias("sequence"), F.concat_ws(" ", F.col("event_type"), F.col("event_id").cast("string")).alias("caption_text"),
    )


#: The same in DuckDB's SQL.
STEPS_SQL = """
steps AS (
  SELECT user_id AS playbook_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ordinal,
         CASE WHEN event_type = 'error' THEN 'quiet_period' ELSE 'keyframe' END AS trigger, value AS diff_score,
         epoch_us(ts) AS us, event_id AS sequence, event_type || ' ' || CAST(event_id AS VARCHAR) AS caption_text
  FROM events)"""
