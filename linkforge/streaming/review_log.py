"""The review log as a stream: deduplicated reviews, and the latest decision of each pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import REVIEW


def read(spark: SparkSession, path: str, watermark: str = "1 day") -> DataFrame:
    """New reviews as their files appear; a repeated review_id within the watermark is dropped."""
    log = spark.readStream.schema(REVIEW).parquet(path)
    log = log.withColumn("reviewed", F.to_timestamp("reviewed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return log.withWatermark("reviewed", watermark).dropDuplicatesWithinWatermark(["review_id"])


def decisions(log: DataFrame, window: str = "1 hour") -> DataFrame:
    """Decisions by event-time window; late ones beyond the watermark are left out."""
    return log.groupBy(F.window("reviewed", window).alias("w"), "decision").agg(F.count(F.lit(1)).alias("reviews")).select(F.col("w.start").alias("start"), "decision", "reviews")


def latest(log: DataFrame) -> DataFrame:
    """The last decision on each pair."""
    last = F.max_by(F.struct("decision", "forensic_status", "review_id"), F.struct("reviewed_at", "review_id"))
    return log.groupBy("pm_record_id", "am_record_id").agg(last.alias("r"), F.count(F.lit(1)).alias("reviews")).select("pm_record_id", "am_record_id", "r.*", "reviews")
