"""Evidence tables derived from the star-schema tables, with integer arithmetic only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EPOCH_MS = 1_704_067_200_000  # 2024-01-01


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caption segments: media_id, source_order, segment_id, speaker, raw_text, start_ms, end_ms."""
    c = table(spark, sf_dir, "conversations")
    duration = F.lit(400).cast("long") + 55 * F.length("text")
    gap = F.pmod(F.col("conv_id") * 7919 + F.col("turn") * 104729, F.lit(2600)) - 300
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    start = F.greatest(F.lit(0).cast("long"), F.coalesce(F.sum(duration + gap).over(before), F.lit(0).cast("long")))
    rows = c.select("conv_id", "turn", "text", start.alias("start_ms"), duration.alias("duration"))
    return rows.select(
        F.col("conv_id").alias("media_id"), F.col("turn").alias("source_order"), F.format_string("T%06d", F.col("turn") + 1).alias("segment_id"),
        F.when(F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4)) < 2, "A").otherwise("B").alias("speaker"), F.col("text").alias("raw_text"),
        "start_ms", (F.col("start_ms") + F.col("duration")).alias("end_ms"))


def issue_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments with planted faults: fast cues, long gaps, placeholders, repeats, loops, backward cues."""
    c = table(spark, sf_dir, "conversations")
    k = F.col("conv_id") + F.col("turn")
    every = lambda n: F.pmod(k, F.lit(n)) == 0
    w = Window.partitionBy("conv_id").orderBy("turn")
    base = F.lit(400).cast("long") + 55 * F.length("text")
    duration = F.when(every(3), F.expr("(400 + 55 * length(text)) div 4")).otherwise(base)
    gap = F.pmod(F.col("conv_id") * 7919 + F.col("turn") * 104729, F.lit(2600)) - 300
    gap = F.when(every(7), gap * 10).otherwise(gap)
    start = F.greatest(F.lit(0).cast("long"), F.coalesce(F.sum(duration + gap).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    text = F.when(F.pmod("conv_id", F.lit(7)) == 0, F.concat(F.lit("loop line "), F.pmod("turn", F.lit(2)))).when(every(11), "...").when(every(13), F.coalesce(F.lag("text").over(w), F.col("text"))).otherwise(F.col("text"))
    rows = c.select("conv_id", "turn", text.alias("raw_text"), start.alias("s"), duration.alias("duration"), every(9).alias("back"))
    moved = F.when(F.col("back"), F.greatest(F.lit(0).cast("long"), F.col("s") - 40_000)).otherwise(F.col("s"))
    return rows.select(F.col("conv_id").alias("media_id"), F.col("turn").alias("source_order"), "raw_text", moved.alias("start_ms"), (moved + F.col("duration")).alias("end_ms"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visual events of 10 media: media_id, event_id, actual_ms, event_type, value, user_id."""
    e = table(spark, sf_dir, "events")
    ms = F.expr(f"(unix_millis(cast(ts as timestamp)) - {EPOCH_MS}) div 1000")
    return e.select(F.pmod("user_id", F.lit(10)).alias("media_id"), "event_id", ms.alias("actual_ms"), "event_type", "value", "user_id")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled intervals: media_id, event_id, start_ms, end_ms, label."""
    s = signals(spark, sf_dir)
    return s.select("media_id", "event_id", F.col("actual_ms").alias("start_ms"), (F.col("actual_ms") + (1 + F.pmod("event_id", F.lit(24))) * 500).alias("end_ms"), F.col("event_type").alias("label"))
