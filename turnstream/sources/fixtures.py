"""Timed relations derived from the driver tables: segments, words and units of recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.timecode import format_timestamp

# fixed values: speaking rate and least length of a cue, in characters a second and seconds
CHARS_PER_SECOND, LEAST_CUE = 15, 1.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, seg_idx, speaker, text, start, end, timestamp: conversations laid out in time."""
    order = Window.partitionBy("recording_id").orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("recording_id"), F.col("turn").alias("seg_idx"), F.col("role").alias("speaker"), "text", F.greatest(F.lit(LEAST_CUE), F.char_length("text") / CHARS_PER_SECOND).alias("dur"))
    timed = rows.withColumn("start", F.round(F.coalesce(F.sum("dur").over(order), F.lit(0.0)), 3))
    return timed.withColumn("end", F.round(F.col("start") + F.col("dur"), 3)).withColumn("timestamp", format_timestamp(F.col("start"))).drop("dur")


def words(seg: DataFrame) -> DataFrame:
    """recording_id, seg_idx, speaker, pos, word, start_ms, end_ms: a word every 300 ms, 250 ms long."""
    parts = F.filter(F.split("text", r"[\t-\r ]+"), lambda w: w != "")
    begin = F.round(F.col("start") * 1000).cast("long")
    return seg.select("recording_id", "seg_idx", "speaker", begin.alias("at"), F.posexplode(parts).alias("pos", "word")).select(
        "recording_id", "seg_idx", "speaker", "pos", "word", (F.col("at") + 300 * F.col("pos")).alias("start_ms"), (F.col("at") + 300 * F.col("pos") + 250).alias("end_ms")
    )
