"""Transcripts as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timecode import clock, precise_clock


def _listed(line: Column, separator: str) -> Column:
    """The lines of one recording in the order of its segments."""
    rows = F.array_sort(F.collect_list(F.struct("seg_idx", line.alias("line"))))
    return F.array_join(F.transform(rows, lambda r: r["line"]), separator)


def transcript_text(segments: DataFrame) -> DataFrame:
    """Per recording: full_text (texts joined by spaces) and formatted (timestamp speaker: text, a line each)."""
    line = F.concat("timestamp", F.lit(" "), "speaker", F.lit(": "), "text")
    return segments.groupBy("recording_id").agg(_listed(F.col("text"), " ").alias("full_text"), _listed(line, "\n").alias("formatted"))


def document_summary(segments: DataFrame) -> DataFrame:
    """Per recording: its duration and number of speakers, gap markers left out."""
    s = segments.groupBy("recording_id").agg(F.max("end").alias("d"), F.count_distinct(F.when(F.col("speaker") != "Untranscribed", F.col("speaker"))).alias("n"))
    people = F.when(F.col("n") == 1, "1 speaker").when(F.col("n") > 1, F.concat(F.col("n").cast("string"), F.lit(" speakers")))
    return s.select("recording_id", F.concat_ws(" · ", F.when(F.col("d") > 0, F.concat(F.lit("Duration "), clock(F.col("d")))), people).alias("summary"))


def cue_times(segments: DataFrame) -> DataFrame:
    """Start and end of each segment as subtitle formats write them."""
    return segments.select("recording_id", "seg_idx", precise_clock(F.col("start"), ",").alias("srt_start"), precise_clock(F.col("end"), ",").alias("srt_end"), precise_clock(F.col("start"), ".").alias("vtt_start"))
