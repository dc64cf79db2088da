"""What a viewer shows of a transcript, as column expressions: durations, ends, search hits and a summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import count_matches
from .timecode import parse_timestamp

GAP_SPEAKER = "Untranscribed"


def short_duration(seconds: Column) -> Column:
    """12s, 3m, 3m 5s, 2h, 2h 5m: whole seconds, rounded."""
    t = F.floor(F.coalesce(seconds, F.lit(0)) + 0.5)
    h, m = F.floor(t / 3600), F.floor(t % 3600 / 60)
    return (
        F.when(t < 60, F.format_string("%ds", t)).when(h > 0, F.when(m > 0, F.format_string("%dh %dm", h, m)).otherwise(F.format_string("%dh", h)))
        .when(t % 60 > 0, F.format_string("%dm %ds", m, t % 60)).otherwise(F.format_string("%dm", m))
    )


def segment_start(start: Column, timestamp: Column) -> Column:
    """The precise start of a segment, else that of its timestamp, else 0."""
    return F.coalesce(start, parse_timestamp(timestamp).cast("double"), F.lit(0.0))


def utf16_length(text: Column) -> Column:
    """UTF-16 code units of a text."""
    return F.octet_length(F.encode(text, "UTF-16BE")) / 2


def shown_ends(seg: DataFrame) -> DataFrame:
    """recording_id, seg_idx, end as a viewer draws it: the given one, else by length, up to the next start but half a second at least."""
    order = Window.partitionBy("recording_id").orderBy("seg_idx")
    s = segment_start(F.col("start"), F.col("timestamp"))
    rows = seg.select("recording_id", "seg_idx", s.alias("s"), F.col("end").alias("given"), F.greatest(F.lit(1.0), utf16_length(F.coalesce("text", F.lit(""))) / 15).alias("guess"))
    rows = rows.withColumn("next", F.lead("s").over(order))
    guess = F.col("s") + F.col("guess")
    end = F.when(F.col("given") > F.col("s"), F.col("given")).when(F.col("next").isNotNull(), F.least(guess, F.greatest("next", F.col("s") + 0.5))).otherwise(guess)
    return rows.select("recording_id", "seg_idx", F.round(end, 3).alias("end"))


def search(seg: DataFrame, query: str) -> DataFrame:
    """The segments that a search shows, with matches: those that hold the query, whatever its case; all, with 0, for a blank one."""
    q = query.strip()
    rows = seg.withColumn("matches", count_matches(F.col("text"), q))
    return rows.where("matches > 0") if q else rows


def summary(seg: DataFrame, results: DataFrame) -> DataFrame:
    """recording_id, parts, n_gaps of results (recording_id, duration, model, judged, processing_time, score): what stands above a transcript."""
    who = seg.groupBy("recording_id").agg(F.count_distinct(F.when(F.col("speaker") != GAP_SPEAKER, F.col("speaker"))).alias("n"), F.count_if(F.col("speaker") == GAP_SPEAKER).alias("n_gaps"))
    rows = results.join(who, "recording_id", "left").na.fill(0, ["n", "n_gaps"])
    plural = lambda c, one: F.when(c == 1, F.lit(f"1 {one}")).otherwise(F.format_string(f"%d {one}s", c))
    gaps = F.when(F.col("n_gaps") == 1, "1 gap to check").when(F.col("n_gaps") > 1, F.format_string("%d gaps to check", "n_gaps"))
    score = F.when(F.col("judged") & (F.col("score") > 0), F.format_string("quality %d/100", F.floor(F.col("score") + 0.5)))
    parts = F.concat_ws(" | ", short_duration(F.col("duration")), plural(F.col("n"), "speaker"), F.when(F.col("model") != "", F.col("model")), F.when(F.col("judged"), "reviewed by a judge"), F.concat(F.lit("done in "), short_duration(F.col("processing_time"))), gaps, score)
    return rows.select("recording_id", parts.alias("parts"), "n_gaps")


def visible_rows(seg: DataFrame, query: str) -> DataFrame:
    """recording_id, visible, matches: how many segments a search shows, and its matches."""
    q = query.strip()
    m = count_matches(F.col("text"), q)
    return seg.groupBy("recording_id").agg((F.count_if(m > 0) if q else F.count(F.lit(1))).alias("visible"), F.sum(m).alias("matches"))
