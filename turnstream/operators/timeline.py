"""Order-dependent operators on segments: ends, lanes, speakers, turns, chunks and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scan import Running, running
from .subtitles import turns

#: Time of a block that one task scans.
BLOCK_MS = 600_000


def _by_time():
    return Window.partitionBy("recording_id").orderBy("seg_idx")

def _whole():
    return Window.partitionBy("recording_id")


def segment_ends(seg: DataFrame) -> DataFrame:
    """An end for each segment: by its length, or the given one, cut at the next start."""
    guess = F.col("start") + F.greatest(F.lit(1.0), F.char_length("text") / 15)
    end = F.when(F.col("end") > F.col("start"), F.col("end")).otherwise(guess)
    r = seg.withColumn("e", end).withColumn("next", F.lead("start").over(_by_time()))
    return r.select("recording_id", "seg_idx", F.round(F.when((F.col("next") > F.col("start")) & (F.col("next") < F.col("e")), F.col("next")).otherwise(F.col("e")), 3).alias("cue_end"))


def timeline_lanes(seg: DataFrame) -> DataFrame:
    total = F.greatest(F.max("end").over(_whole()), F.lit(1.0))
    return seg.select("recording_id", "seg_idx", "speaker", F.round(F.col("start") / total * 100, 4).alias("left_pct"), F.round(F.greatest(F.col("end") - F.col("start"), F.lit(0.2)) / total * 100, 4).alias("width_pct"))


def speakers_by_first(seg: DataFrame) -> DataFrame:
    """Labels of each recording's speakers by first appearance; a blank one is the unknown speaker and takes no number."""
    name = F.trim(F.coalesce("speaker", F.lit("")))
    first = seg.groupBy("recording_id", name.alias("speaker")).agg(F.min("seg_idx").alias("first_idx"), F.count(F.lit(1)).alias("n"))
    blank = F.col("speaker") == ""
    rank = F.row_number().over(Window.partitionBy("recording_id", blank).orderBy("first_idx"))
    return first.select("recording_id", "speaker", "first_idx", "n", F.when(blank, "Unknown speaker").otherwise(F.format_string("Speaker %d", rank)).alias("label"))


def speakers_by_recency(seg: DataFrame) -> DataFrame:
    last = seg.groupBy("recording_id", "speaker").agg(F.max("start").alias("last_start"))
    return last.withColumn("rank", F.row_number().over(Window.partitionBy("recording_id").orderBy(F.desc("last_start"), "speaker")))


def unique_speakers(seg: DataFrame) -> DataFrame:
    first = seg.groupBy("recording_id", "speaker").agg(F.min("seg_idx").alias("i"))
    return first.groupBy("recording_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "speaker"))), lambda x: x["speaker"]), ",").alias("by_first"), F.array_join(F.array_sort(F.collect_list("speaker")), ",").alias("by_name"))


def chunk_plan(seg: DataFrame, duration_ms: int = 20_000, overlap_ms: int = 5_000) -> DataFrame:
    """Fixed chunks: 1 + ceil((total - D) / (D - O)) of them, the last one `final`."""
    total = seg.groupBy("recording_id").agg(F.round(F.max("end") * 1000).cast("long").alias("total_ms"))
    step = duration_ms - overlap_ms
    count = F.when(F.col("total_ms") <= duration_ms, 1).otherwise(1 + F.ceil((F.col("total_ms") - duration_ms) / step)).cast("int")
    rows = total.select("recording_id", "total_ms", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk_idx"))
    start = F.col("chunk_idx").cast("long") * step
    return rows.select("recording_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), start.alias("start_ms"), F.least(start + duration_ms, "total_ms").alias("end_ms"), F.when(start + duration_ms > F.col("total_ms"), "final").otherwise("fixed").alias("boundary_type"))


def cut_points(chunks: DataFrame) -> DataFrame:
    """Keep windows: a seam in silence is cut at the end of the chunk before it, any other in the middle of the overlap."""
    w = Window.partitionBy("recording_id").orderBy("chunk_idx")
    quiet = F.col("boundary_type") == "silence"
    r = chunks.withColumns({"prev_end": F.lag("end_ms").over(w), "prev_quiet": F.lag(quiet).over(w), "next_start": F.lead("start_ms").over(w), "quiet": quiet})
    begin = F.when(F.col("prev_quiet"), F.col("prev_end")).when(F.col("prev_end").isNotNull(), F.expr("(start_ms + prev_end) div 2"))
    until = F.when(F.col("next_start").isNotNull(), F.when(F.col("quiet"), F.col("end_ms")).otherwise(F.expr("(next_start + end_ms) div 2")))
    return r.select("recording_id", "chunk_idx", begin.alias("keep_from_ms"), until.alias("keep_until_ms"))


def keep_window(units: DataFrame, cuts: DataFrame) -> DataFrame:
    """Units of each chunk's keep window, counted.

    Windows follow one another, so a unit belongs to the last that began by its start: both are sorted together,
    in blocks of time, and no pair of a unit and a window is built.
    """
    begin = cuts.select("recording_id", F.coalesce("keep_from_ms", F.lit(0)).alias("at"), F.lit(0).alias("is_unit"), "chunk_idx", F.col("keep_until_ms").alias("until"), F.lit(None).cast("long").alias("end_ms"))
    heard = units.select("recording_id", F.col("start_ms").alias("at"), F.lit(1).alias("is_unit"), F.lit(None).cast("long").alias("chunk_idx"), F.lit(None).cast("long").alias("until"), "end_ms")
    window = F.when(F.col("is_unit") == 0, F.struct("chunk_idx", "until"))
    rows = running(begin.unionByName(heard), ["recording_id"], F.expr(f"at div {BLOCK_MS}"), ["at", "is_unit", "chunk_idx"], {"w": Running("last", window)})
    rows = rows.withColumns({"c": F.col("w.chunk_idx"), "u": F.col("w.until")})
    inside = rows.where((F.col("is_unit") == 1) & F.col("c").isNotNull() & (F.col("u").isNull() | (F.col("at") < F.col("u"))))
    return inside.groupBy("recording_id", F.col("c").alias("chunk_idx")).agg(F.count(F.lit(1)).alias("n_units"), F.min("at").alias("first_ms"), F.max("end_ms").alias("last_ms"))


def reading_turns(seg: DataFrame, most: float = 120.0) -> DataFrame:
    """Runs of one speaker that began less than `most` seconds before; blank segments neither count nor break.

    The rule resets at each turn's own start, so it is a fold over the recording's ordered segments.
    """
    return turns(seg, most).select("recording_id", "turn_idx", "speaker", "start", "n_segments", F.char_length("text").cast("long").alias("n_chars"))
