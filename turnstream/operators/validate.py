"""Validation, relabelling and rebasing of segments (recording_id, seg_idx, speaker, text, timestamp, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timecode import format_timestamp, normalise_timestamp, parse_timestamp

# fixed values: the label and the opening words of gap markers, and audio tokens a second
GAP_SPEAKER, GAP_TEXT, TOKENS_PER_SECOND = "untranscribed", "[no transcript produced for ", 32
BLANK = r"^[\t-\r ]*$"


def segment_error() -> Column:
    """The first rule that a segment breaks - timestamp, range, speaker, text, confidence - or null."""
    part = lambda k: F.regexp_extract("timestamp", r"^\[(\d{2,}):(\d{2}):(\d{2})\]$", k).cast("int")
    blank = lambda c: F.coalesce(F.col(c).rlike(BLANK), F.lit(True))
    return (
        F.when(parse_timestamp(F.col("timestamp")).isNull(), "timestamp").when((part(2) >= 60) | (part(3) >= 60), "range")
        .when(blank("speaker"), "speaker").when(blank("text"), "text").when(~F.col("confidence").between(0, 1), "confidence")
    )


def list_verdicts(segments: DataFrame) -> DataFrame:
    """Per recording: n_segments, n_errors, monotonic (ties allowed; a time that cannot be read breaks it), accepted."""
    order = Window.partitionBy("recording_id").orderBy("seg_idx")
    t = parse_timestamp(F.col("timestamp"))
    rows = segments.select("recording_id", segment_error().isNotNull().cast("long").alias("bad"), (t.isNotNull() & F.coalesce(t >= F.lag(t).over(order), F.lag("seg_idx").over(order).isNull())).alias("fine"))
    found = rows.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n_segments"), F.sum("bad").alias("n_errors"), F.bool_and("fine").alias("monotonic"))
    return found.withColumn("accepted", (F.col("n_errors") == 0) & F.col("monotonic"))


def accepted_segments(segments: DataFrame) -> DataFrame:
    """Segments of the recordings whose whole list is accepted.

    First timestamps are put in their strict form where they can be, and a confidence out of range becomes null.
    """
    clean = segments.withColumn("timestamp", normalise_timestamp(F.col("timestamp"))).withColumn("text", F.trim("text")).withColumn("speaker", F.trim("speaker")).withColumn("confidence", F.when(F.col("confidence").between(0, 1), F.col("confidence")))
    return clean.join(list_verdicts(clean).where("accepted").select("recording_id"), "recording_id", "left_semi")


def is_gap() -> Column:
    return (F.trim(F.lower("speaker")) == GAP_SPEAKER) | F.startswith(F.trim(F.lower("text")), F.lit(GAP_TEXT))


def rename_speakers(segments: DataFrame, names: dict[str, str]) -> DataFrame:
    """Speakers by map; a blank target changes nothing."""
    pairs = [F.lit(x) for k, v in names.items() if v.strip() for x in (k, v)]
    return segments.withColumn("speaker", F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("speaker")), F.col("speaker"))) if pairs else segments


def map_speakers(segments: DataFrame, names: list[str]) -> DataFrame:
    """`Speaker N` becomes the N-th name; other labels, and numbers beyond the list, stay."""
    if not names:
        return segments
    n = F.expr(r"try_cast(regexp_extract(trim(speaker), '(?i)^Speaker[\\t\\n\\f\\r ]*([0-9]+)$', 1) as int)")
    named = F.when(n.between(1, len(names)), F.element_at(F.array(*map(F.lit, names)), F.greatest(F.least(n, F.lit(len(names))), F.lit(1))))
    return segments.withColumn("speaker", F.coalesce(named, F.col("speaker")))


def change_notes(source: DataFrame, final: DataFrame) -> DataFrame:
    """Per segment of final which of timestamp, speaker and text differ from source; where counts differ, status is required."""
    keys = ["recording_id", "seg_idx"]
    one, two = (d.select(*keys, F.struct("timestamp", "speaker", "text").alias(n)) for d, n in ((source, "x"), (final, "y")))
    differs = lambda c: F.when(~F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")), c)
    rows = one.join(two, keys, "full")
    sums = rows.groupBy("recording_id").agg((F.count("x") != F.count("y")).alias("uneven"))
    notes = F.concat_ws(",", *(differs(c) for c in ("timestamp", "speaker", "text")))
    both = rows.where("y is not null").join(sums, "recording_id")
    return both.select(*keys, F.when(F.col("uneven"), "").otherwise(notes).alias("notes"), F.when(F.col("uneven"), "required").alias("status"))


def rebase(segments: DataFrame, start_seconds: Column) -> DataFrame:
    """Timestamps relative to a span's start, 0 at least; one that cannot be read stays."""
    return segments.withColumn("timestamp", F.coalesce(format_timestamp(parse_timestamp(F.col("timestamp")) - start_seconds), F.col("timestamp")))


def budget_preflight(plan: DataFrame, runs: int, overlap_ms: int, limit: int) -> DataFrame:
    """Tokens that the chunks of a plan (recording_id, chunk_idx, end_ms) need at least, overlaps sent twice, against a limit."""
    total = plan.groupBy("recording_id").agg(F.max("end_ms").alias("total"), F.count(F.lit(1)).alias("n_chunks"))
    audio = F.col("total") + (F.col("n_chunks") - 1) * overlap_ms
    tokens = F.floor((audio * TOKENS_PER_SECOND + 999) / 1000) * runs
    return total.select("recording_id", "n_chunks", tokens.alias("tokens"), (tokens <= limit).alias("allowed"))
