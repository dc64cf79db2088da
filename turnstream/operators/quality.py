"""Transcript scores: one row per recording, aggregated from counts of each segment, so that no text is gathered."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fields, trimmed
from ..functions.timecode import parse_timestamp

# fixed values: weights of the overall score, and the most that an incomplete transcript scores
WEIGHTS = {"readability": 0.25, "vocabulary": 0.15, "variety": 0.15, "punctuation": 0.10, "consistency": 0.10, "coverage": 0.25}
MOST_INCOMPLETE = 59.0


@dataclass(frozen=True)
class QualitySettings:
    """Weights of the overall score by part, and the scores below (density: above) which a transcript is warned of."""

    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    readability: float = 70.0
    vocabulary: float = 30.0
    density: float = 0.15
    coverage: float = 80.0

    def __post_init__(self):
        if unknown := set(self.weights) - set(WEIGHTS):
            raise ValueError(f"unknown parts of the score: {', '.join(sorted(unknown))}")


def _by_time():
    return Window.partitionBy("recording_id").orderBy("seg_idx")


def _clamp(c):
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(100.0))


def intervals(seg: DataFrame) -> DataFrame:
    """The segments whose timestamp can be read, each with the gap to the one before."""
    t = seg.select("recording_id", "seg_idx", parse_timestamp(F.col("timestamp")).alias("t")).where("t is not null")
    return t.withColumn("gap", F.col("t") - F.lag("t").over(_by_time()))


def sentences(seg: DataFrame) -> DataFrame:
    """recording_id, k: words of each sentence of a recording's joined text.

    A sentence runs on into the next segment until a mark ends it; so it is numbered by the marks before it.
    """
    marks = F.regexp_count("text", F.lit("[.!?]+"))
    before = F.coalesce(F.sum(marks).over(_by_time().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = seg.select("recording_id", "seg_idx", F.coalesce("text", F.lit("")).alias("text")).select("recording_id", before.alias("before"), F.posexplode(F.split("text", "[.!?]+")).alias("pos", "part"))
    each = parts.select("recording_id", (F.col("before") + F.col("pos")).alias("sentence"), F.size(fields(F.col("part"))).alias("k"))
    return each.groupBy("recording_id", "sentence").agg(F.sum("k").alias("k")).where("k > 0").select("recording_id", "k")


def coverage(seg: DataFrame, durations: DataFrame) -> DataFrame:
    """recording_id, coverage: how much of a recording its timestamps span, and at most the share that can be read."""
    n = seg.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n"))
    times = intervals(seg).groupBy("recording_id").agg(F.count(F.lit(1)).alias("parsed"), F.max_by("t", "seg_idx").alias("last"), F.percentile(F.when(F.col("gap") > 0, F.col("gap")), 0.5).alias("mid"))
    g = n.join(times, "recording_id", "left").join(durations, "recording_id", "left").na.fill(0, ["parsed"])
    ratio = F.col("parsed") / F.col("n") * 100
    reach = _clamp((F.col("last") + F.coalesce("mid", F.lit(0.0))) / F.col("duration") * 100)
    return g.select("recording_id", F.when(F.coalesce(F.col("duration") <= 0, F.lit(True)), ratio).when(F.col("parsed") == 0, 0.0).when((F.col("n") == 1) & (F.col("last") == 0), 100.0).otherwise(F.least(reach, ratio)).alias("coverage"))


def consistency(seg: DataFrame) -> DataFrame:
    """recording_id, n_speakers, consistency: how evenly, and by how few, a recording is spoken."""
    per = seg.groupBy("recording_id", trimmed(F.coalesce("speaker", F.lit(""))).alias("speaker")).count().groupBy("recording_id").agg((F.coalesce(F.stddev_samp("count"), F.lit(0.0)) / F.avg("count")).alias("cv"), F.count(F.lit(1)).alias("u"))
    balance = F.when(F.col("u") > 1, F.greatest(F.lit(0.0), 100 - 50 * F.col("cv"))).otherwise(100.0)
    few = F.least(F.lit(100.0), balance + F.greatest(F.lit(0), 5 * (10 - F.col("u"))))
    return per.select("recording_id", F.col("u").alias("n_speakers"), F.when(F.col("u") > 10, F.greatest(F.lit(0.0), 100.0 - 10 * (F.col("u") - 10))).otherwise(few).alias("consistency"))


def assessment(score: Column) -> Column:
    return F.when(score >= 80, "Excellent").when(score >= 60, "Good").when(score >= 40, "Fair").otherwise("Poor")


def scorecard(seg: DataFrame, durations: DataFrame | None = None, settings: QualitySettings = QualitySettings()) -> DataFrame:
    """Per recording its counts, scores and overall score.

    seg: recording_id, seg_idx, speaker, text, timestamp.  durations: recording_id, duration in seconds; by default
    the latest end of the segments.  Where no duration is known, coverage is the share of readable timestamps.
    """
    if durations is None:
        durations = seg.groupBy("recording_id").agg(F.max("end").alias("duration"))
    text = F.coalesce("text", F.lit(""))
    counts = seg.groupBy("recording_id").agg(
        F.count(F.lit(1)).alias("n_segments"),
        F.sum(F.regexp_count(text, F.lit("[.,;:!?]"))).alias("marks"),
        (F.sum(F.octet_length(text)) + F.count(F.lit(1)) - 1).alias("bytes"),
    )
    words = seg.select("recording_id", F.explode(fields(F.lower(text))).alias("w")).groupBy("recording_id", "w").agg(F.count(F.lit(1)).alias("n"))
    words = words.groupBy("recording_id").agg(F.sum("n").alias("n_words"), F.count(F.lit(1)).alias("n_distinct"))
    lengths = sentences(seg).groupBy("recording_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.stddev_samp("k").alias("sd"))
    b = counts.join(words, "recording_id", "left").join(lengths, "recording_id", "left").join(coverage(seg, durations), "recording_id").join(consistency(seg), "recording_id")
    b = b.na.fill(0, ["n_words", "n_distinct", "n_sentences"])
    s, w = F.col("n_sentences"), F.col("n_words")
    b = b.select(
        "recording_id", "n_segments", "n_speakers", "n_words", "n_sentences", (F.col("marks") / F.greatest(F.col("bytes"), F.lit(1))).alias("density"),
        _clamp(100 - 3 * F.abs(w / F.greatest(s, F.lit(1)) - 15)).alias("readability"),
        F.when(s > 1, F.least(F.lit(100.0), 10 * F.col("sd"))).when(s == 1, 50.0).otherwise(0.0).alias("variety"),
        F.least(F.lit(100.0), 200 * F.col("n_distinct") / F.greatest(w, F.lit(1))).alias("vocabulary"),
        "coverage", "consistency",
    )
    punct = F.greatest(F.lit(0.0), 100 - 100 * F.col("density"))
    total = sum((weight * (punct if k == "punctuation" else F.col(k)) for k, weight in settings.weights.items()), F.lit(0.0))
    b = b.withColumn("overall", F.round(total, 4))
    return b.select("recording_id", "n_segments", "n_speakers", "n_words", "n_sentences", *[F.round(c, 4).alias(c) for c in ("density", "readability", "variety", "vocabulary", "coverage", "consistency")], "overall", assessment(F.col("overall")).alias("assessment"))


def score_warnings(settings: QualitySettings = QualitySettings()) -> list[Column]:
    """The warnings that a scorecard's scores give; null where one does not apply."""
    warn = lambda cond, text, c, d: F.when(cond, F.format_string(text, F.round(c, d)))
    # fixed values: the messages
    return [
        warn(F.col("readability") < settings.readability, "Low readability score: %.1f", F.col("readability"), 1),
        warn(F.col("vocabulary") < settings.vocabulary, "Low vocabulary richness: %.1f", F.col("vocabulary"), 1),
        warn(F.col("density") > settings.density, "High punctuation density: %.3f", F.col("density"), 3),
        warn(F.col("coverage") < settings.coverage, "Low timestamp coverage: %.1f%%", F.col("coverage"), 1),
    ]


def quality_report(seg: DataFrame, recordings: DataFrame, settings: QualitySettings = QualitySettings()) -> DataFrame:
    """Per row of recordings (recording_id, duration): score, n_gaps, issues and warnings (arrays).

    A transcript with gap markers scores MOST_INCOMPLETE at most and has an issue; one without segments has no score.
    """
    from .validate import is_gap

    gaps = seg.groupBy("recording_id").agg(F.count_if(is_gap()).alias("n_gaps"))
    rows = recordings.select("recording_id").join(scorecard(seg, recordings, settings), "recording_id", "left").join(gaps, "recording_id", "left")
    incomplete = F.col("n_gaps") > 0
    message = F.format_string("Transcript contains %d explicitly untranscribed span(s)", F.col("n_gaps"))
    issue = lambda code, text: F.array(F.struct(F.lit("error").alias("type"), F.lit(code).alias("code"), text.alias("message")))
    none = F.array().cast("array<struct<type:string,code:string,message:string>>")
    return rows.select(
        "recording_id",
        F.when(incomplete, F.least(F.col("overall"), F.lit(MOST_INCOMPLETE))).otherwise(F.col("overall")).alias("score"),
        F.coalesce("n_gaps", F.lit(0)).cast("long").alias("n_gaps"),
        F.when(F.col("n_segments").isNull(), issue("no_segments", F.lit("No segments transcribed"))).when(incomplete, issue("incomplete_transcript", message)).otherwise(none).alias("issues"),
        F.array_compact(F.array(*score_warnings(settings), F.when(incomplete, F.concat(message, F.lit("."))))).alias("warnings"),
    )


def duration_estimate(seg: DataFrame) -> DataFrame:
    g = intervals(seg).groupBy("recording_id").agg(F.max_by("t", "seg_idx").alias("last"), F.avg(F.when(F.col("gap") > 0, F.col("gap"))).alias("mean"))
    return g.select("recording_id", F.round(F.when(F.col("mean").isNull(), F.greatest(F.col("last") + 30, F.lit(30))).otherwise(F.greatest(F.col("last") + F.col("mean"), F.lit(1))), 4).alias("seconds"))


def boundary_analysis(seg: DataFrame) -> DataFrame:
    """Adjacent duplicates, steps back, gaps over 30 s, speaker changes and unreadable timestamps.

    Texts and speakers are compared with the segment before; times with the last that could be read, 0 at first.
    """
    from ..functions.text import normalise

    r = seg.select("recording_id", "seg_idx", "speaker", normalise(F.col("text")).alias("norm"), parse_timestamp(F.col("timestamp")).alias("t"))
    known = F.last("t", ignorenulls=True).over(_by_time().rowsBetween(Window.unboundedPreceding, -1))
    first = F.row_number().over(_by_time()) == 1
    r = r.select("*", F.lag("norm").over(_by_time()).alias("pn"), F.when(~first, F.coalesce(known, F.lit(0))).alias("pt"), F.lag("speaker").over(_by_time()).alias("ps"))
    counts = {
        "duplicates": F.count_if((F.col("norm") != "") & (F.col("norm") == F.col("pn"))),
        "back_steps": F.count_if(F.col("t") < F.col("pt")),
        "long_gaps": F.count_if(F.col("t") - F.col("pt") > 30),
        "speaker_changes": F.count_if(F.col("speaker") != F.col("ps")),
        "unreadable": F.count_if(F.col("t").isNull()),
    }
    return r.groupBy("recording_id").agg(*(c.alias(n) for n, c in counts.items()))


def boundary_issues(seg: DataFrame) -> DataFrame:
    """recording_id, issues (array): what boundary_analysis found, in words."""
    say = lambda c, text: F.when(F.col(c) > 0, F.format_string(f"%d {text}", c))
    found = F.array(say("duplicates", "adjacent duplicate segment(s)"), say("back_steps", "non-monotonic timestamp transition(s)"), say("long_gaps", "timestamp gap(s) over 30 seconds"), say("unreadable", "invalid timestamp(s)"))
    return boundary_analysis(seg).select("recording_id", F.array_compact(found).alias("issues"))
