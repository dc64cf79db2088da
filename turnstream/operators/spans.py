"""Spans of a recording: validity of what was heard in them, seams between them, and where final segments come from.

Segments: recording_id, seg_idx, timestamp, speaker, text, confidence; those of candidates also have span_idx and
candidate_id.  Spans: recording_id, span_idx, start_ms, end_ms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalise, trimmed
from ..functions.timecode import format_timestamp, parse_timestamp
from .evidence import CANDIDATES_DIFFER, LEAST_QUALITY, LEAST_TIMES, dispute_islands, is_generic
from .folds import ordered_fold
from .validate import segment_error

# fixed values: seconds that a timestamp may lie beyond its span or recording, reach around a seam, and a large gap
BEYOND, NEAR_SEAM, AROUND_SEAM, LARGE_GAP = 5, 12, 60, 30
DISAGREE = 0.18
_KEYS = ["recording_id", "seg_idx"]


# ---------------------------------------------------------------- validity


def _first_problem(rows: DataFrame, keys: list[str], outside: Column, text: Column) -> DataFrame:
    """keys and error: the first segment of each list that is invalid, out of place or earlier than the one before.

    rows: keys, seg_idx, segment columns and t.
    """
    order = Window.partitionBy(*keys).orderBy("seg_idx")
    place = F.row_number().over(order) - 1
    back = F.coalesce(F.col("t") < F.lag("t").over(order), F.lit(False))
    at = F.concat(F.lit("segment "), F.col("place").cast("string"))
    rows = rows.withColumns({"place": place, "back": back, "broken": segment_error()})
    problem = F.when(F.col("broken").isNotNull(), F.concat(at, F.lit(": "), "broken")).when(outside, F.concat(at, F.lit(" "), text)).when(F.col("back"), F.concat(at, F.lit(" timestamp is not monotonic")))
    return rows.withColumn("problem", problem).groupBy(*keys).agg(F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("place"))).alias("error"))


def span_errors(candidates: DataFrame, spans: DataFrame) -> DataFrame:
    """recording_id, span_idx, candidate_id, error of each candidate's segments of a span; null where all are valid.

    A timestamp, in whole seconds, lies in its span or up to BEYOND seconds behind it, and none steps back.
    """
    keys = ["recording_id", "span_idx", "candidate_id"]
    rows = candidates.join(spans.select("recording_id", "span_idx", F.expr("start_ms div 1000").alias("lo"), (F.col("end_ms") / 1000 + BEYOND).alias("hi")), ["recording_id", "span_idx"]).withColumn("t", parse_timestamp(F.col("timestamp")))
    text = F.format_string("timestamp %ds is outside span %d-%d", "t", "lo", F.round("hi").cast("long"))
    return _first_problem(rows, keys, (F.col("t") < F.col("lo")) | (F.col("t") > F.col("hi")), text)


def valid_candidates(candidates: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows of the candidates whose whole list is valid in its span."""
    good = span_errors(candidates, spans).where("error is null").select("recording_id", "span_idx", "candidate_id")
    return candidates.join(good, ["recording_id", "span_idx", "candidate_id"], "left_semi")


def audio_errors(segments: DataFrame, durations: DataFrame) -> DataFrame:
    """recording_id, error of each recording's final segments against its duration; without one, times are not bounded."""
    rows = segments.join(durations.select("recording_id", "duration"), "recording_id", "left").withColumn("t", parse_timestamp(F.col("timestamp")))
    text = F.format_string("timestamp %ds exceeds audio duration %ds", "t", F.round("duration").cast("long"))
    return _first_problem(rows, ["recording_id"], F.coalesce((F.col("duration") > 0) & (F.col("t") > F.col("duration") + BEYOND), F.lit(False)), text)


def judged(decisions: DataFrame, decided: DataFrame, candidates: DataFrame, scores: DataFrame, spans: DataFrame) -> DataFrame:
    """Per span the outcome of judging: method, candidate_ids, and whether the decided segments stand.

    decisions: recording_id, span_idx, selected (array).  decided: their segments with span_idx.  candidates: as
    above.  scores: recording_id, span_idx, candidate_id, idx, score.  Without a valid candidate the method is
    degraded_no_valid_candidate and a gap marker stands in; a decision without valid segments or known ids falls back
    to the best valid candidate.
    """
    keys = ["recording_id", "span_idx"]
    errors = span_errors(candidates, spans).where("error is null").select(*keys, "candidate_id")
    ranked = errors.join(scores, [*keys, "candidate_id"]).groupBy(*keys).agg(
        F.max_by("candidate_id", F.struct(F.coalesce("score", F.lit(float("-inf"))), -F.col("idx"))).alias("best"),
        F.min_by("candidate_id", "idx").alias("primary"), F.collect_set("candidate_id").alias("valid"),
    )
    own = span_errors(decided.withColumn("candidate_id", F.lit("judge")), spans).select(*keys, F.lit(True).alias("some"), "error")
    rows = spans.select(*keys).join(ranked, keys, "left").join(decisions.select(*keys, "selected"), keys, "left").join(own, keys, "left")
    # of the ids that the judge names, those that exist; it may repeat them
    known = F.array_sort(F.array_intersect(F.coalesce("selected", F.array().cast("array<string>")), "valid"))
    method = (
        F.when(F.col("valid").isNull(), "degraded_no_valid_candidate")
        .when(F.col("selected").isNull(), "fallback_budget_exhausted")
        .when(F.size(known) == 0, "fallback_invalid_selection")
        .when(F.col("some").isNull(), "fallback_empty_judge_output")
        .when(F.col("error").isNotNull(), "fallback_out_of_span_judge_output")
        .otherwise("model")
    )
    ids = F.when(F.col("method") == "model", known).when(F.col("method") == "fallback_invalid_selection", F.array("primary")).when(F.col("valid").isNotNull(), F.array("best")).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("method", method).select(*keys, "method", ids.alias("candidate_ids"), (F.col("method") == "model").alias("stands"))


def review_errors(reviews: DataFrame, spans: DataFrame) -> DataFrame:
    """recording_id, error of global reviews (recording_id, verdict, span_ids): the verdict is known, and ids come with a rejudge alone and exist."""
    ids = F.coalesce("span_ids", F.array().cast("array<string>"))
    known = spans.select("recording_id", span_id(F.col("span_idx")).alias("id")).distinct()
    asked = reviews.where("verdict = 'rejudge'").select("recording_id", F.posexplode(ids).alias("pos", "id"))
    invented = asked.join(known, ["recording_id", "id"], "left_anti").groupBy("recording_id").agg(F.min_by("id", "pos").alias("invented"))
    error = (
        F.when(F.col("verdict").isin("pass", "review_required"), F.when(F.size(ids) > 0, F.concat(F.lit("verdict "), "verdict", F.lit(" cannot include rejudge spans"))))
        .when(F.col("verdict") == "rejudge", F.when(F.size(ids) == 0, "rejudge without span ids").when(F.col("invented").isNotNull(), F.concat(F.lit("invented span id "), "invented")))
        .otherwise(F.concat(F.lit("unknown verdict "), F.coalesce("verdict", F.lit(""))))
    )
    return reviews.join(invented, "recording_id", "left").select("recording_id", error.alias("error"))


def segments_equal(one: DataFrame, two: DataFrame) -> DataFrame:
    """recording_id, equal: whether two lists agree row by row in timestamp, speaker, text and confidence."""
    of = lambda d, n: d.select(*_KEYS, F.struct("timestamp", "speaker", "text", "confidence").alias(n))
    return of(one, "x").join(of(two, "y"), _KEYS, "full").groupBy("recording_id").agg(F.bool_and(F.col("x").eqNullSafe(F.col("y"))).alias("equal"))


# ---------------------------------------------------------------- seams


def around_seams(segments: DataFrame, seams: DataFrame, reach: int) -> DataFrame:
    """recording_id, seam_idx, at, before, after: the readable segments nearest to each seam on either side, within reach.

    seams: recording_id, seam_idx, at (seconds).  A segment at the seam is before it; equal distances go to the lower
    seg_idx; without one on both sides a seam has no row.  Times are joined by buckets as wide as the reach.
    """
    t = segments.select(*_KEYS, parse_timestamp(F.col("timestamp")).alias("t")).where("t is not null")
    t = t.withColumn("bucket", F.floor(F.col("t") / reach))
    s = seams.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("at") / reach) - 1, F.floor(F.col("at") / reach) + 1)))
    near = s.join(t, ["recording_id", "bucket"]).where(F.abs(F.col("t") - F.col("at")) <= reach)
    side = lambda cond: F.min_by(F.struct("seg_idx", "t"), F.when(cond, F.struct(F.abs(F.col("t") - F.col("at")), F.col("seg_idx"))))
    found = near.groupBy("recording_id", "seam_idx", "at").agg(side(F.col("t") <= F.col("at")).alias("before"), side(F.col("t") > F.col("at")).alias("after"), F.bool_or(F.col("t") <= F.col("at")).alias("b"), F.bool_or(F.col("t") > F.col("at")).alias("a"))
    return found.where("a and b").drop("a", "b")


class _Repair:
    """Seams in order, each with the segments around it; a dropped segment is gone for the seams after."""

    def __init__(self):
        self.gone: set[int] = set()

    def push(self, row: dict) -> list[tuple]:
        near = [x for x in row["near"] if x["seg_idx"] not in self.gone]
        for reach in (NEAR_SEAM, AROUND_SEAM):
            sides = [[x for x in near if (x["t"] > row["at"]) == late and abs(x["t"] - row["at"]) <= reach] for late in (False, True)]
            if not all(sides):
                continue
            one, two = (min(side, key=lambda x: (abs(x["t"] - row["at"]), x["seg_idx"])) for side in sides)
            if reach == NEAR_SEAM and one["norm"] and one["norm"] == two["norm"] and (one["who"] == two["who"] or one["generic"] or two["generic"]):
                self.gone.add(two["seg_idx"])
                return [(row["seam_idx"], "duplicate", two["seg_idx"], None)]
            if reach == AROUND_SEAM and two["t"] - one["t"] > LARGE_GAP:
                return [(row["seam_idx"], "gap", None, two["t"] - one["t"])]
        return []

    def end(self) -> list[tuple]:
        return []


def seam_repairs(segments: DataFrame, seams: DataFrame) -> DataFrame:
    """recording_id, seam_idx, kind (duplicate or gap), seg_idx to drop, seconds of the gap, note.

    Within NEAR_SEAM seconds of a seam, the segment after it that repeats the one before it goes; else a gap of more
    than LARGE_GAP seconds around it is noted.  Seams are taken in order, as a segment that one drops is not there
    for the next; only segments near a seam reach that fold, those of one seam at a time.
    """
    t = segments.select(*_KEYS, "text", "speaker", parse_timestamp(F.col("timestamp")).alias("t")).where("t is not null").withColumn("bucket", F.floor(F.col("t") / AROUND_SEAM))
    s = seams.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("at") / AROUND_SEAM) - 1, F.floor(F.col("at") / AROUND_SEAM) + 1)))
    near = s.join(t, ["recording_id", "bucket"]).where(F.abs(F.col("t") - F.col("at")) <= AROUND_SEAM)
    one = F.struct("seg_idx", F.col("t").cast("double").alias("t"), normalise(F.col("text")).alias("norm"), F.lower(F.regexp_replace(F.trim("speaker"), r"[\t-\r ]+", " ")).alias("who"), is_generic("speaker").alias("generic"))
    rows = near.groupBy("recording_id", "seam_idx", F.col("at").cast("double").alias("at")).agg(F.collect_list(one).alias("near"))
    found = ordered_fold(rows, ["seam_idx"], _Repair, "recording_id long, seam_idx long, kind string, seg_idx long, seconds double")
    found = found.join(seams.select("recording_id", "seam_idx", "at"), ["recording_id", "seam_idx"]).join(segments.select(*_KEYS, "text"), _KEYS, "left")
    at = format_timestamp(F.col("at"))
    note = F.when(F.col("kind") == "duplicate", F.concat(F.lit("Removed duplicate overlap near chunk boundary "), at, F.lit(": "), "text")).otherwise(F.concat(F.lit("Large gap near chunk boundary "), at, F.format_string(": %ds between adjacent segments.", F.round("seconds").cast("long"))))
    return found.select("recording_id", "seam_idx", "kind", "seg_idx", "seconds", note.alias("note"))


def repaired(segments: DataFrame, seams: DataFrame) -> DataFrame:
    """segments without those that seam_repairs drops."""
    return segments.join(seam_repairs(segments, seams).where("kind = 'duplicate'").select(*_KEYS), _KEYS, "left_anti")


def chunk_seams(chunks: DataFrame) -> DataFrame:
    """recording_id, seam_idx, at (seconds), label of the next chunk: the end of every chunk but the last."""
    order = Window.partitionBy("recording_id").orderBy("chunk_idx")
    rows = chunks.withColumns({"more": F.lead("chunk_idx").over(order).isNotNull(), "i": F.row_number().over(order), "n": F.count(F.lit(1)).over(Window.partitionBy("recording_id"))})
    return rows.where("more").select("recording_id", F.col("chunk_idx").alias("seam_idx"), (F.col("end_ms") / 1000).alias("at"), F.format_string("chunk %d of %d", "i", "n").alias("label"))


def gap_markers(chunks: DataFrame, segments: DataFrame) -> DataFrame:
    """A marker for each chunk (recording_id, chunk_idx, start_ms) without a segment: timestamp, speaker, text."""
    order = Window.partitionBy("recording_id").orderBy("chunk_idx")
    label = F.format_string("chunk %d of %d", F.row_number().over(order), F.count(F.lit(1)).over(Window.partitionBy("recording_id")))
    empty = chunks.withColumn("label", label).join(segments.select("recording_id", "chunk_idx"), ["recording_id", "chunk_idx"], "left_anti")
    return empty.select("recording_id", "chunk_idx", format_timestamp(F.col("start_ms") / 1000).alias("timestamp"), F.lit("Untranscribed").alias("speaker"), F.concat(F.lit("[no transcript produced for "), "label", F.lit("]")).alias("text"))


def consistent_speakers(segments: DataFrame, preserve: bool) -> DataFrame:
    """Labels made alike: numbered generic ones stay, names stay if preserve, all others become `Speaker N` by first appearance."""
    name = trimmed(F.coalesce("speaker", F.lit("")))
    rows = segments.withColumns({"speaker": name})
    if preserve:
        return rows
    generic = F.startswith(F.lower(F.col("speaker")), F.lit("speaker")) & F.col("speaker").rlike("[0-9]")
    first = rows.where(~generic).groupBy("recording_id", "speaker").agg(F.min("seg_idx").alias("first"))
    ranks = first.select("recording_id", "speaker", F.format_string("Speaker %d", F.row_number().over(Window.partitionBy("recording_id").orderBy("first"))).alias("label"))
    return rows.join(ranks, ["recording_id", "speaker"], "left").withColumn("speaker", F.coalesce("label", "speaker")).drop("label").select(*segments.columns)


# ---------------------------------------------------------------- provenance


def span_id(idx: Column) -> Column:
    return F.format_string("span_%04d", idx)


def owning_spans(final: DataFrame, parts: DataFrame, spans: DataFrame) -> DataFrame:
    """recording_id, seg_idx, span_idx of each final segment: the first span whose segments hold its timestamp and text,
    else the first whose time holds it, up to BEYOND seconds behind; null where there is none.

    parts: recording_id, span_idx, timestamp, text of the spans' own segments.  An unreadable timestamp counts as 0.
    Spans are joined by buckets of a minute.
    """
    exact = parts.groupBy("recording_id", "timestamp", "text").agg(F.min("span_idx").alias("exact"))
    rows = final.select(*_KEYS, "timestamp", "text").withColumn("t", F.coalesce(parse_timestamp(F.col("timestamp")), F.lit(0)))
    minute = lambda c: F.floor(c / 60)
    times = spans.select("recording_id", "span_idx", (F.col("start_ms") / 1000).alias("lo"), (F.col("end_ms") / 1000 + BEYOND).alias("hi"))
    times = times.withColumn("minute", F.explode(F.sequence(minute(F.col("lo")), minute(F.col("hi")))))
    held = rows.select(*_KEYS, "t", minute(F.col("t")).alias("minute")).join(times, ["recording_id", "minute"]).where((F.col("t") >= F.col("lo")) & (F.col("t") <= F.col("hi")))
    held = held.groupBy(*_KEYS).agg(F.min("span_idx").alias("held"))
    return rows.join(exact, ["recording_id", "timestamp", "text"], "left").join(held, _KEYS, "left").select(*_KEYS, F.coalesce("exact", "held").alias("span_idx"))


def span_evidence(final: DataFrame, parts: DataFrame, spans: DataFrame) -> DataFrame:
    """Per final segment: span_id, sources, attempts, disputed, notes, review.

    spans also have candidate_ids (array) chosen, attempted (array) candidate ids, disagreement, reasons (array),
    method and state.  review is the reason why a person must look, or null.
    """
    ids = F.coalesce("candidate_ids", F.array().cast("array<string>"))
    attempts = F.transform(F.filter("attempted", lambda a: F.array_contains(F.col("sources"), a)), lambda a: F.concat("span_id", F.lit(":"), a, F.lit(":1")))
    rows = owning_spans(final, parts, spans).join(spans, ["recording_id", "span_idx"], "left").withColumns({"span_id": span_id(F.col("span_idx")), "sources": ids})
    none = F.col("span_idx").isNull()
    poor = F.startswith(F.col("method"), F.lit("fallback_")) | (F.col("state") == "degraded")
    empty = F.array().cast("array<string>")
    return rows.select(
        *_KEYS, F.when(~none, F.col("span_id")).alias("span_id"), F.when(none, empty).otherwise(F.col("sources")).alias("sources"), F.when(none, empty).otherwise(F.coalesce(attempts, empty)).alias("attempts"),
        F.coalesce(F.col("disagreement") > DISAGREE, none).alias("disputed"),
        F.when(none, F.array(F.lit("No span provenance covers this timestamp."))).otherwise(F.coalesce("reasons", empty)).alias("notes"),
        F.when(none, F.format_string("Segment %d has no span provenance.", "seg_idx")).when(poor, F.concat("span_id", F.lit(" used "), "method", F.lit("."))).alias("review"),
    )


def provenance_disputes(evidence: DataFrame) -> DataFrame:
    """Runs of neighbouring segments whose span was disputed, as judged."""
    return dispute_islands(evidence.where("span_id is not null").withColumn("status", F.lit("adjudicated")))


def human_review(evidence: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """recording_id, status, reasons: required if any segment, or a row of extra (recording_id, review), gives a reason; reasons once each, in order."""
    rows = evidence.select("recording_id", F.col("seg_idx").cast("long").alias("at"), "review")
    if extra is not None:
        rows = rows.unionByName(extra.select("recording_id", F.lit(1 << 62).alias("at"), "review"))
    first = rows.where("review is not null").groupBy("recording_id", "review").agg(F.min("at").alias("at"))
    reasons = first.groupBy("recording_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "review"))), lambda x: x["review"]).alias("reasons"))
    return rows.select("recording_id").distinct().join(reasons, "recording_id", "left").select("recording_id", F.when(F.col("reasons").isNull(), "not_required").otherwise("required").alias("status"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))


def run_status(terminal: Column, review: Column) -> Column:
    """The status that a run ends with: canceled, then failed, then a required review, then completed."""
    return F.when(terminal.isin("canceled", "failed"), terminal).when(review == "required", "review_required").otherwise("completed")


def span_evaluation(spans: DataFrame) -> DataFrame:
    """recording_id, span_idx, severity, needs_evidence, reasons of spans with n_valid, quality, times, advice, disagreement.

    times and advice are the score and recommendation of the first valid candidate's timestamps; disagreement is 1 less
    the word similarity of the first two.
    """
    short = lambda c, limit: F.greatest(F.lit(0.0), (limit - F.coalesce(c, F.lit(0))) / limit)
    valid = F.col("n_valid") > 0
    apart = F.coalesce(F.when(F.col("n_valid") > 1, F.col("disagreement")), F.lit(0.0))
    severity = F.when(valid, F.greatest(short(F.col("quality"), LEAST_QUALITY), short(F.col("times"), LEAST_TIMES), apart)).otherwise(1.0)
    advice = F.when(F.col("advice") == "optional", F.format_string("Timestamps acceptable but could improve (score: %d)", "times")).when(F.col("advice") == "fix", F.format_string("Timestamps need correction (score: %d)", "times"))
    reasons = F.array_compact(F.array(F.when(F.coalesce("quality", F.lit(0)) < LEAST_QUALITY, "Primary quality score is below the evidence threshold."), advice, F.when(apart > DISAGREE, "Independent candidates materially disagree.")))
    return spans.select("recording_id", "span_idx", severity.alias("severity"), (severity > 0).alias("needs_evidence"), F.when(valid, reasons).otherwise(F.array(F.lit("No valid candidate completed for this span."))).alias("reasons"))


def span_audit(spans: DataFrame) -> DataFrame:
    """Attempts and state transitions of spans (attempted, n_segments by attempt, method, degraded, rejudges).

    Returns recording_id, span_idx, span_id, attempts (id and status), transitions (`from>to`), state.
    """
    sid = span_id(F.col("span_idx"))
    attempts = F.transform("attempted", lambda a, i: F.struct(F.concat(sid, F.lit(":"), a, F.lit(":1")).alias("id"), F.when(F.element_at("n_segments", i + 1) > 0, "completed").otherwise("failed").alias("status")))
    last = F.when(F.col("degraded"), "degraded").otherwise("judged")
    path = F.array_compact(F.array(F.lit("planned"), F.lit("primary_complete"), F.when(F.size("attempted") > 1, "evidence_complete"), last, F.when((F.col("rejudges") > 0) & ~F.col("degraded"), "rejudged")))
    steps = F.transform(F.slice(path, F.lit(2), F.size(path)), lambda to, i: F.concat(F.element_at(path, i + 1), F.lit(">"), to))
    return spans.select("recording_id", "span_idx", sid.alias("span_id"), attempts.alias("attempts"), steps.alias("transitions"), F.element_at(path, -1).alias("state"))


def tool_usage(calls: DataFrame) -> DataFrame:
    """recording_id, name, count, rank of tool calls (recording_id, pos, name, count): summed by name; rank by first use."""
    rows = calls.where("name != '' and count != 0").groupBy("recording_id", "name").agg(F.sum("count").alias("count"), F.min("pos").alias("first"))
    return rows.select("recording_id", "name", "count", F.row_number().over(Window.partitionBy("recording_id").orderBy("first")).alias("rank"))


def ordered_distinct(rows: DataFrame, value: str, blanks: bool = False) -> DataFrame:
    """recording_id, pos, value: the first of equal values of each recording (recording_id, pos), trimmed and without blanks unless blanks."""
    if not blanks:
        rows = rows.withColumn(value, trimmed(F.col(value))).where(F.col(value) != "")
    return rows.groupBy("recording_id", value).agg(F.min("pos").alias("pos")).select("recording_id", "pos", value)


def merged_candidates(candidates: DataFrame) -> DataFrame:
    """Each candidate's segments over all spans as one list, without rows that a span repeats from the one before."""
    from .folds import merge_chunks

    rows = candidates.select("recording_id", "candidate_id", F.col("span_idx").alias("chunk_idx"), "seg_idx", "speaker", "text", "timestamp")
    merged = merge_chunks(rows, ("recording_id", "candidate_id"))
    return merged.select("recording_id", "candidate_id", "seg_idx", F.col("chunk_idx").alias("span_idx"), "speaker", "text", "timestamp")


def ends_of(units: DataFrame) -> DataFrame:
    """recording_id, first_text, last_text, first_ms, last_ms: the first and last timed unit of each recording by unit_idx."""
    timed = units.where("not coalesce(untimed, false)")
    return timed.groupBy("recording_id").agg(F.min_by("text", "unit_idx").alias("first_text"), F.max_by("text", "unit_idx").alias("last_text"), F.min_by("start_ms", "unit_idx").alias("first_ms"), F.max_by("start_ms", "unit_idx").alias("last_ms"))


def disagreement(similarity: Column) -> Column:
    """Whether two candidates of this word similarity differ so that evidence is asked for."""
    return similarity < CANDIDATES_DIFFER


def zipped(results: DataFrame, units: DataFrame) -> DataFrame:
    """Results and units of a recording side by side by index: recording_id, idx, has_result, has_unit, fits (equal in number)."""
    r = results.select("recording_id", "idx", F.lit(True).alias("has_result"))
    u = units.select("recording_id", "idx", F.lit(True).alias("has_unit"))
    both = r.join(u, ["recording_id", "idx"], "full").na.fill(False)
    return both.withColumn("fits", F.bool_and(F.col("has_result") & F.col("has_unit")).over(Window.partitionBy("recording_id")))
