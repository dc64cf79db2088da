"""Support and disputes of final segments among candidate transcripts, timestamp scores and escalation.

Joins in time carry the recording and a time bucket as equality keys, so that a long recording is spread over
tasks and no pair outside neighbouring buckets is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalise
from ..functions.timecode import parse_timestamp
from . import quality

# fixed values: reach in seconds, and the limits of support, disagreement and acceptance
REACH, SUPPORTED, TEXTS_DIFFER, CANDIDATES_DIFFER, LEAST_QUALITY, LEAST_TIMES, CONFIDENT = 8, 0.55, 0.72, 0.82, 78, 85, 0.75
WORD_TOLERANCE_MS, TURN_TOLERANCE_MS = 400, 1000
#: Time of a bucket of joins in time, in seconds; of overlaps of chunks, in milliseconds.
BUCKET, LAP_MS = 8 * REACH, 5000
_KEYS = ["recording_id", "seg_idx"]


def is_generic(speaker: str) -> Column:
    """Whether a label is `Speaker` and a number."""
    return F.trim(speaker).rlike(r"^(?i:speaker)[\t\n\f\r ]*[0-9]+\z")


def _by_time():
    return Window.partitionBy("recording_id").orderBy("seg_idx")


def numbered_words(seg: DataFrame) -> DataFrame:
    """seg with ws: the ASCII words of each text, those that repeat numbered, so that a set intersection counts as of bags."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.array_sort(F.filter(F.split(F.regexp_replace(F.coalesce(low, F.lit("")), "[^a-z0-9 ]", " "), " +"), lambda w: w != ""))
    seg = seg.withColumn("ws", words)
    # sorted words lie in runs; each is read at its start and numbered from 0
    places = F.sequence(F.lit(0), F.size("ws") - 1)
    starts = F.when(F.size("ws") > 0, F.filter(places, lambda i: (i == 0) | (F.get("ws", i) != F.get("ws", i - 1)))).otherwise(F.array().cast("array<int>"))
    seg = seg.withColumn("starts", F.concat(starts, F.array(F.size("ws"))))
    runs = F.transform(F.slice("starts", 1, F.size("starts") - 1), lambda at, k: F.transform(F.sequence(F.lit(0), F.get("starts", k + 1) - at - 1), lambda n: F.concat_ws(" ", F.get("ws", at), n.cast("string"))))
    return seg.withColumn("ws", F.flatten(runs)).drop("starts")


def bag_similarity(a: Column, b: Column) -> Column:
    """Multiset Jaccard of two arrays of numbered words; 1 where both are empty."""
    rate = lambda both: both / (F.size(a) + F.size(b) - both)
    return F.when(a == b, 1.0).otherwise(rate(F.size(F.array_intersect(a, b))))


def _matched(final: DataFrame, candidates: DataFrame, *carried: str) -> DataFrame:
    """best_matches with bucket and the carried columns of final; a segment without a match is one row without candidate_id.

    A final segment lies in one wide bucket, a candidate's in its own and, near the bound, the next: texts are shuffled
    once, their words are made after that, and all groups of a segment are found where its bucket is.
    """
    bucket = lambda c: F.floor(c / BUCKET)
    one = final.select(*_KEYS, *carried, "text", F.coalesce(parse_timestamp(F.col("timestamp")), F.lit(0)).alias("t")).withColumn("bucket", bucket(F.col("t"))).repartition("recording_id", "bucket")
    one = numbered_words(one).drop("text").withColumnRenamed("ws", "own")
    two = candidates.select(F.col("recording_id").alias("of"), F.col("seg_idx").alias("match_idx"), "candidate_id", "text", parse_timestamp(F.col("timestamp")).alias("u")).where("u is not null")
    two = two.withColumn("home", F.explode(F.sequence(bucket(F.col("u") - REACH), bucket(F.col("u") + REACH)))).repartition("of", "home")
    two = numbered_words(two).drop("text")
    near = one.join(two, (F.col("recording_id") == F.col("of")) & (F.col("bucket") == F.col("home")) & (F.abs(F.col("t") - F.col("u")) <= REACH), "left")
    rated = near.withColumn("similarity", bag_similarity(F.col("own"), F.col("ws")))
    best = F.min_by(F.struct("match_idx", "similarity", "ws"), F.struct(-F.col("similarity"), F.abs(F.col("t") - F.col("u")), "match_idx"))
    return rated.groupBy("recording_id", "bucket", "seg_idx", "candidate_id").agg(best.alias("m"), *(F.first(c).alias(c) for c in carried)).select(*_KEYS, "bucket", *carried, "candidate_id", "m.*")


def best_matches(final: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per final segment and candidate_id the candidate's segment within REACH seconds that is worded most like it.

    Returns recording_id, seg_idx, candidate_id, match_idx, similarity, ws.  Ties go to the nearer, then the earlier
    segment.  Segments whose timestamp cannot be read match nothing; a final one counts as at 0.
    """
    return _matched(final, candidates).where("candidate_id is not null").drop("bucket")


def run_evidence(final: DataFrame, candidates: DataFrame, selected: tuple[str, ...] = ()) -> DataFrame:
    """Per final segment: sources (candidate ids, comma-joined, sorted), disputed, status, supported.

    Disputed: two candidates' matches differ.  Its status is adjudicated if a selected candidate (any, if none is
    named) is among the sources, else review_required; a segment that is not disputed is adjudicated.
    Candidates are a handful of alternatives for each recording, so those of one segment fit a row.
    """
    found = _matched(final.withColumn("location", review_location()), candidates, "timestamp", "location").groupBy("recording_id", "bucket", "seg_idx").agg(
        F.array_sort(F.collect_list(F.when(F.col("similarity") >= SUPPORTED, F.col("candidate_id")))).alias("ids"), F.collect_list("ws").alias("texts"), F.first("timestamp").alias("timestamp"), F.first("location").alias("location")
    )
    later = lambda i: F.slice("texts", i + 2, F.size("texts"))
    pairs = F.flatten(F.transform("texts", lambda x, i: F.transform(later(i), lambda y: bag_similarity(x, y) < TEXTS_DIFFER)))
    differ = F.exists(pairs, lambda x: x)
    ids = F.col("ids")
    chosen = F.arrays_overlap(ids, F.array(*map(F.lit, selected))) if selected else F.size(ids) > 0
    disputed = F.coalesce(differ, F.lit(False))
    return found.select(*_KEYS, "timestamp", F.array_join(ids, ",").alias("sources"), (F.size(ids) > 0).alias("supported"), disputed.alias("disputed"), F.when(disputed & ~chosen, "review_required").otherwise("adjudicated").alias("status"), "location")


def review_location() -> Column:
    """Timestamp, speaker and the first ten words of a segment, for a reviewer."""
    ws = F.filter(F.split("text", r"[\t-\r ]+"), lambda w: w != "")
    return F.concat("timestamp", F.lit(" "), "speaker", F.lit(": “"), F.array_join(F.slice(ws, 1, 10), " "), F.when(F.size(ws) > 10, "…").otherwise(""), F.lit("”"))


def dispute_islands(evidence: DataFrame) -> DataFrame:
    """Runs of neighbouring disputed segments of one status: recording_id, first_idx, last_idx, status, n."""
    d = evidence.where("disputed").select(*_KEYS, "status")
    fresh = ~F.coalesce((F.lag("seg_idx").over(_by_time()) == F.col("seg_idx") - 1) & (F.lag("status").over(_by_time()) == F.col("status")), F.lit(False))
    d = d.withColumn("fresh", fresh.cast("int")).withColumn("island", F.sum("fresh").over(_by_time()))
    return d.groupBy("recording_id", "island").agg(F.min("seg_idx").alias("first_idx"), F.max("seg_idx").alias("last_idx"), F.first("status").alias("status"), F.count(F.lit(1)).alias("n")).drop("island")


def candidates_disagree(candidates: DataFrame) -> DataFrame:
    """Per recording the least word similarity of two candidates' whole texts, and whether it is below the limit."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    each = candidates.select("recording_id", "candidate_id", F.explode(F.split(F.regexp_replace(low, "[^a-z0-9 ]", " "), " +")).alias("w")).where("w != ''")
    bags = each.groupBy("recording_id", "candidate_id", "w").agg(F.count(F.lit(1)).alias("n"))
    totals = bags.groupBy("recording_id", "candidate_id").agg(F.sum("n").alias("n"))
    all_ = candidates.select("recording_id", "candidate_id").distinct().join(totals, ["recording_id", "candidate_id"], "left").na.fill(0, ["n"])
    pairs = all_.toDF("recording_id", "a", "na").join(all_.toDF("recording_id", "b", "nb"), "recording_id").where("a < b")
    shared = bags.toDF("recording_id", "a", "w", "x").join(bags.toDF("recording_id", "b", "w", "y"), ["recording_id", "w"]).where("a < b").groupBy("recording_id", "a", "b").agg(F.sum(F.least("x", "y")).alias("shared"))
    s = F.coalesce("shared", F.lit(0))
    similarity = F.when(F.col("na") + F.col("nb") == 0, 1.0).otherwise(s / F.greatest(F.col("na") + F.col("nb") - s, F.lit(1)))
    least = pairs.join(shared, ["recording_id", "a", "b"], "left").groupBy("recording_id").agg(F.round(F.min(similarity), 6).alias("similarity"))
    return least.withColumn("disagree", F.col("similarity") < CANDIDATES_DIFFER)


def timestamp_quality(seg: DataFrame) -> DataFrame:
    """Per recording: score of its timestamps from 0 to 100, back_steps, irregular, recommendation (skip, optional, fix).

    A timestamp that cannot be read counts as 0; recordings under 30 s score 80 and are skipped.
    """
    t = seg.select(*_KEYS, "end", F.coalesce(parse_timestamp(F.col("timestamp")), F.lit(0)).alias("t"))
    t = t.withColumn("gap", F.col("t") - F.lag("t").over(_by_time()))
    means = t.groupBy("recording_id").agg(F.avg("gap").alias("mean"), F.count("gap").alias("n_gaps"), F.max("t").alias("reach"), F.max("end").alias("dur"), F.count_if(F.col("gap") < 0).alias("back_steps"))
    odd = t.join(means.select("recording_id", "mean"), "recording_id").groupBy("recording_id").agg(F.count_if((F.col("gap") < 0) | (F.col("gap") > 3 * F.col("mean"))).alias("irregular"))
    g = means.join(odd, "recording_id")
    minus = lambda cond, by: F.when(cond, by).otherwise(0)
    cover = F.col("reach") / F.greatest(F.col("dur"), F.lit(1e-9)) * 100
    one = F.col("n_gaps") == 0
    raw = 100 - minus(one, 25) - minus(one & (F.col("reach") <= 2), 25) - 15 * F.col("back_steps") - minus(F.col("irregular") * 5 > F.col("n_gaps"), 10) - minus(cover < 70, 15) - minus(cover > 110, 20)
    score = F.when(F.col("dur") < 30, 80).otherwise(F.greatest(F.least(raw, F.lit(100)), F.lit(0))).cast("long")
    advice = F.when((F.col("dur") < 30) | (F.col("score") >= LEAST_TIMES), "skip").when(F.col("score") >= 70, "optional").otherwise("fix")
    return g.withColumn("score", score).select("recording_id", "score", "back_steps", "irregular", advice.alias("recommendation"))


def timestamp_issues(seg: DataFrame) -> DataFrame:
    """recording_id, issues (array), reason: what timestamp_quality found wrong, in words."""
    order = _by_time()
    t = seg.select(*_KEYS, "end", F.coalesce(parse_timestamp(F.col("timestamp")), F.lit(0)).alias("t"))
    t = t.withColumns({"gap": F.col("t") - F.lag("t").over(order), "place": F.row_number().over(order) - 1})
    back = t.where("gap < 0").groupBy("recording_id").agg(F.array_sort(F.collect_list("place")).alias("back"))
    facts = t.groupBy("recording_id").agg(F.count("gap").alias("n_gaps"), F.max("t").alias("reach"), F.max("end").alias("dur"))
    q = timestamp_quality(seg).join(facts, "recording_id").join(back, "recording_id", "left")
    one, cover = F.col("n_gaps") == 0, F.col("reach") / F.greatest(F.col("dur"), F.lit(1e-9)) * 100
    steps = F.transform(F.coalesce("back", F.array().cast("array<int>")), lambda i: F.concat(F.lit("Non-monotonic at segment "), i.cast("string")))
    # rint: halves go to the even number, where %.0f alone takes them up
    others = F.array_compact(F.array(
        F.when(F.col("irregular") * 5 > F.col("n_gaps"), F.format_string("Irregular gaps: %.0f%% of segments", F.rint(F.col("irregular") / F.col("n_gaps") * 100))),
        F.when(cover < 70, F.format_string("Poor coverage: timestamps only reach %.0f%% of audio", F.rint(cover))).when(cover > 110, "Timestamp drift: timestamps exceed audio duration"),
    ))
    alone = F.array_compact(F.array(F.when(one, "Single-segment transcript may need forced alignment"), F.when(one & (F.col("reach") <= 2), "Single segment starts at the beginning of a long recording")))
    brief = F.col("dur") < 30
    score = F.col("score").cast("string")
    reason = (
        F.when(brief, "Audio too short (<30s), correction overhead not worth it").when(F.col("recommendation") == "skip", F.concat(F.lit("Timestamps look good (score: "), score, F.lit(")")))
        .when(F.col("recommendation") == "optional", F.concat(F.lit("Timestamps acceptable but could improve (score: "), score, F.lit(")"))).otherwise(F.concat(F.lit("Timestamps need correction (score: "), score, F.lit(")")))
    )
    return q.select("recording_id", F.when(brief, F.array().cast("array<string>")).otherwise(F.concat(alone, steps, others)).alias("issues"), reason.alias("reason"))


def evidence_notes(evidence: DataFrame) -> DataFrame:
    """Rows of run_evidence with notes (array) and review: why a person must look at the segment, or null."""
    notes = F.array_compact(F.array(F.when(~F.col("supported"), "No candidate strongly supports the final wording."), F.when(F.col("disputed"), "Candidate wording differs around this timestamp.")))
    none = F.concat("location", F.lit(": no candidate transcript supports this wording."))
    review = F.when(~F.col("supported"), none).when(F.col("status") == "review_required", F.concat("location", F.lit(": candidate transcripts disagree here.")))
    return evidence.withColumns({"notes": notes, "review": review})


def score_warnings(card: DataFrame, settings: quality.QualitySettings = quality.QualitySettings()) -> DataFrame:
    """Per row of a scorecard the warnings that its scores give, joined by `; `."""
    return card.select("recording_id", F.concat_ws("; ", *quality.score_warnings(settings)).alias("warnings"))


def escalation(seg: DataFrame, card: DataFrame) -> DataFrame:
    """Per recording the first reason to ask for more evidence - empty, quality, timestamps, confidence - or null.

    seg has a confidence; card has recording_id and overall.  A recording of card without segments is empty.
    """
    conf = seg.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n"), F.count("confidence").alias("known"), F.count_if(F.col("confidence") >= CONFIDENT).alias("sure"))
    g = card.select("recording_id", "overall").join(conf, "recording_id", "left").join(timestamp_quality(seg).select("recording_id", "score", "recommendation"), "recording_id", "left")
    reason = (
        F.when(F.col("n").isNull(), "empty").when(F.col("overall").isNull() | (F.col("overall") < LEAST_QUALITY), "quality").when(F.col("recommendation") != "skip", "timestamps")
        .when((F.col("known") * 2 >= F.col("n")) & (F.col("sure") * 4 < F.col("known") * 3), "confidence")
    )
    short = lambda c, limit: F.greatest(F.lit(0.0), (limit - F.coalesce(c, F.lit(0))) / limit)
    return g.select("recording_id", reason.alias("reason"), F.round(F.when(F.col("n").isNull(), 1.0).otherwise(F.greatest(short(F.col("overall"), LEAST_QUALITY), short(F.col("score"), LEAST_TIMES))), 6).alias("severity"))


def best_candidate(scores: DataFrame) -> DataFrame:
    """Per recording the candidate of the highest score; equal ones keep the earlier idx, null never beats a score."""
    best = F.max_by(F.struct("candidate_id", "score"), F.struct(F.coalesce("score", F.lit(float("-inf"))), -F.col("idx")))
    return scores.groupBy("recording_id").agg(best.alias("b")).select("recording_id", "b.candidate_id", "b.score")


def nearest_units(previous: DataFrame, current: DataFrame, spans: DataFrame, generic: bool = True) -> DataFrame:
    """For each unit in the overlap with the chunk before, that chunk's rendition of it: the nearest of equal text, else the nearest.

    previous (labels in use) and current (the chunk's own): recording_id, chunk_idx, unit_idx, text, speaker,
    start_ms, turn, untimed.  spans: recording_id, chunk_idx, start_ms, end_ms.  generic: only `Speaker N` labels of
    previous count.  Returns recording_id, chunk_idx, unit_idx, raw, label, match_idx.

    A join of both overlaps by a time bucket, in which each unit lies once and what may be near it in one or two.
    """
    order = Window.partitionBy("recording_id").orderBy("chunk_idx")
    keys = ["recording_id", "chunk_idx"]
    lap = spans.select(*keys, F.col("start_ms").alias("lo"), F.lag("end_ms").over(order).alias("hi")).where("hi is not null")
    now = current.where("not untimed and speaker != ''").join(lap, keys).where("start_ms >= lo and start_ms < hi")
    was = previous.where(~F.col("untimed") & (is_generic("speaker") if generic else F.lit(True))).withColumn("chunk_idx", F.col("chunk_idx") + 1).join(lap, keys).where((F.col("start_ms") >= F.col("lo") - TURN_TOLERANCE_MS) & (F.col("start_ms") < F.col("hi")))
    norm = F.coalesce(normalise(F.col("text")), F.lit("")).alias
    unit = now.select(*keys, "unit_idx", F.col("speaker").alias("raw"), F.col("start_ms").alias("at"), norm("norm"), F.when(F.col("turn"), TURN_TOLERANCE_MS).otherwise(WORD_TOLERANCE_MS).alias("tol"), "lo").withColumn("bucket", F.floor(F.col("at") / LAP_MS))
    known = was.select(*keys, F.col("unit_idx").alias("match_idx"), F.col("speaker").alias("label"), F.col("start_ms").alias("heard"), norm("known"))
    known = known.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("heard") - TURN_TOLERANCE_MS) / LAP_MS), F.floor((F.col("heard") + TURN_TOLERANCE_MS) / LAP_MS))))
    by = [*keys, "bucket"]
    far = F.abs(F.col("heard") - F.col("at"))
    # both sides are cut out of whole chunks: spread anew, they take no room beside what cut them
    near = unit.repartition(*by).join(known.repartition(*by), by).where((far <= F.col("tol")) & (F.col("heard") >= F.col("lo") - F.col("tol")))
    other = (F.col("norm") == "") | (F.col("norm") != F.col("known"))
    best = F.min(F.struct(other.alias("other"), far.alias("far"), "match_idx", "label"))
    return near.groupBy(*by, "unit_idx").agg(best.alias("m"), F.first("raw").alias("raw")).select(*keys, "unit_idx", "raw", "m.label", "m.match_idx")


def speaker_votes(nearest: DataFrame) -> DataFrame:
    """How many units of a chunk's own label were heard under each label in use."""
    return nearest.groupBy("recording_id", "chunk_idx", "raw", "label").agg(F.count(F.lit(1)).alias("votes"))


def span_digest(seg: DataFrame) -> DataFrame:
    """First and last segment of each recording, as `speaker: text`, and its last five as a context of lines."""
    line = F.concat("speaker", F.lit(": "), "text")
    last = seg.withColumn("back", F.row_number().over(Window.partitionBy("recording_id").orderBy(F.desc("seg_idx")))).where("back <= 5")
    tail = last.groupBy("recording_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", line.alias("line")))), lambda r: r["line"]), "\n").alias("context"))
    return seg.groupBy("recording_id").agg(F.min_by(line, "seg_idx").alias("head"), F.max_by(line, "seg_idx").alias("tail")).join(tail, "recording_id")


def playhead(seg: DataFrame, at: float) -> DataFrame:
    """The segment that plays at a second: the last with a start up to 0.05 s later, before the first that is later still."""
    late = F.min(F.when(F.col("start") > at + 0.05, F.col("seg_idx"))).over(Window.partitionBy("recording_id"))
    return seg.withColumn("late", late).where(F.col("late").isNull() | (F.col("seg_idx") < F.col("late"))).groupBy("recording_id").agg(F.max("seg_idx").alias("seg_idx"))
