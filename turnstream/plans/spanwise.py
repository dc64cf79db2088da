"""Queries of spans, seams and provenance, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timecode import format_timestamp
from ..operators import evidence, quality, rejudge, spans, timeline, tools
from ..sources.fixtures import segments, table

_KEYS = ("recording_id", "seg_idx")
_seg = lambda f: lambda s, d: f(segments(s, d))
_list = lambda c: F.array_join(c, ",")


def _spans(seg: DataFrame) -> DataFrame:
    return timeline.chunk_plan(seg).withColumnRenamed("chunk_idx", "span_idx").drop("boundary_type")


def _heard(seg: DataFrame) -> DataFrame:
    """Segments in each span of 20 s, every 15 s, in which they begin."""
    ms = F.round(F.col("start") * 1000).cast("long")
    rows = seg.withColumn("ms", ms).withColumn("span_idx", F.explode(F.array(F.expr("ms div 15000"), F.expr("ms div 15000 - 1"))))
    return rows.join(_spans(seg), ["recording_id", "span_idx"]).where("ms >= start_ms and ms < end_ms").drop("start_ms", "end_ms", "ms").withColumn("confidence", F.lit(0.5))


def _candidates(seg: DataFrame) -> DataFrame:
    """a: all; b: without some; c: some late by 30 s and some without a speaker."""
    rows = _heard(seg)
    late = F.when(F.col("seg_idx") % 5 == 0, format_timestamp(F.col("start") + 30)).otherwise(F.col("timestamp"))
    blank = F.when(F.col("seg_idx") % 11 == 3, " ").otherwise(F.col("speaker"))
    heard = lambda n, stamp, speaker: F.struct(F.lit(n).alias("candidate_id"), stamp.alias("timestamp"), speaker.alias("speaker"))
    plain = (F.col("timestamp"), F.col("speaker"))
    # one pass over the segments, not a union of three: a join must not rely on how a union of equal parts is partitioned
    each = F.array_compact(F.array(heard("a", *plain), F.when((F.col("recording_id") + F.col("seg_idx")) % 7 != 0, heard("b", *plain)), heard("c", late, blank)))
    return rows.withColumn("x", F.explode(each)).select(*(c for c in rows.columns if c not in ("timestamp", "speaker")), "x.*")


def _audio(seg: DataFrame) -> DataFrame:
    k = F.col("recording_id") % 3
    durations = seg.groupBy("recording_id").agg(F.max("end").alias("e")).select("recording_id", (F.when(k == 0, 0.5).when(k == 1, 0.0).otherwise(1.0) * F.col("e")).alias("duration"))
    return spans.audio_errors(seg.withColumn("confidence", F.lit(None).cast("double")), durations)


def _first_pass(seg: DataFrame) -> tuple[DataFrame, ...]:
    """What judging takes: decisions, decided segments, candidates, scores and spans."""
    found = _candidates(seg)
    s = F.col("span_idx")
    picks = F.when(s % 4 == 0, F.array(F.lit("a"), F.lit("zz"))).when(s % 4 == 1, F.array(F.lit("zz"))).when(s % 4 == 3, F.array(F.lit("b"), F.lit("b"), F.lit("a")))
    decisions = _spans(seg).select("recording_id", "span_idx", picks.alias("selected")).where("selected is not null")
    decided = found.where((F.col("candidate_id") == "a") & (s % 3 != 0)).drop("candidate_id").withColumn("timestamp", F.when(s % 8 == 4, format_timestamp(F.col("start") + 60)).otherwise(F.col("timestamp")))
    ids = F.explode(F.array(*(F.struct(F.lit(n).alias("candidate_id"), F.lit(i).alias("idx")) for i, n in enumerate("abc")))).alias("x")
    score = F.when((F.col("idx") == 1) & (s % 5 == 0), None).otherwise(70 + 5 * F.col("idx") - 10 * (F.col("idx") * s % 3))
    scores = _spans(seg).select("recording_id", "span_idx", ids).select("recording_id", "span_idx", "x.*").withColumn("score", score.cast("double"))
    return decisions, decided, found, scores, _spans(seg)


def _judged(seg: DataFrame) -> DataFrame:
    return spans.judged(*_first_pass(seg)).withColumn("candidate_ids", _list(F.col("candidate_ids")))


def _second_pass(seg: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reviews that name spans, some unknown and some beyond a budget of two; the judge then takes b, at times out of the span."""
    first = _first_pass(seg)
    _, _, found, scores, all_ = first
    k, s = F.col("recording_id") % 4, F.col("span_idx")
    ids = lambda *x: F.array(*(F.lit(f"span_{i:04d}") for i in x))
    verdict = F.when(k == 0, "pass").when(k == 3, "review_required").otherwise("rejudge")
    reviews = seg.select("recording_id").distinct().select("recording_id", verdict.alias("verdict"), F.when(k == 1, ids(0, 1)).when(k == 2, ids(1, 99, 2, 1, 3)).otherwise(F.array().cast("array<string>")).alias("span_ids"), F.when(k == 2, F.array(F.lit("seams"))).alias("reasons"))
    decisions = all_.select("recording_id", "span_idx", F.when(s % 3 == 1, F.array(F.lit("zz"))).otherwise(F.array(F.lit("b"))).alias("selected"))
    late = F.when((F.col("recording_id") + s) % 5 == 0, format_timestamp(F.col("start") + 60)).otherwise(F.col("timestamp"))
    decided = found.where("candidate_id = 'b'").drop("candidate_id").withColumn("timestamp", late)
    return rejudge.rejudged(spans.judged(*first), reviews, decisions, decided, found, scores, all_, 2)


def _calls(seg: DataFrame) -> DataFrame:
    """Up to five calls for each segment, by turn of every other segment."""
    n = (F.col("recording_id") + 2 * F.col("seg_idx")) % 6
    rows = seg.where("seg_idx % 2 = 0").select("recording_id", F.col("seg_idx").alias("turn"), F.explode(F.filter(F.sequence(F.lit(0), F.lit(4)), lambda i: i < n)).alias("pos"))
    k = (F.col("recording_id") + F.col("turn") + F.col("pos")) % 3
    name = F.when(k == 0, "timestamp_analysis").when(k == 1, "segment_count").otherwise("web_search")
    return rows.select("recording_id", "turn", "pos", name.alias("name"), F.array(F.when(F.col("pos") == 2, "x").otherwise("a")).alias("candidate_ids"))


def _tool_loop(seg: DataFrame) -> DataFrame:
    one = F.array(F.lit("a")).alias("candidate_ids")
    found = {
        "timestamp_analysis": evidence.timestamp_quality(seg).select("recording_id", one, F.to_json(F.struct("score", "recommendation")).alias("result")),
        "segment_count": seg.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n")).select("recording_id", one, F.to_json(F.struct("n")).alias("result")),
    }
    return tools.tool_loop(_calls(seg), found)


def _reviews(seg: DataFrame) -> DataFrame:
    k = F.col("recording_id") % 6
    verdict = F.when(k < 2, "pass").when(k < 5, "rejudge").otherwise("maybe")
    ids = F.when(k.isin(0, 2), F.array().cast("array<string>")).when(k == 4, F.array(F.lit("span_0000"), F.lit("span_9999"))).otherwise(F.array(F.lit("span_0000")))
    return spans.review_errors(seg.select("recording_id").distinct().select("recording_id", verdict.alias("verdict"), ids.alias("span_ids")), _spans(seg))


def _equal(seg: DataFrame) -> DataFrame:
    one = seg.withColumn("confidence", F.when(F.col("seg_idx") % 2 == 0, 0.5))
    k = (F.col("recording_id") * 31 + F.col("seg_idx")) % 10
    two = one.withColumn("confidence", F.when(k == 3, 0.25).otherwise(F.col("confidence"))).where((F.col("recording_id") % 9 != 0) | (F.col("seg_idx") != 1))
    return spans.segments_equal(one, two)


def _seams(seg: DataFrame) -> DataFrame:
    return spans.chunk_seams(timeline.chunk_plan(seg)).drop("label")


def _doubled(seg: DataFrame) -> DataFrame:
    """Every segment, and a copy of it two seconds later under a numbered label."""
    first = seg.withColumn("seg_idx", F.col("seg_idx") * 2)
    again = seg.withColumns({"seg_idx": F.col("seg_idx") * 2 + 1, "speaker": F.lit("Speaker 7"), "timestamp": format_timestamp(F.col("start") + 2)})
    return first.unionByName(again)


def _far_seams(seg: DataFrame) -> DataFrame:
    return spans.chunk_seams(timeline.chunk_plan(seg, 120_000, 5_000)).drop("label")


def _gaps(seg: DataFrame) -> DataFrame:
    chunks = timeline.chunk_plan(seg)
    return spans.gap_markers(chunks, _heard(seg).where("seg_idx % 3 != 1").withColumnRenamed("span_idx", "chunk_idx"))


def _labelled(seg: DataFrame) -> DataFrame:
    k = F.col("seg_idx") % 5
    return seg.withColumn("speaker", F.when(k == 1, "Speaker 9").when(k == 2, F.concat(F.lit(" "), "speaker", F.lit(" "))).when(k == 4, "speaker x").otherwise(F.col("speaker")))


def _owned(seg: DataFrame) -> DataFrame:
    return spans.owning_spans(seg, _heard(seg).where("span_idx % 2 = 1"), _spans(seg).where("span_idx % 5 != 4"))


def _evidence(seg: DataFrame) -> DataFrame:
    s = F.col("span_idx")
    rows = _spans(seg).where("span_idx % 5 != 4").withColumns({
        "candidate_ids": F.when(s % 2 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("b"), F.lit("c"))), "attempted": F.array(F.lit("a"), F.lit("b")),
        "disagreement": s % 4 / 10.0, "reasons": F.when(s % 3 == 0, F.array(F.lit("r"))), "method": F.when(s % 6 == 1, "fallback_x").otherwise("model"), "state": F.when(s % 7 == 2, "degraded").otherwise("judged"),
    })
    return spans.span_evidence(seg, _heard(seg).where("span_idx % 2 = 1"), rows)


def _reviewed(seg: DataFrame) -> DataFrame:
    extra = seg.select("recording_id").distinct().where("recording_id % 4 = 0").withColumn("review", F.lit("global"))
    found = spans.human_review(_evidence(seg), extra)
    terminal = F.when(F.col("recording_id") % 10 == 0, "canceled").when(F.col("recording_id") % 10 == 1, "failed").otherwise("completed")
    return found.select("recording_id", F.col("status").alias("review"), F.size("reasons").cast("long").alias("n_reasons"), F.element_at("reasons", F.when(F.size("reasons") > 0, F.lit(1))).alias("first_reason"), spans.run_status(terminal, F.col("status")).alias("status"))


def _evaluated(seg: DataFrame) -> DataFrame:
    k = F.col("recording_id") + F.col("span_idx")
    rows = _spans(seg).withColumns({"n_valid": k % 3, "quality": F.when(k % 5 != 0, (k % 50 + 50).cast("double")), "times": (k % 40 + 60).cast("long"), "disagreement": k % 10 / 20.0})
    rows = rows.withColumn("advice", F.when(F.col("times") >= 85, "skip").when(F.col("times") >= 70, "optional").otherwise("fix"))
    return spans.span_evaluation(rows).select("recording_id", "span_idx", F.round("severity", 6).alias("severity"), "needs_evidence", F.array_join("reasons", "; ").alias("reasons"))


def _audited(seg: DataFrame) -> DataFrame:
    k = F.col("recording_id") + F.col("span_idx")
    rows = _spans(seg).withColumns({"attempted": F.when(k % 2 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))), "n_segments": F.array(F.lit(3), (k % 3).cast("int")), "degraded": k % 5 == 0, "rejudges": (k % 4 == 0).cast("int")})
    out = spans.span_audit(rows)
    return out.select("recording_id", "span_idx", "span_id", _list(F.transform("attempts", lambda a: F.concat_ws(" ", a["id"], a["status"]))).alias("attempts"), _list(F.col("transitions")).alias("transitions"), "state")


def _tools(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("recording_id"), F.col("event_id").alias("pos"), F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("name"), (F.col("event_id") % 3).alias("count"))
    return spans.tool_usage(rows).withColumn("rank", F.col("rank").cast("long"))


def _distinct_notes(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("recording_id"), F.col("event_id").alias("pos"), F.when(F.col("event_id") % 4 == 0, " ").otherwise(F.concat(F.lit(" "), "event_type")).alias("note"))
    return spans.ordered_distinct(rows, "note")


def _merged(seg: DataFrame) -> DataFrame:
    """Of candidates a and b heard in spans that share one segment with the next, each segment once."""
    k = F.col("seg_idx")
    rows = seg.withColumn("span_idx", F.explode(F.filter(F.array(F.floor(k / 2), F.floor(k / 2) - 1), lambda c: (c >= 0) & (c * 2 + 2 >= k))))
    both = rows.withColumn("candidate_id", F.lit("a")).unionByName(rows.where("recording_id % 2 = 0").withColumn("candidate_id", F.lit("b")))
    return spans.merged_candidates(both).select("recording_id", "candidate_id", "seg_idx", "speaker", "text", "timestamp")


def _unit_ends(seg: DataFrame) -> DataFrame:
    units = seg.select("recording_id", F.col("seg_idx").alias("unit_idx"), "text", F.round(F.col("start") * 1000).cast("long").alias("start_ms"), (F.col("seg_idx") % 4 == 0).alias("untimed"))
    return spans.ends_of(units)


def _zip(seg: DataFrame) -> DataFrame:
    a = seg.select("recording_id", F.col("seg_idx").alias("idx"))
    return spans.zipped(a.where("recording_id % 3 != 0 or idx != 1"), a.where("recording_id % 5 != 0 or idx != 2"))


def _flawed(seg: DataFrame) -> DataFrame:
    """Segments with unreadable timestamps, gap markers and padded labels."""
    k = (F.col("recording_id") * 31 + F.col("seg_idx")) % 20
    return seg.withColumns({
        "timestamp": F.when(k == 3, "bad").when((F.col("recording_id") % 11 == 5), "0:1").otherwise(F.col("timestamp")),
        "speaker": F.when(k == 7, "Untranscribed").when(k == 9, F.concat(F.lit(" "), "speaker", F.lit(" "))).otherwise(F.col("speaker")),
    })


def _report(seg: DataFrame) -> DataFrame:
    r = F.col("recording_id")
    recordings = seg.groupBy("recording_id").agg(F.max("end").alias("e")).select("recording_id", F.when(r % 7 == 0, 0.0).when(r % 7 == 1, F.lit(None)).otherwise(F.col("e")).alias("duration"))
    more = recordings.select((r + 1_000_000).alias("recording_id"), "duration").where("recording_id % 10 = 0")
    out = quality.quality_report(_flawed(seg), recordings.unionByName(more))
    return out.select("recording_id", "score", "n_gaps", F.array_join(F.transform("issues", lambda x: F.concat_ws(": ", x["code"], x["message"])), "; ").alias("issues"), F.array_join("warnings", "; ").alias("warnings"))


QUERIES = {
    "q_span_errors": _seg(lambda x: spans.span_errors(_candidates(x), _spans(x))),
    "q_valid_candidates": _seg(lambda x: spans.valid_candidates(_candidates(x), _spans(x)).select("recording_id", "span_idx", "candidate_id", "seg_idx", "timestamp")),
    "q_audio_errors": _seg(_audio),
    "q_judged_spans": _seg(_judged),
    "q_review_errors": _seg(_reviews),
    "q_rejudged_spans": _seg(lambda x: _second_pass(x)[0].withColumn("candidate_ids", _list(F.col("candidate_ids")))),
    "q_rejudged_reviews": _seg(lambda x: _second_pass(x)[1].withColumn("reasons", F.array_join("reasons", "; "))),
    "q_tool_loop": _seg(_tool_loop),
    "q_segments_equal": _seg(_equal),
    "q_around_seams": _seg(lambda x: spans.around_seams(x, _seams(x), spans.NEAR_SEAM).select("recording_id", "seam_idx", F.col("before.seg_idx").alias("before_idx"), F.col("after.seg_idx").alias("after_idx"))),
    "q_seam_repairs": _seg(lambda x: spans.seam_repairs(_doubled(x), _far_seams(x))),
    "q_repaired": _seg(lambda x: spans.repaired(_doubled(x), _far_seams(x)).select(*_KEYS, "speaker", "timestamp")),
    "q_chunk_seams": _seg(lambda x: spans.chunk_seams(timeline.chunk_plan(x))),
    "q_gap_marker_rows": _seg(_gaps),
    "q_consistent_speakers": _seg(lambda x: spans.consistent_speakers(_labelled(x), False).select(*_KEYS, "speaker").withColumn("kept", F.lit(False)).unionByName(spans.consistent_speakers(_labelled(x), True).select(*_KEYS, "speaker").withColumn("kept", F.lit(True)))),
    "q_owning_spans": _seg(_owned),
    "q_span_evidence": _seg(lambda x: _evidence(x).select(*_KEYS, "span_id", _list(F.col("sources")).alias("sources"), _list(F.col("attempts")).alias("attempts"), "disputed", _list(F.col("notes")).alias("notes"), "review")),
    "q_provenance_disputes": _seg(lambda x: spans.provenance_disputes(_evidence(x))),
    "q_human_review": _seg(_reviewed),
    "q_span_evaluation": _seg(_evaluated),
    "q_span_audit": _seg(_audited),
    "q_tool_usage": _tools,
    "q_ordered_distinct": _distinct_notes,
    "q_merged_candidates": _seg(_merged),
    "q_unit_ends": _seg(_unit_ends),
    "q_zipped": _seg(_zip),
    "q_quality_report": _seg(_report),
    "q_generic_speakers": _seg(lambda x: _labelled(x).select(*_KEYS, spans.is_generic("speaker").alias("generic"))),
}


def card_sql(rel: str, ws: str) -> str:
    """CTEs ending in card: scores of rel (recording_id, seg_idx, speaker, text, t) against dur (recording_id, duration)."""
    space = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
    words = lambda c: f"list_filter(string_split_regex({c}, '{space}+'), lambda w: w <> '')"
    return f"""c_text AS (SELECT recording_id, string_agg(text, ' ' ORDER BY seg_idx) AS text, count(*) AS n_segments, count(t) AS parsed FROM {rel} GROUP BY 1),
c_parts AS (SELECT *, {words('lower(text)')} AS ws, list_filter(string_split_regex(text, '[.!?]+'), lambda s: NOT regexp_full_match(s, '{space}*')) AS ss FROM c_text),
c_spread AS (SELECT recording_id, stddev_samp(len({words('s')})) AS sd FROM (SELECT recording_id, unnest(ss) AS s FROM c_parts) GROUP BY 1),
c_times AS (SELECT recording_id, seg_idx, t, t - lag(t) OVER (PARTITION BY recording_id ORDER BY seg_idx) AS gap FROM {rel} WHERE t IS NOT NULL),
c_last AS (SELECT recording_id, max_by(t, seg_idx) AS last, coalesce(median(gap) FILTER (gap > 0), 0) AS mid FROM c_times GROUP BY 1),
c_who AS (SELECT recording_id, stddev_samp(c) / avg(c) AS cv, count(*) AS u FROM (SELECT recording_id, regexp_replace(speaker, '^{space}+|{space}+$', '', 'g') AS who, count(*) AS c FROM {rel} GROUP BY 1, 2) GROUP BY 1),
c_raw AS (SELECT p.recording_id, n_segments, u AS n_speakers, len(ws)::BIGINT AS n_words, len(ss)::BIGINT AS n_sentences, len(regexp_extract_all(text, '[.,;:!?]')) / greatest(strlen(text), 1) AS density,
  least(greatest(100 - 3 * abs(len(ws) / greatest(len(ss), 1) - 15), 0), 100) AS readability, CASE WHEN len(ss) > 1 THEN least(100, 10 * sd) WHEN len(ss) = 1 THEN 50 ELSE 0 END AS variety,
  least(100, 200 * len(list_distinct(ws)) / greatest(len(ws), 1)) AS vocabulary,
  CASE WHEN duration IS NULL OR duration <= 0 THEN parsed / n_segments * 100 WHEN parsed = 0 THEN 0 WHEN n_segments = 1 AND last = 0 THEN 100 ELSE least(greatest(least((last + mid) / duration * 100, 100), 0), parsed / n_segments * 100) END AS coverage,
  CASE WHEN u > 10 THEN greatest(0, 100 - 10 * (u - 10)) ELSE least(100, CASE WHEN u > 1 THEN greatest(0, 100 - 50 * cv) ELSE 100 END + 5 * (10 - u)) END AS consistency
  FROM c_parts p JOIN c_who USING (recording_id) LEFT JOIN c_last USING (recording_id) LEFT JOIN c_spread USING (recording_id) LEFT JOIN dur USING (recording_id)),
card AS (SELECT recording_id, n_segments, n_speakers, n_words, n_sentences, round(density, 4) AS density, round(readability, 4) AS readability, round(variety, 4) AS variety, round(vocabulary, 4) AS vocabulary, round(coverage, 4) AS coverage, round(consistency, 4) AS consistency,
  round(0.25::DOUBLE * readability + 0.15::DOUBLE * vocabulary + 0.15::DOUBLE * variety + 0.1::DOUBLE * greatest(0, 100 - 100 * density) + 0.1::DOUBLE * consistency + 0.25::DOUBLE * coverage, 4) AS overall FROM c_raw)"""


GRADE = "CASE WHEN overall >= 80 THEN 'Excellent' WHEN overall >= 60 THEN 'Good' WHEN overall >= 40 THEN 'Fair' ELSE 'Poor' END AS assessment"
WARNINGS = "CASE WHEN readability < 70 THEN printf('Low readability score: %.1f', round(readability, 1)) END, CASE WHEN vocabulary < 30 THEN printf('Low vocabulary richness: %.1f', round(vocabulary, 1)) END, CASE WHEN density > 0.15 THEN printf('High punctuation density: %.3f', round(density, 3)) END, CASE WHEN coverage < 80 THEN printf('Low timestamp coverage: %.1f%%', round(coverage, 1)) END"


def oracle(seg: str, plan: str, norm: str, ws: str) -> dict[str, str]:
    """The SQL of QUERIES."""
    stamp = lambda t: f"format('[{{:02d}}:{{:02d}}:{{:02d}}]', ({t}) // 3600, ({t}) // 60 % 60, ({t}) % 60)"
    heard = f"""{seg}, {plan}, h AS (SELECT s.recording_id, p.chunk_idx AS span_idx, start_ms, end_ms, seg_idx, speaker, text, floor(start)::BIGINT AS t FROM seg s JOIN plan p ON s.recording_id = p.recording_id AND round(start * 1000)::BIGINT >= start_ms AND round(start * 1000)::BIGINT < end_ms)"""
    cands = f"""{heard}, c AS (SELECT *, 'a' AS cid FROM h UNION ALL SELECT *, 'b' FROM h WHERE (recording_id + seg_idx) % 7 <> 0
  UNION ALL SELECT recording_id, span_idx, start_ms, end_ms, seg_idx, CASE WHEN seg_idx % 11 = 3 THEN ' ' ELSE speaker END, text, t + CASE WHEN seg_idx % 5 = 0 THEN 30 ELSE 0 END, 'c' FROM h)"""
    errors = """{0}p AS (SELECT *, row_number() OVER w - 1 AS place, lag(t) OVER w AS pt FROM {1} WINDOW w AS (PARTITION BY recording_id, span_idx, cid ORDER BY seg_idx)),
{0}e AS (SELECT recording_id, span_idx, cid, min_by(problem, place) FILTER (problem IS NOT NULL) AS error FROM (SELECT *, CASE WHEN trim(speaker) = '' THEN 'segment ' || place || ': speaker' WHEN t < start_ms // 1000 OR t > end_ms / 1000 + 5 THEN 'segment ' || place || ' timestamp ' || t || 's is outside span ' || (start_ms // 1000) || '-' || round(end_ms / 1000 + 5)::BIGINT
  WHEN t < pt THEN 'segment ' || place || ' timestamp is not monotonic' END AS problem FROM {0}p) GROUP BY 1, 2, 3)"""
    cerr = errors.format("c", "c")
    seams = "sm AS (SELECT recording_id, chunk_idx AS seam_idx, end_ms / 1000 AS seam_s FROM (SELECT *, lead(chunk_idx) OVER (PARTITION BY recording_id ORDER BY chunk_idx) AS nx FROM {0}) WHERE nx IS NOT NULL)"
    far = plan.replace("plan AS", "fplan AS").replace("20000", "120000").replace("15000", "115000")
    two = f"""{seg}, {far}, {seams.format('fplan')}, db AS (SELECT recording_id, seg_idx * 2 AS seg_idx, speaker, text, floor(start)::BIGINT AS t FROM seg UNION ALL SELECT recording_id, seg_idx * 2 + 1, 'Speaker 7', text, floor(start)::BIGINT + 2 FROM seg),
nr AS (SELECT sm.*, seg_idx, speaker, text, {norm} AS norm, t, abs(t - seam_s) AS far FROM sm JOIN db ON sm.recording_id = db.recording_id AND abs(t - seam_s) <= 60),
pk AS (SELECT recording_id, seam_idx, seam_s, arg_min(struct_pack(i := seg_idx, t := t, n := norm, s := speaker, x := text, d := far), far * 1000000 + seg_idx) FILTER (t <= seam_s) AS b, arg_min(struct_pack(i := seg_idx, t := t, n := norm, s := speaker, x := text, d := far), far * 1000000 + seg_idx) FILTER (t > seam_s) AS a FROM nr GROUP BY ALL),
rp AS (SELECT *, CASE WHEN b.d <= 12 AND a.d <= 12 AND a.n <> '' AND a.n = b.n AND (lower(a.s) = lower(b.s) OR a.s = 'Speaker 7' OR b.s = 'Speaker 7') THEN 'duplicate' WHEN a.t - b.t > 30 THEN 'gap' END AS kind FROM pk WHERE a IS NOT NULL AND b IS NOT NULL)"""
    spans5 = "sp AS (SELECT recording_id, chunk_idx AS span_idx, start_ms, end_ms FROM plan WHERE chunk_idx % 5 <> 4)"
    own = f"""{heard}, {spans5}, ow AS (SELECT s.recording_id, s.seg_idx, s.t, coalesce((SELECT min(span_idx) FROM h WHERE h.recording_id = s.recording_id AND h.t = s.t AND h.text = s.text AND span_idx % 2 = 1),
  (SELECT min(span_idx) FROM sp WHERE sp.recording_id = s.recording_id AND s.t >= start_ms / 1000 AND s.t <= end_ms / 1000 + 5)) AS span_idx FROM (SELECT *, floor(start)::BIGINT AS t FROM seg) s)"""
    ev = f"""{own}, ev AS (SELECT o.recording_id, o.seg_idx, CASE WHEN sp.span_idx IS NOT NULL THEN printf('span_%04d', o.span_idx) END AS span_id, o.span_idx, sp.span_idx IS NULL AS none, o.span_idx AS k FROM ow o LEFT JOIN sp USING (recording_id, span_idx)),
ee AS (SELECT recording_id, seg_idx, CASE WHEN k IS NULL THEN NULL ELSE printf('span_%04d', k) END AS span_id, CASE WHEN none THEN '' WHEN k % 2 = 0 THEN 'a' ELSE 'b,c' END AS sources,
  CASE WHEN none THEN '' WHEN k % 2 = 0 THEN span_id || ':a:1' ELSE span_id || ':b:1' END AS attempts, CASE WHEN none THEN k IS NULL ELSE k % 4 / 10.0::DOUBLE > 0.18 END AS disputed,
  CASE WHEN k IS NULL THEN 'No span provenance covers this timestamp.' WHEN NOT none AND k % 3 = 0 THEN 'r' ELSE '' END AS notes,
  CASE WHEN k IS NULL THEN 'Segment ' || seg_idx || ' has no span provenance.' WHEN NOT none AND (k % 6 = 1 OR k % 7 = 2) THEN span_id || ' used ' || CASE WHEN k % 6 = 1 THEN 'fallback_x' ELSE 'model' END || '.' END AS review FROM ev)"""
    label = "lb AS (SELECT recording_id, seg_idx, CASE seg_idx % 5 WHEN 1 THEN 'Speaker 9' WHEN 4 THEN 'speaker x' ELSE speaker END AS who FROM seg)"
    flawed = f"""fl AS (SELECT recording_id, seg_idx, CASE WHEN k = 7 THEN 'Untranscribed' WHEN k = 9 THEN chr(160) || speaker || ' ' ELSE speaker END AS speaker, text, k, CASE WHEN k = 3 OR recording_id % 11 = 5 THEN NULL ELSE floor(start)::BIGINT END AS t, "end" FROM (SELECT *, (recording_id * 31 + seg_idx) % 20 AS k FROM seg)),
dur AS (SELECT recording_id, CASE WHEN recording_id % 7 = 0 THEN 0.0 WHEN recording_id % 7 = 1 THEN NULL ELSE max("end") END AS duration FROM seg GROUP BY 1)"""
    k = "(recording_id + span_idx)"
    first = f"""{cands}, {cerr}, j AS (SELECT recording_id, span_idx, start_ms, end_ms, seg_idx, speaker, t + CASE WHEN span_idx % 8 = 4 THEN 60 ELSE 0 END AS t, 'judge' AS cid FROM h WHERE span_idx % 3 <> 0), {errors.format('j', 'j')},
v AS (SELECT recording_id, span_idx, cid, ascii(cid) - 97 AS idx, CASE WHEN cid = 'b' AND span_idx % 5 = 0 THEN NULL ELSE 70 + 5 * (ascii(cid) - 97) - 10 * ((ascii(cid) - 97) * span_idx % 3) END AS score FROM ce WHERE error IS NULL),
g AS (SELECT recording_id, span_idx, arg_min(cid, idx - 1000 * coalesce(score, -1000)) AS best, arg_min(cid, idx) AS primary_, list(cid) AS valid FROM v GROUP BY 1, 2),
d AS (SELECT p.recording_id, p.chunk_idx AS span_idx, best, primary_, valid, CASE p.chunk_idx % 4 WHEN 0 THEN ['a', 'zz'] WHEN 1 THEN ['zz'] WHEN 3 THEN ['a', 'b'] END AS sel, je.cid AS judged_by, je.error FROM plan p LEFT JOIN g ON g.recording_id = p.recording_id AND g.span_idx = p.chunk_idx LEFT JOIN je ON je.recording_id = p.recording_id AND je.span_idx = p.chunk_idx),
m AS (SELECT *, list_sort(list_filter(sel, lambda x: list_contains(valid, x))) AS known FROM d),
q AS (SELECT *, CASE WHEN valid IS NULL THEN 'degraded_no_valid_candidate' WHEN sel IS NULL THEN 'fallback_budget_exhausted' WHEN len(known) = 0 THEN 'fallback_invalid_selection' WHEN judged_by IS NULL THEN 'fallback_empty_judge_output' WHEN error IS NOT NULL THEN 'fallback_out_of_span_judge_output' ELSE 'model' END AS method FROM m),
jd AS (SELECT recording_id, span_idx, method, CASE WHEN method = 'model' THEN array_to_string(known, ',') WHEN method = 'fallback_invalid_selection' THEN primary_ WHEN valid IS NOT NULL THEN best ELSE '' END AS candidate_ids, method = 'model' AS stands FROM q)"""
    second = f"""ask AS (SELECT *, k IS NOT NULL AND sum(CASE WHEN k IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY pos) <= 2 AS fits FROM (SELECT i.recording_id, pos, printf('span_%04d', sid) AS id, p.chunk_idx AS k
  FROM (SELECT recording_id, unnest(ids) AS sid, generate_subscripts(ids, 1) AS pos FROM (SELECT DISTINCT recording_id, CASE recording_id % 4 WHEN 1 THEN [0, 1] WHEN 2 THEN [1, 99, 2, 1, 3] ELSE [] END AS ids FROM seg)) i LEFT JOIN plan p ON p.recording_id = i.recording_id AND p.chunk_idx = i.sid)),
j2 AS (SELECT recording_id, span_idx, start_ms, end_ms, seg_idx, speaker, t + CASE WHEN (recording_id + span_idx) % 5 = 0 THEN 60 ELSE 0 END AS t, 'judge' AS cid FROM h WHERE (recording_id + seg_idx) % 7 <> 0), {errors.format('j2', 'j2')},
sec AS (SELECT a.recording_id, a.k AS span_idx, best, primary_, j2e.error, CASE WHEN valid IS NULL THEN 'degraded_no_valid_candidate' WHEN a.k % 3 = 1 OR NOT list_contains(valid, 'b') THEN 'fallback_invalid_selection' WHEN j2e.cid IS NULL THEN 'fallback_empty_judge_output' WHEN j2e.error IS NOT NULL THEN 'fallback_out_of_span_judge_output' ELSE 'model' END AS method
  FROM (SELECT DISTINCT recording_id, k FROM ask WHERE fits) a LEFT JOIN g ON g.recording_id = a.recording_id AND g.span_idx = a.k LEFT JOIN j2e ON j2e.recording_id = a.recording_id AND j2e.span_idx = a.k),
ok AS (SELECT * FROM sec WHERE method NOT IN ('degraded_no_valid_candidate', 'fallback_out_of_span_judge_output'))"""
    scores = f"""tg AS (SELECT recording_id, seg_idx, "end", floor(start)::BIGINT AS t, floor(start)::BIGINT - lag(floor(start)::BIGINT) OVER (PARTITION BY recording_id ORDER BY seg_idx) AS gap FROM seg),
tm AS (SELECT recording_id, avg(gap) AS mean, count(gap) AS n, max(t) AS reach, max("end") AS dur, count(*) FILTER (gap < 0) AS back FROM tg GROUP BY 1), td AS (SELECT recording_id, count(*) FILTER (gap < 0 OR gap > 3 * mean) AS odd FROM tg JOIN tm USING (recording_id) GROUP BY 1),
tr AS (SELECT recording_id, score, CASE WHEN dur < 30 OR score >= 85 THEN 'skip' WHEN score >= 70 THEN 'optional' ELSE 'fix' END AS recommendation FROM (SELECT recording_id, dur, CASE WHEN dur < 30 THEN 80 ELSE least(greatest(100 - CASE WHEN n = 0 THEN 25 ELSE 0 END - CASE WHEN n = 0 AND reach <= 2 THEN 25 ELSE 0 END - 15 * back
  - CASE WHEN odd * 5 > n THEN 10 ELSE 0 END - CASE WHEN reach / dur * 100 < 70 THEN 15 ELSE 0 END - CASE WHEN reach / dur * 100 > 110 THEN 20 ELSE 0 END, 0), 100) END::BIGINT AS score FROM tm JOIN td USING (recording_id)))"""
    return {
        "q_span_errors": f"WITH {cands}, {cerr} SELECT recording_id, span_idx, cid AS candidate_id, error FROM ce",
        "q_valid_candidates": f"WITH {cands}, {cerr} SELECT recording_id, span_idx, cid AS candidate_id, seg_idx, {stamp('t')} AS timestamp FROM c JOIN ce USING (recording_id, span_idx, cid) WHERE error IS NULL",
        "q_audio_errors": f"""WITH {seg}, du AS (SELECT recording_id, max("end") * CASE recording_id % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS d FROM seg GROUP BY 1),
r AS (SELECT *, floor(start)::BIGINT AS t, row_number() OVER (PARTITION BY recording_id ORDER BY seg_idx) - 1 AS place FROM seg JOIN du USING (recording_id))
SELECT recording_id, min_by('segment ' || place || ' timestamp ' || t || 's exceeds audio duration ' || round(d)::BIGINT || 's', place) FILTER (d > 0 AND t > d + 5) AS error FROM r GROUP BY 1""",
        "q_judged_spans": f"WITH {first} SELECT * FROM jd",
        "q_rejudged_spans": f"""WITH {first}, {second}
SELECT jd.*, 0 AS rejudges FROM jd LEFT JOIN ok ON ok.recording_id = jd.recording_id AND ok.span_idx = jd.span_idx WHERE ok.span_idx IS NULL
UNION ALL SELECT recording_id, span_idx, method, CASE WHEN method = 'model' THEN 'b' WHEN method = 'fallback_invalid_selection' THEN primary_ ELSE best END, method = 'model', 1 FROM ok""",
        "q_rejudged_reviews": f"""WITH {first}, {second},
op AS (SELECT recording_id, why, min(pos) AS pos FROM (SELECT a.recording_id, pos, CASE WHEN k IS NULL THEN a.id || ' is not a known span' WHEN NOT fits THEN 'Global reviewer requested ' || a.id || ' but the rejudge budget was exhausted.'
    WHEN method = 'degraded_no_valid_candidate' THEN a.id || ' has no valid candidates for the requested rejudge.' WHEN method = 'fallback_out_of_span_judge_output' THEN a.id || ' rejudge rejected: ' || error END AS why FROM ask a LEFT JOIN sec ON sec.recording_id = a.recording_id AND sec.span_idx = a.k) WHERE why IS NOT NULL GROUP BY 1, 2),
ol AS (SELECT recording_id, string_agg(why, '; ' ORDER BY pos) AS why FROM op GROUP BY 1)
SELECT r.recording_id, CASE WHEN why IS NOT NULL THEN 'review_required' WHEN r.recording_id % 4 = 0 THEN 'pass' WHEN r.recording_id % 4 = 3 THEN 'review_required' ELSE 'rejudge' END AS verdict,
  CASE WHEN why IS NOT NULL THEN 'model_with_unresolved_rejudge' ELSE 'model' END AS method, concat_ws('; ', CASE WHEN r.recording_id % 4 = 2 THEN 'seams' END, why) AS reasons FROM (SELECT DISTINCT recording_id FROM seg) r LEFT JOIN ol ON ol.recording_id = r.recording_id""",
        "q_tool_loop": f"""WITH {seg}, cl AS (SELECT recording_id, seg_idx AS turn, i AS pos, CASE (recording_id + seg_idx + i) % 3 WHEN 0 THEN 'timestamp_analysis' WHEN 1 THEN 'segment_count' ELSE 'web_search' END AS name FROM seg, range(0, 5) AS q(i) WHERE seg_idx % 2 = 0 AND i < (recording_id + 2 * seg_idx) % 6),
tn AS (SELECT recording_id, turn, count(*) AS n, row_number() OVER w AS place, sum(count(*)) OVER w AS so_far FROM cl GROUP BY 1, 2 WINDOW w AS (PARTITION BY recording_id ORDER BY turn)),
bad AS (SELECT recording_id, turn, CASE WHEN place > 2 THEN 'interaction tool loop exceeded max turns (2)' WHEN n > 4 THEN 'interaction requested ' || n || ' function calls; max per turn is 4' WHEN so_far > 8 THEN 'interaction requested ' || so_far || ' total function calls; max is 8' END AS why FROM tn),
fb AS (SELECT recording_id, min(turn) AS end_, arg_min(why, turn) AS why FROM bad WHERE why IS NOT NULL GROUP BY 1),
{scores}, cn AS (SELECT recording_id, count(*) AS n FROM seg GROUP BY 1)
SELECT cl.recording_id, row_number() OVER (PARTITION BY cl.recording_id ORDER BY turn, pos) AS place, turn, pos, name, CASE WHEN turn >= end_ OR pos = 2 THEN NULL WHEN name = 'timestamp_analysis' THEN '{{"score":' || score || ',"recommendation":"' || recommendation || '"}}' WHEN name = 'segment_count' THEN '{{"n":' || cn.n || '}}' END AS result,
  CASE WHEN turn >= end_ THEN why WHEN name = 'web_search' THEN 'unknown tool web_search' WHEN pos = 2 THEN 'unknown candidate_id x' END AS error FROM cl LEFT JOIN fb ON fb.recording_id = cl.recording_id JOIN tr ON tr.recording_id = cl.recording_id JOIN cn ON cn.recording_id = cl.recording_id""",
        "q_review_errors": f"WITH {seg} SELECT DISTINCT recording_id, CASE recording_id % 6 WHEN 1 THEN 'verdict pass cannot include rejudge spans' WHEN 2 THEN 'rejudge without span ids' WHEN 4 THEN 'invented span id span_9999' WHEN 5 THEN 'unknown verdict maybe' END AS error FROM seg",
        "q_segments_equal": f"WITH {seg} SELECT recording_id, NOT bool_or((recording_id * 31 + seg_idx) % 10 = 3 OR (recording_id % 9 = 0 AND seg_idx = 1)) AS equal FROM seg GROUP BY 1",
        "q_around_seams": f"""WITH {seg}, {plan}, {seams.format('plan')}, nr AS (SELECT sm.*, seg_idx, floor(start)::BIGINT AS t, abs(floor(start) - seam_s) * 1000000 + seg_idx AS o FROM sm JOIN seg ON sm.recording_id = seg.recording_id AND abs(floor(start) - seam_s) <= 12)
SELECT recording_id, seam_idx, arg_min(seg_idx, o) FILTER (t <= seam_s) AS before_idx, arg_min(seg_idx, o) FILTER (t > seam_s) AS after_idx FROM nr GROUP BY 1, 2 HAVING count(*) FILTER (t <= seam_s) > 0 AND count(*) FILTER (t > seam_s) > 0""",
        "q_seam_repairs": f"""WITH {two} SELECT recording_id, seam_idx, kind, CASE WHEN kind = 'duplicate' THEN a.i END AS seg_idx, CASE WHEN kind = 'gap' THEN (a.t - b.t)::DOUBLE END AS seconds,
CASE kind WHEN 'duplicate' THEN 'Removed duplicate overlap near chunk boundary ' || {stamp('floor(seam_s)::BIGINT')} || ': ' || a.x ELSE 'Large gap near chunk boundary ' || {stamp('floor(seam_s)::BIGINT')} || ': ' || (a.t - b.t) || 's between adjacent segments.' END AS note FROM rp WHERE kind IS NOT NULL""",
        "q_repaired": f"WITH {two} SELECT recording_id, seg_idx, speaker, {stamp('t')} AS timestamp FROM db WHERE NOT EXISTS (SELECT 1 FROM rp WHERE rp.recording_id = db.recording_id AND kind = 'duplicate' AND rp.a.i = db.seg_idx)",
        "q_chunk_seams": f"WITH {seg}, {plan}, n AS (SELECT *, lead(chunk_idx) OVER w AS nx, count(*) OVER (PARTITION BY recording_id) AS n FROM plan WINDOW w AS (PARTITION BY recording_id ORDER BY chunk_idx)) SELECT recording_id, chunk_idx AS seam_idx, end_ms / 1000 AS \"at\", 'chunk ' || (chunk_idx + 1) || ' of ' || n AS label FROM n WHERE nx IS NOT NULL",
        "q_gap_marker_rows": f"WITH {heard}, n AS (SELECT *, count(*) OVER (PARTITION BY recording_id) AS n FROM plan) SELECT recording_id, chunk_idx, {stamp('start_ms // 1000')} AS timestamp, 'Untranscribed' AS speaker, '[no transcript produced for chunk ' || (chunk_idx + 1) || ' of ' || n || ']' AS text FROM n WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.recording_id = n.recording_id AND h.span_idx = n.chunk_idx AND seg_idx % 3 <> 1)",
        "q_consistent_speakers": f"WITH {seg}, {label}, f AS (SELECT recording_id, who, 'Speaker ' || row_number() OVER (PARTITION BY recording_id ORDER BY min(seg_idx)) AS lab FROM lb WHERE who <> 'Speaker 9' GROUP BY 1, 2) SELECT recording_id, seg_idx, coalesce(lab, who) AS speaker, false AS kept FROM lb LEFT JOIN f USING (recording_id, who) UNION ALL SELECT recording_id, seg_idx, who, true FROM lb",
        "q_generic_speakers": f"WITH {seg} SELECT recording_id, seg_idx, seg_idx % 5 = 1 AS generic FROM seg",
        "q_owning_spans": f"WITH {own} SELECT recording_id, seg_idx, span_idx FROM ow",
        "q_span_evidence": f"WITH {ev} SELECT * FROM ee",
        "q_provenance_disputes": f"WITH {ev}, d AS (SELECT recording_id, seg_idx, seg_idx - row_number() OVER (PARTITION BY recording_id ORDER BY seg_idx) AS isl FROM ee WHERE disputed AND span_id IS NOT NULL) SELECT recording_id, min(seg_idx) AS first_idx, max(seg_idx) AS last_idx, 'adjudicated' AS status, count(*) AS n FROM d GROUP BY recording_id, isl",
        "q_human_review": f"""WITH {ev}, r AS (SELECT recording_id, review, min(seg_idx) AS o FROM ee WHERE review IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT DISTINCT recording_id, 'global', 1000000 FROM seg WHERE recording_id % 4 = 0),
g AS (SELECT recording_id, count(*) AS n_reasons, arg_min(review, o) AS first_reason FROM r GROUP BY 1), f AS (SELECT recording_id, coalesce(n_reasons, 0) AS n_reasons, first_reason FROM (SELECT DISTINCT recording_id FROM seg) LEFT JOIN g USING (recording_id))
SELECT recording_id, CASE WHEN n_reasons > 0 THEN 'required' ELSE 'not_required' END AS review, n_reasons, first_reason, CASE WHEN recording_id % 10 = 0 THEN 'canceled' WHEN recording_id % 10 = 1 THEN 'failed' WHEN n_reasons > 0 THEN 'review_required' ELSE 'completed' END AS status FROM f""",
        "q_span_evaluation": f"""WITH {seg}, {plan}, s AS (SELECT recording_id, chunk_idx AS span_idx, recording_id + chunk_idx AS k FROM plan), e AS (SELECT *, CASE WHEN k % 5 <> 0 THEN k % 50 + 50 ELSE 0 END AS q, k % 40 + 60 AS tm, CASE WHEN k % 3 > 1 THEN k % 10 / 20.0::DOUBLE ELSE 0.0::DOUBLE END AS dis FROM s)
SELECT recording_id, span_idx, CASE WHEN k % 3 = 0 THEN 1.0::DOUBLE ELSE round(greatest(0.0::DOUBLE, (78 - q) / 78, (85 - tm) / 85, dis), 6) END AS severity, k % 3 = 0 OR greatest(78 - q, 85 - tm, dis) > 0 AS needs_evidence,
CASE WHEN k % 3 = 0 THEN 'No valid candidate completed for this span.' ELSE concat_ws('; ', CASE WHEN q < 78 THEN 'Primary quality score is below the evidence threshold.' END, CASE WHEN tm < 70 THEN 'Timestamps need correction (score: ' || tm || ')' WHEN tm < 85 THEN 'Timestamps acceptable but could improve (score: ' || tm || ')' END, CASE WHEN dis > 0.18 THEN 'Independent candidates materially disagree.' END) END AS reasons FROM e""",
        "q_span_audit": f"""WITH {seg}, {plan}, s AS (SELECT recording_id, chunk_idx AS span_idx, recording_id + chunk_idx AS k, printf('span_%04d', chunk_idx) AS span_id FROM plan)
SELECT recording_id, span_idx, span_id, span_id || ':a:1 completed' || CASE WHEN k % 2 = 1 THEN ',' || span_id || ':b:1 ' || CASE WHEN k % 3 = 0 THEN 'failed' ELSE 'completed' END ELSE '' END AS attempts,
'planned>primary_complete,' || CASE WHEN k % 2 = 1 THEN 'primary_complete>evidence_complete,evidence_complete>' ELSE 'primary_complete>' END || CASE WHEN k % 5 = 0 THEN 'degraded' ELSE 'judged' END || CASE WHEN k % 4 = 0 AND k % 5 <> 0 THEN ',judged>rejudged' ELSE '' END AS transitions,
CASE WHEN k % 5 = 0 THEN 'degraded' WHEN k % 4 = 0 THEN 'rejudged' ELSE 'judged' END AS state FROM s""",
        "q_tool_usage": "WITH e AS (SELECT user_id AS recording_id, event_type AS name, sum(event_id % 3)::BIGINT AS count, min(event_id) AS f FROM events WHERE event_type <> 'view' AND event_id % 3 <> 0 GROUP BY 1, 2) SELECT recording_id, name, count, row_number() OVER (PARTITION BY recording_id ORDER BY f) AS rank FROM e",
        "q_ordered_distinct": "SELECT user_id AS recording_id, min(event_id) AS pos, event_type AS note FROM events WHERE event_id % 4 <> 0 GROUP BY 1, 3",
        "q_merged_candidates": f"WITH {seg}, r AS (SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY seg_idx) - 1 AS seg_idx, speaker, text, timestamp FROM seg) SELECT recording_id, 'a' AS candidate_id, seg_idx, speaker, text, timestamp FROM r UNION ALL SELECT recording_id, 'b', seg_idx, speaker, text, timestamp FROM r WHERE recording_id % 2 = 0",
        "q_unit_ends": f"WITH {seg}, u AS (SELECT recording_id, seg_idx, text, round(start * 1000)::BIGINT AS ms FROM seg WHERE seg_idx % 4 <> 0) SELECT recording_id, arg_min(text, seg_idx) AS first_text, arg_max(text, seg_idx) AS last_text, arg_min(ms, seg_idx) AS first_ms, arg_max(ms, seg_idx) AS last_ms FROM u GROUP BY 1",
        "q_zipped": f"WITH {seg}, z AS (SELECT recording_id, seg_idx AS idx, recording_id % 3 <> 0 OR seg_idx <> 1 AS has_result, recording_id % 5 <> 0 OR seg_idx <> 2 AS has_unit FROM seg) SELECT *, bool_and(has_result AND has_unit) OVER (PARTITION BY recording_id) AS fits FROM z WHERE has_result OR has_unit",
        "q_quality_report": f"""WITH {seg}, {flawed}, {card_sql('fl', ws)}, g AS (SELECT recording_id, count(*) FILTER (k = 7) AS n_gaps FROM fl GROUP BY 1)
SELECT recording_id, CASE WHEN n_gaps > 0 THEN least(overall, 59.0) ELSE overall END AS score, n_gaps, CASE WHEN n_gaps > 0 THEN 'incomplete_transcript: Transcript contains ' || n_gaps || ' explicitly untranscribed span(s)' ELSE '' END AS issues,
concat_ws('; ', {WARNINGS}, CASE WHEN n_gaps > 0 THEN 'Transcript contains ' || n_gaps || ' explicitly untranscribed span(s).' END) AS warnings FROM card JOIN g USING (recording_id)
UNION ALL SELECT DISTINCT recording_id + 1000000, NULL, 0, 'no_segments: No segments transcribed', '' FROM seg WHERE recording_id % 10 = 0""",
    }
