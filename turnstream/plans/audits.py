"""Queries of issues in words, notes of evidence and small functions, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import compare, evidence, folds, quality, render, spans, timeline, validate
from ..sources import responses
from ..sources.fixtures import segments, table
from .extended import three_candidates
from .spanwise import _flawed

_seg = lambda f: lambda s, d: f(segments(s, d))
_texts = lambda **cols: lambda s, d: table(s, d, "conversations").select("conv_id", "turn", *(f(F.col("text")).alias(n) for n, f in cols.items()))


def _jumping(seg: DataFrame) -> DataFrame:
    """Segments whose timestamps step back now and then, of recordings that are longer than they say."""
    k = (F.col("recording_id") + F.col("seg_idx")) % 6
    t = F.when(k == 3, 0).otherwise(F.floor("start"))
    return seg.withColumn("timestamp", F.format_string("[00:%02d:%02d]", F.floor(t / 60), t % 60)).withColumn("end", F.col("end") * F.when(F.col("recording_id") % 2 == 0, 2).otherwise(1))


def _loose(seg: DataFrame) -> DataFrame:
    r = F.col("recording_id") % 3
    stamp = F.when(r == 0, F.regexp_replace("timestamp", r"^\[0?([0-9]+):(.*)\]$", " $1:$2")).when((r == 1) & (F.col("seg_idx") == 1), "soon").otherwise(F.col("timestamp"))
    return validate.accepted_segments(seg.withColumns({"timestamp": stamp, "confidence": F.lit(2.0)})).select("recording_id", "seg_idx", "timestamp", "confidence")


def _unnamed(seg: DataFrame) -> DataFrame:
    return timeline.speakers_by_first(seg.withColumn("speaker", F.when(F.col("seg_idx") % 4 == 1, " ").otherwise(F.col("speaker"))))


def _quiet_cuts(seg: DataFrame) -> DataFrame:
    plan = timeline.chunk_plan(seg).withColumn("boundary_type", F.when(F.col("boundary_type") == "final", "final").when(F.col("chunk_idx") % 2 == 0, "silence").otherwise("fixed"))
    return timeline.cut_points(plan)


def _reviewed(seg: DataFrame) -> DataFrame:
    found = evidence.evidence_notes(evidence.run_evidence(seg, three_candidates(seg.where("seg_idx % 5 != 4")), ("c",)))
    reviews = spans.human_review(found)
    return reviews.select("recording_id", "status", F.size("reasons").cast("long").alias("n_reasons"))


def _requests(spark, d):
    e = F.col("event_id")
    tier = F.element_at(F.array(*map(F.lit, ("", "standard", "fast", "flex"))), (e % 4 + 1).cast("int"))
    model, previous = F.when(e % 9 == 0, " ").otherwise("m"), F.when(e % 5 == 0, "p").otherwise("")
    return table(spark, d, "events").select("event_id", responses.request_error(model, e % 7 != 0, tier, e % 3 != 0, previous, e % 2 == 0).alias("error"))


QUERIES = {
    "q_timestamp_issues": _seg(lambda x: evidence.timestamp_issues(_jumping(x)).select("recording_id", F.array_join("issues", "; ").alias("issues"), "reason")),
    "q_boundary_issues": _seg(lambda x: quality.boundary_issues(_flawed(x)).select("recording_id", F.array_join("issues", "; ").alias("issues"))),
    "q_candidate_report": _seg(lambda x: compare.candidate_report(*compare.candidates(x))),
    "q_evidence_reviews": _seg(_reviewed),
    "q_loose_segments": _seg(_loose),
    "q_unknown_speakers": _seg(_unnamed),
    "q_quiet_cut_points": _seg(_quiet_cuts),
    "q_truncated": _texts(short=lambda c: text.truncated(c, 40)),
    "q_output_cleanup": _texts(formatted=lambda c: text.output_text(c, True, ()), bare=lambda c: text.output_text(c, False, ("the", "of"))),
    "q_request_errors": _requests,
    "q_candidate_full_text": _seg(lambda x: render.transcript_text(three_candidates(x).where("candidate_id = 'b'")).select("recording_id", "full_text")),
    "q_reduced_overlaps": lambda s, d: table(s, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, folds.reduced_overlap(5000)).otherwise(folds.reduced_overlap(1500)).cast("long").alias("overlap")),
}


def oracle(seg: str, plan: str, norm: str, evidence_sql: str) -> dict[str, str]:
    """The SQL of QUERIES."""
    per = "SELECT conv_id, turn, {} FROM conversations"
    jump = """jp AS (SELECT recording_id, seg_idx, CASE WHEN (recording_id + seg_idx) % 6 = 3 THEN 0 ELSE floor(start)::BIGINT END AS t, "end" * CASE WHEN recording_id % 2 = 0 THEN 2 ELSE 1 END AS e, row_number() OVER (PARTITION BY recording_id ORDER BY seg_idx) - 1 AS place FROM seg),
jg AS (SELECT *, t - lag(t) OVER (PARTITION BY recording_id ORDER BY seg_idx) AS gap FROM jp), jm AS (SELECT recording_id, avg(gap) AS mean, count(gap) AS n, max(t) AS reach, max(e) AS dur, count(*) FILTER (gap < 0) AS back, string_agg('Non-monotonic at segment ' || place, '; ' ORDER BY place) FILTER (gap < 0) AS steps FROM jg GROUP BY 1),
jo AS (SELECT recording_id, count(*) FILTER (gap < 0 OR gap > 3 * mean) AS odd FROM jg JOIN jm USING (recording_id) GROUP BY 1),
js AS (SELECT *, reach / dur * 100 AS cover, CASE WHEN dur < 30 THEN 80 ELSE least(greatest(100 - CASE WHEN n = 0 THEN 25 ELSE 0 END - CASE WHEN n = 0 AND reach <= 2 THEN 25 ELSE 0 END - 15 * back - CASE WHEN odd * 5 > n THEN 10 ELSE 0 END - CASE WHEN reach / dur * 100 < 70 THEN 15 ELSE 0 END - CASE WHEN reach / dur * 100 > 110 THEN 20 ELSE 0 END, 0), 100) END AS score FROM jm JOIN jo USING (recording_id))"""
    flawed = """fl AS (SELECT recording_id, seg_idx, k, text, CASE WHEN k = 7 THEN 'Untranscribed' ELSE speaker END AS speaker, CASE WHEN k = 3 OR recording_id % 11 = 5 THEN NULL ELSE floor(start)::BIGINT END AS t FROM (SELECT *, (recording_id * 31 + seg_idx) % 20 AS k FROM seg))"""
    spaces = r"trim(regexp_replace({}, '[\t\n\f\r ]+', ' ', 'g'))"
    marks = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '[\t\n\f\r ]+([,.!?;:])', '\1', 'g'), '([,!?;:])([A-Za-z])', '\1 \2', 'g'), '!!+', '!', 'g'), '\?\?+', '?', 'g'), '\.\.+', '...', 'g')"
    bare = r"regexp_replace(trim(regexp_replace(regexp_replace(text, '(?i)\b(?:the|of)\b', '', 'g'), '[\t\n\f\r ]+', ' ', 'g')), '[\t\n\f\r ]+([,.!?;:])', '\1', 'g')"
    est = lambda name, cond: f"{name} AS (SELECT recording_id, round(CASE WHEN avg(g) FILTER (g > 0) IS NULL THEN greatest(max_by(t, seg_idx) + 30, 30) ELSE greatest(max_by(t, seg_idx) + avg(g) FILTER (g > 0), 1) END, 4)::DOUBLE AS sec, count(DISTINCT speaker) AS who FROM (SELECT *, floor(start)::BIGINT AS t, floor(start)::BIGINT - lag(floor(start)::BIGINT) OVER (PARTITION BY recording_id ORDER BY seg_idx) AS g FROM seg WHERE {cond}) GROUP BY 1)"
    return {
        "q_timestamp_issues": f"""WITH {seg}, {jump} SELECT recording_id, CASE WHEN dur < 30 THEN '' ELSE concat_ws('; ', CASE WHEN n = 0 THEN 'Single-segment transcript may need forced alignment' END, CASE WHEN n = 0 AND reach <= 2 THEN 'Single segment starts at the beginning of a long recording' END, steps, CASE WHEN odd * 5 > n THEN 'Irregular gaps: ' || printf('%.0f', odd / n * 100) || '% of segments' END,
CASE WHEN cover < 70 THEN 'Poor coverage: timestamps only reach ' || printf('%.0f', cover) || '% of audio' WHEN cover > 110 THEN 'Timestamp drift: timestamps exceed audio duration' END) END AS issues,
CASE WHEN dur < 30 THEN 'Audio too short (<30s), correction overhead not worth it' WHEN score >= 85 THEN 'Timestamps look good (score: ' || score || ')' WHEN score >= 70 THEN 'Timestamps acceptable but could improve (score: ' || score || ')' ELSE 'Timestamps need correction (score: ' || score || ')' END AS reason FROM js""",
        "q_boundary_issues": f"""WITH {seg}, {flawed}, r AS (SELECT *, {norm} AS norm, row_number() OVER w AS rn, last_value(t IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pt FROM fl WINDOW w AS (PARTITION BY recording_id ORDER BY seg_idx)), l AS (SELECT *, lag(norm) OVER (PARTITION BY recording_id ORDER BY seg_idx) AS pn FROM r),
g AS (SELECT recording_id, count(*) FILTER (norm <> '' AND norm = pn) AS a, count(*) FILTER (rn > 1 AND t < coalesce(pt, 0)) AS b, count(*) FILTER (rn > 1 AND t - coalesce(pt, 0) > 30) AS c, count(*) FILTER (t IS NULL) AS d FROM l GROUP BY 1)
SELECT recording_id, concat_ws('; ', CASE WHEN a > 0 THEN a || ' adjacent duplicate segment(s)' END, CASE WHEN b > 0 THEN b || ' non-monotonic timestamp transition(s)' END, CASE WHEN c > 0 THEN c || ' timestamp gap(s) over 30 seconds' END, CASE WHEN d > 0 THEN d || ' invalid timestamp(s)' END) AS issues FROM g""",
        "q_candidate_report": f"WITH {seg}, {est('ea', 'true')}, {est('eb', '(recording_id + seg_idx) % 7 <> 0')}, x AS (SELECT recording_id, {norm} AS x, count(*) AS na, count(*) FILTER ((recording_id + seg_idx) % 7 <> 0) AS nb FROM seg WHERE {norm} <> '' GROUP BY 1, 2), d AS (SELECT recording_id, sum(least(na, nb))::BIGINT AS shared, sum(na)::BIGINT AS n_a, sum(nb)::BIGINT AS n_b, round(sum(least(na, nb)) / greatest(sum(na), sum(nb)), 6) AS ratio FROM x GROUP BY 1) SELECT d.*, ea.who AS speakers_a, ea.sec AS seconds_a, eb.who AS speakers_b, eb.sec AS seconds_b FROM d LEFT JOIN ea USING (recording_id) LEFT JOIN eb USING (recording_id)",
        "q_evidence_reviews": evidence_sql,
        "q_loose_segments": f"WITH {seg} SELECT recording_id, seg_idx, timestamp, NULL::DOUBLE AS confidence FROM seg WHERE recording_id NOT IN (SELECT recording_id FROM seg WHERE recording_id % 3 = 1 AND seg_idx = 1)",
        "q_unknown_speakers": f"WITH {seg}, f AS (SELECT recording_id, CASE WHEN seg_idx % 4 = 1 THEN '' ELSE speaker END AS speaker, min(seg_idx) AS first_idx, count(*) AS n FROM seg GROUP BY 1, 2) SELECT *, CASE WHEN speaker = '' THEN 'Unknown speaker' ELSE 'Speaker ' || row_number() OVER (PARTITION BY recording_id, speaker = '' ORDER BY first_idx) END AS label FROM f",
        "q_quiet_cut_points": f"WITH {seg}, {plan}, q AS (SELECT *, boundary_type <> 'final' AND chunk_idx % 2 = 0 AS quiet FROM plan), w AS (SELECT *, lag(end_ms) OVER o AS pe, lag(quiet) OVER o AS pq, lead(start_ms) OVER o AS ns FROM q WINDOW o AS (PARTITION BY recording_id ORDER BY chunk_idx)) SELECT recording_id, chunk_idx, CASE WHEN pq THEN pe ELSE (start_ms + pe) // 2 END AS keep_from_ms, CASE WHEN ns IS NOT NULL THEN CASE WHEN quiet THEN end_ms ELSE (ns + end_ms) // 2 END END AS keep_until_ms FROM w",
        "q_truncated": "WITH RECURSIVE h AS (SELECT conv_id, turn, text, 40 AS n FROM conversations WHERE strlen(text) > 40 UNION ALL SELECT conv_id, turn, text, n - 1 FROM h WHERE strlen(substr(text, 1, n)) > 40), m AS (SELECT conv_id, turn, min(n) AS n FROM h GROUP BY 1, 2) SELECT c.conv_id, c.turn, CASE WHEN n IS NULL THEN text ELSE substr(text, 1, n) || '...' END AS short FROM conversations c LEFT JOIN m ON c.conv_id = m.conv_id AND c.turn = m.turn",
        "q_output_cleanup": per.format(f"CASE WHEN trim({marks.format(spaces.format('text'))}) = '' THEN text ELSE {marks.format(spaces.format('text'))} END AS formatted, CASE WHEN {bare} <> '' THEN {bare} ELSE text END AS bare"),
        "q_request_errors": "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'interaction model is required' WHEN event_id % 7 = 0 THEN 'interaction input is required' WHEN event_id % 4 = 2 THEN 'unsupported interaction service_tier fast' WHEN event_id % 3 = 0 AND event_id % 5 = 0 THEN 'store=false cannot be combined with previous_interaction_id' WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN 'store=false cannot be combined with background=true' END AS error FROM events",
        "q_candidate_full_text": f"WITH {seg} SELECT recording_id, string_agg(text, ' ' ORDER BY seg_idx) AS full_text FROM seg WHERE (recording_id + seg_idx) % 7 <> 0 GROUP BY 1",
        "q_reduced_overlaps": "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 2500 ELSE 1000 END::BIGINT AS overlap FROM supplier",
    }
