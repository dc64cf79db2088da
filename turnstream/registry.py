"""The engine's own queries and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text, timecode
from .operators import compare, quality, render, timeline, validate
from .plans import audits, extended, logs, outputs, spanwise
from .sources.fixtures import segments, table, words
from .streaming import events

_seg = lambda f: lambda s, d: f(segments(s, d))
_log = lambda f: lambda s, d: f(events.log(table(s, d, "events")))


def _texts(name, f):
    return lambda s, d: table(s, d, "conversations").select("conv_id", "turn", f(F.col("text")).alias(name))


def _marked(seg):
    """Segments with some of each fault that validation must find, and a confidence."""
    k = (F.col("recording_id") * 31 + F.col("seg_idx")) % 40
    return seg.withColumns({
        "timestamp": F.when(k == 3, "0:00:05").when(k == 7, "[00:75:10]").otherwise(F.col("timestamp")),
        "speaker": F.when(k == 11, " ").when(k == 17, "Untranscribed").otherwise(F.col("speaker")),
        "text": F.when(k == 13, "").otherwise(F.col("text")),
        "confidence": F.col("seg_idx") % 8 / 6,
    })


_numbered = lambda x: x.withColumn("speaker", F.concat(F.lit("Speaker "), F.col("seg_idx") % 4 + 1))
_keys = ("recording_id", "seg_idx")

QUERIES = {
    "q_quality_scorecard": _seg(quality.scorecard),
    "q_duration_estimate": _seg(quality.duration_estimate),
    "q_boundary_analysis": _seg(quality.boundary_analysis),
    "q_timecode_roundtrip": _seg(lambda x: x.select("recording_id", "seg_idx", "timestamp", timecode.parse_timestamp(F.col("timestamp")).alias("seconds"))),
    "q_segment_end": _seg(timeline.segment_ends),
    "q_timeline_lanes": _seg(timeline.timeline_lanes),
    "q_speaker_first_seen": _seg(timeline.speakers_by_first),
    "q_speaker_recency": _seg(timeline.speakers_by_recency),
    "q_unique_speakers": _seg(timeline.unique_speakers),
    "q_chunk_plan_fixed": _seg(timeline.chunk_plan),
    "q_cut_points": _seg(lambda x: timeline.cut_points(timeline.chunk_plan(x))),
    "q_keep_window": _seg(lambda x: timeline.keep_window(words(x), timeline.cut_points(timeline.chunk_plan(x)))),
    "q_reading_turns": _seg(timeline.reading_turns),
    "q_candidate_diff": _seg(lambda x: compare.candidate_diff(*compare.candidates(x))),
    "q_word_similarity": _seg(lambda x: compare.word_similarity(*compare.candidates(x))),
    "q_collapse_spaces": _texts("clean", text.collapse_spaces),
    "q_fix_punctuation": _texts("clean", text.fix_punctuation),
    "q_export_markdown": _texts("markdown", text.escape_markdown),
    "q_export_csv_rows": _texts("cell", text.csv_safe),
    "q_segment_errors": _seg(lambda x: _marked(x).select(*_keys, validate.segment_error().alias("error"))),
    "q_list_verdicts": _seg(lambda x: validate.list_verdicts(_marked(x))),
    "q_accepted_segments": _seg(lambda x: validate.accepted_segments(_marked(x)).select(*_keys, "speaker", "text", F.round("confidence", 6).alias("confidence"))),
    "q_gap_markers": _seg(lambda x: _marked(x).where(validate.is_gap()).select(*_keys)),
    "q_rename_speakers": _seg(lambda x: validate.rename_speakers(x, {"user": "Ada", "assistant": " "}).select(*_keys, "speaker")),
    "q_map_speakers": _seg(lambda x: validate.map_speakers(_numbered(x), ["Ada", "Ben", "Cy"]).select(*_keys, "speaker")),
    "q_change_notes": _seg(lambda x: validate.change_notes(x, _marked(x))),
    "q_rebase": _seg(lambda x: validate.rebase(_marked(x), F.lit(10)).select(*_keys, "timestamp")),
    "q_shift_timestamps": _seg(lambda x: _marked(x).select(*_keys, timecode.shift_timestamp(F.col("timestamp"), F.lit(3600)).alias("timestamp"))),
    "q_budget_preflight": _seg(lambda x: validate.budget_preflight(timeline.chunk_plan(x), 3, 5000, 10000)),
    "q_transcript_text": _seg(render.transcript_text),
    "q_document_summary": _seg(render.document_summary),
    "q_cue_times": _seg(render.cue_times),
    "q_remove_fillers": _texts("clean", lambda c: text.remove_fillers(c, ("um", "uh", "the", "of", "you know"))),
    "q_search_count": _texts("matches", lambda c: text.count_matches(c, "An")),
    "q_pause_sessions": _log(events.pause_sessions),
    "q_latest_event": _log(events.latest_event),
    "q_idempotent_events": _log(events.idempotent),
    "q_budget_ledger": _log(events.budget_ledger),
    "q_event_state_audit": _log(events.state_audit),
}

_SEG = """seg AS (SELECT recording_id, seg_idx, speaker, text, start, round(start + dur, 3) AS "end",
  format('[{:02d}:{:02d}:{:02d}]', (floor(start)::BIGINT // 3600), (floor(start)::BIGINT // 60) % 60, floor(start)::BIGINT % 60) AS timestamp
  FROM (SELECT conv_id AS recording_id, turn AS seg_idx, role AS speaker, text, greatest(1.0::DOUBLE, length(text) / 15) AS dur,
        round(coalesce(sum(greatest(1.0::DOUBLE, length(text) / 15)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3) AS start FROM conversations))"""
_T = "(floor(start)::BIGINT)"
_IV = f"iv AS (SELECT recording_id, seg_idx, {_T} AS t, \"end\" AS e, {_T} - lag({_T}) OVER (PARTITION BY recording_id ORDER BY seg_idx) AS gap FROM seg)"
_LOG = "log AS (SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS id, event_type AS name, props AS data, value, epoch_us(ts) AS t FROM events)"
_NORM = r"trim(regexp_replace(regexp_replace(lower(text), '[^A-Za-z0-9_\t\n\f\r '']', '', 'g'), '[\t\n\f\r ]+', ' ', 'g'))"
_WS = r"list_filter(string_split_regex({}, '[\t-\r ]+'), lambda w: w <> '')"
_PLAN = """tot AS (SELECT recording_id, round(max("end") * 1000)::BIGINT AS total FROM seg GROUP BY 1),
plan AS (SELECT recording_id, k AS chunk_idx, k * 15000 AS start_ms, least(k * 15000 + 20000, total) AS end_ms, CASE WHEN k * 15000 + 20000 > total THEN 'final' ELSE 'fixed' END AS boundary_type
  FROM (SELECT recording_id, total, unnest(range(0, CASE WHEN total <= 20000 THEN 1 ELSE 1 + ceil((total - 20000) / 15000)::BIGINT END)) AS k FROM tot))"""
_CUT = """cut AS (SELECT recording_id, chunk_idx, (start_ms + lag(end_ms) OVER w) // 2 AS keep_from_ms, (lead(start_ms) OVER w + end_ms) // 2 AS keep_until_ms FROM plan WINDOW w AS (PARTITION BY recording_id ORDER BY chunk_idx))"""
_MARKED = """mk AS (SELECT recording_id, seg_idx, start, "end", (recording_id * 31 + seg_idx) % 40 AS k, seg_idx % 8 / 6 AS confidence,
  CASE k WHEN 3 THEN '0:00:05' WHEN 7 THEN '[00:75:10]' ELSE timestamp END AS timestamp, CASE k WHEN 11 THEN ' ' WHEN 17 THEN 'Untranscribed' ELSE speaker END AS speaker,
  CASE k WHEN 13 THEN '' ELSE text END AS text FROM seg),
er AS (SELECT *, CASE WHEN k = 3 THEN 'timestamp' WHEN k = 7 THEN 'range' WHEN regexp_full_match(speaker, '[\\t-\\r ]*') THEN 'speaker' WHEN regexp_full_match(text, '[\\t-\\r ]*') THEN 'text' WHEN confidence > 1 THEN 'confidence' END AS error,
  CASE k WHEN 3 THEN NULL WHEN 7 THEN 4510 ELSE floor(start)::BIGINT END AS t FROM mk)"""
_NORMAL = _MARKED.replace("WHEN k = 3 THEN 'timestamp' WHEN k = 7", "WHEN k = 7").replace("CASE k WHEN 3 THEN NULL WHEN 7", "CASE k WHEN 3 THEN 5 WHEN 7")
_VERDICT = """lg AS (SELECT *, lag(t) OVER w AS pt, row_number() OVER w AS rn FROM er WINDOW w AS (PARTITION BY recording_id ORDER BY seg_idx)),
vd AS (SELECT recording_id, count(*) AS n_segments, count(error) AS n_errors, count(*) FILTER (error <> 'confidence') AS hard, bool_and(t IS NOT NULL AND (rn = 1 OR coalesce(t >= pt, false))) AS monotonic FROM lg GROUP BY 1)"""
_STAMP = "format('[{{:02d}}:{{:02d}}:{{:02d}}]', ({0}) // 3600, ({0}) // 60 % 60, ({0}) % 60)"
_MS = "round({0} * 1000)::BIGINT"
_PRECISE = "format('{{:02d}}:{{:02d}}:{{:02d}}{1}{{:03d}}', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"
_PER_TEXT = "SELECT conv_id, turn, {} FROM conversations"

ORACLE = {
    "q_quality_scorecard": f"""WITH {_SEG}, rl AS (SELECT recording_id, seg_idx, speaker, text, {_T} AS t FROM seg), dur AS (SELECT recording_id, max("end") AS duration FROM seg GROUP BY 1), {spanwise.card_sql("rl", _WS)} SELECT *, {spanwise.GRADE} FROM card""",
    "q_duration_estimate": f"WITH {_SEG}, {_IV} SELECT recording_id, round(CASE WHEN avg(gap) FILTER (gap > 0) IS NULL THEN greatest(max_by(t, seg_idx) + 30, 30) ELSE greatest(max_by(t, seg_idx) + avg(gap) FILTER (gap > 0), 1) END, 4)::DOUBLE AS seconds FROM iv GROUP BY 1",
    "q_boundary_analysis": f"WITH {_SEG}, r AS (SELECT recording_id, seg_idx, speaker, {_NORM} AS norm, {_T} AS t FROM seg), l AS (SELECT *, lag(norm) OVER w AS pn, lag(t) OVER w AS pt, lag(speaker) OVER w AS ps FROM r WINDOW w AS (PARTITION BY recording_id ORDER BY seg_idx)) SELECT recording_id, count(*) FILTER (norm <> '' AND norm = pn) AS duplicates, count(*) FILTER (t < pt) AS back_steps, count(*) FILTER (t - pt > 30) AS long_gaps, count(*) FILTER (speaker <> ps) AS speaker_changes, count(*) FILTER (t IS NULL) AS unreadable FROM l GROUP BY 1",
    "q_timecode_roundtrip": f"WITH {_SEG} SELECT recording_id, seg_idx, timestamp, {_T} AS seconds FROM seg",
    "q_segment_end": f"WITH {_SEG}, n AS (SELECT recording_id, seg_idx, start, CASE WHEN \"end\" > start THEN \"end\" ELSE start + greatest(1, length(text) / 15) END AS e, lead(start) OVER (PARTITION BY recording_id ORDER BY seg_idx) AS nx FROM seg) SELECT recording_id, seg_idx, round(CASE WHEN nx > start AND nx < e THEN nx ELSE e END, 3) AS cue_end FROM n",
    "q_timeline_lanes": f"WITH {_SEG}, m AS (SELECT *, greatest(max(\"end\") OVER (PARTITION BY recording_id), 1.0::DOUBLE) AS total FROM seg) SELECT recording_id, seg_idx, speaker, round(start / total * 100, 4) AS left_pct, round(greatest(\"end\" - start, 0.2::DOUBLE) / total * 100, 4) AS width_pct FROM m",
    "q_speaker_first_seen": f"WITH {_SEG}, f AS (SELECT recording_id, speaker, min(seg_idx) AS first_idx, count(*) AS n FROM seg GROUP BY 1, 2) SELECT *, 'Speaker ' || row_number() OVER (PARTITION BY recording_id ORDER BY first_idx) AS label FROM f",
    "q_speaker_recency": f"WITH {_SEG}, f AS (SELECT recording_id, speaker, max(start) AS last_start FROM seg GROUP BY 1, 2) SELECT *, (row_number() OVER (PARTITION BY recording_id ORDER BY last_start DESC, speaker))::INT AS rank FROM f",
    "q_unique_speakers": f"WITH {_SEG}, f AS (SELECT recording_id, speaker, min(seg_idx) AS i FROM seg GROUP BY 1, 2) SELECT recording_id, string_agg(speaker, ',' ORDER BY i) AS by_first, string_agg(speaker, ',' ORDER BY speaker) AS by_name FROM f GROUP BY 1",
    "q_chunk_plan_fixed": f"WITH {_SEG}, {_PLAN} SELECT * FROM plan",
    "q_cut_points": f"WITH {_SEG}, {_PLAN}, {_CUT} SELECT * FROM cut",
    "q_keep_window": f"WITH {_SEG}, {_PLAN}, {_CUT}, w AS (SELECT recording_id, round(start * 1000)::BIGINT + 300 * (unnest(range(1, len({_WS.format('text')}) + 1)) - 1) AS start_ms FROM seg) SELECT w.recording_id, chunk_idx, count(*) AS n_units, min(start_ms) AS first_ms, max(start_ms) + 250 AS last_ms FROM w JOIN cut ON w.recording_id = cut.recording_id AND start_ms >= coalesce(keep_from_ms, 0) AND (keep_until_ms IS NULL OR start_ms < keep_until_ms) GROUP BY 1, 2",
    "q_candidate_diff": f"WITH {_SEG}, a AS (SELECT recording_id, {_NORM} AS x, count(*) AS na, count(*) FILTER ((recording_id + seg_idx) % 7 <> 0) AS nb FROM seg WHERE {_NORM} <> '' GROUP BY 1, 2) SELECT recording_id, sum(least(na, nb))::BIGINT AS shared, sum(na)::BIGINT AS n_a, sum(nb)::BIGINT AS n_b, round(sum(least(na, nb)) / greatest(sum(na), sum(nb)), 6) AS ratio FROM a GROUP BY 1",
    "q_word_similarity": f"WITH {_SEG}, e AS (SELECT recording_id, seg_idx, unnest(string_split_regex(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9 ]', ' ', 'g'), ' +')) AS w FROM seg), a AS (SELECT recording_id, w, count(*) AS na, count(*) FILTER ((recording_id + seg_idx) % 7 <> 0) AS nb FROM e WHERE w <> '' GROUP BY 1, 2) SELECT recording_id, round(sum(least(na, nb)) / (sum(na) + sum(nb) - sum(least(na, nb))), 6) AS similarity FROM a GROUP BY 1",
    "q_collapse_spaces": _PER_TEXT.format(r"trim(regexp_replace(text, '[\t\n\f\r ]+', ' ', 'g')) AS clean"),
    "q_fix_punctuation": _PER_TEXT.format(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\t\n\f\r ]+([,.!?;:])', '\1', 'g'), '([,!?;:])([A-Za-z])', '\1 \2', 'g'), '!!+', '!', 'g'), '\?\?+', '?', 'g'), '\.\.+', '...', 'g') AS clean"),
    "q_export_markdown": _PER_TEXT.format(r"regexp_replace(text, '([\\`*_\[\]<>#|])', '\\\1', 'g') AS markdown"),
    "q_export_csv_rows": _PER_TEXT.format(r"CASE WHEN regexp_matches(text, '^[=+\-@\t\r]') THEN '''' || text ELSE text END AS cell"),
    "q_segment_errors": f"WITH {_SEG}, {_MARKED} SELECT recording_id, seg_idx, error FROM er",
    "q_list_verdicts": f"WITH {_SEG}, {_MARKED}, {_VERDICT} SELECT recording_id, n_segments, n_errors, monotonic, n_errors = 0 AND monotonic AS accepted FROM vd",
    "q_accepted_segments": f"WITH {_SEG}, {_NORMAL}, {_VERDICT} SELECT recording_id, seg_idx, trim(speaker) AS speaker, trim(text) AS text, CASE WHEN confidence <= 1 THEN round(confidence, 6) END AS confidence FROM er WHERE recording_id IN (SELECT recording_id FROM vd WHERE hard = 0 AND monotonic)",
    "q_gap_markers": f"WITH {_SEG}, {_MARKED} SELECT recording_id, seg_idx FROM mk WHERE k = 17 OR starts_with(trim(lower(text)), '[no transcript produced for ')",
    "q_rename_speakers": f"WITH {_SEG} SELECT recording_id, seg_idx, CASE speaker WHEN 'user' THEN 'Ada' ELSE speaker END AS speaker FROM seg",
    "q_map_speakers": f"WITH {_SEG} SELECT recording_id, seg_idx, coalesce((['Ada', 'Ben', 'Cy'])[seg_idx % 4 + 1], 'Speaker 4') AS speaker FROM seg",
    "q_change_notes": f"WITH {_SEG}, {_MARKED} SELECT recording_id, seg_idx, concat_ws(',', CASE WHEN s.timestamp <> mk.timestamp THEN 'timestamp' END, CASE WHEN s.speaker <> mk.speaker THEN 'speaker' END, CASE WHEN s.text <> mk.text THEN 'text' END) AS notes, NULL::VARCHAR AS status FROM seg s JOIN mk USING (recording_id, seg_idx)",
    "q_rebase": f"WITH {_SEG}, {_MARKED} SELECT recording_id, seg_idx, CASE WHEN t IS NULL THEN timestamp ELSE {_STAMP.format('greatest(t - 10, 0)')} END AS timestamp FROM er",
    "q_shift_timestamps": f"WITH {_SEG}, {_MARKED} SELECT recording_id, seg_idx, CASE WHEN t IS NULL THEN timestamp ELSE {_STAMP.format('t + 3600')} END AS timestamp FROM er",
    "q_budget_preflight": f"WITH {_SEG}, {_PLAN}, g AS (SELECT recording_id, count(*) AS n_chunks, max(end_ms) AS total FROM plan GROUP BY 1), k AS (SELECT recording_id, n_chunks, ((total + (n_chunks - 1) * 5000) * 32 + 999) // 1000 * 3 AS tokens FROM g) SELECT *, tokens <= 10000 AS allowed FROM k",
    "q_transcript_text": f"WITH {_SEG} SELECT recording_id, string_agg(text, ' ' ORDER BY seg_idx) AS full_text, string_agg(timestamp || ' ' || speaker || ': ' || text, chr(10) ORDER BY seg_idx) AS formatted FROM seg GROUP BY 1",
    "q_document_summary": f"WITH {_SEG}, g AS (SELECT recording_id, floor(max(\"end\"))::BIGINT AS d, count(DISTINCT speaker) AS n FROM seg GROUP BY 1) SELECT recording_id, 'Duration ' || CASE WHEN d >= 3600 THEN format('{{:d}}:{{:02d}}:{{:02d}}', d // 3600, d // 60 % 60, d % 60) ELSE format('{{:d}}:{{:02d}}', d // 60, d % 60) END || ' · ' || n || CASE WHEN n = 1 THEN ' speaker' ELSE ' speakers' END AS summary FROM g",
    "q_cue_times": f"WITH {_SEG}, m AS (SELECT recording_id, seg_idx, {_MS.format('start')} AS a, {_MS.format(chr(34) + 'end' + chr(34))} AS b FROM seg) SELECT recording_id, seg_idx, {_PRECISE.format('a', ',')} AS srt_start, {_PRECISE.format('b', ',')} AS srt_end, {_PRECISE.format('a', '.')} AS vtt_start FROM m",
    "q_remove_fillers": _PER_TEXT.format(r"regexp_replace(trim(regexp_replace(regexp_replace(text, '(?i)\b(?:um|uh|the|of|you know)\b', '', 'g'), '[\t\n\f\r ]+', ' ', 'g')), '[\t\n\f\r ]+([,.!?;:])', '\1', 'g') AS clean"),
    "q_search_count": _PER_TEXT.format("((length(lower(text)) - length(replace(lower(text), 'an', ''))) // 2)::BIGINT AS matches"),
    "q_pause_sessions": f"WITH {_LOG}, f AS (SELECT *, coalesce((t - lag(t) OVER (PARTITION BY job_id ORDER BY id) > 1800000000)::INT, 1) AS fresh FROM log), s AS (SELECT *, sum(fresh) OVER (PARTITION BY job_id ORDER BY id)::BIGINT AS session FROM f) SELECT job_id, session, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM s GROUP BY 1, 2",
    "q_latest_event": f"WITH {_LOG} SELECT job_id, name, max(id) AS id, max_by(data, id) AS data FROM log GROUP BY 1, 2",
    "q_idempotent_events": f"WITH {_LOG} SELECT job_id, sha256(trim(concat_ws('|', name, data))) AS idempotency_key, min(id) AS owner_id, count(*) AS attempts FROM log GROUP BY 1, 2",
    "q_budget_ledger": f"WITH RECURSIVE {_LOG}, c AS (SELECT job_id, id, floor(abs(value))::BIGINT AS charge FROM log), s AS (SELECT job_id, id, charge, CASE WHEN charge <= 500 THEN charge ELSE 0 END AS spent, charge <= 500 AS allowed FROM c WHERE id = 1 UNION ALL SELECT c.job_id, c.id, c.charge, CASE WHEN s.spent + c.charge <= 500 THEN s.spent + c.charge ELSE s.spent END, s.spent + c.charge <= 500 FROM s JOIN c ON c.job_id = s.job_id AND c.id = s.id + 1) SELECT * FROM s",
    "q_event_state_audit": f"WITH {_LOG}, p AS (SELECT lag(name) OVER (PARTITION BY job_id ORDER BY id) AS before, name AS after FROM log) SELECT before, after, count(*) AS n FROM p WHERE before IS NOT NULL GROUP BY 1, 2",
}

QUERIES |= extended.QUERIES | spanwise.QUERIES | logs.QUERIES | outputs.QUERIES | audits.QUERIES
ORACLE |= extended.oracle(_SEG, _PLAN, _CUT, _NORM, _WS, ORACLE["q_quality_scorecard"])
ORACLE |= spanwise.oracle(_SEG, _PLAN, _NORM, _WS) | logs.oracle() | outputs.oracle(_SEG, _PLAN, _WS) | audits.oracle(_SEG, _PLAN, _NORM, extended.reviews_sql(_SEG))
