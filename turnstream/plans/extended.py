"""Queries of evidence, timestamp scores, folds and text functions, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, timecode
from ..operators import evidence, folds, quality, subtitles, timeline
from ..sources import payloads
from ..sources.fixtures import segments, table, words

PHRASES = {"the": "THE", "the law": "$1 law", "and": "&"}


def three_candidates(seg: DataFrame) -> DataFrame:
    """Candidate a: all segments; b: some missing; c: some misheard."""
    k = F.col("recording_id") + F.col("seg_idx")
    misheard = F.when(k % 3 == 0, F.translate("text", "e", "a")).otherwise(F.col("text"))
    said = lambda n, words: F.struct(F.lit(n).alias("candidate_id"), words.alias("text"))
    each = F.array_compact(F.array(said("a", F.col("text")), F.when(k % 7 != 0, said("b", F.col("text"))), said("c", misheard)))
    return seg.withColumn("x", F.explode(each)).select(*(c for c in seg.columns if c != "text"), "x.*")


def chunk_units(seg: DataFrame, jitter: int = 0, tail: bool = False) -> DataFrame:
    """The words of each fixed chunk, as that chunk alone would hear them; odd chunks hear them later by jitter.

    tail: the last chunk, which nothing follows, also hears the words that begin at the recording's end or later.
    """
    # chunks begin every 15 s and last 20: a word's chunks follow from its start
    last = timeline.chunk_plan(seg).groupBy("recording_id").agg(F.max("chunk_idx").alias("last"), F.max("end_ms").alias("total"))
    first = F.greatest(F.expr("(start_ms - 5000) div 15000") - F.when(F.col("start_ms") < 5000, 1).otherwise(0), F.lit(0))
    late_words = F.lit(tail) & (F.col("start_ms") >= F.col("total"))
    heard = words(seg).join(last, "recording_id").where((F.col("start_ms") < F.col("total")) | late_words).withColumn("chunk_idx", F.explode(F.sequence(F.when(late_words, F.col("last")).otherwise(first), F.expr("least(start_ms div 15000, last)"))))
    heard = heard.where((F.col("start_ms") >= F.col("chunk_idx") * 15000) & (late_words | (F.col("start_ms") < F.col("chunk_idx") * 15000 + 20000)))
    # words take more room than the texts they come from: spread anew before they are sorted
    heard = heard.repartition("recording_id", "chunk_idx")
    order = Window.partitionBy("recording_id", "chunk_idx").orderBy("start_ms", "seg_idx", "pos")
    late = F.col("chunk_idx") % 2 * jitter
    return heard.withColumn("unit_idx", F.row_number().over(order).cast("long")).select("recording_id", "chunk_idx", "unit_idx", F.col("word").alias("text"), "speaker", (F.col("start_ms") + late).alias("start_ms"), (F.col("end_ms") + late).alias("end_ms"), F.lit(False).alias("turn"), F.lit(False).alias("untimed"))


def turn_units(seg: DataFrame, jitter: int = 0) -> DataFrame:
    """The segments of two voices as each fixed chunk alone would hear them: cut at its ends, with the words of that time
    and labels of its own; odd chunks hear them later by jitter."""
    at, end = F.round(F.col("start") * 1000).cast("long"), F.round(F.col("end") * 1000).cast("long")
    said = seg.select("recording_id", "seg_idx", at.alias("s"), end.alias("e"), text.fields(F.col("text")).alias("ws"))
    heard = said.join(timeline.chunk_plan(seg).select("recording_id", "chunk_idx", F.col("start_ms").alias("lo"), F.col("end_ms").alias("hi")), "recording_id").where("e > lo and s < hi")
    part = heard.withColumns({"a": F.greatest("s", "lo"), "b": F.least("e", "hi"), "n": F.size("ws")})
    first, past = F.expr("cast((a - s) * n div (e - s) as int)"), F.expr("cast((b - s) * n div (e - s) as int)")
    order = Window.partitionBy("recording_id", "chunk_idx").orderBy("seg_idx")
    late = F.col("chunk_idx") % 2 * jitter
    raw = F.when((F.col("seg_idx") + F.col("chunk_idx")) % 2 == 0, "p").otherwise("q")
    return part.withColumn("unit_idx", F.row_number().over(order).cast("long")).select(
        "recording_id", "chunk_idx", "unit_idx", F.array_join(F.slice("ws", first + 1, past - first), " ").alias("text"), raw.alias("speaker"), (F.col("a") + late).alias("start_ms"), (F.col("b") + late).alias("end_ms"), F.lit(True).alias("turn"), F.lit(False).alias("untimed")
    )


def _spans(seg):
    return timeline.chunk_plan(seg).join(timeline.cut_points(timeline.chunk_plan(seg)), ["recording_id", "chunk_idx"])


def _nearest(seg):
    units = chunk_units(seg, 20)
    named = units.withColumn("speaker", F.when(F.col("speaker") == "user", "Speaker 1").otherwise("Speaker 2"))
    return evidence.nearest_units(named, units, timeline.chunk_plan(seg))


def _silences(seg):
    order = Window.partitionBy("recording_id").orderBy("seg_idx")
    at = F.round(F.col("start") * 1000).cast("long")
    return seg.withColumn("first", F.row_number().over(order) == 1).where("not first").select("recording_id", (at - 500).alias("start_ms"), (at + 500).alias("end_ms"))


def _totals(seg):
    return seg.groupBy("recording_id").agg(F.round(F.max("end") * 1000).cast("long").alias("total_ms"))


def _units(seg):
    return words(seg).withColumn("unit_idx", F.col("seg_idx") * 1_000_000 + F.col("pos")).select("recording_id", "unit_idx", F.col("word").alias("text"), "speaker", "start_ms", "end_ms")


def _voices(seg):
    """Words of two voices: odd segments begin 4 s early, over the other's words; every fourth ends a turn, some begin untimed."""
    early = F.when(F.col("seg_idx") % 2 == 1, F.least(F.lit(4000), F.col("start_ms") - 300 * F.col("pos"))).otherwise(0)
    last = F.col("pos") == F.max("pos").over(Window.partitionBy("recording_id", "seg_idx"))
    # spread anew as words, which take more room than their texts, before they are sorted
    return words(seg).repartition("recording_id", "seg_idx").select(
        "recording_id", (F.col("seg_idx") * 1_000_000 + F.col("pos")).alias("unit_idx"), F.col("word").alias("text"), F.when(F.col("seg_idx") % 2 == 1, "B").otherwise("A").alias("speaker"),
        (F.col("start_ms") - early).alias("start_ms"), (F.col("end_ms") - early).alias("end_ms"), (last & (F.col("seg_idx") % 4 == 1)).alias("turn"), ((F.col("pos") == 0) & (F.col("seg_idx") % 6 == 5)).alias("untimed"),
    )


def _escalation(seg):
    return evidence.escalation(seg.withColumn("confidence", F.when(F.col("recording_id") % 2 == 0, F.col("seg_idx") % 8 / 6)), quality.scorecard(seg))


STRICT = quality.QualitySettings({"readability": 0.5, "coverage": 0.5}, 90.0, 60.0, 0.05, 99.0)


def _strict(seg):
    """Scores and warnings by other weights and limits."""
    card = quality.scorecard(seg, settings=STRICT)
    return card.select("recording_id", "overall", "assessment").join(evidence.score_warnings(card, STRICT), "recording_id")


def _scores(seg):
    c = three_candidates(seg).groupBy("recording_id", "candidate_id").agg(F.round(F.avg(F.char_length("text")), 4).alias("score"))
    c = c.withColumn("score", F.when(F.col("recording_id") % 5 != 0, F.col("score"))).withColumn("idx", F.ascii("candidate_id"))
    return evidence.best_candidate(c)


def _payloads(seg, kind):
    """Segments as the payloads that a provider would send: turns, or phrases with a numbered speaker."""
    ms = lambda c: F.round(F.col(c) * 1000)
    one = {
        "turns": F.struct(ms("start").alias("startMs"), ms("end").alias("endMs"), "speaker", F.col("text").alias("transcript")),
        "phrases": F.struct(ms("start").alias("offsetMilliseconds"), (ms("end") - ms("start")).alias("durationMilliseconds"), (F.col("seg_idx") % 2).cast("int").alias("speaker"), "text"),
    }[kind]
    rows = seg.groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("seg_idx", one.alias("x")))).alias("xs"))
    return rows.select("recording_id", F.lit(0).alias("chunk_idx"), F.to_json(F.struct(F.transform("xs", lambda r: r["x"]).alias(kind))).alias("payload"))


def _silence_log(seg):
    at = F.round("start", 3)
    return seg.select("recording_id", F.explode(F.array(F.struct((F.col("seg_idx") * 2).alias("line_no"), F.concat(F.lit("[x] silence_start: "), F.format_string("%.3f", at)).alias("line")), F.struct((F.col("seg_idx") * 2 + 1).alias("line_no"), F.when(F.col("seg_idx") % 3 != 0, F.concat(F.lit("[x] silence_end: "), F.format_string("%.3f", at + 0.5), F.lit(" | silence_duration: 0.5"))).otherwise("frame= 1").alias("line")))).alias("e")).select("recording_id", "e.*")


def _analysis_log(seg):
    """The log of a recording's analysis: its silences, and how far it was decoded."""
    us = F.round(F.col("end") * 1_000_000).cast("long").cast("string")
    progress = seg.select("recording_id", (F.col("seg_idx") * 2 + 1_000_000).alias("line_no"), F.when(F.col("seg_idx") % 4 == 3, "out_time_us=N/A").otherwise(F.concat(F.lit("out_time_us="), us)).alias("line"))
    return _silence_log(seg).unionByName(progress)


_parsed = lambda kind: lambda s, d: payloads.speech_units(_payloads(segments(s, d), kind)).select("recording_id", "unit_idx", "text", "speaker", "start_ms", "end_ms", "error")


def _lists(seg):
    """Three segments to a chunk, of which the next chunk repeats the last."""
    k = F.col("seg_idx")
    chunks = F.filter(F.array(F.floor(k / 2), F.floor(k / 2) - 1), lambda c: (c >= 0) & (c * 2 + 2 >= k))
    return seg.withColumn("chunk_idx", F.explode(chunks))


FILLERS = ("um", "of", "the")


def _cleaned(c):
    return text.clean_text(c, FILLERS, False)


def _replaced(c):
    return text.find_and_replace(c, "an", "AN", whole_word=False)


_seg = lambda f: lambda s, d: f(segments(s, d))
# round(c, 3) takes the shortest decimal of a double, 2.0035 to 2.004; the SQL takes it times 1000, 2003.4999999999998
_thousandths = lambda c: (F.round(F.col(c) * 1000) / 1000).alias(c)
_texts = lambda **cols: lambda s, d: table(s, d, "conversations").select("conv_id", "turn", *(f(F.col("text")).alias(n) for n, f in cols.items()))
_loose = lambda: F.concat(F.lit(" "), F.col("turn").cast("string"), F.lit(":5:"), (F.col("conv_id") % 100).cast("string"))
_codes = lambda: F.concat_ws(", ", F.concat(F.col("role"), F.lit("")), F.lit("en-us nl_NL;cmn-hans-cn es-419 EN-US"))

QUERIES = {
    "q_timestamp_quality": _seg(evidence.timestamp_quality),
    "q_score_warnings": _seg(lambda x: evidence.score_warnings(quality.scorecard(x))),
    "q_quality_by_settings": _seg(_strict),
    "q_escalation": _seg(_escalation),
    "q_best_candidate": _seg(_scores),
    "q_run_evidence": _seg(lambda x: evidence.run_evidence(x, three_candidates(x))),
    "q_dispute_islands": _seg(lambda x: evidence.dispute_islands(evidence.run_evidence(x, three_candidates(x), ("b",)))),
    "q_candidates_disagree": _seg(lambda x: evidence.candidates_disagree(three_candidates(x))),
    "q_nearest_unit_join": _seg(_nearest),
    "q_speaker_votes": _seg(lambda x: evidence.speaker_votes(_nearest(x))),
    "q_span_digest": _seg(evidence.span_digest),
    "q_playhead": _seg(lambda x: evidence.playhead(x, 20.0)),
    "q_segments_from_units": _seg(lambda x: folds.segments_from_units(_voices(x))),
    "q_one_request_segments": _seg(lambda x: folds.one_request_segments(_voices(x).withColumn("speaker", F.when((F.col("speaker") == "A") & (F.col("recording_id") % 5 == 0), "").otherwise(F.col("speaker"))))),
    "q_stitch": _seg(lambda x: folds.stitch_chunks(chunk_units(x, tail=True), _spans(x)).select("recording_id", "chunk_idx", "text", "start_ms")),
    "q_stitch_turns": _seg(lambda x: folds.stitch_chunks(turn_units(x, 20), _spans(x)).drop("turn", "untimed")),
    "q_stitch_segments": _seg(lambda x: folds.segments_from_units(folds.stitch_chunks(turn_units(x, 20), _spans(x)))),
    "q_chunk_plan_adaptive": _seg(lambda x: folds.adaptive_plan(_totals(x), _silences(x), 40_000, 5_000)),
    "q_plan_from_log": _seg(lambda x: folds.plan_from_log(_analysis_log(x), 40_000, 5_000)),
    "q_recogniser_segments": _seg(lambda x: folds.segments_from_words(_units(x).select("recording_id", F.col("unit_idx").alias("pos"), F.col("text").alias("word"), (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end")))),
    "q_speech_turns": _parsed("turns"),
    "q_speech_phrases": _parsed("phrases"),
    "q_silence_log": _seg(lambda x: payloads.silence_spans(_silence_log(x))),
    "q_cues": _seg(lambda x: subtitles.cues(x).select("recording_id", "cue_idx", _thousandths("start"), _thousandths("end"), "speaker", "text")),
    "q_export_txt": _seg(subtitles.render_text),
    "q_export_turns": _seg(lambda x: subtitles.render_text(x, False)),
    "q_export_srt": _seg(subtitles.render_srt),
    "q_export_vtt": _seg(subtitles.render_vtt),
    "q_export_markdown_document": _seg(lambda x: subtitles.render_markdown(x, "Transcript")),
    "q_merge_overlap": _seg(lambda x: folds.merge_chunks(_lists(x)).drop("chunk_idx")),
    "q_clean_text": _texts(clean=lambda c: _cleaned(c)[0], steps=lambda c: _cleaned(c)[1]),
    "q_replacements": _texts(clean=lambda c: text.replace_phrases(c, PHRASES)),
    "q_find_replace": _texts(clean=lambda c: _replaced(c)[0], matches=lambda c: _replaced(c)[1]),
    "q_proper_nouns": _texts(clean=text.proper_nouns),
    "q_sentence_case": _texts(clean=text.sentence_case),
    "q_escape_xml": _texts(clean=text.escape_xml),
    "q_normalize_timestamp": lambda s, d: table(s, d, "conversations").select("conv_id", "turn", timecode.normalise_timestamp(_loose()).alias("timestamp")),
    "q_language_codes": lambda s, d: table(s, d, "conversations").select("conv_id", "turn", F.array_join(text.language_codes(F.when(F.col("turn") % 2 == 0, F.lit(" en-us, nl_NL;cmn-hans-cn es-419 EN-US ")).otherwise(_codes())), ",").alias("codes")),
}


def reviews_sql(seg: str) -> str:
    """Recordings with a segment that no candidate supports, or that they dispute while c does not hold it."""
    tok = "list_filter(string_split_regex(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda w: w <> '')"
    shared = "coalesce(list_sum(list_transform(list_distinct({0}), lambda w: least(len(list_filter({0}, lambda x: x = w)), len(list_filter({1}, lambda x: x = w))))), 0)"
    sim = lambda a, b: f"(CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE ELSE {shared.format(a, b)} / (len({a}) + len({b}) - {shared.format(a, b)}) END)"
    t = "floor(start)::BIGINT"
    return f"""WITH {seg}, hd AS (SELECT * FROM seg WHERE seg_idx % 5 <> 4),
cand AS (SELECT 'a' AS cid, recording_id, seg_idx, {t} AS u, text FROM hd UNION ALL SELECT 'b', recording_id, seg_idx, {t}, text FROM hd WHERE (recording_id + seg_idx) % 7 <> 0 UNION ALL SELECT 'c', recording_id, seg_idx, {t}, CASE WHEN (recording_id + seg_idx) % 3 = 0 THEN translate(text, 'e', 'a') ELSE text END FROM hd),
cw AS (SELECT cid, recording_id, seg_idx AS m, u, {tok} AS ws FROM cand), fw AS (SELECT recording_id, seg_idx, timestamp, speaker, text, {t} AS t, {tok} AS own FROM seg),
rt AS (SELECT fw.recording_id, fw.seg_idx, cid, m, abs(t - u) AS far, {sim('own', 'ws')} AS s, ws FROM fw JOIN cw ON fw.recording_id = cw.recording_id AND abs(t - u) <= 8),
bm AS (SELECT * FROM rt QUALIFY row_number() OVER (PARTITION BY recording_id, seg_idx, cid ORDER BY s DESC, far, m) = 1),
src AS (SELECT recording_id, seg_idx, bool_or(s >= 0.55) AS some_, bool_or(cid = 'c' AND s >= 0.55) AS has FROM bm GROUP BY 1, 2),
df AS (SELECT x.recording_id, x.seg_idx, bool_or({sim('x.ws', 'y.ws')} < 0.72) AS differ FROM bm x JOIN bm y ON x.recording_id = y.recording_id AND x.seg_idx = y.seg_idx AND x.cid < y.cid GROUP BY 1, 2),
ev AS (SELECT fw.recording_id, timestamp, speaker, text, coalesce(some_, false) AS supported, coalesce(differ, false) AND NOT coalesce(has, false) AS open FROM fw LEFT JOIN src USING (recording_id, seg_idx) LEFT JOIN df USING (recording_id, seg_idx)),
rs AS (SELECT DISTINCT recording_id, timestamp || speaker || text || CASE WHEN NOT supported THEN 'x' ELSE 'y' END AS why FROM ev WHERE NOT supported OR open), n AS (SELECT recording_id, count(*) AS n FROM rs GROUP BY 1)
SELECT recording_id, CASE WHEN n IS NULL THEN 'not_required' ELSE 'required' END AS status, coalesce(n, 0) AS n_reasons FROM (SELECT DISTINCT recording_id FROM seg) LEFT JOIN n USING (recording_id)"""


def oracle(seg: str, plan: str, cut: str, norm: str, ws: str, card: str) -> dict[str, str]:
    """The SQL of QUERIES, from the relations that the engine's other SQL uses too."""
    tok = "list_filter(string_split_regex(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda w: w <> '')"
    shared = "coalesce(list_sum(list_transform(list_distinct({0}), lambda w: least(len(list_filter({0}, lambda x: x = w)), len(list_filter({1}, lambda x: x = w))))), 0)"
    sim = lambda a, b: f"(CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE ELSE {shared.format(a, b)} / (len({a}) + len({b}) - {shared.format(a, b)}) END)"
    t = "floor(start)::BIGINT"
    cand = f"""cand AS (SELECT 'a' AS cid, recording_id, seg_idx, {t} AS u, text FROM seg UNION ALL SELECT 'b', recording_id, seg_idx, {t}, text FROM seg WHERE (recording_id + seg_idx) % 7 <> 0
  UNION ALL SELECT 'c', recording_id, seg_idx, {t}, CASE WHEN (recording_id + seg_idx) % 3 = 0 THEN translate(text, 'e', 'a') ELSE text END FROM seg)"""
    ev = f"""{cand}, cw AS (SELECT cid, recording_id, seg_idx AS match_idx, u, {tok} AS ws FROM cand),
fw AS (SELECT recording_id, seg_idx, {t} AS t, {tok} AS own FROM seg),
rt AS (SELECT fw.recording_id, fw.seg_idx, cid, match_idx, abs(t - u) AS far, {sim('own', 'ws')} AS s, ws FROM fw JOIN cw ON fw.recording_id = cw.recording_id AND abs(t - u) <= 8),
bm AS (SELECT * FROM rt QUALIFY row_number() OVER (PARTITION BY recording_id, seg_idx, cid ORDER BY s DESC, far, match_idx) = 1),
src AS (SELECT recording_id, seg_idx, coalesce(string_agg(cid, ',' ORDER BY cid) FILTER (s >= 0.55), '') AS sources, coalesce(bool_or(cid = 'b' AND s >= 0.55), false) AS has_b FROM bm GROUP BY 1, 2),
df AS (SELECT x.recording_id, x.seg_idx, bool_or({sim('x.ws', 'y.ws')} < 0.72) AS differ FROM bm x JOIN bm y ON x.recording_id = y.recording_id AND x.seg_idx = y.seg_idx AND x.cid < y.cid GROUP BY 1, 2),
evd AS (SELECT seg.*, coalesce(sources, '') AS sources, coalesce(has_b, false) AS has_b, coalesce(differ, false) AS disputed FROM seg LEFT JOIN src USING (recording_id, seg_idx) LEFT JOIN df USING (recording_id, seg_idx))"""
    w = f"wd AS (SELECT recording_id, seg_idx, speaker, pos, ws[pos + 1] AS word, round(start * 1000)::BIGINT + 300 * pos AS start_ms FROM (SELECT *, unnest(range(0, len(ws))) AS pos FROM (SELECT *, {ws.format('text')} AS ws FROM seg)))"
    un = f"{w}, un AS (SELECT wd.*, chunk_idx, p.start_ms AS lo, p.end_ms AS hi, row_number() OVER (PARTITION BY wd.recording_id, chunk_idx ORDER BY wd.start_ms, seg_idx, pos) AS unit_idx FROM wd JOIN plan p ON wd.recording_id = p.recording_id AND wd.start_ms >= p.start_ms AND wd.start_ms < p.end_ms)"
    wnorm = norm.replace("lower(text)", "lower(word)")
    near = f"""{un}, j AS (SELECT *, start_ms + chunk_idx % 2 * 20 AS at, {wnorm} AS norm FROM un),
lap AS (SELECT recording_id, chunk_idx, start_ms AS o_lo, lag(end_ms) OVER (PARTITION BY recording_id ORDER BY chunk_idx) AS o_hi FROM plan),
nr AS (SELECT c.recording_id, c.chunk_idx, c.unit_idx, c.speaker AS raw, CASE p.speaker WHEN 'user' THEN 'Speaker 1' ELSE 'Speaker 2' END AS label, p.unit_idx AS match_idx
  FROM j c JOIN lap USING (recording_id, chunk_idx) JOIN j p ON p.recording_id = c.recording_id AND p.chunk_idx = c.chunk_idx - 1 AND abs(p.at - c.at) <= 400 AND p.at >= o_lo - 400 AND p.at < o_hi
  WHERE c.at >= o_lo AND c.at < o_hi
  QUALIFY row_number() OVER (PARTITION BY c.recording_id, c.chunk_idx, c.unit_idx ORDER BY (c.norm <> '' AND c.norm = p.norm) DESC, abs(p.at - c.at), p.unit_idx) = 1)"""
    tq = f"""g AS (SELECT recording_id, seg_idx, "end", {t} AS t, {t} - lag({t}) OVER (PARTITION BY recording_id ORDER BY seg_idx) AS gap FROM seg),
mn AS (SELECT recording_id, avg(gap) AS mean, count(gap) AS n, max(t) AS reach, max("end") AS dur, count(*) FILTER (gap < 0) AS back_steps FROM g GROUP BY 1),
od AS (SELECT recording_id, count(*) FILTER (gap < 0 OR gap > 3 * mean) AS irregular FROM g JOIN mn USING (recording_id) GROUP BY 1),
tq AS (SELECT recording_id, back_steps, irregular, dur, CASE WHEN dur < 30 THEN 80 ELSE least(greatest(100 - CASE WHEN n = 0 THEN 25 ELSE 0 END - CASE WHEN n = 0 AND reach <= 2 THEN 25 ELSE 0 END - 15 * back_steps
  - CASE WHEN irregular * 5 > n THEN 10 ELSE 0 END - CASE WHEN reach / dur * 100 < 70 THEN 15 ELSE 0 END - CASE WHEN reach / dur * 100 > 110 THEN 20 ELSE 0 END, 0), 100) END::BIGINT AS score FROM mn JOIN od USING (recording_id)),
tr AS (SELECT *, CASE WHEN dur < 30 OR score >= 85 THEN 'skip' WHEN score >= 70 THEN 'optional' ELSE 'fix' END AS recommendation FROM tq)"""
    per = "SELECT conv_id, turn, {} FROM conversations"

    def chain(pairs):
        out = "text"
        for find, to in pairs:
            out = f"regexp_replace({out}, '(?i)\\b{find}\\b', '{to}', 'g')"
        return out

    ms = lambda c: f"round({c} * 1000)::BIGINT"
    # an adaptive plan by recursion: the nearest silence in reach, else the target
    cutat = """(SELECT mid FROM sil WHERE sil.recording_id = {r} AND mid > {s} + 30000 AND mid < {t} AND abs(mid - {s} - 40000) <= 10000 ORDER BY abs(mid - {s} - 40000), mid LIMIT 1)"""
    adaptive = f"""tt AS (SELECT recording_id, {ms('max("end")')} AS total FROM seg GROUP BY 1),
sil AS (SELECT recording_id, {ms('start')} AS mid FROM seg QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY seg_idx) > 1),
st AS (SELECT recording_id, total, 0::BIGINT AS chunk_idx, 0::BIGINT AS start_ms, CASE WHEN total <= 40000 THEN NULL ELSE {cutat.format(r='tt.recording_id', s='0', t='total')} END AS mid, -1::BIGINT AS last_end FROM tt WHERE total > 0
UNION ALL SELECT recording_id, total, chunk_idx + 1, nx, CASE WHEN nx + 40000 > total THEN NULL ELSE {cutat.format(r='q.recording_id', s='nx', t='total')} END, end_ms
  FROM (SELECT *, CASE WHEN start_ms + 40000 > total THEN total ELSE coalesce(mid, start_ms + 40000) END AS end_ms, greatest(CASE WHEN mid IS NULL THEN start_ms + 35000 ELSE mid - 2500 END, 0) AS nx FROM st) q WHERE end_ms < total AND end_ms > last_end)"""
    planned = lambda adaptive: f"WITH RECURSIVE {seg}, {adaptive}, f AS (SELECT *, CASE WHEN total <= 40000 OR start_ms + 40000 > total THEN 'final' WHEN mid IS NOT NULL THEN 'silence' ELSE 'fixed' END AS kind FROM st) SELECT recording_id, chunk_idx, start_ms, CASE kind WHEN 'final' THEN total WHEN 'silence' THEN mid ELSE start_ms + 40000 END AS end_ms, CASE kind WHEN 'final' THEN 0 WHEN 'silence' THEN 2500 ELSE 5000 END::BIGINT AS overlap_ms, kind AS boundary_type, CASE kind WHEN 'final' THEN 1.0 WHEN 'silence' THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence FROM f"
    log_tt = f"tt AS (SELECT recording_id, max(CASE WHEN seg_idx % 4 <> 3 THEN round(\"end\" * 1000000)::BIGINT // 1000 ELSE 0 END) AS total FROM seg GROUP BY 1),\nsil AS (SELECT recording_id, trunc(round(start, 3) * 1000)::BIGINT + 250 AS mid FROM seg WHERE seg_idx % 3 <> 0),\n"
    logged = log_tt + adaptive[adaptive.index("st AS (") :]
    spaces = r"trim(regexp_replace({}, '[\t\n\f\r ]+', ' ', 'g'))"
    marks = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '[\t\n\f\r ]+([,.!?;:])', '\1', 'g'), '([,!?;:])([A-Za-z])', '\1 \2', 'g'), '!!+', '!', 'g'), '\?\?+', '?', 'g'), '\.\.+', '...', 'g')"
    plain = r"regexp_replace(trim(regexp_replace(regexp_replace({}, '(?i)\b(?:um|of|the)\b', '', 'g'), '[\t\n\f\r ]+', ' ', 'g')), '[\t\n\f\r ]+([,.!?;:])', '\1', 'g')"
    # two voices by recursion over units: of each voice the number, start and end of its open segment (null: none)
    voices = f"""{w}, vo AS (SELECT recording_id, word AS text, seg_idx % 2 AS v, start_ms - off AS start_ms, start_ms - off + 250 AS end_ms, seg_idx % 6 = 5 AND pos = 0 AS untimed,
    (seg_idx % 4 = 1 AND pos = max(pos) OVER (PARTITION BY recording_id, seg_idx)) OR right(word, 1) IN ('.', '!', '?', '。', '؟') AS closes, row_number() OVER (PARTITION BY recording_id ORDER BY start_ms - off, seg_idx, pos) AS rn
  FROM (SELECT *, CASE WHEN seg_idx % 2 = 1 THEN least(4000, start_ms - 300 * pos) ELSE 0 END AS off FROM wd)),
st AS (SELECT recording_id, rn, 0::BIGINT AS seg, 1::BIGINT AS n, CASE WHEN v = 0 AND NOT closes AND NOT untimed THEN 0::BIGINT END AS g0, start_ms AS s0, end_ms AS e0, CASE WHEN v = 1 AND NOT closes AND NOT untimed THEN 0::BIGINT END AS g1, start_ms AS s1, end_ms AS e1 FROM vo WHERE rn = 1
UNION ALL SELECT recording_id, rn, CASE WHEN own IS NULL OR untimed THEN n ELSE own END, CASE WHEN own IS NULL OR untimed THEN n + 1 ELSE n END,
    CASE WHEN untimed THEN NULL WHEN v = 1 THEN other WHEN closes THEN NULL ELSE coalesce(own, n) END, CASE WHEN v = 0 AND own IS NULL THEN start_ms ELSE s0 END, CASE WHEN v = 1 THEN e0 WHEN own IS NULL THEN end_ms ELSE greatest(e0, end_ms) END,
    CASE WHEN untimed THEN NULL WHEN v = 0 THEN other WHEN closes THEN NULL ELSE coalesce(own, n) END, CASE WHEN v = 1 AND own IS NULL THEN start_ms ELSE s1 END, CASE WHEN v = 0 THEN e1 WHEN own IS NULL THEN end_ms ELSE greatest(e1, end_ms) END
  FROM (SELECT u.*, n, s0, e0, s1, e1, CASE WHEN u.v = 0 THEN CASE WHEN u.start_ms - e0 <= 2000 AND u.start_ms - s0 < 20000 THEN g0 END ELSE CASE WHEN u.start_ms - e1 <= 2000 AND u.start_ms - s1 < 20000 THEN g1 END END AS own,
          CASE WHEN u.v = 0 THEN CASE WHEN u.start_ms <= e1 + 250 THEN g1 END ELSE CASE WHEN u.start_ms <= e0 + 250 THEN g0 END END AS other
        FROM st JOIN vo u ON u.recording_id = st.recording_id AND u.rn = st.rn + 1))"""
    strict = card.replace("0.25::DOUBLE * readability + 0.15::DOUBLE * vocabulary + 0.15::DOUBLE * variety + 0.1::DOUBLE * greatest(0, 100 - 100 * density) + 0.1::DOUBLE * consistency + 0.25::DOUBLE * coverage", "0.5::DOUBLE * readability + 0.5::DOUBLE * coverage")
    # turns across cuts; labels by recursion over chunks: of each voice its label there, and when each label was last heard
    tnorm = norm.replace("lower(text)", "lower(h.text)")
    stitched = f"""hu AS (SELECT g.recording_id, g.seg_idx % 2 AS v, p.chunk_idx, p.start_ms AS lo, p.end_ms AS hi, s, e, ws, greatest(s, p.start_ms) AS a, least(e, p.end_ms) AS b,
    lag(p.end_ms) OVER (PARTITION BY g.recording_id, g.seg_idx ORDER BY p.chunk_idx) AS x, row_number() OVER (PARTITION BY g.recording_id, p.chunk_idx ORDER BY g.seg_idx) AS unit_idx
  FROM (SELECT recording_id, seg_idx, {ms('start')} AS s, {ms(chr(34) + 'end' + chr(34))} AS e, {ws.format('text')} AS ws FROM seg) g JOIN plan p ON g.recording_id = p.recording_id AND e > p.start_ms AND s < p.end_ms),
pe AS (SELECT recording_id, chunk_idx, lag(end_ms) OVER (PARTITION BY recording_id ORDER BY chunk_idx) AS prev_end FROM plan),
ht AS (SELECT hu.recording_id, hu.chunk_idx, unit_idx, v, coalesce(array_to_string(ws[(a - s) * len(ws) // (e - s) + 1 : (b - s) * len(ws) // (e - s)], ' '), '') AS text,
    a + hu.chunk_idx % 2 * 20 AS start_ms, b + hu.chunk_idx % 2 * 20 AS end_ms, coalesce(keep_from_ms, 0) AS kf, keep_until_ms AS ku, prev_end FROM hu JOIN pe USING (recording_id, chunk_idx) JOIN cut USING (recording_id, chunk_idx)),
kt AS (SELECT h.*, {tnorm} AS norm, unit_idx = min(unit_idx) OVER (PARTITION BY recording_id, chunk_idx) AS head FROM ht h
  WHERE (start_ms >= kf AND (ku IS NULL OR start_ms < ku)) OR coalesce(start_ms < kf AND end_ms > prev_end + 500, false)),
gt AS (SELECT k.*, (SELECT min(c.chunk_idx) FROM kt c WHERE c.recording_id = k.recording_id AND c.head AND c.start_ms < c.kf AND c.chunk_idx > k.chunk_idx AND c.start_ms - 1000 <= k.start_ms) AS gone FROM kt k),
db AS (SELECT h.recording_id, h.chunk_idx, h.unit_idx, arg_max(p.norm, (p.chunk_idx, p.unit_idx)) = h.norm AND h.norm <> '' AND abs(arg_max(p.start_ms, (p.chunk_idx, p.unit_idx)) - h.start_ms) <= 500 AS doubled
  FROM gt h JOIN gt p ON p.recording_id = h.recording_id AND p.chunk_idx < h.chunk_idx AND (p.gone IS NULL OR p.gone > h.chunk_idx) WHERE h.head GROUP BY h.recording_id, h.chunk_idx, h.unit_idx, h.norm, h.start_ms),
nv AS (SELECT c.recording_id, c.chunk_idx, c.v, arg_min(p.v, (NOT (c.norm <> '' AND c.norm = p.norm), abs(p.start_ms - c.start_ms), p.unit_idx)) AS was
  FROM (SELECT ht.*, {tnorm.replace('h.text', 'text')} AS norm, plan.start_ms AS o_lo FROM ht JOIN plan USING (recording_id, chunk_idx)) c JOIN (SELECT *, {tnorm.replace('h.text', 'text')} AS norm FROM ht) p
    ON p.recording_id = c.recording_id AND p.chunk_idx = c.chunk_idx - 1 AND abs(p.start_ms - c.start_ms) <= 1000 AND p.start_ms >= o_lo - 1000 AND p.start_ms < c.prev_end
  WHERE c.start_ms >= o_lo AND c.start_ms < c.prev_end GROUP BY c.recording_id, c.chunk_idx, c.unit_idx, c.v),
vt AS (SELECT recording_id, chunk_idx, v, was, count(*) AS n FROM nv GROUP BY ALL),
rk AS (SELECT recording_id, chunk_idx, v, row_number() OVER (PARTITION BY recording_id, chunk_idx ORDER BY min(unit_idx)) AS r FROM ht GROUP BY 1, 2, 3),
en AS (SELECT recording_id, chunk_idx, v, max(start_ms) AS t FROM kt GROUP BY 1, 2, 3),
ck AS (SELECT rk.recording_id, rk.chunk_idx, list({{'v': rk.v, 'r': r, 't': t}} ORDER BY r) AS names, coalesce(any_value(votes), []) AS votes FROM rk LEFT JOIN en ON rk.recording_id = en.recording_id AND rk.chunk_idx = en.chunk_idx AND rk.v = en.v
  LEFT JOIN (SELECT vt.recording_id, vt.chunk_idx, list({{'n': -n, 'r': r, 'v': vt.v, 'was': was}}) AS votes FROM vt JOIN rk ON vt.recording_id = rk.recording_id AND vt.chunk_idx = rk.chunk_idx AND vt.v = rk.v GROUP BY 1, 2) w ON w.recording_id = rk.recording_id AND w.chunk_idx = rk.chunk_idx GROUP BY 1, 2),
lb AS (SELECT recording_id, -1::BIGINT AS chunk_idx, [NULL::BIGINT, NULL] AS label, []::STRUCT(t BIGINT, l BIGINT)[] AS heard, 0::BIGINT AS n FROM (SELECT DISTINCT recording_id FROM ck)
UNION ALL SELECT recording_id, chunk_idx, CASE WHEN names[1].v = 0 THEN [l1, l2] ELSE [l2, l1] END,
    list_concat(list_filter(heard, lambda h: NOT coalesce(h.l = l1 AND names[1].t IS NOT NULL OR h.l = l2 AND names[2].t IS NOT NULL, false)),
      list_filter([{{'t': least(-names[1].t, list_filter(heard, lambda h: h.l = l1)[1].t), 'l': l1}}, {{'t': least(-names[2].t, list_filter(heard, lambda h: h.l = l2)[1].t), 'l': l2}}], lambda h: h.l IS NOT NULL AND CASE WHEN h.l = l1 THEN names[1].t ELSE names[2].t END IS NOT NULL)), greatest(n, l1, l2)
  FROM (SELECT *, CASE WHEN len(names) > 1 THEN coalesce(w2, CASE WHEN w1 IS NULL THEN free[2].l ELSE free[1].l END, greatest(n, l1) + 1) END AS l2
    FROM (SELECT *, coalesce(w1, free[1].l, n + 1) AS l1 FROM (SELECT *, list_sort(list_filter(heard, lambda h: h.l IS DISTINCT FROM w1 AND h.l IS DISTINCT FROM w2)) AS free
      FROM (SELECT *, CASE WHEN b1.r = 1 THEN b1.l WHEN b2.r = 1 THEN b2.l END AS w1, CASE WHEN b1.r = 2 THEN b1.l WHEN b2.r = 2 THEN b2.l END AS w2 FROM (SELECT *, list_filter(cand, lambda c: c.r <> b1.r AND c.l <> b1.l)[1] AS b2
        FROM (SELECT *, cand[1] AS b1 FROM (SELECT ck.*, heard, n, list_sort(list_filter(list_transform(votes, lambda x: {{'n': x.n, 'r': x.r, 'l': label[x.was + 1]}}), lambda c: c.l IS NOT NULL)) AS cand
          FROM lb JOIN ck ON ck.recording_id = lb.recording_id AND ck.chunk_idx = lb.chunk_idx + 1)))))))),
sti AS (SELECT g.recording_id, row_number() OVER (PARTITION BY g.recording_id ORDER BY start_ms, g.chunk_idx, g.unit_idx) - 1 AS unit_idx, g.chunk_idx, text, 'Speaker ' || label[v + 1] AS speaker, start_ms, end_ms, g.v
  FROM gt g JOIN lb ON g.recording_id = lb.recording_id AND g.chunk_idx = lb.chunk_idx LEFT JOIN db ON g.recording_id = db.recording_id AND g.chunk_idx = db.chunk_idx AND g.unit_idx = db.unit_idx WHERE gone IS NULL AND NOT coalesce(doubled, false))"""
    return {
        "q_segments_from_units": f"""WITH RECURSIVE {seg}, {voices} SELECT st.recording_id, seg AS seg_idx, any_value(CASE v WHEN 1 THEN 'B' ELSE 'A' END) AS speaker, string_agg(text, ' ' ORDER BY st.rn) AS text,
  CASE WHEN NOT bool_or(untimed) THEN min(start_ms) / 1000 END AS start, CASE WHEN NOT bool_or(untimed) THEN max(end_ms) / 1000 END AS "end", format('[{{:02d}}:{{:02d}}:{{:02d}}]', min(start_ms) // 3600000, min(start_ms) // 60000 % 60, min(start_ms) // 1000 % 60) AS timestamp
FROM st JOIN vo ON st.recording_id = vo.recording_id AND st.rn = vo.rn GROUP BY 1, 2""",
        "q_stitch_turns": f"WITH RECURSIVE {seg}, {plan}, {cut}, {stitched} SELECT recording_id, unit_idx, chunk_idx, text, speaker, start_ms, end_ms FROM sti",
        "q_one_request_segments": f"""WITH RECURSIVE {seg}, {voices}, fl AS (SELECT recording_id, v, row_number() OVER (PARTITION BY recording_id ORDER BY min(rn)) AS k FROM vo WHERE NOT untimed AND (v = 1 OR recording_id % 5 <> 0) GROUP BY 1, 2)
SELECT st.recording_id, seg AS seg_idx, any_value(CASE WHEN untimed THEN CASE WHEN vo.v = 1 THEN 'B' ELSE 'A' END ELSE coalesce('Speaker ' || k, 'Unknown speaker') END) AS speaker, string_agg(text, ' ' ORDER BY st.rn) AS text,
  CASE WHEN NOT bool_or(untimed) THEN min(start_ms) / 1000 END AS start, CASE WHEN NOT bool_or(untimed) THEN max(end_ms) / 1000 END AS "end", format('[{{:02d}}:{{:02d}}:{{:02d}}]', min(start_ms) // 3600000, min(start_ms) // 60000 % 60, min(start_ms) // 1000 % 60) AS timestamp
FROM st JOIN vo ON st.recording_id = vo.recording_id AND st.rn = vo.rn LEFT JOIN fl ON fl.recording_id = vo.recording_id AND fl.v = vo.v GROUP BY 1, 2""",
        "q_quality_by_settings": f"WITH q AS ({strict}) SELECT recording_id, overall, assessment, concat_ws('; ', CASE WHEN readability < 90 THEN printf('Low readability score: %.1f', round(readability, 1)) END, CASE WHEN vocabulary < 60 THEN printf('Low vocabulary richness: %.1f', round(vocabulary, 1)) END, CASE WHEN density > 0.05 THEN printf('High punctuation density: %.3f', round(density, 3)) END, CASE WHEN coverage < 99 THEN printf('Low timestamp coverage: %.1f%%', round(coverage, 1)) END) AS warnings FROM q",
        # each turn is a segment
        "q_stitch_segments": f"""WITH RECURSIVE {seg}, {plan}, {cut}, {stitched} SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY unit_idx) - 1 AS seg_idx, speaker, text, start_ms / 1000 AS start, end_ms / 1000 AS "end",
  format('[{{:02d}}:{{:02d}}:{{:02d}}]', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60) AS timestamp FROM sti WHERE text <> ''""",
        "q_merge_overlap": f"WITH {seg} SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY seg_idx) - 1 AS seg_idx, speaker, text, timestamp FROM seg",
        "q_recogniser_segments": f"""WITH RECURSIVE {seg}, {w}, rw AS (SELECT *, lag(start_ms + 250) OVER o AS last, row_number() OVER o AS rn FROM wd WINDOW o AS (PARTITION BY recording_id ORDER BY seg_idx, pos)),
st AS (SELECT recording_id, rn, word, start_ms, 0::BIGINT AS grp, 1 AS size, start_ms AS since FROM rw WHERE rn = 1
UNION ALL SELECT r.recording_id, r.rn, r.word, r.start_ms, CASE WHEN f THEN grp + 1 ELSE grp END, CASE WHEN f THEN 1 ELSE size + 1 END, CASE WHEN f THEN r.start_ms ELSE since END
  FROM (SELECT s.grp, s.size, s.since, r.*, greatest(r.start_ms, r.last) - r.last >= 1000 OR s.size >= 18 OR greatest(r.start_ms, r.last) - s.since >= 8000 AS f FROM st s JOIN rw r ON r.recording_id = s.recording_id AND r.rn = s.rn + 1) r)
SELECT recording_id, grp AS seg_idx, 'Speaker 1' AS speaker, trim(string_agg(CASE WHEN word IN ('.', ',', '!', '?', ';', ':', chr(39), '"', ')', ']', '}}') OR starts_with(word, chr(39)) THEN word ELSE ' ' || word END, '' ORDER BY rn)) AS text,
  format('[{{:02d}}:{{:02d}}:{{:02d}}]', arg_min(start_ms, rn) // 3600000, arg_min(start_ms, rn) // 60000 % 60, arg_min(start_ms, rn) // 1000 % 60) AS timestamp FROM st GROUP BY 1, 2""",
        "q_clean_text": f"WITH a AS (SELECT conv_id, turn, text, {spaces.format('text')} AS s FROM conversations), b AS (SELECT *, {marks.format('s')} AS p FROM a), c AS (SELECT *, {plain.format('p')} AS f FROM b) SELECT conv_id, turn, CASE WHEN trim(f) = '' THEN text ELSE f END AS clean, concat_ws(',', CASE WHEN s <> text THEN 'spaces' END, CASE WHEN p <> text THEN 'punctuation' END, CASE WHEN f <> text THEN 'fillers' END) AS steps FROM c",
        "q_chunk_plan_adaptive": planned(adaptive),
        "q_plan_from_log": planned(logged),
        "q_speech_turns": f"WITH {seg} SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY start, seg_idx) - 1 AS unit_idx, text, speaker, {ms('start')} AS start_ms, {ms(chr(34) + 'end' + chr(34))} AS end_ms, NULL::VARCHAR AS error FROM seg",
        "q_speech_phrases": f"WITH {seg} SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY start, seg_idx) - 1 AS unit_idx, text, (seg_idx % 2)::VARCHAR AS speaker, {ms('start')} AS start_ms, {ms(chr(34) + 'end' + chr(34))} AS end_ms, NULL::VARCHAR AS error FROM seg",
        "q_silence_log": f"WITH {seg} SELECT recording_id, trunc(round(start, 3) * 1000)::BIGINT AS start_ms, trunc(round(start + 0.5, 3) * 1000)::BIGINT AS end_ms FROM seg WHERE seg_idx % 3 <> 0",
        "q_export_txt": f"WITH {seg} SELECT recording_id, string_agg(timestamp || ' ' || speaker || ': ' || text || chr(10), '' ORDER BY seg_idx) AS document FROM seg GROUP BY 1",
        "q_timestamp_quality": f"WITH {seg}, {tq} SELECT recording_id, score, back_steps, irregular, recommendation FROM tr",
        "q_score_warnings": f"WITH q AS ({card}) SELECT recording_id, concat_ws('; ', CASE WHEN readability < 70 THEN printf('Low readability score: %.1f', round(readability, 1)) END, CASE WHEN vocabulary < 30 THEN printf('Low vocabulary richness: %.1f', round(vocabulary, 1)) END, CASE WHEN density > 0.15 THEN printf('High punctuation density: %.3f', round(density, 3)) END, CASE WHEN coverage < 80 THEN printf('Low timestamp coverage: %.1f%%', round(coverage, 1)) END) AS warnings FROM q",
        "q_escalation": f"WITH q AS ({card}), {seg}, {tq}, cf AS (SELECT recording_id, count(*) AS n, count(c) AS known, count(*) FILTER (c >= 0.75) AS sure FROM (SELECT recording_id, CASE WHEN recording_id % 2 = 0 THEN seg_idx % 8 / 6 END AS c FROM seg) GROUP BY 1) SELECT recording_id, CASE WHEN overall < 78 THEN 'quality' WHEN recommendation <> 'skip' THEN 'timestamps' WHEN known * 2 >= n AND sure * 4 < known * 3 THEN 'confidence' END AS reason, round(greatest(0.0::DOUBLE, (78 - overall) / 78, (85 - score) / 85), 6) AS severity FROM q JOIN cf USING (recording_id) JOIN tr USING (recording_id)",
        "q_best_candidate": f"WITH {seg}, {cand}, s AS (SELECT recording_id, cid, CASE WHEN recording_id % 5 <> 0 THEN round(avg(length(text)), 4) END AS score FROM cand GROUP BY 1, 2) SELECT recording_id, cid AS candidate_id, score FROM s QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY score DESC NULLS LAST, cid) = 1",
        "q_run_evidence": f"WITH {seg}, {ev} SELECT recording_id, seg_idx, timestamp, sources, sources <> '' AS supported, disputed, CASE WHEN disputed AND sources = '' THEN 'review_required' ELSE 'adjudicated' END AS status, timestamp || ' ' || speaker || ': “' || array_to_string({ws.format('text')}[1:10], ' ') || CASE WHEN len({ws.format('text')}) > 10 THEN '…' ELSE '' END || '”' AS location FROM evd",
        "q_dispute_islands": f"WITH {seg}, {ev}, d AS (SELECT recording_id, seg_idx, CASE WHEN has_b THEN 'adjudicated' ELSE 'review_required' END AS status FROM evd WHERE disputed), i AS (SELECT *, seg_idx - row_number() OVER (PARTITION BY recording_id, status ORDER BY seg_idx) AS k FROM d) SELECT recording_id, min(seg_idx) AS first_idx, max(seg_idx) AS last_idx, status, count(*) AS n FROM i GROUP BY recording_id, status, k",
        "q_candidates_disagree": f"WITH {seg}, {cand}, b AS (SELECT cid, recording_id, list_sort(flatten(list({tok}))) AS ws FROM cand GROUP BY 1, 2), p AS (SELECT x.recording_id, round(min({sim('x.ws', 'y.ws')}), 6) AS similarity FROM b x JOIN b y ON x.recording_id = y.recording_id AND x.cid < y.cid GROUP BY 1) SELECT *, similarity < 0.82 AS disagree FROM p",
        "q_nearest_unit_join": f"WITH {seg}, {plan}, {near} SELECT * FROM nr",
        "q_speaker_votes": f"WITH {seg}, {plan}, {near} SELECT recording_id, chunk_idx, raw, label, count(*) AS votes FROM nr GROUP BY ALL",
        "q_span_digest": f"WITH {seg}, l AS (SELECT *, speaker || ': ' || text AS line, row_number() OVER (PARTITION BY recording_id ORDER BY seg_idx DESC) AS back FROM seg) SELECT recording_id, min_by(line, seg_idx) AS head, max_by(line, seg_idx) AS tail, string_agg(line, chr(10) ORDER BY seg_idx) FILTER (back <= 5) AS context FROM l GROUP BY 1",
        "q_playhead": f"WITH {seg} SELECT recording_id, max(seg_idx) AS seg_idx FROM seg WHERE start <= 20.05 GROUP BY 1",
        "q_stitch": f"WITH {seg}, {plan}, {cut}, {w}, kp AS (SELECT wd.recording_id, chunk_idx, word AS text, start_ms, seg_idx, pos, {wnorm} AS norm FROM wd JOIN cut c ON wd.recording_id = c.recording_id AND start_ms >= coalesce(keep_from_ms, 0) AND (keep_until_ms IS NULL OR start_ms < keep_until_ms)), lg AS (SELECT *, lag(norm) OVER o AS pn, lag(start_ms) OVER o AS ps, lag(chunk_idx) OVER o AS pc FROM kp WINDOW o AS (PARTITION BY recording_id ORDER BY chunk_idx, start_ms, seg_idx, pos)) SELECT recording_id, chunk_idx, text, start_ms FROM lg WHERE NOT coalesce(pc <> chunk_idx AND norm <> '' AND norm = pn AND abs(start_ms - ps) <= 500, false)",
        "q_replacements": per.format(chain([("the law", "$1 law"), ("and", "&"), ("the", "THE")]) + " AS clean"),
        "q_find_replace": per.format("regexp_replace(text, '(?i)an', 'AN', 'g') AS clean, len(regexp_extract_all(text, '(?i)an'))::BIGINT AS matches"),
        "q_proper_nouns": per.format(chain([(n, n) for n in text.PROPER_NOUNS]) + " AS clean"),
        "q_sentence_case": per.format(r"""coalesce(array_to_string(list_transform(regexp_extract_all(text, '[^.!?]+|[.!?]+'), lambda p: regexp_replace(CASE WHEN regexp_matches(p, '\p{L}')
  THEN regexp_extract(p, '(?s)^([^\p{L}]*)(\p{L})(.*)$', 1) || upper(regexp_extract(p, '(?s)^([^\p{L}]*)(\p{L})(.*)$', 2)) || regexp_extract(p, '(?s)^([^\p{L}]*)(\p{L})(.*)$', 3) ELSE p END, '\bi\b', 'I', 'g')), ''), '') AS clean"""),
        "q_escape_xml": per.format("replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS clean"),
        "q_normalize_timestamp": per.format("format('[{:02d}:05:{:02d}]', turn, conv_id % 100) AS timestamp"),
        "q_language_codes": per.format("CASE WHEN turn % 2 = 0 THEN 'en-US,nl-NL,cmn-Hans-CN,es-419' END AS codes"),
    }
