"""Queries of documents, displays, prompts, media and model answers, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import display, text
from ..operators import evidence, export, folds, prompts, quality, subtitles, timeline
from ..plans import settings
from ..sources import media, payloads, responses
from ..sources.fixtures import segments, table, words

_KEYS = ("recording_id", "seg_idx")
_seg = lambda f: lambda s, d: f(segments(s, d))
_pick = lambda k, *xs: F.element_at(F.array(*(x if isinstance(x, Column) else F.lit(x) for x in xs)), (k % len(xs) + 1).cast("int"))


# ---------------------------------------------------------------- documents


def _runs(seg: DataFrame) -> DataFrame:
    """Segments of two speakers, one of whom speaks two in a row."""
    return seg.withColumn("speaker", F.when(F.col("seg_idx") % 3 == 0, "A").otherwise("B"))


def _recordings(seg: DataFrame) -> DataFrame:
    r = F.col("recording_id")
    return seg.groupBy("recording_id").agg(F.max("end").alias("e")).select("recording_id", F.when(r % 4 != 0, F.col("e")).alias("duration"), F.when(r % 3 != 0, F.date_add(F.lit("2024-01-28").cast("date"), (r % 9).cast("int"))).alias("created_at"))


def _cells(seg: DataFrame) -> DataFrame:
    k = F.col("seg_idx") % 5
    said = F.when(k == 0, F.concat(F.lit("=1,"), "text")).when(k == 1, F.concat(F.lit('say "'), "text", F.lit('"'))).when(k == 2, F.concat(F.lit(" "), "text")).when(k == 3, F.concat("text", F.lit("\nmore"))).otherwise("\\.")
    return seg.withColumn("text", said)


def _downloads(seg: DataFrame) -> DataFrame:
    """Six requests for each recording, as text: plain, renamed, with too many or unreadable names, unknown, and without a transcript."""
    r = F.col("recording_id")
    many = F.transform(F.sequence(F.lit(1), F.lit(65)), lambda i: F.concat(F.lit("s"), i.cast("string"), F.lit("=x")))
    asked = [(".TXT", F.array()), ("", F.array(F.lit("user=Ann"), F.lit(" user = Bo=b "))), ("text", many), ("csv", F.array(F.lit("=x"))), ("pdf", F.array()), ("txt", F.array(F.lit(f"{'l' * 121}=x")))]
    one = F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("k"), F.lit(name).alias("format"), names.cast("array<string>").alias("speakers")) for i, (name, names) in enumerate(asked)))).alias("x")
    rows = seg.select("recording_id").distinct().select("recording_id", one).select((r * 10 + F.col("x.k")).alias("request_id"), "recording_id", "x.format", "x.speakers", F.lit("dir/a talk.mp3").alias("filename"), F.lit(True).alias("timestamps"))
    return export.downloads(rows, seg.where(r % 7 != 3)).withColumn("document", F.col("document").cast("string"))


def _json(seg: DataFrame) -> DataFrame:
    """The documents read back."""
    docs = export.render(seg, "json", recordings=_recordings(seg))
    kind = "recording_id bigint, duration double, segments array<struct<timestamp:string,speaker:string,text:string,start:double,end:double>>"
    read = docs.select(F.from_json("document", kind).alias("d")).select("d.recording_id", "d.duration", F.posexplode("d.segments").alias("pos", "x"))
    return read.select("recording_id", F.round("duration", 3).alias("duration"), F.col("pos").cast("long").alias("pos"), "x.*")


def _formats(spark, d):
    rows = [(f.name, f.label, f.extension, f.content_type, f.binary, f.timestamps) for f in export.FORMATS]
    known = spark.createDataFrame(rows, "name string, label string, extension string, content_type string, binary boolean, timestamps boolean")
    names = spark.createDataFrame([(x, export.lookup(x).name) for x in (".TXT", "Markdown", "word", " subrip", "WebVTT", ".csv", "JSON")], "asked string, name string")
    return known.join(names, "name")


def _docx(seg: DataFrame) -> DataFrame:
    return subtitles.docx_bodies(_runs(seg), "A & B", export.document_summaries(_runs(seg), _recordings(seg)))


def _units(seg: DataFrame) -> DataFrame:
    w = words(seg)
    return w.select("recording_id", (F.col("seg_idx") * 1_000_000 + F.col("pos")).alias("unit_idx"), F.col("word").alias("text"), F.lit("v").alias("speaker"), "start_ms", "end_ms")


# ---------------------------------------------------------------- prompts


def _contexts(spark, d):
    r = F.col("s_suppkey")
    none = F.array().cast("array<string>")
    rows = table(spark, d, "supplier").select(
        r.alias("recording_id"), F.when(r % 2 == 0, F.array(F.lit("Ada"), F.lit("Ben"))).otherwise(none).alias("speaker_names"), F.when(r % 3 == 0, F.lit("law")).otherwise(" ").alias("topic"), F.when(r % 5 == 0, F.array(F.lit("tort"))).alias("terms"),
        F.when(r % 7 == 0, F.lit("be brief")).alias("instructions"), F.lit(None).cast("string").alias("language_hints"), F.when(r % 4 == 0, F.array(F.lit("en-US"), F.lit("nl-NL"))).otherwise(none).alias("language_codes"), none.alias("keywords"),
    )
    return prompts.context_prompt(rows)


def _blocks(seg: DataFrame) -> DataFrame:
    one = seg.withColumn("candidate_id", F.lit("a")).unionByName(seg.where("recording_id % 2 = 0").withColumn("candidate_id", F.lit("b")))
    ids = F.explode(F.array(F.lit("a"), F.lit("b"))).alias("candidate_id")
    heads = seg.select("recording_id").distinct().select("recording_id", ids).select("recording_id", "candidate_id", F.concat(F.lit("L"), "candidate_id").alias("label"), F.lit("k").alias("kind"), F.lit("m").alias("model"), F.when(F.col("candidate_id") == "b", F.array(F.lit("x"), F.lit("y"))).alias("notes"))
    return prompts.candidate_texts(one, heads)


def _chunk_prompts(seg: DataFrame) -> DataFrame:
    plan = timeline.chunk_plan(seg).withColumn("context", F.when(F.col("chunk_idx") > 0, F.lit("before"))).drop("end_ms", "boundary_type")
    return prompts.chunk_prompt(plan, "Transcribe.", ("Ada",), "Be exact.")


# ---------------------------------------------------------------- media


def _names(spark, d):
    p = F.col("page_id")
    return table(spark, d, "pages").select("page_id", F.concat(_pick(p, "talk", "a b&c", "dir/CON", "..", "x.y", "audio", "q\\é?"), _pick(p, ".MP3", ".wav", "", ".m4a", ".ogg", ".exe")).alias("name"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("size"))


def _probes(seg: DataFrame) -> DataFrame:
    r = F.col("recording_id")
    rows = seg.groupBy("recording_id").agg(F.max("end").alias("e"))
    stream = lambda kind, rate: F.struct(F.lit(kind).alias("codec_type"), F.lit(rate).alias("sample_rate"), F.lit(2).alias("channels"))
    streams = F.when(r % 5 == 0, F.array(stream("video", "0"))).otherwise(F.array(stream("video", "0"), stream("audio", "44100"), stream("audio", "8000")))
    seconds = F.when(r % 7 == 0, "N/A").otherwise(F.format_string("%.3f", "e"))
    body = F.when(r % 11 == 0, "{oops").otherwise(F.to_json(F.struct(F.struct(seconds.alias("duration")).alias("format"), streams.alias("streams"))))
    return media.probed(rows.select("recording_id", F.concat(F.lit("f"), r.cast("string"), F.lit(".WAV")).alias("name"), (r * 1024).alias("size_bytes"), body.alias("json")))


def _metadata(seg: DataFrame) -> DataFrame:
    return media.metadata(_probes(seg), timeline.chunk_plan(seg)).withColumns({"size_mb": F.round("size_mb", 6)})


def _volumes(seg: DataFrame) -> DataFrame:
    r = F.col("recording_id")
    level = F.when(r % 3 == 0, "-inf").otherwise(F.format_string("-%d.5", r % 50))
    rows = seg.select("recording_id").distinct()
    one = rows.select("recording_id", F.concat(F.lit("[v] max_volume: "), level, F.lit(" dB")).alias("line")).where("recording_id % 10 != 1")
    return media.silent(one.unionByName(rows.select("recording_id", F.lit("frame= 1").alias("line"))))


def _waves(seg: DataFrame) -> DataFrame:
    le = lambda n: F.unhex(F.regexp_replace(F.lpad(F.hex(n), 8, "0"), "^(..)(..)(..)(..)$", "$4$3$2$1"))
    raw = lambda s: F.lit(s).cast("binary")
    body = F.col("text").cast("binary")
    odd = F.concat(raw("LIST"), le(F.lit(3)), raw("abc"), raw("\0"))
    size = F.when(F.col("seg_idx") % 2 == 0, F.octet_length("text")).otherwise(F.lit(0))
    file = F.concat(raw("RIFF"), le(F.lit(36)), raw("WAVE"), odd, raw("data"), le(size), body)
    file = F.when(F.col("seg_idx") % 5 == 4, body).when(F.col("seg_idx") % 5 == 3, F.concat(raw("RIFF"), le(F.lit(4)), raw("WAVE"), odd)).otherwise(file)
    key = F.col("recording_id") * 1000 + F.col("seg_idx")
    return media.wave_sizes(seg.select(key.alias("recording_id"), file.alias("content")))


def _dispatched(seg: DataFrame) -> DataFrame:
    """Each segment as an answer: words with times, a text without them, or segments of a general model."""
    k = (F.col("recording_id") + F.col("seg_idx")) % 3
    w = words(seg).withColumn("at", F.col("pos") * 300)
    stamp = lambda c: F.format_string("%.3fs", c / 1000)
    one = F.struct(F.lit("word_info").alias("type"), F.col("word").alias("text"), F.when(F.col("pos") % 2 == 0, "x").otherwise("y").alias("speaker"), stamp(F.col("at")).alias("start_offset"), stamp(F.col("at") + 250).alias("end_offset"), F.lit(None).cast("int").alias("start_index"), F.lit(None).cast("int").alias("end_index"))
    said = w.groupBy("recording_id", "seg_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", one.alias("x")))), lambda v: v["x"]).alias("all"))
    rows = seg.join(said, ["recording_id", "seg_idx"], "left")
    content = F.struct(F.lit("text").alias("type"), F.col("text"), F.when(k == 0, F.col("all")).alias("annotations"))
    step = F.struct(F.lit("model_output").alias("type"), F.array(content).alias("content"))
    general = F.struct(F.array(F.struct(F.lit("[00:00:05]").alias("timestamp"), F.lit("Ann").alias("speaker"), F.col("text"))).alias("segments"))
    payload = F.when(k == 2, F.to_json(general)).otherwise(F.to_json(F.struct(F.array(step).alias("steps"))))
    requests = rows.select("recording_id", F.col("seg_idx").alias("chunk_idx"), (F.col("seg_idx") * 15_000).alias("offset_ms"), payload.alias("payload"))
    return responses.dispatched_segments(requests, (F.col("recording_id") + F.col("chunk_idx")) % 3 != 2)


def _progress(seg: DataFrame) -> DataFrame:
    us = F.round(F.col("end") * 1_000_000).cast("long")
    lines = F.explode(F.array(F.concat(F.lit("out_time_us="), us.cast("string")), F.lit("progress=continue"), F.lit("out_time_us=N/A"))).alias("line")
    return payloads.decoded_ms(seg.select("recording_id", lines))


def _stamped(seg: DataFrame) -> DataFrame:
    """Transcripts as models send them: an object in a fence, a bare list, or broken."""
    r = F.col("recording_id")
    one = F.struct(F.concat(F.lit("0:0:"), (F.col("seg_idx") % 60).cast("string")).alias("timestamp"), F.concat(F.lit(" "), "speaker").alias("speaker"), "text", (F.col("seg_idx") / 4).alias("confidence"))
    lists = seg.groupBy("recording_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", one.alias("x")))), lambda v: v["x"]).alias("segments"))
    body = F.when(r % 3 == 0, F.concat(F.lit("```json\n"), F.to_json(F.struct("segments")), F.lit("\n```"))).when(r % 3 == 1, F.to_json("segments")).otherwise("sorry")
    return payloads.transcript_segments(lists.select("recording_id", body.alias("payload"))).withColumn("confidence", F.round("confidence", 6))


# ---------------------------------------------------------------- model answers


def _annotated(seg: DataFrame) -> DataFrame:
    """Words of each segment's text as annotations: some without a start, with an end before it, or named by bytes."""
    w = words(seg)
    k = (F.col("recording_id") + F.col("seg_idx") + F.col("pos")) % 7
    start = F.when(k == 2, F.lit(None).cast("string")).when(k == 3, "-1s").otherwise(F.format_string("%.3fs", F.col("start_ms") / 1000))
    end = F.when(k == 4, F.lit("0.001s")).when(k == 5, F.lit(None).cast("string")).otherwise(F.format_string("%.3fs", F.col("end_ms") / 1000))
    said = F.when(k == 6, "").otherwise(F.col("word"))
    at = F.when(k == 6, 0).cast("int")
    one = F.struct(F.lit("word_info").alias("type"), said.alias("text"), "speaker", start.alias("start_offset"), end.alias("end_offset"), at.alias("start_index"), F.when(k == 6, 2).cast("int").alias("end_index"))
    rows = w.groupBy("recording_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "pos", one.alias("x")))), lambda v: v["x"]).alias("annotations"))
    r = F.col("recording_id")
    content = F.struct(F.lit("text").alias("type"), F.when(r % 13 == 0, "é").otherwise("ab cd").alias("text"), F.col("annotations").alias("annotations"))
    step = F.struct(F.when(r % 17 == 0, "thought").otherwise("model_output").alias("type"), F.array(content).alias("content"))
    return responses.word_units(rows.select("recording_id", F.lit(1).alias("chunk_idx"), F.lit(500).alias("offset_ms"), F.to_json(F.struct(F.array(step).alias("steps"))).alias("payload")))


def _aligned(seg: DataFrame) -> DataFrame:
    one = seg.withColumn("confidence", F.lit(0.5))
    k = F.col("recording_id") % 4
    two = one.withColumn("text", F.when((k == 1) & (F.col("seg_idx") >= 2), F.upper("text")).otherwise(F.col("text"))).withColumn("timestamp", F.lit("[00:00:00]")).where((k != 2) | (F.col("seg_idx") != 1))
    return responses.alignment_errors(one, two)


def _answered(seg: DataFrame) -> DataFrame:
    r = F.col("recording_id")
    part = lambda kind, said: F.struct(F.lit(kind).alias("type"), F.lit(said).alias("text"))
    step = lambda kind, *parts: F.struct(F.lit(kind).alias("type"), (F.array(*parts) if parts else F.array().cast("array<struct<type:string,text:string>>")).alias("content"))
    steps = _pick(r, F.array(step("model_output", part("text", "old")), step("thought"), step("model_output", part("image", ""), part("text", "a"), part("text", "b"))), F.array(step("model_output", part("text", "kept")), step("thought")), F.array(step("function_call")), F.array(step("thought")))
    status = _pick(F.floor(r / 4), "completed", "failed", "requires_action", "queued", "strange")
    errors = F.array(F.struct(F.lit("E1").alias("code"), F.lit("bad").alias("message")))
    return responses.answers(seg.select("recording_id").distinct().select("recording_id", F.to_json(F.struct(status.alias("status"), steps.alias("steps"), errors.alias("errors"))).alias("payload")))


def _failures(spark, d):
    e = F.col("event_id")
    code = _pick(e, 429, 503, 500, 404, None, None, None, 408).cast("int")
    said = _pick(e, "x", "x", "x", "x", "read: connection reset by peer", "dial: connection refused", "weird", "x")
    wait = _pick(e, "7", "", "soon", "Mon, 01 Jan 2024 00:00:30 GMT")
    rows = table(spark, d, "events")
    return rows.select("event_id", F.coalesce(responses.retryable(code, said), F.lit(False)).alias("retry"), responses.may_have_spent(code, said).alias("spent"), responses.retry_after(wait, F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))).cast("long").alias("wait"), responses.reserved_tokens(F.col("props"), e % 10 - 5, F.lit(100)).cast("long").alias("reserved"), responses.output_cap(F.lit(65536), (e % 90000).cast("long"), F.lit(settings.least_output("gemini-4-argon"))).cast("long").alias("cap"))


def _decided(seg: DataFrame) -> DataFrame:
    r = F.col("recording_id")
    one = F.struct("timestamp", "speaker", "text")
    lists = seg.groupBy("recording_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", one.alias("x")))), lambda v: v["x"]).alias("segments"))
    body = F.to_json(F.struct("segments", F.array(F.lit("a"), F.lit("b")).alias("selected_candidate_ids")))
    raw = F.when(r % 4 == 0, "").when(r % 4 == 1, "no").otherwise(F.concat(F.lit("```\n"), body, F.lit("\n```")))
    header, rows = responses.decisions(lists.select("recording_id", raw.alias("payload")))
    counts = rows.where("error is null").groupBy("recording_id").agg(F.count(F.lit(1)).alias("n"))
    return header.join(counts, "recording_id", "left").select("recording_id", F.array_join("selected", ",").alias("selected"), "error", "n")


# ---------------------------------------------------------------- settings


def _plans(spark, d):
    raw = _pick(F.col("s_suppkey"), "gemini|@auto|@model; gemini|second|@secondary-auto", "parakeet|p|@parakeet;gemini||google-gla:gemini-3-flash-preview;broken", "gemini|x|MAI-Transcribe-2;other|y|m", "")
    return settings.planned_candidates(table(spark, d, "supplier").select(F.col("s_suppkey").alias("plan"), raw.alias("text")), settings.SPEECH_MODEL)


def _plan_errors(spark, d):
    s = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(s.alias("plan"), F.posexplode(F.array(F.lit("a"), F.lit("b"))).alias("pos", "x"))
    second = F.col("pos") == 1
    k = F.col("plan") % 6
    return settings.candidate_errors(rows.select("plan", "pos", F.when(second & (k == 1), "a").when(second & (k == 2), " ").otherwise(F.col("x")).alias("id"), F.when(second & (k == 3), "odd").when(second & (k == 4), "speech").otherwise("gemini").alias("kind"), F.when(second & (k == 5), "gemini-0").otherwise("gemini-3.8-flash").alias("model")))


def _packs(spark, d):
    n = F.col("s_suppkey")
    name = F.concat(F.lit("pack-"), (n % 4).cast("string"))
    content = F.concat(F.lit("---\nname: "), F.when(n % 9 == 0, "Bad Name").otherwise(name), F.lit("\ndescription: about\nmetadata:\n  kind: format\n  formats: \"x, Y-"), (n % 4).cast("string"), F.lit("\"\n---\nBody "), n.cast("string"))
    rows = table(spark, d, "supplier").select((n % 3).alias("root"), name.alias("folder"), F.when(n % 7 == 0, "no front").otherwise(content).alias("content"), n)
    found = settings.packs(rows)
    return found.where("chosen").select("root", "name", "kind", F.array_join("keys", ",").alias("keys"))


def _budgets(spark, d):
    s = settings.Settings(model="gemini-3.8-flash").checked()
    n = F.col("s_suppkey") % 5
    rows = [(k, *s.budget(k).values()) for k in range(5)]
    names = list(s.budget(1))
    known = spark.createDataFrame(rows, "spans long, " + ", ".join(f"{x} long" for x in names))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("recording_id"), n.alias("spans")).join(F.broadcast(known), "spans")


QUERIES = {
    "q_turns": _seg(lambda x: subtitles.turns(_runs(x))),
    "q_export_turns_text": _seg(lambda x: export.render(_runs(x), "text", export.Options(timestamps=False))),
    "q_export_markdown_summary": _seg(lambda x: export.render(_runs(x), "markdown", recordings=_recordings(x))),
    "q_document_summaries": _seg(lambda x: export.document_summaries(_runs(x), _recordings(x))),
    "q_export_docx_body": _seg(_docx),
    "q_export_docx": _seg(lambda x: export.render(x, "docx", recordings=_recordings(x)).select("recording_id", (F.substring("document", 1, 2) == F.lit("PK").cast("binary")).alias("zip"))),
    "q_export_srt_lines": _seg(lambda x: export.render(x, "srt")),
    "q_export_vtt_lines": _seg(lambda x: export.render(x, "vtt", export.Options(names={"user": "A&B"}))),
    "q_downloads": _seg(_downloads),
    "q_export_csv": _seg(lambda x: export.render(_cells(x), "csv")),
    "q_export_json_rows": _seg(_json),
    "q_format_registry": _formats,
    "q_formatted_lines": _seg(export.formatted),
    "q_segments_one_voice": _seg(lambda x: folds.segments_from_units(_units(x)).drop("timestamp")),
    "q_shown_ends": _seg(display.shown_ends),
    "q_short_durations": lambda s, d: table(s, d, "events").select("event_id", display.short_duration(F.col("event_id") * 7.5).alias("shown")),
    "q_search_rows": _seg(lambda x: display.search(x, " AN ").select(*_KEYS, "matches")),
    "q_visible_rows": _seg(lambda x: display.visible_rows(x, "an")),
    "q_result_summary": _seg(lambda x: display.summary(x, x.groupBy("recording_id").agg(F.max("end").alias("duration")).withColumns({"model": F.lit("m"), "judged": F.col("recording_id") % 2 == 0, "processing_time": F.lit(65.0), "score": F.col("recording_id") % 100 + 0.5}))),
    "q_context_prompts": _contexts,
    "q_candidate_blocks": _seg(_blocks),
    "q_judge_prompts": _seg(lambda x: prompts.judge_prompt(_blocks(x), speakers=("Ada",), label="chunk 1 of 2").select("recording_id", F.char_length("prompt").cast("long").alias("chars"), F.sha2("prompt", 256).alias("digest"))),
    "q_chunk_prompts": _seg(_chunk_prompts),
    "q_file_checks": lambda s, d: _names(s, d).select("page_id", media.file_error(F.col("name"), F.col("size") * 1000, 1).alias("error"), media.media_type(F.col("name"), F.when(F.col("page_id") % 2 == 0, " Audio/OGG")).alias("type")),
    "q_safe_filenames": lambda s, d: _names(s, d).select("page_id", media.safe_filename(F.col("name")).alias("safe"), media.transcript_title(F.col("name")).alias("title")),
    "q_probes": _seg(_probes),
    "q_recording_metadata": _seg(_metadata),
    "q_silent_chunks": _seg(_volumes),
    "q_wave_sizes": _seg(_waves),
    "q_dispatched_segments": _seg(_dispatched),
    "q_decoded_durations": _seg(_progress),
    "q_cut_commands": _seg(lambda x: timeline.chunk_plan(x).select("recording_id", "chunk_idx", F.array_join(media.cut_command(F.lit("in.wav"), F.col("start_ms"), F.col("end_ms"), F.concat(F.lit("chunk_"), "chunk_idx", F.lit(".wav"))), " ").alias("command"))),
    "q_transcript_payloads": _seg(_stamped),
    "q_word_annotations": _seg(_annotated),
    "q_alignment_errors": _seg(_aligned),
    "q_answers": _seg(_answered),
    "q_failures": _failures,
    "q_decisions": _seg(_decided),
    "q_candidate_plans": _plans,
    "q_candidate_plan_errors": _plan_errors,
    "q_packs": _packs,
    "q_run_budgets": _budgets,
    "q_trimmed_lists": lambda s, d: table(s, d, "events").select("event_id", F.array_join(F.filter(F.transform(F.split(F.concat(F.lit(" a ,, "), "event_type", F.lit(" ,b")), ","), text.trimmed), lambda x: x != ""), "|").alias("items"), settings.scrubbed(F.col("props"), ("k",)).alias("scrubbed")),
}


def oracle(seg: str, plan: str, ws: str) -> dict[str, str]:
    """The SQL of QUERIES."""
    runs = "rs AS (SELECT recording_id, seg_idx, CASE WHEN seg_idx % 3 = 0 THEN 'A' ELSE 'B' END AS speaker, text, start, row_number() OVER (PARTITION BY recording_id ORDER BY seg_idx) AS rn FROM seg)"
    same = "r.speaker = t.speaker AND r.start - t.ts < 120"
    turns = f"""{seg}, {runs}, tr AS (SELECT recording_id, rn, speaker, 0::BIGINT AS turn_idx, start AS ts, text FROM rs WHERE rn = 1 UNION ALL SELECT r.recording_id, r.rn, r.speaker, CASE WHEN {same} THEN turn_idx ELSE turn_idx + 1 END, CASE WHEN {same} THEN t.ts ELSE r.start END, r.text FROM tr t JOIN rs r ON r.recording_id = t.recording_id AND r.rn = t.rn + 1),
tu AS (SELECT recording_id, turn_idx, any_value(speaker) AS speaker, any_value(ts) AS start, string_agg(trim(text), ' ' ORDER BY rn) AS text, count(*) AS n_segments FROM tr GROUP BY 1, 2)"""
    rec = """rc AS (SELECT recording_id, CASE WHEN recording_id % 4 <> 0 THEN max("end") END AS duration, CASE WHEN recording_id % 3 <> 0 THEN DATE '2024-01-28' + (recording_id % 9)::INT END AS created_at FROM seg GROUP BY 1)"""
    clock = lambda c: f"(CASE WHEN floor({c}) >= 3600 THEN format('{{:d}}:{{:02d}}:{{:02d}}', floor({c})::BIGINT // 3600, floor({c})::BIGINT // 60 % 60, floor({c})::BIGINT % 60) ELSE format('{{:d}}:{{:02d}}', floor({c})::BIGINT // 60, floor({c})::BIGINT % 60) END)"
    summ = f"""{rec}, pp AS (SELECT recording_id, count(DISTINCT speaker) AS n FROM rs GROUP BY 1), sm AS (SELECT recording_id, concat_ws(' · ', CASE WHEN duration > 0 THEN 'Duration ' || {clock('duration')} END, n || CASE WHEN n = 1 THEN ' speaker' ELSE ' speakers' END, strftime(created_at, '%-d %B %Y')) AS summary FROM rc JOIN pp USING (recording_id))"""
    esc = lambda c: f"regexp_replace({c}, '([\\\\`*_\\[\\]<>#|])', '\\\\\\1', 'g')"
    xml = lambda c: f"replace(replace(replace(regexp_replace({c}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', chr(65533), 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    para = lambda style, c: ("'<w:p>'" if not style else f"'<w:p><w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>'") + f" || {c} || '</w:p>'"
    run = lambda c, look="": f"'<w:r>{look}<w:t xml:space=\"preserve\">' || {c} || '</w:t></w:r>'"
    ms = lambda c: f"round({c} * 1000)::BIGINT"
    precise = lambda c, sep: f"format('{{:02d}}:{{:02d}}:{{:02d}}{sep}{{:03d}}', {ms(c)} // 3600000, {ms(c)} // 60000 % 60, {ms(c)} // 1000 % 60, {ms(c)} % 1000)"
    stop = 'CASE WHEN nx > start AND nx < "end" THEN nx ELSE "end" END'
    cell = "CASE seg_idx % 5 WHEN 0 THEN '\"' || chr(39) || '=1,' || replace(text, '\"', '\"\"') || '\"' WHEN 1 THEN '\"say \"\"' || replace(text, '\"', '\"\"') || '\"\"\"' WHEN 2 THEN '\" ' || replace(text, '\"', '\"\"') || '\"' WHEN 3 THEN '\"' || replace(text, '\"', '\"\"') || chr(10) || 'more\"' ELSE '\"\\.\"' END"
    word = f"wd AS (SELECT recording_id, seg_idx, speaker, pos, ws[pos + 1] AS word, round(start * 1000)::BIGINT + 300 * pos AS start_ms FROM (SELECT *, unnest(range(0, len(ws))) AS pos FROM (SELECT *, {ws.format('text')} AS ws FROM seg)))"
    names = "nm AS (SELECT page_id, (['talk', 'a b&c', 'dir/CON', '..', 'x.y', 'audio', 'q\\é?'])[page_id % 7 + 1] || (['.MP3', '.wav', '', '.m4a', '.ogg', '.exe'])[page_id % 6 + 1] AS name, strlen(coalesce(html, '')) AS size FROM pages), nx AS (SELECT *, lower(regexp_extract(regexp_extract(name, '[^/\\\\]*$', 0), '\\.([^.]*)$', 1)) AS ext FROM nm)"
    # cuts of a segment's words: as many cues as length and time need, cut where one is full or, half full, a sentence ends
    cues = f"""{seg}, q0 AS (SELECT *, lead(start) OVER (PARTITION BY recording_id ORDER BY seg_idx) AS nx FROM seg),
q1 AS (SELECT recording_id, seg_idx, speaker, start, CASE WHEN nx > start AND nx < "end" THEN nx ELSE "end" END AS stop, {ws.format('text')} AS ws FROM q0),
q2 AS (SELECT *, list_transform(range(1, len(ws) + 1), lambda i: length(array_to_string(ws[1:i], ' ')) + 1) AS ends FROM q1 WHERE len(ws) > 0),
q3 AS (SELECT *, least(greatest(ceil((ends[-1] - 1) / 84), ceil((stop - start) / 7), 1), len(ws))::BIGINT AS cnt FROM q2),
q4 AS (SELECT *, ceil((ends[-1] - 1) / cnt)::BIGINT AS target FROM q3),
ct AS (SELECT recording_id, seg_idx, [0::BIGINT] AS cuts, cnt > 1 AS more FROM q4 UNION ALL SELECT recording_id, seg_idx, CASE WHEN fits THEN list_append(cuts, cut) ELSE cuts END, fits AND len(cuts) + 1 < cnt FROM
  (SELECT *, cut <= len(ws) - (cnt - len(cuts)) AS fits FROM (SELECT *, least(greatest(first + 1, len(list_filter(ends, lambda x: x <= base + target + 1))), coalesce(list_min(list_filter(range(first, len(ws)), lambda i: ends[i + 1] >= base + target / 2 + 1 AND regexp_matches(ws[i + 1], '[.!?]$'))) + 1, 1000000)) AS cut
    FROM (SELECT c.recording_id, c.seg_idx, cuts, cuts[-1] AS first, CASE WHEN cuts[-1] = 0 THEN 0 ELSE ends[cuts[-1]] END AS base, ws, ends, cnt, target FROM ct c JOIN q4 ON q4.recording_id = c.recording_id AND q4.seg_idx = c.seg_idx WHERE more)))),
lc AS (SELECT recording_id, seg_idx, arg_max(cuts, len(cuts)) AS cuts FROM ct GROUP BY 1, 2),
pt AS (SELECT recording_id, seg_idx, speaker, start, stop, i, array_to_string(ws[cuts[i] + 1 : CASE WHEN i = len(cuts) THEN len(ws) ELSE cuts[i + 1] END], ' ') AS text FROM (SELECT *, unnest(range(1, len(cuts) + 1)) AS i FROM lc JOIN q4 USING (recording_id, seg_idx))),
sh2 AS (SELECT *, coalesce(sum(length(text)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(length(text)) OVER (PARTITION BY recording_id, seg_idx) AS total, row_number() OVER (PARTITION BY recording_id ORDER BY seg_idx, i) - 1 AS cue_idx FROM pt WINDOW w AS (PARTITION BY recording_id, seg_idx ORDER BY i)),
rw2 AS (SELECT recording_id, cue_idx, speaker, text, start + (stop - start) * before / total AS raw, start + (stop - start) * (before + length(text)) / total AS raw_end FROM sh2),
adj AS (SELECT *, raw AS s FROM rw2 WHERE cue_idx = 0 UNION ALL SELECT r.*, CASE WHEN r.raw <= a.s THEN a.s + 0.1 ELSE r.raw END FROM adj a JOIN rw2 r ON r.recording_id = a.recording_id AND r.cue_idx = a.cue_idx + 1)"""
    # lines of a cue: whole, or the two most even halves that fit, or filled in turn
    halves = "list_sort(list_filter(list_transform(range(1, len(w)), lambda i: {'d': abs(length(array_to_string(w[1:i], ' ')) - length(array_to_string(w[i + 1:], ' '))), 'i': i, 'm': greatest(length(array_to_string(w[1:i], ' ')), length(array_to_string(w[i + 1:], ' ')))}), lambda h: h.m <= 42))[1].i"
    filled = "list_reduce(w, lambda a, x: CASE WHEN length(split_part(a, chr(10), -1)) + 1 + length(x) > 42 THEN a || chr(10) || x ELSE a || ' ' || x END)"
    wrapped = f"""tm AS (SELECT recording_id, cue_idx, speaker, s, least(greatest(raw_end, s + 0.1), lead(s) OVER (PARTITION BY recording_id ORDER BY cue_idx)) AS e, text, string_split(text, ' ') AS w FROM adj),
ln AS (SELECT *, CASE WHEN length(text) <= 42 THEN text WHEN h IS NOT NULL THEN array_to_string(w[1:h], ' ') || chr(10) || array_to_string(w[h + 1:], ' ') ELSE {filled} END AS lines FROM (SELECT *, {halves} AS h FROM tm))"""
    inline = cues.replace(f"{ws.format('text')} AS ws FROM q0", f"CASE WHEN len(w0) > 0 THEN list_concat([trim(speaker) || ':'], w0) ELSE w0 END AS ws FROM (SELECT *, {ws.format('text')} AS w0 FROM q0)")
    srt = f"WITH RECURSIVE {inline}, {wrapped} SELECT recording_id, string_agg((cue_idx + 1) || chr(10) || {precise('s', ',')} || ' --> ' || {precise('e', ',')} || chr(10) || lines || chr(10) || chr(10), '' ORDER BY cue_idx) AS document FROM ln GROUP BY 1"
    escaped = "replace(replace(replace(lines, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    vtt = lambda who: f"WITH RECURSIVE {cues}, {wrapped} SELECT recording_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({precise('s', '.')} || ' --> ' || {precise('e', '.')} || chr(10) || '<v ' || {who} || '>' || {escaped} || chr(10) || chr(10), '' ORDER BY cue_idx) AS document FROM ln GROUP BY 1"
    probe = """pb AS (SELECT recording_id, max("end") AS e FROM seg GROUP BY 1), pr AS (SELECT recording_id, CASE WHEN recording_id % 7 = 0 OR recording_id % 11 = 0 THEN 'invalid duration' WHEN recording_id % 5 = 0 THEN 'no audio stream' END AS error, round(e * 1000)::BIGINT AS d FROM pb)"""
    plain = turns.replace("CASE WHEN seg_idx % 3 = 0 THEN 'A' ELSE 'B' END AS speaker", "speaker")
    return {
        "q_reading_turns": f"WITH RECURSIVE {plain} SELECT recording_id, turn_idx, speaker, start, n_segments, length(text) AS n_chars FROM tu",
        "q_export_turns": f"WITH RECURSIVE {plain} SELECT recording_id, string_agg(speaker || ': ' || text || chr(10), chr(10) ORDER BY turn_idx) AS document FROM tu GROUP BY 1",
        "q_export_markdown_document": f"WITH RECURSIVE {plain} SELECT recording_id, '# Transcript' || chr(10) || chr(10) || string_agg('**' || {esc('speaker')} || '** · `' || {clock('start')} || '`' || chr(10) || chr(10) || {esc('text')}, chr(10) || chr(10) ORDER BY turn_idx) || chr(10) AS document FROM tu GROUP BY 1",
        "q_cues": f"WITH RECURSIVE {cues} SELECT recording_id, cue_idx, round(s, 3) AS start, round(least(greatest(raw_end, s + 0.1), lead(s) OVER (PARTITION BY recording_id ORDER BY cue_idx)), 3) AS \"end\", speaker, text FROM adj",
        "q_turns": f"WITH RECURSIVE {turns} SELECT * FROM tu",
        "q_export_turns_text": f"WITH RECURSIVE {turns} SELECT recording_id, string_agg(speaker || ': ' || text || chr(10), chr(10) ORDER BY turn_idx) AS document FROM tu GROUP BY 1",
        "q_document_summaries": f"WITH {seg}, {runs}, {summ} SELECT * FROM sm",
        "q_export_markdown_summary": f"WITH RECURSIVE {turns}, {summ} SELECT recording_id, '# Transcript' || chr(10) || chr(10) || '_' || any_value(summary) || '_' || chr(10) || chr(10) || string_agg('**' || speaker || '** · `' || {clock('start')} || '`' || chr(10) || chr(10) || {esc('text')}, chr(10) || chr(10) ORDER BY turn_idx) || chr(10) AS document FROM tu JOIN sm USING (recording_id) GROUP BY 1",
        "q_export_docx_body": f"""WITH RECURSIVE {turns}, {summ} SELECT recording_id, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' || chr(10) || '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>' || {para('Title', run("'A &amp; B'"))} || {para('Subtitle', run('any_value(summary)'))} ||
  string_agg({para('Speaker', run('speaker', '<w:rPr><w:b/></w:rPr>') + ' || ' + run("'   ' || " + clock('start'), '<w:rPr><w:color w:val="6B7280"/><w:sz w:val="18"/></w:rPr>'))} || {para('', run(xml('text')))}, '' ORDER BY turn_idx) || '<w:sectPr/></w:body></w:document>' AS body FROM tu JOIN sm USING (recording_id) GROUP BY 1""",
        "q_export_docx": f"WITH {seg} SELECT DISTINCT recording_id, true AS zip FROM seg",
        "q_export_srt": srt,
        "q_export_srt_lines": srt,
        "q_export_vtt": vtt("speaker"),
        "q_export_vtt_lines": vtt("CASE speaker WHEN 'user' THEN 'A&amp;B' ELSE speaker END"),
        "q_downloads": f"""WITH {seg}, dc AS (SELECT recording_id, string_agg(timestamp || ' ' || speaker || ': ' || text || chr(10), '' ORDER BY seg_idx) AS a, string_agg(timestamp || ' ' || CASE speaker WHEN 'user' THEN 'Bo=b' ELSE speaker END || ': ' || text || chr(10), '' ORDER BY seg_idx) AS b FROM seg GROUP BY 1)
SELECT recording_id * 10 + k AS request_id, CASE WHEN k < 2 AND recording_id % 7 <> 3 THEN 'a talk.txt' ELSE 'a talk' END AS filename, CASE WHEN k < 2 AND recording_id % 7 <> 3 THEN 'text/plain; charset=utf-8' END AS content_type, CASE WHEN recording_id % 7 = 3 THEN NULL WHEN k = 0 THEN a WHEN k = 1 THEN b END AS document,
  CASE WHEN k = 4 THEN 'unsupported export format "pdf" (supported: txt, md, docx, srt, vtt, csv, json)' WHEN recording_id % 7 = 3 THEN 'transcript is not ready' WHEN k = 2 THEN 'at most 64 speaker names' WHEN k IN (3, 5) THEN 'speaker must be <label>=<name>' END AS error FROM dc, range(0, 6) AS q(k)""",
        "q_export_csv": f"""WITH {seg}, n AS (SELECT *, lead(start) OVER (PARTITION BY recording_id ORDER BY seg_idx) AS nx FROM seg) SELECT recording_id, 'start,end,speaker,text' || chr(10) || string_agg({precise('start', '.')} || ',' || {precise('(' + stop + ')', '.')} || ',' || speaker || ',' || {cell} || chr(10), '' ORDER BY seg_idx) AS document FROM n GROUP BY 1""",
        "q_export_json_rows": f"""WITH {seg}, {rec} SELECT recording_id, round(duration, 3) AS duration, row_number() OVER (PARTITION BY recording_id ORDER BY seg_idx) - 1 AS pos, timestamp, speaker, text, start, "end" FROM seg JOIN rc USING (recording_id)""",
        "q_format_registry": "SELECT * FROM (VALUES ('txt', 'Plain text', 'txt', 'text/plain; charset=utf-8', false, true, '.TXT'), ('md', 'Markdown', 'md', 'text/markdown; charset=utf-8', false, true, 'Markdown'), ('docx', 'Word document', 'docx', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document', true, true, 'word'), ('srt', 'SubRip subtitles', 'srt', 'application/x-subrip; charset=utf-8', false, false, ' subrip'), ('vtt', 'WebVTT subtitles', 'vtt', 'text/vtt; charset=utf-8', false, false, 'WebVTT'), ('csv', 'Spreadsheet (CSV)', 'csv', 'text/csv; charset=utf-8', false, false, '.csv'), ('json', 'JSON', 'json', 'application/json; charset=utf-8', false, false, 'JSON')) t(name, label, extension, content_type, \"binary\", timestamps, asked)",
        "q_formatted_lines": f"WITH {seg} SELECT recording_id, seg_idx, timestamp || ' ' || speaker || ': ' || text AS line FROM seg",
        "q_segments_one_voice": f"""WITH RECURSIVE {seg}, {word}, nw AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY start_ms, seg_idx, pos) AS rn FROM wd),
st AS (SELECT recording_id, rn, word, start_ms, 0::BIGINT AS g, start_ms AS s0, start_ms + 250 AS e0, regexp_matches(word, '[.!?。؟]$') AS done FROM nw WHERE rn = 1 UNION ALL
  SELECT recording_id, rn, word, start_ms, CASE WHEN f THEN g + 1 ELSE g END, CASE WHEN f THEN start_ms ELSE s0 END, CASE WHEN f THEN start_ms + 250 ELSE greatest(e0, start_ms + 250) END, regexp_matches(word, '[.!?。؟]$') FROM (SELECT s.g, s.s0, s.e0, n.*, s.done OR n.start_ms - s.e0 > 2000 OR n.start_ms - s.s0 >= 20000 AS f FROM st s JOIN nw n ON n.recording_id = s.recording_id AND n.rn = s.rn + 1))
SELECT recording_id, g AS seg_idx, 'v' AS speaker, string_agg(word, ' ' ORDER BY rn) AS text, any_value(s0) / 1000 AS start, max(e0) / 1000 AS "end" FROM st GROUP BY 1, 2""",
        "q_shown_ends": f"""WITH {seg}, n AS (SELECT *, lead(start) OVER (PARTITION BY recording_id ORDER BY seg_idx) AS nx FROM seg) SELECT recording_id, seg_idx, round("end", 3) AS "end" FROM n""",
        "q_short_durations": "WITH t AS (SELECT event_id, floor(event_id * 7.5::DOUBLE + 0.5)::BIGINT AS t FROM events) SELECT event_id, CASE WHEN t < 60 THEN t || 's' WHEN t >= 3600 THEN (t // 3600) || 'h' || CASE WHEN t % 3600 // 60 > 0 THEN ' ' || (t % 3600 // 60) || 'm' ELSE '' END ELSE (t // 60) || 'm' || CASE WHEN t % 60 > 0 THEN ' ' || (t % 60) || 's' ELSE '' END END AS shown FROM t",
        "q_search_rows": "WITH m AS (SELECT conv_id AS recording_id, turn AS seg_idx, ((length(lower(text)) - length(replace(lower(text), 'an', ''))) // 2)::BIGINT AS matches FROM conversations) SELECT * FROM m WHERE matches > 0",
        "q_visible_rows": "WITH m AS (SELECT conv_id AS recording_id, ((length(lower(text)) - length(replace(lower(text), 'an', ''))) // 2)::BIGINT AS m FROM conversations) SELECT recording_id, count(*) FILTER (m > 0) AS visible, sum(m)::BIGINT AS matches FROM m GROUP BY 1",
        "q_result_summary": f"""WITH {seg}, g AS (SELECT recording_id, floor(max("end") + 0.5)::BIGINT AS t, count(DISTINCT speaker) AS n FROM seg GROUP BY 1) SELECT recording_id, concat_ws(' | ', CASE WHEN t < 60 THEN t || 's' ELSE (t // 60) || 'm' || CASE WHEN t % 60 > 0 THEN ' ' || (t % 60) || 's' ELSE '' END END, n || CASE WHEN n = 1 THEN ' speaker' ELSE ' speakers' END, 'm', CASE WHEN recording_id % 2 = 0 THEN 'reviewed by a judge' END, 'done in 1m 5s', CASE WHEN recording_id % 2 = 0 THEN 'quality ' || (recording_id % 100 + 1) || '/100' END) AS parts, 0::BIGINT AS n_gaps FROM g""",
        "q_context_prompts": """WITH p AS (SELECT s_suppkey AS recording_id, concat_ws(chr(10), CASE WHEN s_suppkey % 2 = 0 THEN 'KNOWN SPEAKERS: Ada, Ben' || chr(10) || 'IMPORTANT: You MUST use these exact speaker names in your transcription.' || chr(10) || 'Replace any ''Speaker 1'', ''Speaker 2'' etc. with the actual names provided above.' || chr(10) || 'If you can distinguish between voices, map them to these names based on context and voice characteristics.' END,
CASE WHEN s_suppkey % 3 = 0 THEN 'TOPIC/DOMAIN: law' || chr(10) || 'Pay special attention to technical terms and jargon related to: law' END, CASE WHEN s_suppkey % 5 = 0 THEN 'TECHNICAL VOCABULARY: tort' || chr(10) || 'Ensure these terms are spelled correctly and used appropriately.' END, CASE WHEN s_suppkey % 7 = 0 THEN 'SPECIAL INSTRUCTIONS: be brief' END,
CASE WHEN s_suppkey % 4 = 0 THEN 'EXPECTED LANGUAGES (BCP-47): en-US, nl-NL' || chr(10) || 'Transcribe each language as spoken; do not translate.' END) AS b FROM supplier) SELECT recording_id, CASE WHEN b = '' THEN '' ELSE chr(10) || chr(10) || '=== USER-PROVIDED CONTEXT ===' || chr(10) || b || chr(10) || '=== END CONTEXT ===' || chr(10) END AS prompt FROM p""",
        **_blocks_sql(seg),
        "q_chunk_prompts": f"WITH {seg}, {plan} SELECT recording_id, chunk_idx, concat_ws(chr(10), 'Transcribe.', chr(10) || 'KNOWN SPEAKERS: Ada', 'Use these exact speaker names in your transcription.', CASE WHEN chunk_idx > 0 THEN chr(10) || 'PREVIOUS CONTEXT:' || chr(10) || 'before' END, chr(10) || 'CHUNK INFO: This is chunk ' || (chunk_idx + 1) || ' starting at ' || printf('%.1f', start_ms / 1000) || ' seconds.', 'Start timestamps at [00:00:00] for this chunk; the workflow will apply the absolute offset after transcription.', chr(10) || 'ADDITIONAL INSTRUCTIONS:' || chr(10) || 'Be exact.') AS prompt FROM plan",
        "q_file_checks": f"WITH {names} SELECT page_id, CASE WHEN ext NOT IN ('mp3', 'wav', 'm4a', 'flac', 'ogg') THEN 'unsupported file format: ' || ext WHEN size * 1000 > 1048576 THEN 'file size (' || printf('%.1f', size * 1000 / 1048576) || 'MB) exceeds limit (1MB)' END AS error, CASE WHEN ext = 'm4a' THEN 'audio/m4a' WHEN page_id % 2 = 0 THEN 'audio/ogg' WHEN ext IN ('mp3', 'wav', 'ogg', 'flac') THEN 'audio/' || ext ELSE 'audio/wav' END AS type FROM nx",
        "q_safe_filenames": "WITH n AS (SELECT page_id, page_id % 7 AS a, page_id % 6 AS b FROM pages), e AS (SELECT *, (['.MP3', '.wav', '', '.m4a', '.ogg', '.exe'])[b + 1] AS x FROM n) SELECT page_id, CASE WHEN a = 3 AND x = '' THEN 'upload.audio' WHEN a = 4 AND x = '' THEN 'x.y' ELSE (['talk', 'a_b_c', '_CON', '..', 'x.y', 'audio', 'q___'])[a + 1] || CASE WHEN x = '' THEN '.audio' ELSE x END END AS safe, CASE a WHEN 0 THEN 'talk' WHEN 1 THEN 'a b&c' WHEN 2 THEN 'CON' WHEN 3 THEN CASE WHEN x = '' THEN 'Transcript' ELSE '..' END WHEN 4 THEN CASE WHEN x = '' THEN 'x' ELSE 'x.y' END WHEN 5 THEN 'Transcript' ELSE 'é' END AS title FROM e",
        "q_probes": f"WITH {seg}, {probe} SELECT recording_id, CASE WHEN error IS NULL THEN 'wav' END AS format, CASE WHEN error IS NULL THEN d END AS duration_ms, recording_id * 1024 AS size_bytes, CASE WHEN error IS NULL THEN 44100 END AS sample_rate, CASE WHEN error IS NULL THEN 2 END AS channels, error FROM pr",
        "q_recording_metadata": f"WITH {seg}, {plan}, {probe}, c AS (SELECT recording_id, count(*) AS n FROM plan GROUP BY 1) SELECT recording_id, d / 1000 AS duration, round(recording_id / 1024, 6) AS size_mb, 'wav' AS format, 44100 AS sample_rate, 2 AS channels, n AS chunk_count, n > 1 AS needs_chunking FROM pr JOIN c USING (recording_id) WHERE error IS NULL",
        "q_silent_chunks": f"WITH {seg} SELECT DISTINCT recording_id, CASE WHEN recording_id % 10 <> 1 THEN recording_id % 3 = 0 OR recording_id % 50 + 0.5 > 35 END AS silent FROM seg",
        "q_wave_sizes": f"WITH {seg} SELECT recording_id * 1000 + seg_idx AS recording_id, CASE seg_idx % 5 WHEN 4 THEN NULL WHEN 3 THEN 0 ELSE strlen(text) END AS data_bytes FROM seg",
        # two voices by turns, word by word: neither is silent for long, so each has a segment until a sentence ends or 20 s have passed
        "q_dispatched_segments": f"""WITH RECURSIVE {seg}, {word}, dw AS (SELECT recording_id, seg_idx, pos, word, pos % 2 AS v, seg_idx * 15000 + 300 * pos AS s, regexp_matches(word, '[.!?。؟]$') AS closes, (recording_id + seg_idx) % 3 AS k FROM wd),
st AS (SELECT recording_id, seg_idx, pos, 0::BIGINT AS grp, 1::BIGINT AS n, [CASE WHEN v = 0 AND NOT closes THEN {{'g': 0::BIGINT, 's': s}} END, CASE WHEN v = 1 AND NOT closes THEN {{'g': 0::BIGINT, 's': s}} END] AS open_ FROM dw WHERE pos = 0 AND k = 0
UNION ALL SELECT recording_id, seg_idx, pos, coalesce(own.g, n), CASE WHEN own IS NULL THEN n + 1 ELSE n END, CASE WHEN v = 0 THEN [CASE WHEN NOT closes THEN {{'g': coalesce(own.g, n), 's': coalesce(own.s, s)}} END, open_[2]] ELSE [open_[1], CASE WHEN NOT closes THEN {{'g': coalesce(own.g, n), 's': coalesce(own.s, s)}} END] END
  FROM (SELECT d.*, t.n, CASE WHEN d.v = 0 THEN [t.open_[1], CASE WHEN d.s > t_last + 250 THEN NULL ELSE t.open_[2] END] ELSE [CASE WHEN d.s > t_last + 250 THEN NULL ELSE t.open_[1] END, t.open_[2]] END AS open_, CASE WHEN d.s - t.open_[d.v + 1].s < 20000 THEN t.open_[d.v + 1] END AS own
    FROM (SELECT *, seg_idx * 15000 + 300 * pos + 250 AS t_last FROM st) t JOIN dw d ON d.recording_id = t.recording_id AND d.seg_idx = t.seg_idx AND d.pos = t.pos + 1)),
sp AS (SELECT st.recording_id, st.seg_idx AS chunk_idx, grp AS seg_idx, min(s) AS s, 'Speaker ' || (any_value(v) + 1) AS speaker, string_agg(word, ' ' ORDER BY st.pos) AS text FROM st JOIN dw USING (recording_id, seg_idx, pos) GROUP BY 1, 2, 3)
SELECT recording_id, chunk_idx, seg_idx, format('[{{:02d}}:{{:02d}}:{{:02d}}]', s // 3600000, s // 60000 % 60, s // 1000 % 60) AS timestamp, speaker, text, NULL::VARCHAR AS error FROM sp
UNION ALL SELECT recording_id, seg_idx, 0, format('[{{:02d}}:{{:02d}}:{{:02d}}]', seg_idx * 15 // 3600, seg_idx * 15 // 60 % 60, seg_idx * 15 % 60), 'Untranscribed', '[word timestamps unavailable] ' || trim(text), NULL FROM seg WHERE (recording_id + seg_idx) % 3 = 1
UNION ALL SELECT recording_id, seg_idx, 0, format('[{{:02d}}:{{:02d}}:{{:02d}}]', (seg_idx * 15 + 5) // 3600, (seg_idx * 15 + 5) // 60 % 60, (seg_idx * 15 + 5) % 60), 'Ann', trim(text), NULL FROM seg WHERE (recording_id + seg_idx) % 3 = 2""",
        "q_decoded_durations": f"""WITH {seg} SELECT recording_id, max(round("end" * 1000000)::BIGINT // 1000) AS duration_ms FROM seg GROUP BY 1""",
        "q_cut_commands": f"WITH {seg}, {plan} SELECT recording_id, chunk_idx, 'ffmpeg -hide_banner -nostdin -y -ss ' || printf('%d.%03d', start_ms // 1000, start_ms % 1000) || ' -t ' || printf('%d.%03d', (end_ms - start_ms) // 1000, (end_ms - start_ms) % 1000) || ' -i in.wav -vn -ac 1 -ar 16000 -c:a pcm_s16le chunk_' || chunk_idx || '.wav' AS command FROM plan",
        "q_transcript_payloads": f"WITH {seg}, r AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY seg_idx) - 1 AS n FROM seg) SELECT recording_id, n AS seg_idx, format('[00:00:{{:02d}}]', seg_idx % 60) AS timestamp, speaker, trim(text) AS text, CASE WHEN seg_idx <= 4 THEN round(seg_idx / 4, 6) END AS confidence, NULL::VARCHAR AS error FROM r WHERE recording_id % 3 < 2 UNION ALL SELECT DISTINCT recording_id, NULL, NULL, NULL, NULL, NULL, 'unreadable' FROM seg WHERE recording_id % 3 = 2",
        "q_word_annotations": f"""WITH RECURSIVE {seg}, {word}, w AS (SELECT *, (recording_id + seg_idx + pos) % 7 AS k, row_number() OVER (PARTITION BY recording_id ORDER BY seg_idx, pos) AS rn FROM wd),
v AS (SELECT recording_id, rn, speaker, CASE k WHEN 6 THEN CASE WHEN recording_id % 13 = 0 THEN 'é' ELSE 'ab' END ELSE word END AS text, CASE WHEN k NOT IN (2, 3) THEN start_ms END AS a, CASE k WHEN 4 THEN 1 WHEN 5 THEN NULL ELSE start_ms + 250 END AS b FROM w),
st AS (SELECT *, coalesce(a, 0) AS s, CASE WHEN b >= coalesce(a, 0) THEN b ELSE coalesce(a, 0) END AS e FROM v WHERE rn = 1 UNION ALL SELECT n.recording_id, n.rn, n.speaker, n.text, n.a, n.b, coalesce(n.a, t.e), CASE WHEN n.b >= coalesce(n.a, t.e) THEN n.b ELSE coalesce(n.a, t.e) END FROM st t JOIN v n ON n.recording_id = t.recording_id AND n.rn = t.rn + 1),
g AS (SELECT recording_id, count(*) FILTER (a IS NULL OR b IS NULL OR b < s) AS repaired FROM st GROUP BY 1)
SELECT recording_id, 1 AS chunk_idx, row_number() OVER (PARTITION BY recording_id ORDER BY s, rn) - 1 AS unit_idx, text, speaker, 500 + s AS start_ms, 500 + e AS end_ms, repaired, NULL::VARCHAR AS error FROM st JOIN g USING (recording_id) WHERE recording_id % 17 <> 0
UNION ALL SELECT DISTINCT recording_id, 1, NULL, NULL, NULL, NULL, NULL, NULL, 'no word annotations' FROM seg WHERE recording_id % 17 = 0""",
        "q_alignment_errors": f"WITH {seg} SELECT recording_id, CASE WHEN recording_id % 4 = 2 AND bool_or(seg_idx = 1) THEN 'segment count differs' WHEN recording_id % 4 = 1 AND bool_or(seg_idx >= 2 AND upper(text) <> text) THEN 'segment ' || min(seg_idx) FILTER (seg_idx >= 2 AND upper(text) <> text) || ' changed' END AS error FROM seg GROUP BY 1",
        "q_answers": f"""WITH {seg}, r AS (SELECT DISTINCT recording_id, recording_id % 4 AS k, recording_id // 4 % 5 AS s FROM seg) SELECT recording_id, (['ab', 'kept', '', ''])[k + 1] AS text, CASE WHEN k = 2 THEN 1 ELSE 0 END::BIGINT AS n_calls,
CASE s WHEN 0 THEN CASE WHEN k = 2 THEN 'completed interaction unexpectedly returned function calls' END WHEN 1 THEN 'interaction ended with status failed: E1 bad' WHEN 2 THEN CASE WHEN k <> 2 THEN 'interaction requires action but returned no function calls' END WHEN 3 THEN 'synchronous interaction unexpectedly remained queued' ELSE 'interaction returned unknown status strange' END AS error FROM r""",
        "q_failures": "SELECT event_id, event_id % 8 IN (0, 1, 2, 4, 5, 7) AS retry, event_id % 8 IN (2, 4, 6, 7) AS spent, CASE event_id % 4 WHEN 0 THEN 7 WHEN 3 THEN 30 ELSE 0 END::BIGINT AS wait, strlen(props) + greatest(event_id % 10 - 5, 0) + 100 AS reserved, least(65536, greatest(event_id % 90000, 32768)) AS cap FROM events",
        "q_decisions": f"WITH {seg} SELECT recording_id, CASE WHEN recording_id % 4 > 1 THEN 'a,b' END AS selected, CASE recording_id % 4 WHEN 0 THEN 'empty judge output' WHEN 1 THEN 'unreadable' END AS error, CASE WHEN recording_id % 4 > 1 THEN count(*) END AS n FROM seg GROUP BY 1",
        "q_candidate_plans": """WITH v(k, pos, id, label, kind, model) AS (VALUES (0, 0, 'gemini_3.5_transcribe', 'Gemini 3.5 Transcribe', 'gemini', 'gemini-3.5-transcribe'), (0, 1, 'second', 'Gemini 3.5 Flash-Lite', 'gemini', 'gemini-3.5-flash-lite'), (1, 0, 'p', 'Parakeet Audio', 'parakeet', 'nvidia/parakeet-ctc-0.6b'), (1, 1, 'gemini_3.8_flash', 'Gemini 3.8 Flash', 'gemini', 'gemini-3.8-flash'), (2, 0, 'x', 'MAI-Transcribe-2', 'speech', 'MAI-Transcribe-2'), (2, 1, 'y', 'm', 'other', 'm')) SELECT s_suppkey AS plan, pos, id, label, kind, model FROM supplier JOIN v ON k = s_suppkey % 4""",
        "q_candidate_plan_errors": "SELECT s_suppkey AS plan, CASE s_suppkey % 6 WHEN 1 THEN 'duplicate candidate id a' WHEN 2 THEN 'candidate spec 1 has no candidate id' WHEN 3 THEN 'unknown kind odd' WHEN 4 THEN 'unsupported speech model gemini-3.8-flash' WHEN 5 THEN 'unsupported model gemini-0' END AS error FROM supplier",
        "q_packs": "WITH v AS (SELECT s_suppkey AS n, s_suppkey % 4 AS k, s_suppkey % 3 AS root FROM supplier WHERE s_suppkey % 9 <> 0 AND s_suppkey % 7 <> 0) SELECT min(root)::INT AS root, 'pack-' || k AS name, 'format' AS kind, 'x,Y-' || k AS keys FROM v GROUP BY k",
        "q_run_budgets": "WITH n AS (SELECT s_suppkey AS recording_id, s_suppkey % 5 AS spans, greatest(s_suppkey % 5, 1) AS u FROM supplier), j AS (SELECT *, 4 * u + CASE WHEN u > 1 THEN 1 ELSE 0 END AS judge_calls FROM n) SELECT recording_id, spans, 3 * u AS candidate_runs, judge_calls, 3 * u AS planner_turns, 4::BIGINT AS span_escalations, 3 * u + 3 * judge_calls + 1 AS requests, 8 * judge_calls AS tool_calls, 1::BIGINT AS global_reviews, 1000000::BIGINT AS tokens FROM j",
        "q_trimmed_lists": "SELECT event_id, 'a|' || event_type || '|b' AS items, replace(props, 'k', '[redacted]') AS scrubbed FROM events",
    }


def _blocks_sql(seg: str) -> dict[str, str]:
    block = f"""{seg}, tx AS (SELECT recording_id, string_agg(timestamp || ' ' || speaker || ': ' || text, chr(10) ORDER BY seg_idx) AS t FROM seg GROUP BY 1),
bl AS (SELECT recording_id, c AS candidate_id, concat_ws(chr(10), 'Candidate ID: ' || c, 'Label: L' || c, 'Kind: k', 'Model: m', 'Notes: ' || CASE c WHEN 'b' THEN 'x; y' ELSE 'none' END, 'Transcript:', CASE WHEN c = 'a' OR recording_id % 2 = 0 THEN t ELSE '[empty candidate]' END) AS block FROM tx, (VALUES ('a'), ('b')) v(c))"""
    told = "Judge these transcript candidates for chunk 1 of 2.|Context: None provided|Known speakers: Ada|Ignore empty or unavailable candidates when at least one usable transcript candidate is present.|You may call transcript-analysis tools before the final JSON decision. Tool results are advisory; the final transcript must still be supported by candidates.|Candidates:"
    two = "chr(10) || chr(10)"
    return {
        "q_candidate_blocks": f"WITH {block} SELECT * FROM bl",
        "q_judge_prompts": f"WITH {block}, p AS (SELECT recording_id, replace('{told}', '|', {two}) || {two} || string_agg(block, {two} || '---' || {two} ORDER BY candidate_id) || {two} || 'Return the final corrected transcript for this audio span.' AS p FROM bl GROUP BY 1) SELECT recording_id, length(p) AS chars, sha256(p) AS digest FROM p",
    }
