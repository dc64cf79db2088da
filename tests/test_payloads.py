"""Payloads of several shapes, good and bad."""

from pyspark.sql import functions as F

from turnstream.functions import text, timecode
from turnstream.operators import evidence
from turnstream.sources import payloads


def test_speech_payloads(spark):
    rows = [
        (1, 0, '{"turns":[{"startMs":2100,"endMs":2000,"speaker":"B","transcript":"b"},{"startMs":100,"speaker":"A","transcript":"a"},{"startMs":50,"transcript":" "}]}'),
        (2, 0, '{"phrases":[{"offsetMilliseconds":5,"durationMilliseconds":7.9,"speaker":3,"text":"x"}]}'),
        (3, 0, '{"turns":[{"startMs":-1,"transcript":"a"}]}'), (4, 0, '{"turns":[{"transcript":"a"}]}'), (5, 0, "{broken"), (6, 0, '{"turns":[]}'), (7, 0, None),
    ]
    got = payloads.speech_units(spark.createDataFrame(rows, "recording_id long, chunk_idx long, payload string")).orderBy("recording_id", "unit_idx").collect()
    assert [(r.recording_id, r.text, r.speaker, r.start_ms, r.end_ms) for r in got if not r.error] == [(1, "a", "A", 100, 100), (1, "b", "B", 2100, 2100), (2, "x", "3", 5, 12)]
    assert [(r.recording_id, r.error) for r in got if r.error] == [(3, "missing or negative timestamp"), (4, "missing or negative timestamp"), (5, "unreadable"), (6, "no speech"), (7, "unreadable")]


def test_transcript_payloads(spark):
    rows = [(1, '```json\n{"segments":[{"timestamp":"0:00:00","speaker":" A ","text":"hi","confidence":1.2}]}\n```'), (2, '[{"timestamp":"[1:2:3]","speaker":"B","text":"x","confidence":0.5}]'), (3, "none"), (4, "{}")]
    got = payloads.transcript_segments(spark.createDataFrame(rows, "recording_id long, payload string")).orderBy("recording_id").collect()
    assert [(r.timestamp, r.speaker, r.text, r.confidence, r.error) for r in got] == [("[00:00:00]", "A", "hi", None, None), ("[01:02:03]", "B", "x", 0.5, None), (None, None, None, None, "unreadable"), (None, None, None, None, "unreadable")]


def test_logs(spark):
    lines = ["silence_start: 1.5", "silence_start: 12.345", "silence_end: 14.0 | silence_duration: 1", "silence_end: 15", "silence_start: -0.2", "x", "silence_end: 0.5", "silence_start: 3", "silence_end: 3", "silence_start: 9"]
    got = payloads.silence_spans(spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "recording_id long, line_no long, line string"))
    assert sorted((r.start_ms, r.end_ms) for r in got.collect()) == [(0, 500), (12345, 14000)]
    got = payloads.decoded_ms(spark.createDataFrame([(1, "out_time_us=1500"), (1, "out_time_us=7999"), (1, "frame=3"), (2, "x")], "recording_id long, line string"))
    assert sorted(map(tuple, got.collect())) == [(1, 7), (2, 0)]


def test_loose_timestamps_and_codes(spark):
    f = timecode.normalise_timestamp
    r = spark.range(1).select(*(f(F.lit(x)) for x in ("0:00:00", "[1:2:3]", " [1:1:1", "100:0:5", "12:34")), f(F.lit(None).cast("string"))).first()
    assert tuple(r) == ("[00:00:00]", "[01:02:03]", "[1:1:1", "[100:00:05]", "12:34", None)
    r = spark.range(1).select(text.language_codes(F.lit(" en-us, nl_NL;cmn-hans-cn es-419 EN-US ")), text.language_codes(F.lit("en, english1")), text.language_codes(F.lit(""))).first()
    assert tuple(r) == (["en-US", "nl-NL", "cmn-Hans-CN", "es-419"], None, [])


def test_editing(spark):
    r = spark.range(1).select(text.replace_phrases(F.lit("New York is new"), {"new york": "$NY", "new": "old"}), text.sentence_case(F.lit("hi! ça va? i am (ok).  x")), text.proper_nouns(F.lit("on MONDAY, mayor")), text.strip_fences(F.lit("```json\n[1]\n```"))).first()
    assert tuple(r) == ("$NY is old", "Hi! Ça va? I am (ok).  X", "on Monday, mayor", "[1]")


def test_evidence_prefers_wording_over_nearness(spark):
    kind = "recording_id long, seg_idx long, timestamp string, speaker string, text string"
    final = spark.createDataFrame([(1, 0, "[00:00:10]", "A", "good morning all"), (1, 1, "[00:01:00]", "A", "quite alone")], kind)
    cand = spark.createDataFrame([(1, 0, "[00:00:10]", "A", "something else"), (1, 1, "[00:00:17]", "A", "good morning all"), (1, 2, "[00:01:09]", "A", "quite alone")], kind)
    both = cand.withColumn("candidate_id", F.lit("a")).unionByName(cand.where("seg_idx = 0").withColumn("candidate_id", F.lit("b")))
    got = evidence.run_evidence(final, both).orderBy("seg_idx").collect()
    assert [(r.sources, r.supported, r.disputed, r.status) for r in got] == [("a", True, True, "adjudicated"), ("", False, False, "adjudicated")]
