"""Faults that larger tables showed: rounding, words past a recording's end, unions below joins."""

import pyarrow as pa
from pyspark.sql import functions as F

from turnstream.operators import evidence, folds, subtitles
from turnstream.plans import extended, spanwise
from turnstream.sources import media, payloads, responses, stores

SEG = "recording_id long, seg_idx long, speaker string, text string, start double, end double, timestamp string"


def test_candidates_are_read_in_one_pass(spark):
    seg = spark.createDataFrame([(1, i, "A", "w", i * 4.0, i * 4.0 + 4, f"[00:00:{i * 4:02d}]") for i in range(12)], SEG)
    found = spanwise._candidates(seg)
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = found.collect()
    assert {x.candidate_id for x in rows} == {"a", "b", "c"} and all((x.recording_id + x.seg_idx) % 7 for x in rows if x.candidate_id == "b")
    assert {x.seg_idx for x in rows if x.candidate_id == "c" and x.speaker == " "} == {3}
    late = {x.seg_idx: x.timestamp for x in rows if x.candidate_id == "c"}
    assert late[5] == "[00:00:50]" and late[6] == "[00:00:24]"


def test_plans_from_logs_cut_at_half_the_length_that_was_logged(spark):
    # every start with its end half a second later: truncated ends alone would make 499 ms of some
    starts = [i for i in range(30_000, 39_999, 7) if int((i + 500) / 1000 * 1000) < i + 500 and int(i / 1000 * 1000) == i]
    assert starts
    lines = [(i, k, x) for i in starts for k, x in enumerate((f"silence_start: {i / 1000:.3f}", f"silence_end: {(i + 500) / 1000:.3f} | silence_duration: 0.5", "out_time_us=120000000"))]
    log = spark.createDataFrame(lines, "recording_id long, line_no long, line string")
    assert {x.end_ms - x.start_ms for x in payloads.silence_spans(log).collect()} == {499}
    cut = {x.recording_id: x.end_ms for x in folds.plan_from_log(log, 40_000, 5_000).where("chunk_idx = 0").collect()}
    assert cut == {i: i + 250 for i in starts}


def test_seconds_are_whole_milliseconds(spark):
    ms = spark.createDataFrame([(f"{i // 1000}.{i % 1000:03d}", i) for i in range(0, 300_000, 7)], "s string, ms long")
    assert ms.where(payloads.whole_ms(F.col("s")) != F.col("ms")).isEmpty()
    odd = spark.createDataFrame([("1e3",), ("0.0019",), ("1e300",), ("NaN",), ("x",), (None,)], "s string").select(payloads.whole_ms(F.col("s")).alias("ms")).collect()
    assert [x.ms for x in odd] == [1_000_000, 1, None, None, None, None]


def test_probed_durations_are_whole_milliseconds(spark):
    body = lambda s: f'{{"format":{{"duration":"{s}"}},"streams":[{{"codec_type":"audio","sample_rate":"8000","channels":1}}]}}'
    rows = spark.createDataFrame([(i, "a.wav", 1, body(s)) for i, s in enumerate(("261.066", "128.200", "256.734", "0.0005"))], "recording_id long, name string, size_bytes long, json string")
    assert [x.duration_ms for x in media.probed(rows).orderBy("recording_id").collect()] == [261066, 128200, 256734, 0]


def test_halves_of_percents_go_to_the_even_number(spark):
    seg = spark.createDataFrame([(1, 0, "A", "x", 0.0, 20.0, "[00:00:00]"), (1, 1, "A", "x", 25.0, 40.0, "[00:00:25]"), (2, 0, "A", "x", 0.0, 20.0, "[00:00:00]"), (2, 1, "A", "x", 17.0, 40.0, "[00:00:17]")], SEG)
    got = {x.recording_id: x.issues for x in evidence.timestamp_issues(seg).collect()}
    assert got == {1: ["Poor coverage: timestamps only reach 62% of audio"], 2: ["Poor coverage: timestamps only reach 42% of audio"]}


def test_words_past_the_end_of_a_recording_are_stitched(spark):
    # the last segment is 1 s long, but its words, 300 ms each, last longer
    seg = spark.createDataFrame([(1, 0, "A", "one two", 0.0, 30.0, "[00:00:00]"), (1, 1, "B", "a b c d e f", 30.0, 31.0, "[00:00:30]")], SEG)
    out = folds.stitch_chunks(extended.chunk_units(seg, tail=True), extended._spans(seg)).collect()
    assert [x.text for x in sorted(out, key=lambda x: x.start_ms)] == ["one", "two", "a", "b", "c", "d", "e", "f"]
    assert extended.chunk_units(seg).agg(F.max("start_ms")).first()[0] == 30_900


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_answers_are_read_once(spark):
    rows = spark.createDataFrame([(1, 0, 0, "{}")], "recording_id long, chunk_idx long, offset_ms long, payload string")
    assert plan(responses.word_units(rows)).count("Generate") == 3
    assert plan(responses.timed_units(rows)).count("Generate") == 3


def test_answers_without_words_keep_their_row(spark):
    word = '{"type":"word_info","text":"%s","start_offset":"%s","end_offset":"%s"}'
    step = '{"steps":[{"type":"%s","content":[{"type":"text","text":"whole","annotations":[%s]}]}]}'
    rows = [(1, 0, 5, step % ("model_output", ",".join([word % ("b", "2s", "2.5s"), word % ("a", "1m", "-1s"), word % ("c", "", "3s"), '{"type":"x"}']))), (2, 0, 0, step % ("thought", word % ("a", "1s", "2s"))), (3, 0, 0, None), (4, 0, 0, step % ("model_output", word % ("a", "", "2s"))), (5, 0, 0, '{"steps":[]}'), (6, 0, 0, step % ("model_output", '{"type":"word_info","start_index":0,"end_index":99},' + word % ("a", "1s", "2s")))]
    table = spark.createDataFrame(rows, "recording_id long, chunk_idx long, offset_ms long, payload string")
    got = responses.word_units(table).orderBy("recording_id", "unit_idx").collect()
    assert [(x.unit_idx, x.text, x.start_ms, x.end_ms, x.repaired) for x in got[:3]] == [(0, "b", 2005, 2505, 2), (1, "a", 60005, 60005, 2), (2, "c", 60005, 60005, 2)]
    assert [(x.recording_id, x.error, x.text) for x in got[3:]] == [(i, "no word annotations", None) for i in (2, 3, 4, 5)] + [(6, "invalid word byte range", None)]
    timed = {x.recording_id: (x.text, x.error, x.untimed) for x in responses.timed_units(table).where("recording_id > 1").collect()}
    assert timed[4] == ("[word timestamps unavailable] whole", None, True) and timed[6] == (None, "invalid word byte range", False) and timed[5] == (None, "no word annotations", False)


def test_evidence_shuffles_texts_once(spark):
    seg = spark.createDataFrame([(1, i, "A", f"word {i}", i * 8.0, i * 8.0 + 8, f"[00:{i * 8 // 60:02d}:{i * 8 % 60:02d}]") for i in range(30)], SEG)
    shown = plan(evidence.run_evidence(seg, extended.three_candidates(seg)))
    assert shown.count("Join") == 1 and "Union" not in shown and shown.count("RepartitionByExpression") == 2
    # matches on both sides of the bounds of buckets, 8 s away at most
    other = seg.where("seg_idx % 2 = 1").withColumn("candidate_id", F.lit("a"))
    got = {x.seg_idx: x.match_idx for x in evidence.best_matches(seg, other).collect()}
    assert got == {i: i if i % 2 else max(i - 1, 1) for i in range(30)}
    none = evidence.run_evidence(seg, other.where("false")).collect()
    assert len(none) == 30 and not any(x.supported or x.disputed for x in none)


def test_nearest_units_are_cut_out_of_chunks_before_they_are_compared(spark):
    kind = "recording_id long, chunk_idx long, unit_idx long, text string, speaker string, start_ms long, end_ms long, turn boolean, untimed boolean"
    unit = lambda chunk, i, text, at, turn=False: (1, chunk, i, text, "Speaker 1" if chunk == 0 else "q", at, at, turn, False)
    was = spark.createDataFrame([unit(0, 0, "a", 15_000), unit(0, 1, "b", 15_400), unit(0, 2, "c", 15_400), unit(0, 3, None, 19_800), unit(0, 4, "far", 14_900)], kind)
    now = spark.createDataFrame([unit(1, 0, "x", 15_200), unit(1, 1, "c", 15_400), unit(1, 2, "a", 15_400), unit(1, 3, None, 19_999), unit(1, 4, "far", 15_900, True), unit(1, 5, "y", 17_000)], kind)
    spans = spark.createDataFrame([(1, 0, 0, 20_000), (1, 1, 15_000, 35_000)], "recording_id long, chunk_idx long, start_ms long, end_ms long")
    out = evidence.nearest_units(was, now, spans)
    assert {x.unit_idx: x.match_idx for x in out.collect()} == {0: 0, 1: 2, 2: 0, 3: 3, 4: 4}
    assert "last(" not in plan(out) and plan(out).count("RepartitionByExpression") == 2


def test_units_are_spread_by_their_own_size_before_windows(spark):
    units = spark.createDataFrame([(1, 0, "a", "x", 0, 1)], "recording_id long, unit_idx long, text string, speaker string, start_ms long, end_ms long")
    assert plan(folds.segments_from_units(units)).count("RepartitionByExpression") == 2


def test_cues_are_made_a_slice_at_a_time():
    n = subtitles.SLICE * 3 + 1
    batch = pa.RecordBatch.from_pydict({"recording_id": [1] * n, "seg_idx": list(range(n)), "speaker": ["A"] * n, "text": ["some words"] * n, "start": [0.0] * n, "stop": [1.0] * n})
    out = list(subtitles._texts(False)(iter([batch])))
    assert len(out) == 4 and [x for b in out for x in b.column("seg_idx").to_pylist()] == list(range(n))


def test_cues_round_as_their_sql(spark):
    rows = spark.createDataFrame([(2.0035,), (128.5836,), (2.0,)], "start double").select(extended._thousandths("start")).collect()
    assert [x.start for x in rows] == [2.003, 128.584, 2.0]


def test_units_are_made_once_for_all_steps_of_a_stitch(spark, monkeypatch, tmp_path):
    seg = spark.createDataFrame([(1, i, "AB"[i % 2], f"word {i} and more of it.", i * 7.0, i * 7.0 + 8, "") for i in range(12)], SEG)
    stitched = lambda: folds.stitch_chunks(extended.turn_units(seg, 20), extended._spans(seg))
    plain = sorted(map(tuple, stitched().collect()))
    monkeypatch.setattr(stores, "shared", lambda spark: f"file://{tmp_path}")
    once = stitched()
    assert plain and sorted(map(tuple, once.collect())) == plain
    assert "LogicalRDD" not in plan(once)
