"""The engine object, settings, adapters and documents on literal cases."""

import io
import sys
import zipfile

import pytest
from pyspark.sql import functions as F

from turnstream.engine import Engine
from turnstream.functions import timecode
from turnstream.operators import evidence, export, quality, spans, subtitles
from turnstream.plans import settings
from turnstream.sources import media, payloads, responses
from turnstream.streaming import journal, live

SEG = "recording_id long, seg_idx long, timestamp string, speaker string, text string, start double, end double, confidence double"


def seg(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], SEG)


def test_engine_steps_chain(spark):
    s = seg(spark, [("[00:00:01]", "A", "hi um there.", 1.0, 3.0, None), ("[00:00:03]", "B", "yes", 3.0, 5.0, 0.5)])
    e = Engine(spark, settings.Settings(auto_format=False, remove_fillers=True))
    clean = e.autoformat(s)
    assert [r.text for r in clean.orderBy("seg_idx").collect()] == ["hi there.", "yes"]
    assert e.render(clean, "txt").first().document == "[00:00:01] A: hi there.\n[00:00:03] B: yes\n"
    assert e.turns(clean).count() == 2 and e.cues(clean).count() == 2
    assert e.tool("quality_metrics", s).first().n_segments == 2
    assert e.tool("quality_metrics", s, allowed=("candidate_diff",)).first().error == "unknown tool"
    assert e.tool("candidate_diff", s).first().error == "unknown candidate_id"
    assert e.diff(s, clean).first().shared == 1


def test_numbers_too_large_to_count_fail_nothing(spark):
    r = spark.range(1).select(timecode.parse_timestamp(F.lit("[99999999999999999999:00:00]")).alias("a"), timecode.parse_timestamp(F.lit("[00:00:01]\n")).alias("b")).first()
    assert tuple(r) == (None, None)
    bad = spark.createDataFrame([(1, 0, '{"turns": [{"startMs": 1e30, "transcript": "x"}]}')], "recording_id long, chunk_idx long, payload string")
    assert payloads.speech_units(bad).first().error == "missing or negative timestamp"


def test_coverage_of_unreadable_and_endless_recordings(spark):
    rows = [("[00:00:00]", "a", "x", 0.0, 1.0, None), ("[00:00:10]", "a", "x", 10.0, 11.0, None), ("bad", "a", "x", None, None, None)]
    of = lambda d: quality.coverage(seg(spark, rows), spark.createDataFrame([(1, d)], "recording_id long, duration double")).first().coverage
    assert of(20.0) == pytest.approx(200 / 3) and of(0.0) == pytest.approx(200 / 3) and of(40.0) == pytest.approx(50.0)


def test_sentences_run_over_segments(spark):
    s = seg(spark, [("", "a", "one two", None, None, None), ("", "a", "three. four", None, None, None), ("", "a", "?! five", None, None, None)])
    assert sorted(r.k for r in quality.sentences(s).collect()) == [1, 1, 3]


def test_seams_see_what_earlier_ones_dropped(spark):
    at = [("[00:01:55]", "A", "hello there"), ("[00:02:01]", "Speaker 2", "hello there"), ("[00:02:04]", "Speaker 2", "hello there"), ("[00:03:30]", "A", "late")]
    s = seg(spark, [(*x, None, None, None) for x in at])
    seams = spark.createDataFrame([(1, 0, 120.0), (1, 1, 122.0), (1, 2, 200.0)], "recording_id long, seam_idx long, at double")
    got = [(r.seam_idx, r.kind, r.seg_idx) for r in spans.seam_repairs(s, seams).orderBy("seam_idx").collect()]
    assert got == [(0, "duplicate", 1), (1, "duplicate", 2)]
    assert spans.repaired(s, seams).count() == 2


def test_settings_check_their_limits():
    s = settings.Settings().checked()
    assert (s.chunk_ms, s.judge, s.strategy) == (1_500_000, False, "single_gemini")
    assert [c.id for c in settings.Settings(model="gemini-3-flash-preview").checked().candidates()] == ["gemini_3.8_flash", "gemini_3.5_flash_lite"]
    assert settings.Settings(model="MAI-Transcribe-2").checked().candidates()[0].kind == "speech"
    assert settings.Settings(speech_review=True).checked().judge
    for bad in ({"concurrency": 17}, {"model": "x"}, {"overlap_ms": 2_000_000}, {"chunk_ms": 1_790_000}, {"judge_thinking": "minimal"}, {"chunking": "odd"}, {"escalation_score": 101}):
        with pytest.raises(ValueError):
            settings.Settings(**bad).checked()
    assert settings.settings_from({"concurrency": " 5 ", "router": "on", "odd": "1", "tier": ""}) == settings.Settings(concurrency=5, router=True)
    assert settings.parse_pack("﻿---\nname: a\nmetadata:\n  kind: judge\n---\nBody\n") == ({"name": "a", "metadata": {"kind": "judge"}}, "Body")
    with pytest.raises(ValueError):
        settings.parse_pack("name: a")


def test_programs_run_where_rows_are(spark):
    argv = lambda code: [sys.executable, "-c", code]
    rows = spark.createDataFrame([(1, argv("print(input())"), "hi"), (2, argv("import sys; sys.exit(3)"), None), (3, ["/no/such/program"], None), (4, argv("print('x' * 100)"), None)], "recording_id long, argv array<string>, stdin string")
    got = {r.recording_id: r for r in media.run_commands(rows, 60, 50).collect()}
    assert got[1].output == "hi\n" and got[1].error is None and got[2].error == "exit code 3" and got[3].error == "FileNotFoundError" and got[4].error == "too much output"
    calls = spark.createDataFrame([(1, 0, "ok"), (2, 0, "bad")], "recording_id long, chunk_idx long, body string")

    def call(body):
        if body == "bad":
            raise OSError("down")
        return body.upper()

    got = {r.recording_id: (r.payload, r.error) for r in media.call_service(calls, call).collect()}
    assert got == {1: ("OK", None), 2: (None, "OSError: down")}
    assert media.split_command("a 'b c' d") == ["a", "b c", "d"] and media.split_command(r'"C:\x y\z" -q', True) == [r"C:\x y\z", "-q"]


def test_word_files_have_five_parts(spark):
    s = seg(spark, [("[00:00:01]", "A<", "b & \x01c", 1.0, 2.0, None)])
    z = zipfile.ZipFile(io.BytesIO(bytes(export.render(s, "Word", export.Options(title=" ")).first().document)))
    assert len(z.namelist()) == 5 and b"<w:t xml:space=\"preserve\">Transcript</w:t>" in z.read("word/document.xml") and "b &amp; \ufffdc".encode() in z.read("word/document.xml")
    with pytest.raises(ValueError):
        export.export_text(s, "docx")
    with pytest.raises(ValueError):
        export.lookup("pdf")


def test_lines_are_balanced_or_filled():
    words = "one two three four five six seven eight nine ten".split()
    for n in range(1, 11):
        lines = subtitles.wrap_lines(" ".join(words[:n]))
        whole = " ".join(words[:n])
        assert " ".join(lines) == whole and all(len(x) <= 42 for x in lines)
        if len(whole) > 42:
            halves = [(" ".join(words[:i]), " ".join(words[i:n])) for i in range(1, n)]
            assert abs(len(lines[0]) - len(lines[1])) == min(abs(len(a) - len(b)) for a, b in halves if max(len(a), len(b)) <= 42)
    assert subtitles.wrap_lines("x" * 50) == ["x" * 50]


def test_durations_of_annotations(spark):
    given = {"0.850s": 850, "1m2.5s": 62500, "12ms": 12, "-1s": -1000, "x": None, "": None, "5": None, "1h": 3_600_000}
    rows = spark.createDataFrame([(k,) for k in given], "o string").select("o", responses.milliseconds(F.col("o")).alias("ms"))
    assert {r.o: r.ms for r in rows.collect()} == given


def test_reviews_expire_and_are_purged_a_deadline_later(spark, tmp_path):
    at = [(1, 1, "awaiting_review", 100), (2, 1, "succeeded", 110), (3, 1, "running", 110), (9, 1, "running", 500), (9, 2, "running", 1500), (9, 3, "running", 5000)]
    for i, row in enumerate(at):
        df = spark.createDataFrame([row], "job_id long, id long, name string, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = live.retention(stream, 300, "1 second").writeStream.option("checkpointLocation", f"{tmp_path}/ck").format("parquet").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination(180)
    assert q.exception() is None
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(got) == [(1, "expire"), (1, "purge"), (2, "purge")]


def test_admission_is_bounded(spark):
    rows = spark.createDataFrame([(0, 1, 1, 1), (0, 2, 2, 1), (0, 3, 3, 1), (0, 4, 1, -1), (0, 5, 4, 1)], "server long, seq long, job_id long, change int")
    assert [(r.job_id, r.admitted) for r in journal.admitted(rows, 2).orderBy("seq").collect()] == [(1, True), (2, True), (3, False), (4, True)]


def test_tools_agree_on_disagreement(spark):
    assert spark.range(1).select(spans.disagreement(F.lit(0.8)).alias("x")).first().x and evidence.CANDIDATES_DIFFER == 0.82
