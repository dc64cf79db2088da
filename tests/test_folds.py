"""Folds and renderers on literal cases, and the adaptive plan against a direct one."""

import io
import random
import zipfile

from turnstream.operators import export, folds, subtitles

UNIT = "recording_id long, chunk_idx long, unit_idx long, text string, speaker string, start_ms long, end_ms long, turn boolean, untimed boolean"


def units(spark, rows):
    return spark.createDataFrame([(1, c, i, t, s, a, b, turn, untimed) for i, (c, t, s, a, b, turn, untimed) in enumerate(rows)], UNIT)


def word(text, speaker, at, chunk=0, turn=False, end=None):
    return (chunk, text, speaker, at, at + 250 if end is None else end, turn, False)


def segs(spark, rows):
    return [(r.speaker, r.text) for r in folds.segments_from_units(units(spark, rows)).orderBy("seg_idx").collect()]


def test_speech_over_another_stays_one_segment(spark):
    got = segs(spark, [word("hello", "A", 0), word("there", "A", 300), word("yes", "B", 400), word("friend", "A", 700), word("bye", "B", 2000)])
    assert got == [("A", "hello there friend"), ("B", "yes bye")]


def test_pauses_lengths_and_sentences_close(spark):
    assert segs(spark, [word("a", "A", 0), word("b", "A", 2250), word("c", "A", 4501)]) == [("A", "a b"), ("A", "c")]
    assert segs(spark, [word("a.", "A", 0), word("b", "A", 300), word(" ", "A", 400), word("c", "A", 600, turn=True), word("d", "A", 900)]) == [("A", "a."), ("A", "b c"), ("A", "d")]
    assert segs(spark, [word(f"w{i}", "A", i * 1000) for i in range(22)]) == [("A", " ".join(f"w{i}" for i in range(20))), ("A", "w20 w21")]
    assert segs(spark, [word("a", "A", 0), (0, "gap", "Untranscribed", 100, 100, True, True), word("b", "A", 300)]) == [("A", "a"), ("Untranscribed", "gap"), ("A", "b")]


def plain_segments(rows):
    """Segments by the rule, with all open ones at hand."""
    state, out = folds._Segments(), []
    for i, (text, speaker, a, b, turn, untimed) in sorted(enumerate(rows), key=lambda x: (x[1][2], x[0])):
        if text.strip():
            out += state.push({"text": text.strip(), "speaker": speaker, "start_ms": a, "end_ms": b, "turn": turn, "untimed": untimed})
    return [x[1:] for x in out + state.end()]


def test_stretches_give_the_same_segments_in_several_tasks(spark):
    rng = random.Random(17)
    cases = {}
    for r in range(40):
        at, rows = 0, []
        for _ in range(rng.randint(0, 150)):
            at += rng.choice([0, 50, 200, 300, 300, 600, 1500, 2600])
            rows.append((rng.choice(["a", "b.", "c", " ", "d?", "é"]), rng.choice("XXXYYZ"), at, at + rng.choice([0, 100, 250, 3000]), rng.random() < 0.1, rng.random() < 0.05))
        cases[r] = rows
    table = spark.createDataFrame([(r, 0, i, *x) for r, rows in cases.items() for i, x in enumerate(rows)], UNIT)
    got = {}
    for x in folds.segments_from_units(table).orderBy("recording_id", "seg_idx").collect():
        got.setdefault(x.recording_id, []).append((x.speaker, x.text, x.start, x.end))
    want = {r: [(s, t, a / 1000 if timed else None, b / 1000 if timed else None) for s, t, a, b, timed in plain_segments(rows)] for r, rows in cases.items()}
    assert got == {r: x for r, x in want.items() if x}
    one = spark.createDataFrame([(1, 0, i, "w." if i % 9 == 8 else "w", "A", i * 400, i * 400 + 100, False, False) for i in range(4000)], UNIT)
    parts = folds.state_free_stretches(one).groupBy("stretch").count()
    assert parts.count() > 400  # so that tasks share one recording


def test_segments_of_nothing(spark):
    assert folds.segments_from_units(units(spark, [])).count() == 0


def stitched(spark, rows, spans):
    spans = spark.createDataFrame([(1, i, *x) for i, x in enumerate(spans)], "recording_id long, chunk_idx long, start_ms long, end_ms long, keep_from_ms long, keep_until_ms long")
    return [(r.speaker, r.text) for r in folds.stitch_chunks(units(spark, rows), spans).orderBy("unit_idx").collect()]


SPANS = [(0, 120000, None, 117500), (115000, 240000, 117500, None)]


def test_overlap_is_kept_once_and_speakers_match(spark):
    first = [word(f"w{i}", "x" if i < 10 else "y", 114000 + 300 * i) for i in range(20)]
    second = [word(f"w{i}", "2" if i < 10 else "1", 114020 + 300 * i, 1) for i in range(4, 20)] + [word("new", "3", 121000, 1)]
    got = stitched(spark, first + second, SPANS)
    assert got == [("Speaker 1" if i < 10 else "Speaker 2", f"w{i}") for i in range(20)] + [("Speaker 3", "new")]


def test_jitter_over_the_cut_and_free_labels(spark):
    got = stitched(spark, [word("alpha", "a", 116000), word("beta", "a", 117490), word("beta", "9", 117510, 1), word("gamma", "9", 130000, 1)], SPANS)
    assert got == [("Speaker 1", "alpha"), ("Speaker 1", "beta"), ("Speaker 1", "gamma")]


def test_a_turn_over_the_cut_replaces_the_shorter(spark):
    got = stitched(spark, [word("so it", "a", 116000, turn=True, end=120000), word("so it goes", "b", 116050, 1, True, 125000)], SPANS)
    assert got == [("Speaker 1", "so it goes")]


def plan(total, silences, d, o):
    """The plan by its rule, over the whole list of silences."""
    soft = o // 2 if o // 2 >= 1000 else min(o, 1000)
    window, least = min(max(d // 8, 10000), 30000), d // 2 if d // 2 >= 30000 else min(d - 1, 30000)
    out, start = [], 0
    while start < total:
        end, kind = start + d, "fixed"
        mids = sorted({a + (b - a) // 2 for a, b in silences if b > a})
        near = [m for m in mids if start + least < m < total and abs(m - start - d) <= window]
        if total <= d or end > total:
            end, kind = total, "final"
        elif near:
            end, kind = min(near, key=lambda m: abs(m - start - d)), "silence"
        if out and end <= out[-1][1]:
            break
        out.append((start, end, kind))
        if end >= total:
            break
        start = max(end - {"final": 0, "fixed": o, "silence": soft}[kind], 0)
    return out


def test_adaptive_plan_equals_the_direct_one(spark):
    rng = random.Random(3)
    cases = {i: (rng.randint(1, 900000), [(a, a + rng.randint(-5, 3000)) for a in (rng.randint(0, 900000) for _ in range(rng.randint(0, 60)))]) for i in range(60)}
    totals = spark.createDataFrame([(i, t) for i, (t, _) in cases.items()], "recording_id long, total_ms long")
    spans = spark.createDataFrame([(i, a, b) for i, (_, s) in cases.items() for a, b in s], "recording_id long, start_ms long, end_ms long")
    for d, o in ((120000, 5000), (20000, 500), (61000, 0)):
        found = {}
        for r in folds.adaptive_plan(totals, spans, d, o).orderBy("recording_id", "chunk_idx").collect():
            found.setdefault(r.recording_id, []).append((r.start_ms, r.end_ms, r.boundary_type))
        assert found == {i: plan(t, s, d, o) for i, (t, s) in cases.items()}


def test_recogniser_words(spark):
    rows = [(1, i, w, a, b) for i, (w, a, b) in enumerate([("hello", 0.0, 0.2), ("there", 0.3, 0.5), (".", 0.5, 0.5), ("again", 2.0, 2.3)])]
    got = folds.segments_from_words(spark.createDataFrame(rows, "recording_id long, pos long, word string, start double, end double")).orderBy("seg_idx").collect()
    assert [(r.text, r.timestamp) for r in got] == [("hello there.", "[00:00:00]"), ("again", "[00:00:02]")]


def transcript(spark, rows):
    return spark.createDataFrame([(1, i, *x, f"[00:00:{int(x[2] or 0):02d}]") for i, x in enumerate(rows)], "recording_id long, seg_idx long, speaker string, text string, start double, end double, timestamp string")


def test_cues_of_one_second(spark):
    got = subtitles.cues(transcript(spark, [("a", "x", 5.0, None), ("a", "y", 5.0, None), ("a", "z", 5.0, None)])).orderBy("cue_idx").collect()
    assert [(round(r.start, 3), round(r.end, 3)) for r in got] == [(5.0, 5.1), (5.1, 5.2), (5.2, 6.0)]


def test_long_segments_are_split_and_wrapped(spark):
    text = "One two three four five six seven eight nine ten. " * 6
    got = subtitles.cues(transcript(spark, [("a", text, 0.0, 30.0)])).orderBy("cue_idx").collect()
    assert " ".join(r.text for r in got).split() == text.split() and len(got) >= 5
    assert got[-1].end == 30.0 or abs(got[-1].end - 30.0) < 1e-9
    assert all(len(x) <= 42 for r in got if len(r.text) <= 80 for x in r.lines.split("\n"))


def test_documents(spark):
    seg = transcript(spark, [("Ada", "A & <b>", 0.0, 2.0), ("Ben", "*hm*", 2.0, 4.0)])
    one = lambda df: df.first().document
    assert one(subtitles.render_srt(seg)) == "1\n00:00:00,000 --> 00:00:02,000\nAda: A & <b>\n\n2\n00:00:02,000 --> 00:00:04,000\nBen: *hm*\n\n"
    assert one(subtitles.render_vtt(seg)).startswith("WEBVTT\n\n00:00:00.000 --> 00:00:02.000\n<v Ada>A &amp; &lt;b&gt;\n\n")
    assert one(subtitles.render_text(seg)) == "[00:00:00] Ada: A & <b>\n[00:00:02] Ben: *hm*\n"
    assert one(subtitles.render_text(seg, False)) == "Ada: A & <b>\n\nBen: *hm*\n"
    assert one(subtitles.render_markdown(seg, "T#")) == "# T\\#\n\n**Ada** · `0:00`\n\nA & \\<b\\>\n\n**Ben** · `0:02`\n\n\\*hm\\*\n"
    assert '"speaker" : "Ada"' in one(export.render_json(seg))
    with zipfile.ZipFile(io.BytesIO(one(subtitles.render_docx(seg, "T")))) as z:
        assert "A &amp; &lt;b&gt;" in z.read("word/document.xml").decode()


def merged(spark, rows):
    lists = spark.createDataFrame([(1, c, i, s, t, f"[00:{at // 60:02d}:{at % 60:02d}]") for i, (c, s, t, at) in enumerate(rows)], "recording_id long, chunk_idx long, seg_idx long, speaker string, text string, timestamp string")
    return [r.text for r in folds.merge_chunks(lists).orderBy("seg_idx").collect()]


def test_repeated_rows_of_a_seam_go(spark):
    assert merged(spark, [(0, "A", "hello world", 0), (0, "A", "this is a test", 5), (1, "a ", "This is a test!", 6), (1, "A", "more", 9)]) == ["hello world", "this is a test", "more"]
    assert merged(spark, [(0, "A", "x", 0), (0, "A", "y", 1), (1, "A", "x", 1), (1, "A", "y", 2), (1, "A", "y", 2), (2, "A", "z", 9)]) == ["x", "y", "y", "z"]
    assert merged(spark, [(0, "A", "x", 0), (1, "B", "x", 0), (2, "B", "x", 3)]) == ["x", "x", "x"]
    assert merged(spark, [(0, "A", "привет", 0), (1, "A", "пока", 1), (2, "A", "пока", 1)]) == ["привет", "пока"]
    assert merged(spark, [(0, "A", str(i), i) for i in range(9)] + [(1, "A", str(i), i) for i in range(3, 12)]) == [str(i) for i in range(9)] + [str(i) for i in range(3, 12)]
