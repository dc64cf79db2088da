"""Limits of tool loops, and outcomes of a second pass of judging."""

from pyspark.sql import functions as F

from turnstream import registry
from turnstream.operators import export, tools

SF = "/root/testdata/sf0.001"


def test_limits_end_an_interaction(spark):
    calls = [(1, 0, i) for i in range(4)] + [(1, 2, i) for i in range(4)] + [(1, 5, 0)]  # a third turn
    calls += [(2, 0, 0)] + [(2, 1, i) for i in range(5)]  # five in a turn
    calls += [(3, 0, i) for i in range(4)] + [(3, 1, 0)]  # within the limits
    table = spark.createDataFrame([(*x, "n", ["a"]) for x in calls], "recording_id long, turn long, pos long, name string, candidate_ids array<string>")
    got = {(x.recording_id, x.turn, x.pos): x.refused for x in tools.bounded_calls(table).collect()}
    assert {k: v for k, v in got.items() if v} == {(1, 5, 0): "interaction tool loop exceeded max turns (2)", **{(2, 1, i): "interaction requested 5 function calls; max per turn is 4" for i in range(5)}}
    few = {(x.recording_id, x.turn) for x in tools.bounded_calls(table, 9, 9, 7).where("refused is not null").collect()}
    assert few == {(1, 2), (1, 5)}  # 4 and 4 are more than 7
    one = spark.createDataFrame([(1, ["a"], "7"), (3, ["a"], "8")], "recording_id long, candidate_ids array<string>, result string")
    rows = tools.tool_loop(table, {"n": one}).collect()
    assert len(rows) == len(calls) and {x.result for x in rows if x.recording_id == 3} == {"8"}
    assert {x.error for x in rows if x.recording_id == 2 and x.turn == 0} == {"unknown candidate_id a"}
    assert tools.tool_loop(table.limit(0), {}).count() == 0


def test_the_second_pass_touches_named_spans_alone(spark):
    spans = registry.QUERIES["q_rejudged_spans"](spark, SF).cache()
    first = registry.QUERIES["q_judged_spans"](spark, SF)
    assert spans.count() == first.count() == spans.select("recording_id", "span_idx").distinct().count()
    again = spans.where("rejudges = 1")
    assert not again.isEmpty() and again.where("recording_id % 4 in (0, 3) or span_idx > 2").isEmpty()
    assert spans.where("rejudges = 0").drop("rejudges").exceptAll(first).isEmpty()
    reasons = "; ".join(x.reasons for x in registry.QUERIES["q_rejudged_reviews"](spark, SF).where(F.col("method") != "model").collect())
    for part in ("span_0099 is not a known span", "budget was exhausted", "rejudge rejected: segment 0 timestamp"):
        assert part in reasons


def test_downloads_in_every_format(spark):
    seg = spark.createDataFrame([(1, 0, "A", "hello there", 0.0, 2.0, "[00:00:00]"), (1, 1, "B", "x, y", 2.0, 4.0, "[00:00:02]")], "recording_id long, seg_idx long, speaker string, text string, start double, end double, timestamp string")
    names = ("txt", "Markdown", " word", ".srt", "WEBVTT", "csv", "json")
    rows = [(10 + i, 1, n, None if i else "", True, ["A=Ann", "A=Anna"]) for i, n in enumerate(names)] + [(30, 1, "txt", "C:\\x\\b.mp3", False, None), (31, 2, "txt", "c.wav", True, [])]
    asked = spark.createDataFrame(rows, "request_id long, recording_id long, format string, filename string, timestamps boolean, speakers array<string>")
    got = {x.request_id: x for x in export.downloads(asked, seg).collect()}
    assert len(got) == 9 and all(got[10 + i].filename == f"Transcript.{f.extension}" and got[10 + i].content_type == f.content_type and got[10 + i].error is None for i, f in enumerate(export.FORMATS))
    assert bytes(got[10].document).decode() == "[00:00:00] Anna: hello there\n[00:00:02] B: x, y\n" and bytes(got[12].document)[:2] == b"PK"
    assert all(b"Anna" in bytes(got[10 + i].document) for i in (1, 3, 4, 5, 6))
    assert bytes(got[30].document).decode() == "A: hello there\n\nB: x, y\n" and got[30].filename == "b.txt"
    assert got[31].error == "transcript is not ready" and got[31].document is None
