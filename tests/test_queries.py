"""Every query with SQL agrees with it on the smallest tables, and literal cases of the functions."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from turnstream import registry
from turnstream.functions import text, timecode
from turnstream.operators import timeline, validate

SF = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_oracle(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.execute(registry.ORACLE[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)


def test_timecodes(spark):
    r = spark.range(1).select(timecode.format_timestamp(F.lit(360000.9)).alias("a"), timecode.format_timestamp(F.lit(-5)).alias("b"), timecode.parse_timestamp(F.lit("[00:99:00]")).alias("c"), timecode.parse_timestamp(F.lit("00:01:30")).alias("d")).first()
    assert tuple(r) == ("[100:00:00]", "[00:00:00]", 5940, None)


def test_text(spark):
    r = spark.range(1).select(text.fix_punctuation(F.lit("Hi ,there!!  ok..")).alias("a"), text.csv_safe(F.lit("=1")).alias("b"), text.escape_markdown(F.lit("a*b|")).alias("c")).first()
    assert tuple(r) == ("Hi, there!  ok...", "'=1", "a\\*b\\|")


def test_reading_turns_reset_at_their_own_start(spark):
    rows = [(1, 0, "a", "x", 0.0), (1, 1, "a", "y", 60.0), (1, 2, "a", "z", 120.0), (1, 3, "b", " ", 130.0), (1, 4, "a", "w", 140.0)]
    got = timeline.reading_turns(spark.createDataFrame(rows, "recording_id long, seg_idx long, speaker string, text string, start double")).orderBy("turn_idx").collect()
    assert [(r.speaker, r.start, r.n_segments) for r in got] == [("a", 0.0, 2), ("a", 120.0, 2)]


def test_null_times_stay_null(spark):
    none = F.lit(None).cast("double")
    r = spark.range(1).select(timecode.format_timestamp(none).alias("a"), timecode.clock(none).alias("b"), timecode.precise_clock(none, ",").alias("c"), timecode.clock(F.lit(3661.9)).alias("d"), timecode.precise_clock(F.lit(-1.0), ".").alias("e"), timecode.shift_timestamp(F.lit("bad"), F.lit(5)).alias("f")).first()
    assert tuple(r) == (None, None, None, "1:01:01", "00:00:00.000", "bad")


def test_validation_rules_and_changes(spark):
    kind = "recording_id long, seg_idx long, timestamp string, speaker string, text string, confidence double"
    rows = [(1, 0, "[00:00:01]", "Speaker 2", "a", None), (1, 1, "[00:00:00]", "speaker2", "b", 1.5), (2, 0, None, "Speaker 9", "[No transcript produced for x", 0.0)]
    seg = spark.createDataFrame(rows, kind)
    assert [r.error for r in seg.select("recording_id", "seg_idx", validate.segment_error().alias("error")).orderBy("recording_id", "seg_idx").collect()] == [None, "confidence", "timestamp"]
    assert [tuple(r) for r in validate.list_verdicts(seg).orderBy("recording_id").collect()] == [(1, 2, 1, False, False), (2, 1, 1, False, False)]
    assert [r.speaker for r in validate.map_speakers(seg, ["Ada", "Ben"]).orderBy("recording_id", "seg_idx").collect()] == ["Ben", "Ben", "Speaker 9"]
    assert seg.where(validate.is_gap()).count() == 1
    notes = validate.change_notes(seg, seg.where("seg_idx = 0")).orderBy("recording_id").collect()
    assert [(r.recording_id, r.notes, r.status) for r in notes] == [(1, "", "required"), (2, "", None)]


def test_fillers_and_search(spark):
    r = spark.range(1).select(text.remove_fillers(F.lit("Um, so  the umber um. You know!"), ("um", "you know")).alias("a"), text.count_matches(F.lit("aAaab"), "aa").alias("b"), text.count_matches(F.lit("x"), "").alias("c")).first()
    assert tuple(r) == (", so the umber.!", 2, 0)
