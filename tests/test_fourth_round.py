"""Faults of the fourth round: recordings that a cap on chunks left without a plan."""

import random

from test_folds import plan

from turnstream import registry
from turnstream.operators import folds


def planned(df):
    found = {}
    for r in df.orderBy("recording_id", "chunk_idx").collect():
        found.setdefault(r.recording_id, []).append(tuple(r)[1:])
    return found


def rows(cuts, overlap):
    """All columns of a plan's cuts."""
    sure = {"final": 1.0, "fixed": 0.5, "silence": 0.9}
    return [(i, a, b, {"final": 0, "fixed": overlap, "silence": folds.reduced_overlap(overlap)}[kind], kind, sure[kind]) for i, (a, b, kind) in enumerate(cuts)]


def test_long_recordings_are_planned_from_their_log(spark):
    # 10,000 fixed chunks of 40 s and 5 s of overlap reach 350,005 s; ends beside that, on a target, and far beyond
    totals = {1: 350_005_000, 2: 350_005_001, 3: 40_000 + 35_000 * 10_500, 4: 400_000_000, 5: 430_000_000}
    rng = random.Random(4)
    silences = {i: [] for i in totals}
    silences[4] = [(a, a + 500) for a in sorted([*range(20_000, 900_000, 1500), *range(350_000_000, 350_400_000, 25_000), 390_000_000])]
    # whole halves of a second, as other times are cut as doubles
    silences[5] = [(a, a + 500) for a in sorted(rng.sample(range(0, 440_000_000, 500), 200))]
    lines = [(i, k, x) for i, spans in silences.items() for k, x in enumerate(x for a, b in spans for x in (f"silence_start: {a / 1000:.3f}", f"silence_end: {b / 1000:.3f} | silence_duration: 0.5"))]
    lines += [(i, 1_000_000, f"out_time_us={t}000") for i, t in totals.items()]
    found = planned(folds.plan_from_log(spark.createDataFrame(lines, "recording_id long, line_no long, line string"), 40_000, 5_000))
    assert all(len(found.get(i, [])) > 10_000 for i in (2, 3, 4, 5)) and len(found[1]) == 10_000
    assert found == {i: rows(plan(t, silences[i], 40_000, 5_000), 5_000) for i, t in totals.items()}


def test_runs_of_fixed_chunks_equal_chunks_made_one_by_one(spark):
    rng = random.Random(5)
    cases = {i: (rng.choice([rng.randint(1, 900_000), rng.randint(0, 20) * 500 + 20_000]), [(a, a + rng.randint(-5, 3000)) for a in (rng.choice([rng.randint(0, 900_000), 333_000]) for _ in range(rng.randint(0, 9)))]) for i in range(80)}
    totals = spark.createDataFrame([(i, t) for i, (t, _) in cases.items()], "recording_id long, total_ms long")
    spans = spark.createDataFrame([(i, a, b) for i, (_, s) in cases.items() for a, b in s], "recording_id long, start_ms long, end_ms long")
    for d, o in ((20_000, 500), (20_000, 19_500), (3000, 0), (120_000, 119_000)):
        assert planned(folds.adaptive_plan(totals, spans, d, o)) == {i: rows(plan(t, s, d, o), o) for i, (t, s) in cases.items()}


def test_a_plan_holds_no_more_for_a_longer_recording():
    state = folds._planner(40_000, 5_000)()
    long = 35_000 * 10**6
    assert state.push({"total_ms": long, "mid_ms": 35_000}) == []
    assert [len(state.push({"total_ms": long, "mid_ms": long - 50_000})) for _ in range(3)] == [2, 0, 0] and len(state.mids) == 1
    assert sum(x[-1] for x in state.end()) == 2 and state.over
    assert state.push({"total_ms": long, "mid_ms": long + 1}) == [] and len(state.mids) <= 1


def test_long_conversations_keep_their_plan(spark, tmp_path):
    # 21 turns of 300,000 characters, 15 of them a second
    turns = spark.createDataFrame([(c, t, "user", "x" * (300_000 if c == 1 else 900)) for c in (1, 2) for t in range(21)], "conv_id long, turn long, role string, text string")
    turns.write.parquet(str(tmp_path / "conversations.parquet"))
    found = planned(registry.QUERIES["q_plan_from_log"](spark, str(tmp_path)))
    assert len(found[1]) > 10_000 and found[1][-1][2] == 420_000_000 and found[2][-1][2] == 1_260_000
    assert all(b[0] == a[0] + 1 and b[1] == a[2] - a[3] for a, b in zip(found[1], found[1][1:], strict=False))
