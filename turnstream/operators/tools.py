"""Bounded tool loops: calls that a model asks for, checked against limits, run as joins with the tools' relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: turns with calls, calls in a turn and calls in all that one interaction may ask for
MOST_TURNS, MOST_CALLS, MOST_IN_ALL = 2, 4, 8
_KEYS = ["recording_id", "turn", "pos"]


def bounded_calls(calls: DataFrame, turns: int = MOST_TURNS, per_turn: int = MOST_CALLS, total: int = MOST_IN_ALL) -> DataFrame:
    """calls (recording_id, turn, pos and others) with refused: why the interaction ends at this call's turn, or null.

    Turns count if they hold calls.  The first turn beyond the limits ends the interaction: its calls and all later
    ones are refused, with one reason; those of the turns before have run.  Only counts by turn are ordered.
    """
    order = Window.partitionBy("recording_id").orderBy("turn")
    counts = calls.groupBy("recording_id", "turn").agg(F.count(F.lit(1)).alias("n")).withColumns({"place": F.row_number().over(order), "so_far": F.sum("n").over(order)})
    # fixed values: the messages
    reason = (
        F.when(F.col("place") > turns, F.lit(f"interaction tool loop exceeded max turns ({turns})"))
        .when(F.col("n") > per_turn, F.format_string(f"interaction requested %d function calls; max per turn is {per_turn}", "n"))
        .when(F.col("so_far") > total, F.format_string(f"interaction requested %d total function calls; max is {total}", "so_far"))
    )
    first = counts.withColumn("reason", reason).where("reason is not null").groupBy("recording_id").agg(F.min("turn").alias("end"), F.min_by("reason", "turn").alias("reason"))
    return calls.join(first, "recording_id", "left").withColumn("refused", F.when(F.col("turn") >= F.col("end"), F.col("reason"))).drop("end", "reason")


def run_calls(calls: DataFrame, tools: dict[str, DataFrame]) -> DataFrame:
    """recording_id, turn, pos, name, result, error of each call that is not refused.

    calls: recording_id, turn, pos, name, candidate_ids (array) and refused.  tools: by name, their results for every
    recording_id and candidate_ids that they can be asked about.  Each tool's calls are joined with its own relation;
    unknown names and candidates give an error in place of a result.
    """
    allowed = calls.where("refused is null")
    parts = [allowed.where(~F.coalesce(F.col("name").isin(*tools), F.lit(False))).select(*_KEYS, "name", F.lit(None).cast("string").alias("result"), F.concat(F.lit("unknown tool "), F.coalesce("name", F.lit(""))).alias("error"))]
    for name, results in tools.items():
        mine = allowed.where(F.col("name") == name).join(results.select("recording_id", "candidate_ids", "result"), ["recording_id", "candidate_ids"], "left")
        parts.append(mine.select(*_KEYS, "name", "result", F.when(F.col("result").isNull(), F.concat(F.lit("unknown candidate_id "), F.array_join(F.coalesce("candidate_ids", F.array()), ","))).alias("error")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tool_loop(calls: DataFrame, tools: dict[str, DataFrame], turns: int = MOST_TURNS, per_turn: int = MOST_CALLS, total: int = MOST_IN_ALL) -> DataFrame:
    """recording_id, place, turn, pos, name, result, error: the answers to an interaction's calls in the order of the calls, refused ones with their reason."""
    known = bounded_calls(calls, turns, per_turn, total)
    refused = known.where("refused is not null").select(*_KEYS, "name", F.lit(None).cast("string").alias("result"), F.col("refused").alias("error"))
    place = F.row_number().over(Window.partitionBy("recording_id").orderBy("turn", "pos")).cast("long")
    return run_calls(known, tools).unionByName(refused).withColumn("place", place)
