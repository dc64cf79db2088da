"""The event log: sessions, cursors, idempotency and budgets over keyed, ordered events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.folds import ordered_fold


def log(events: DataFrame) -> DataFrame:
    """job_id, id (from 1), name, data, t (epoch microseconds): the append-only log of each job."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(F.col("user_id").alias("job_id"), F.row_number().over(w).cast("long").alias("id"), F.col("event_type").alias("name"), F.col("props").alias("data"), "value", F.expr("unix_micros(cast(ts as timestamp))").alias("t"))


def pause_sessions(log_: DataFrame, gap_us: int = 1_800_000_000) -> DataFrame:
    w = Window.partitionBy("job_id").orderBy("id")
    r = log_.withColumn("fresh", F.coalesce((F.col("t") - F.lag("t").over(w) > gap_us).cast("int"), F.lit(1))).withColumn("session", F.sum("fresh").over(w))
    return r.groupBy("job_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def latest_event(log_: DataFrame) -> DataFrame:
    return log_.groupBy("job_id", "name").agg(F.max("id").alias("id"), F.max_by("data", "id").alias("data"))


def idempotent(log_: DataFrame) -> DataFrame:
    """One owner for each key (the hash of name and data): the first event of the job."""
    key = F.sha2(F.trim(F.concat_ws("|", "name", "data")), 256)
    return log_.select("job_id", "id", key.alias("idempotency_key")).groupBy("job_id", "idempotency_key").agg(F.min("id").alias("owner_id"), F.count(F.lit(1)).alias("attempts"))


class _Charges:
    """A charge that does not fit under the cap is refused and costs nothing."""

    def __init__(self, cap: int):
        self.cap, self.spent = cap, 0

    def push(self, row: dict) -> list[tuple]:
        fits = self.spent + row["charge"] <= self.cap
        self.spent += row["charge"] * fits
        return [(row["id"], row["charge"], self.spent, fits)]

    def end(self) -> list[tuple]:
        return []


def budget_ledger(log_: DataFrame, cap: int = 500) -> DataFrame:
    """job_id, id, charge, spent, allowed: charges of each job in order; those beyond the cap are refused and leave what is spent as it was."""
    cost = F.coalesce(F.floor(F.abs("value")), F.lit(0)).cast("long")
    rows = log_.select(F.col("job_id").alias("recording_id"), "id", cost.alias("charge"))
    return ordered_fold(rows, ["id"], lambda: _Charges(cap), "recording_id long, id long, charge long, spent long, allowed boolean").withColumnRenamed("recording_id", "job_id")


def state_audit(log_: DataFrame) -> DataFrame:
    """How often each state follows each other state."""
    w = Window.partitionBy("job_id").orderBy("id")
    return log_.select(F.lag("name").over(w).alias("before"), F.col("name").alias("after")).where("before is not null").groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))
