"""Structured Streaming forms of the event log's operators.

Streams have job_id, id, name, data, value and ts (timestamp).  State is keyed by job and bounded: one number or
status for each job, keys within the watermark, or an open session.  Set spark.sql.streaming.stateStore.providerClass
to the RocksDB provider where jobs outgrow an executor's memory, and give writeStream a checkpointLocation in shared storage.
budget_ledger and job_states take micro-batches as they arrive: an event that comes in a later one than its successors is
applied then.  Their forms in_order hold events back until the gap before them is filled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# fixed values: the states of a job and those that may follow each
NEXT = {
    "queued": ("running", "cancel_requested", "failed"),
    "running": ("queued", "awaiting_review", "cancel_requested", "succeeded", "failed", "canceled"),
    "awaiting_review": ("succeeded", "failed", "expired"),
    "cancel_requested": ("canceled",),
}


def first_of_key(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One event for each idempotency key (the hash of its job, name and data) within the watermark's delay."""
    key = F.sha2(F.concat_ws("|", F.col("job_id").cast("string"), "name", "data"), 256)
    return stream.withColumn("idempotency_key", key).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["idempotency_key"])


def sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """job_id, first_t, last_t, n of each job's sessions; late events beyond the delay are dropped by the watermark."""
    return stream.withWatermark("ts", delay).groupBy("job_id", F.session_window("ts", gap)).agg(F.min("ts").alias("first_t"), F.max("ts").alias("last_t"), F.count(F.lit(1)).alias("n")).drop("session_window")


def _ledger(cap: int):
    def charge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent = state.get[0] if state.exists else 0
        # the rows of a job in one micro-batch; maxFilesPerTrigger bounds them
        rows = pd.concat(list(batches)).sort_values("id", kind="stable")
        cost = rows["value"].abs().fillna(0).astype("int64")
        after, fits = [], []
        for c in cost:
            fits.append(spent + c <= cap)
            spent += c if fits[-1] else 0
            after.append(spent)
        state.update((int(spent),))
        yield pd.DataFrame({"job_id": key[0], "id": rows["id"].to_numpy(), "charge": cost.to_numpy(), "spent": after, "allowed": fits})

    return charge


def budget_ledger(stream: DataFrame, cap: int = 500) -> DataFrame:
    """job_id, id, charge, spent, allowed: charges of each job, in the order of ids within a micro-batch; refused ones cost nothing."""
    return stream.groupBy("job_id").applyInPandasWithState(_ledger(cap), "job_id long, id long, charge long, spent long, allowed boolean", "spent long", "append", GroupStateTimeout.NoTimeout)


def _machine(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status = state.get[0] if state.exists else "queued"
    out = []
    for row in pd.concat(list(batches)).sort_values("id", kind="stable").itertuples(index=False):
        fine = row.name in NEXT.get(status, ())
        out.append((key[0], row.id, status, row.name, fine))
        status = row.name if fine else status
    state.update((status,))
    yield pd.DataFrame(out, columns=["job_id", "id", "before", "after", "accepted"])


def job_states(stream: DataFrame) -> DataFrame:
    """job_id, id, before, after, accepted: each requested status against the job's own; a job begins queued, and refused requests change nothing."""
    return stream.select("job_id", "id", F.col("name")).groupBy("job_id").applyInPandasWithState(_machine, "job_id long, id long, before string, after string, accepted boolean", "status string", "append", GroupStateTimeout.NoTimeout)


def _janitor(ttl_ms: int):
    def tick(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, since = state.get if state.exists else ("queued", 0)
        if state.hasTimedOut:
            if status == "awaiting_review":
                # an expired review stays one more deadline, for its last event to be read
                now = state.getCurrentWatermarkMs()
                state.update(("expired", now))
                state.setTimeoutTimestamp(now + ttl_ms)
                yield pd.DataFrame({"job_id": [key[0]], "action": ["expire"]})
            else:
                state.remove()
                yield pd.DataFrame({"job_id": [key[0]], "action": ["purge"]})
            return
        for row in pd.concat(list(batches)).sort_values("id", kind="stable").itertuples(index=False):
            status, since = row.name, int(row.ts.timestamp() * 1000)
        state.update((status, since))
        if status in ("succeeded", "failed", "canceled", "expired", "awaiting_review"):
            state.setTimeoutTimestamp(max(since + ttl_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"job_id": pd.Series([], dtype="int64"), "action": pd.Series([], dtype="str")})

    return tick


def retention(stream: DataFrame, ttl_seconds: int, delay: str = "1 minute") -> DataFrame:
    """job_id, action: finished jobs are purged, and reviews left alone expire, once the watermark is ttl_seconds past their last event."""
    rows = stream.withWatermark("ts", delay).select("job_id", "id", "name", "ts")
    return rows.groupBy("job_id").applyInPandasWithState(_janitor(ttl_seconds * 1000), "job_id long, action string", "status string, since long", "append", GroupStateTimeout.EventTimeTimeout)


def cursor_tail(stream: DataFrame, after: int = 0) -> DataFrame:
    """The events after an id, as they arrive; where a reader stopped, its checkpoint resumes."""
    return stream.where(F.col("id") > max(after, 0))


class _InOrder(StatefulProcessor):
    """Applies a job's events in the order of their ids, from 1 on.

    An event waits in a map state until all before it have come, or until the watermark is `patience` past the latest
    event that came when the wait began; then the gap is given up and those that wait are applied.  Events whose place has passed are
    dropped, as they were either applied or given up.
    """

    def __init__(self, columns: list[str], kinds: str, start: tuple, state: str, step: Callable, out: list[str], patience_ms: int):
        self.columns, self.kinds, self.start, self.state, self.step, self.out, self.patience = columns, kinds, start, state, step, out, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "id long")
        self.now = handle.getValueState("now", self.state)
        self.waiting = handle.getMapState("waiting", "id long", self.kinds)

    def _drain(self, key: tuple, at: int) -> Iterator[pd.DataFrame]:
        now = self.now.get() or self.start
        out = []
        while self.waiting.containsKey((at,)):
            now, row = self.step(tuple(now), dict(zip(self.columns, self.waiting.getValue((at,)), strict=True)))
            out.append((key[0], at, *row))
            self.waiting.removeKey((at,))
            at += 1
        self.next.update((at,))
        self.now.update(tuple(now))
        if out:
            yield pd.DataFrame(out, columns=["job_id", "id", *self.out])

    def _wait(self, since: int) -> None:
        if next(iter(self.waiting.keys()), None) is not None and not list(self.handle.listTimers()):
            self.handle.registerTimer(since + self.patience)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, latest = self.next.get()[0] if self.next.exists() else 1, timerValues.getCurrentWatermarkInMs()
        for batch in rows:
            latest = max(latest, int(batch["ts"].max().timestamp() * 1000))
            for row in batch[["id", *self.columns]].itertuples(index=False):
                if row[0] >= at:
                    self.waiting.updateValue((int(row[0]),), tuple(None if pd.isna(x) else x for x in row[1:]))
        yield from self._drain(key, at)
        self._wait(latest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting = [k[0] for k in self.waiting.keys()]
        if waiting and min(waiting) > self.next.get()[0]:
            yield from self._drain(key, min(waiting))
        self._wait(timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def _in_order(stream: DataFrame, processor: _InOrder, out: str, delay: str) -> DataFrame:
    rows = stream.withWatermark("ts", delay).select("job_id", "id", *processor.columns, "ts")
    return rows.groupBy("job_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="append", timeMode="EventTime")


def _accept(state: tuple, row: dict) -> tuple[tuple, tuple]:
    fine = row["name"] in NEXT.get(state[0], ())
    return (row["name"] if fine else state[0],), (state[0], row["name"], fine)


def job_states_in_order(stream: DataFrame, delay: str = "1 minute", patience_ms: int = 3_600_000) -> DataFrame:
    """job_states over events that may arrive out of order: ids of a job count from 1 without gaps, see _InOrder.

    Needs the RocksDB state store provider.
    """
    return _in_order(stream, _InOrder(["name"], "name string", ("queued",), "status string", _accept, ["before", "after", "accepted"], patience_ms), "job_id long, id long, before string, after string, accepted boolean", delay)


def budget_ledger_in_order(stream: DataFrame, cap: int = 500, delay: str = "1 minute", patience_ms: int = 3_600_000) -> DataFrame:
    """budget_ledger over events that may arrive out of order, see job_states_in_order."""

    def charge(state: tuple, row: dict) -> tuple[tuple, tuple]:
        cost = int(abs(row["value"] or 0))
        fits = state[0] + cost <= cap
        spent = state[0] + (cost if fits else 0)
        return (spent,), (cost, spent, fits)

    return _in_order(stream, _InOrder(["value"], "value double", (0,), "spent long", charge, ["charge", "spent", "allowed"], patience_ms), "job_id long, id long, charge long, spent long, allowed boolean", delay)
