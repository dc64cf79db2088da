"""The durable log of jobs in batch form: journals and snapshots read back, cursors, retention, budgets and states.

A journal is lines of JSON (job_id, line_no, line): an event with id, name and data each, ids from 1 without gaps.  A
snapshot (job_id, status, created_at, updated_at, finished_at, committed, idempotency) says how many events count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.folds import ordered_fold
from ..operators.scan import Running, running
from .live import NEXT

# fixed values: states that a job does not leave, and the states of a span
TERMINAL = ("succeeded", "failed", "canceled", "expired")
SPAN_NEXT = {"planned": ("primary_complete",), "primary_complete": ("evidence_complete", "judged", "degraded"), "evidence_complete": ("judged", "degraded"), "judged": ("rejudged",)}
#: Seconds of creation that one task ranks.
RANK_SECONDS = 600
_EVENT = "id bigint, name string, data string"


def is_terminal(status: Column) -> Column:
    return status.isin(*TERMINAL)


def scan_journal(lines: DataFrame, snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, verdicts): the committed events of readable journals, and per job what the scan found.

    lines also have last (the file's last line) and ended (by a newline).  A last line that does not end and cannot be
    read is torn and goes; any other unreadable line, a gap in the ids, or fewer events than the snapshot commits
    make the journal unreadable.  Events beyond the committed ones go (committed null: all count).
    verdicts: job_id, error, n_events, torn, dropped (uncommitted), missing_newline.
    """
    raw = F.trim("line")
    rows = lines.withColumn("e", F.from_json(raw, _EVENT)).withColumn("broken", F.col("e").isNull() | F.col("e.id").isNull())
    rows = rows.withColumn("torn", F.col("broken") & F.col("last") & ~F.col("ended"))
    order = Window.partitionBy("job_id").orderBy("line_no")
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("gap", ~F.col("broken") & (F.col("e.id") != F.col("place")))
    problem = F.when(F.col("broken") & ~F.col("torn"), F.format_string("decode event %d", "place")).when(F.col("gap"), F.format_string("non-contiguous event id %d", "e.id"))
    found = rows.withColumn("problem", problem).groupBy("job_id").agg(
        F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("place"))).alias("problem"), F.count_if(~F.col("broken")).alias("n"),
        F.bool_or("torn").alias("torn"), F.bool_or(F.col("last") & ~F.col("ended") & ~F.col("broken")).alias("missing_newline"),
    )
    known = snapshots.select("job_id", "committed").join(found, "job_id", "left").na.fill(0, ["n"]).na.fill(False, ["torn", "missing_newline"])
    short = F.when(F.col("n") < F.col("committed"), F.format_string("event journal has %d events, job snapshot commits %d", "n", "committed"))
    verdicts = known.withColumn("error", F.coalesce("problem", short))
    keep = F.least(F.col("n"), F.coalesce("committed", F.col("n")))
    verdicts = verdicts.select("job_id", "error", F.when(F.col("error").isNull(), keep).alias("n_events"), "torn", F.when(F.col("error").isNull(), F.col("n") - keep).alias("dropped"), "missing_newline")
    events = rows.where("not broken").join(verdicts.where("error is null").select("job_id", "n_events"), "job_id").where("place <= n_events").select("job_id", "e.id", "e.name", "e.data")
    return events, verdicts


def read_after(events: DataFrame, after: Column) -> DataFrame:
    """The events that come after a cursor: ids greater than it, all for a negative one."""
    return events.where(F.col("id") > F.greatest(after, F.lit(0)))


def recovered(snapshots: DataFrame) -> DataFrame:
    """What a restart makes of each job: job_id, status, event (to append), requeued, rank among the jobs to run again by creation."""
    again = F.col("status").isin("queued", "running")
    status = F.when(again, "queued").when(F.col("status") == "cancel_requested", "canceled").otherwise(F.col("status"))
    rows = snapshots.select("job_id", status.alias("status"), F.when(F.col("status") == "cancel_requested", "canceled").alias("event"), again.alias("requeued"), "created_at")
    # jobs are ranked in blocks of their creation, whose sizes alone are summed in one place
    place = Running("sum", F.col("requeued").cast("long"))
    ranked = running(rows, [], F.floor(F.coalesce("created_at", F.lit(0)) / RANK_SECONDS), ["created_at", "job_id"], {"rank": place})
    return ranked.select("job_id", "status", "event", "requeued", F.when(F.col("requeued"), F.col("rank")).alias("rank"))


def retention(snapshots: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """job_id, action of the janitor at a time: purge finished jobs past the deadline, expire reviews left alone, else keep.

    Times are seconds.  An expired review stays one deadline longer, as its expiry is when it finished.
    """
    cutoff = now - ttl_seconds
    finished = is_terminal(F.col("status"))
    action = F.when(finished & (F.col("finished_at") < cutoff), "purge").when((F.col("status") == "awaiting_review") & (F.col("updated_at") < cutoff), "expire").otherwise("keep")
    return snapshots.select("job_id", action.alias("action"))


def admitted(arrivals: DataFrame, most: int) -> DataFrame:
    """Which arrivals (seq, job_id, change: 1 to enter, -1 to leave) a server with room for `most` jobs admits; a fold over all, in order."""

    class Door:
        def __init__(self):
            self.inside: set[int] = set()

        def push(self, row: dict) -> list[tuple]:
            if row["change"] < 0:
                self.inside.discard(row["job_id"])
                return []
            fits = len(self.inside) < most
            if fits:
                self.inside.add(row["job_id"])
            return [(row["seq"], row["job_id"], fits)]

        def end(self) -> list[tuple]:
            return []

    return ordered_fold(arrivals.withColumnRenamed("server", "recording_id"), ["seq"], Door, "recording_id long, seq long, job_id long, admitted boolean").withColumnRenamed("recording_id", "server")


class _Budget:
    """Requests in order: a reservation that does not fit is refused and costs nothing; a response frees it and is charged."""

    def __init__(self, cap: int):
        self.cap, self.used, self.open = cap, 0, {}

    def push(self, row: dict) -> list[tuple]:
        phase, key, tokens = row["phase"], row["request"], max(row["tokens"] or 0, 0)
        fine = True
        if phase == "before_request":
            fine = key not in self.open and self.used + sum(self.open.values()) + tokens <= self.cap
            if fine:
                self.open[key] = tokens
        elif phase == "after_response":
            held = self.open.pop(key, 0)
            self.used += tokens or held
            fine = self.used <= self.cap
        elif phase == "request_failed":
            held = self.open.pop(key, 0)
            self.used += held if row["ambiguous"] else 0
        elif phase == "attempt_failed" and row["ambiguous"]:
            self.used += tokens
            fine = self.used + sum(self.open.values()) <= self.cap
        return [(row["id"], fine, self.used, sum(self.open.values()))]

    def end(self) -> list[tuple]:
        return []


def token_ledger(requests: DataFrame, cap: int) -> DataFrame:
    """job_id, id, allowed, used, reserved after each row of requests (job_id, id, phase, request, tokens, ambiguous).

    Open requests of a job are held, which its own concurrency bounds.
    """
    rows = requests.select(F.col("job_id").alias("recording_id"), "id", "phase", "request", "tokens", "ambiguous")
    return ordered_fold(rows, ["id"], lambda: _Budget(cap), "recording_id long, id long, allowed boolean, used long, reserved long").withColumnRenamed("recording_id", "job_id")


class _Claims:
    """Attempts at one key in order: the first owns it until it fails; later ones wait for, or replay, the owner's job."""

    def __init__(self):
        self.owner, self.committed = None, False

    def push(self, row: dict) -> list[tuple]:
        what = row["what"]
        if what == "fail":
            role = "released" if self.owner == row["job"] and not self.committed else "ignored"
            self.owner = None if role == "released" else self.owner
        elif what == "commit":
            role = "committed" if self.owner == row["job"] else "ignored"
            self.committed |= role == "committed"
        else:
            role = "owner" if self.owner is None else "replay" if self.committed else "wait"
            self.owner = row["job"] if self.owner is None else self.owner
        return [(row["id"], role, self.owner)]

    def end(self) -> list[tuple]:
        return []


def key_claims(attempts: DataFrame) -> DataFrame:
    """key, id, role, owner after each row of attempts (key, id, job, what: claim, commit or fail)."""
    rows = attempts.select(F.col("key").alias("recording_id"), "id", "job", "what")
    return ordered_fold(rows, ["id"], _Claims, "recording_id long, id long, role string, owner long").withColumnRenamed("recording_id", "key")


def _allowed(table: dict[str, tuple[str, ...]], before: Column, after: Column) -> Column:
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, bs in table.items() for b in bs]
    return F.array_contains(F.array(*pairs), F.struct(before.alias("a"), after.alias("b")))


def job_transition_allowed(before: Column, after: Column) -> Column:
    """Whether a job may go from one state to another."""
    return F.coalesce(_allowed(NEXT, before, after), F.lit(False))


def span_transition_allowed(before: Column, after: Column) -> Column:
    """Whether a span may go from one state to another."""
    return F.coalesce(_allowed(SPAN_NEXT, before, after), F.lit(False))


def cancel_outcome(status: Column) -> Column:
    """What asking for a job's end does: nothing where it is asked or done, an error in other ends and under review, else a request."""
    return F.when(status.isin("canceled", "cancel_requested"), "unchanged").when(is_terminal(status) | (status == "awaiting_review"), "refused").otherwise("cancel_requested")


def attempts(log: DataFrame) -> DataFrame:
    """job_id, attempts: how often each job began to run."""
    return log.groupBy("job_id").agg(F.count_if(F.col("name") == "started").alias("attempts"))


def step_log(steps: DataFrame) -> DataFrame:
    """Steps (run_id, seq, name) with ids step_0001 and on, in order."""
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy("seq"))
    return steps.select("run_id", F.format_string("step_%04d", rank).alias("step_id"), "seq", "name")


def progress(done: Column, total: Column) -> Column:
    """Fraction of a run's work after `done` of `total` chunks: from 0.3 to 0.7."""
    return 0.3 + 0.4 * done / F.greatest(total, F.lit(1))


def latest_result(log: DataFrame, name: str = "result") -> DataFrame:
    """job_id, id, data of each job's last event of a name whose data holds an object."""
    last = log.where(F.col("name") == name).groupBy("job_id").agg(F.max_by(F.struct("id", "data"), "id").alias("x"))
    return last.where("x.data like '{%'").select("job_id", "x.*")


#: fixed value: bytes of the largest event that a journal takes
MOST_EVENT_BYTES = 64 << 20


class _Guarded:
    """A job's status and number of events; a request changes both or, where a check or the write fails, neither."""

    def __init__(self):
        self.status, self.events = "queued", 0

    def push(self, row: dict) -> list[tuple]:
        before, to = self.status, row["status"]
        if row["largest"] > MOST_EVENT_BYTES:
            outcome = "too_large"
        elif row["expected"] is not None and row["expected"] != before:
            outcome = "unexpected"
        elif to not in NEXT.get(before, ()):
            outcome = "illegal"
        else:
            outcome = "applied" if row["written"] else "rolled_back"
        first = None
        if outcome == "applied":
            first = self.events + 1 if row["n_events"] else None
            self.status, self.events = to, self.events + row["n_events"]
        return [(row["seq"], outcome, before, self.status, first, self.events)]

    def end(self) -> list[tuple]:
        return []


def guarded_transitions(requests: DataFrame) -> DataFrame:
    """job_id, seq, outcome, before, after, first_event, n_events of requests to change a job's status with a batch of events.

    requests: job_id, seq, status, expected (a status, or null for any), n_events, largest (bytes of the largest event),
    written (whether the journal and snapshot could be written).  A request is applied as a whole or not at all: not if
    an event is too large, the job is not as expected, the change is not allowed, or writing fails; the events of
    one that is rolled back take no ids.  A job begins queued, without events.
    """
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    rows = requests.select(F.col("job_id").alias("recording_id"), "seq", "status", "expected", zero("n_events"), zero("largest"), F.coalesce("written", F.lit(True)).alias("written"))
    return ordered_fold(rows, ["seq"], _Guarded, "recording_id long, seq long, outcome string, before string, after string, first_event long, n_events long").withColumnRenamed("recording_id", "job_id")
