"""Queries of the durable log of jobs, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import stores
from ..sources.fixtures import segments, table
from ..streaming import events, journal, store

_log = lambda f: lambda s, d: f(events.log(table(s, d, "events")))
STATES = ("queued", "running", "awaiting_review", "cancel_requested", "succeeded", "failed", "canceled", "expired")
_state = lambda c: F.element_at(F.array(*map(F.lit, STATES)), (c % 8 + 1).cast("int"))


def _journals(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Journals of the log, some torn, broken, with a gap, without a last newline or with an uncommitted tail."""
    k = F.col("job_id") % 7
    sizes = log.groupBy("job_id").agg(F.max("id").alias("n"))
    rows = log.join(sizes, "job_id").withColumn("last", F.col("id") == F.col("n"))
    shown = F.when((k == 3) & (F.col("id") == 2), F.col("id") + 5).otherwise(F.col("id"))
    line = F.to_json(F.struct(shown.alias("id"), "name", "data"))
    line = F.when((k == 1) & F.col("last"), F.lit('{"id": ')).when((k == 2) & F.col("last"), F.lit("oops")).otherwise(line)
    lines = rows.select("job_id", F.col("id").alias("line_no"), line.alias("line"), "last", (~F.col("last") | ~k.isin(1, 4)).alias("ended"))
    committed = F.when(k == 5, F.greatest(F.col("n") - 2, F.lit(0))).when(k == 6, F.col("n") + 1).when(k == 1, F.col("n") - 1).when(k == 0, F.lit(None)).otherwise(F.col("n"))
    return lines, sizes.select("job_id", committed.cast("long").alias("committed"))


def _snapshots(spark, d) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"))
    j = F.col("job_id")
    return rows.select("job_id", _state(j).alias("status"), (j * 7919 % 10007).alias("created_at"), (j * 31 % 5000).alias("updated_at"), (j * 17 % 5000).alias("finished_at"))


def _arrivals(log: DataFrame) -> DataFrame:
    """Four servers; a job enters with its first event and leaves with its last."""
    w = log.groupBy("job_id").agg(F.min_by("t", "id").alias("a"), F.max_by("t", "id").alias("b"))
    ends = w.select("job_id", F.explode(F.array(F.struct(F.col("a").alias("t"), F.lit(1).alias("change")), F.struct((F.col("b") + 1).alias("t"), F.lit(-1).alias("change")))).alias("x"))
    return ends.select((F.col("job_id") % 4).alias("server"), (F.col("x.t") * 2 + (F.col("x.change") + 1) / 2).cast("long").alias("at"), "job_id", F.col("x.change").alias("change")).withColumn("seq", F.col("at") * 0 + F.xxhash64("job_id", "change") % 1_000_000_007)


def _requests(log: DataFrame) -> DataFrame:
    """A request for every event and, three in four, an answer to the one before."""
    k = F.col("id") % 4
    asked = log.select("job_id", (F.col("id") * 2).alias("id"), F.lit("before_request").alias("phase"), F.col("id").alias("request"), F.floor(F.abs("value")).cast("long").alias("tokens"), F.lit(False).alias("ambiguous"))
    phase = F.when(k == 1, "after_response").when(k == 2, "request_failed").otherwise("after_response")
    done = log.where("id % 4 != 0").select("job_id", (F.col("id") * 2 + 1).alias("id"), phase.alias("phase"), F.col("id").alias("request"), F.when(k == 1, 3).otherwise(0).cast("long").alias("tokens"), (F.col("id") % 8 == 2).alias("ambiguous"))
    return asked.unionByName(done)


def _claims(log: DataFrame) -> DataFrame:
    """Of every job, by event: two claims, then its owner fails or commits, and more claims."""
    what = F.element_at(F.array(*map(F.lit, ("claim", "claim", "fail", "claim", "commit", "claim"))), ((F.col("id") - 1) % 6 + 1).cast("int"))
    job = F.when(F.col("id") == 3, 1).when(F.col("id") == 5, 4).otherwise(F.col("id"))
    return log.where("id <= 6").select(F.col("job_id").alias("key"), "id", job.cast("long").alias("job"), what.alias("what"))


def _pairs(allowed, names) -> DataFrame:
    def query(spark, d):
        rows = table(spark, d, "orders").select((F.col("o_orderkey") % (len(names) * len(names))).alias("k")).distinct()
        of = lambda c: F.element_at(F.array(*map(F.lit, names)), (c + 1).cast("int"))
        rows = rows.select(of(F.floor(F.col("k") / len(names))).alias("before"), of(F.col("k") % len(names)).alias("after"))
        return rows.withColumn("allowed", allowed(F.col("before"), F.col("after")))

    return query


def _guarded(log: DataFrame) -> DataFrame:
    """A request for each event of the log: to one of the states, some expecting a status, some too large, some not written."""
    k = F.col("id") + F.col("job_id")
    to = F.element_at(F.array(*map(F.lit, ("running", "queued", "running", "awaiting_review", "cancel_requested", "succeeded", "canceled"))), ((F.col("id") * 3 + F.col("job_id")) % 7 + 1).cast("int"))
    return log.select("job_id", F.col("id").alias("seq"), to.alias("status"), F.when(k % 3 == 0, F.when(k % 2 == 0, "running").otherwise("queued")).alias("expected"), (F.col("id") % 4).alias("n_events"), F.when(k % 11 == 5, journal.MOST_EVENT_BYTES + 1).otherwise(9).alias("largest"), (k % 5 != 1).alias("written"))


def _followed(spark, d) -> DataFrame:
    """The log, appended to a journal in three batches, one of them twice, and read back."""
    log = events.log(table(spark, d, "events")).select("job_id", "id", "name", "data")
    path = stores.scratch(spark, "journal")
    for k in (0, 1, 2, 1):
        store.append_events(log.where(F.col("job_id") % 3 == k), path, f"part-{k}")
    return store.read_events(spark, path, "job_id long, id long, name string, data string")


def _snapshot(spark, d) -> DataFrame:
    """Each job's last event by name, of two versions of a snapshot: the first without the last event."""
    log = events.log(table(spark, d, "events"))
    path, kind = stores.scratch(spark, "snapshot"), "job_id long, name string, id long, data string"
    sizes = log.groupBy("job_id").agg(F.max("id").alias("n"))
    store.write_snapshot(events.latest_event(log.join(sizes, "job_id").where("id < n")), path)
    store.write_snapshot(events.latest_event(log), path)
    version = lambda v: store.read_snapshot(spark, path, kind, v).withColumn("version", F.lit(v or 2))
    return version(1).unionByName(version(None))


SPAN_STATES = ("planned", "primary_complete", "evidence_complete", "judged", "degraded", "rejudged")
QUERIES = {
    "q_journal_events": _log(lambda x: journal.scan_journal(*_journals(x))[0]),
    "q_journal_verdicts": _log(lambda x: journal.scan_journal(*_journals(x))[1]),
    "q_cursor_read": _log(lambda x: journal.read_after(x, F.col("job_id") % 5 - 1).select("job_id", "id", "name")),
    "q_recovered_jobs": lambda s, d: journal.recovered(_snapshots(s, d)),
    "q_retention": lambda s, d: journal.retention(_snapshots(s, d), F.lit(4000), 1800),
    "q_token_ledger": _log(lambda x: journal.token_ledger(_requests(x), 300)),
    "q_key_claims": _log(lambda x: journal.key_claims(_claims(x))),
    "q_job_transitions": _pairs(journal.job_transition_allowed, STATES),
    "q_span_transitions": _pairs(journal.span_transition_allowed, SPAN_STATES),
    "q_cancel_outcomes": lambda s, d: _snapshots(s, d).select("job_id", journal.cancel_outcome(F.col("status")).alias("outcome"), journal.is_terminal(F.col("status")).alias("terminal")),
    "q_attempts": _log(lambda x: journal.attempts(x.withColumn("name", F.when(F.col("name") == "click", "started").otherwise(F.col("name"))))),
    "q_step_log": _log(lambda x: journal.step_log(x.select(F.col("job_id").alias("run_id"), (F.col("id") * 3).alias("seq"), "name"))),
    "q_progress": lambda s, d: segments(s, d).groupBy("recording_id").agg(F.count(F.lit(1)).alias("n")).select("recording_id", F.round(journal.progress(F.col("recording_id") % 3, F.col("n")), 6).alias("fraction")),
    "q_latest_result": _log(lambda x: journal.latest_result(x, "purchase")),
    "q_journal_followed": _followed,
    "q_guarded_transitions": _log(lambda x: journal.guarded_transitions(_guarded(x))),
    "q_snapshot_versions": _snapshot,
}


def oracle() -> dict[str, str]:
    """The SQL of QUERIES."""
    log = "log AS (SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS id, event_type AS name, props AS data, value FROM events), sz AS (SELECT job_id, max(id) AS n FROM log GROUP BY 1)"
    snap = "sn AS (SELECT o_orderkey AS job_id, (" + str(list(STATES)) + ")[o_orderkey % 8 + 1] AS status, o_orderkey * 7919 % 10007 AS created_at, o_orderkey * 31 % 5000 AS updated_at, o_orderkey * 17 % 5000 AS finished_at FROM orders)"
    verdict = """v AS (SELECT job_id, n, job_id % 7 AS k, CASE job_id % 7 WHEN 5 THEN greatest(n - 2, 0) WHEN 6 THEN n + 1 WHEN 1 THEN n - 1 WHEN 0 THEN NULL ELSE n END AS committed, CASE WHEN job_id % 7 IN (1, 2) THEN n - 1 ELSE n END AS good FROM sz),
w AS (SELECT *, CASE WHEN k = 2 THEN 'decode event ' || n WHEN k = 3 AND n >= 2 THEN 'non-contiguous event id 7' WHEN good < committed THEN 'event journal has ' || good || ' events, job snapshot commits ' || committed END AS error FROM v),
x AS (SELECT job_id, k, error, CASE WHEN error IS NULL THEN least(good, coalesce(committed, good)) END AS n_events, good FROM w)"""
    allowed = lambda table: "[" + ", ".join(f"'{a}>{b}'" for a, bs in table.items() for b in bs) + "]"
    pair = lambda names, table: f"WITH k AS (SELECT DISTINCT o_orderkey % {len(names) ** 2} AS k FROM orders), p AS (SELECT ({list(names)})[k // {len(names)} + 1] AS before, ({list(names)})[k % {len(names)} + 1] AS after FROM k) SELECT *, list_contains({allowed(table)}, before || '>' || after) AS allowed FROM p"
    return {
        "q_journal_events": f"WITH {log}, {verdict} SELECT job_id, id, name, data FROM log JOIN x USING (job_id) WHERE error IS NULL AND id <= n_events",
        "q_journal_verdicts": f"WITH {log}, {verdict} SELECT job_id, error, n_events, k = 1 AS torn, CASE WHEN error IS NULL THEN good - n_events END AS dropped, k = 4 AS missing_newline FROM x",
        "q_guarded_transitions": f"""WITH RECURSIVE {log}, rq AS (SELECT job_id, id AS seq, (['running', 'queued', 'running', 'awaiting_review', 'cancel_requested', 'succeeded', 'canceled'])[(id * 3 + job_id) % 7 + 1] AS status,
  CASE WHEN (id + job_id) % 3 = 0 THEN CASE WHEN (id + job_id) % 2 = 0 THEN 'running' ELSE 'queued' END END AS expected, id % 4 AS n, (id + job_id) % 11 = 5 AS large, (id + job_id) % 5 <> 1 AS written FROM log),
st AS (SELECT DISTINCT job_id, 0::BIGINT AS seq, '' AS outcome, '' AS before, 'queued' AS after, NULL::BIGINT AS first_event, 0::BIGINT AS n_events FROM rq
UNION ALL SELECT job_id, seq, outcome, before, CASE WHEN outcome = 'applied' THEN status ELSE before END, CASE WHEN outcome = 'applied' AND n > 0 THEN n_events + 1 END, CASE WHEN outcome = 'applied' THEN n_events + n ELSE n_events END
  FROM (SELECT r.*, s.after AS before, s.n_events, CASE WHEN large THEN 'too_large' WHEN expected IS NOT NULL AND expected <> s.after THEN 'unexpected' WHEN NOT list_contains({allowed(journal.NEXT)}, s.after || '>' || status) THEN 'illegal' WHEN written THEN 'applied' ELSE 'rolled_back' END AS outcome
    FROM st s JOIN rq r ON r.job_id = s.job_id AND r.seq = s.seq + 1))
SELECT * FROM st WHERE seq > 0""",
        "q_journal_followed": f"WITH {log} SELECT job_id, id, name, data FROM log",
        "q_snapshot_versions": f"WITH {log} SELECT job_id, name, max(id) AS id, arg_max(data, id) AS data, 2 AS version FROM log GROUP BY ALL UNION ALL SELECT job_id, name, max(id), arg_max(data, id), 1 FROM log JOIN sz USING (job_id) WHERE id < n GROUP BY ALL",
        "q_cursor_read": f"WITH {log} SELECT job_id, id, name FROM log WHERE id > job_id % 5 - 1",
        "q_recovered_jobs": f"WITH {snap}, r AS (SELECT *, status IN ('queued', 'running') AS requeued FROM sn) SELECT job_id, CASE WHEN requeued THEN 'queued' WHEN status = 'cancel_requested' THEN 'canceled' ELSE status END AS status, CASE WHEN status = 'cancel_requested' THEN 'canceled' END AS event, requeued, CASE WHEN requeued THEN row_number() OVER (PARTITION BY requeued ORDER BY created_at, job_id) END AS rank FROM r",
        "q_retention": f"WITH {snap} SELECT job_id, CASE WHEN status IN ('succeeded', 'failed', 'canceled', 'expired') AND finished_at < 2200 THEN 'purge' WHEN status = 'awaiting_review' AND updated_at < 2200 THEN 'expire' ELSE 'keep' END AS action FROM sn",
        "q_token_ledger": f"""WITH RECURSIVE {log}, rq AS (SELECT job_id, id * 2 AS id, 'ask' AS phase, id AS request, floor(abs(value))::BIGINT AS tokens, false AS amb FROM log UNION ALL SELECT job_id, id * 2 + 1, CASE id % 4 WHEN 2 THEN 'fail' ELSE 'done' END, id, CASE id % 4 WHEN 1 THEN 3 ELSE 0 END, id % 8 = 2 FROM log WHERE id % 4 <> 0),
nu AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY id) AS rn FROM rq),
st AS (SELECT job_id, id, rn, tokens <= 300 AS allowed, 0::BIGINT AS used, CASE WHEN tokens <= 300 THEN tokens ELSE 0 END AS reserved, CASE WHEN tokens <= 300 THEN tokens END AS held, request FROM nu WHERE rn = 1
UNION ALL SELECT n.job_id, n.id, n.rn, CASE n.phase WHEN 'ask' THEN s.used + s.reserved + n.tokens <= 300 WHEN 'done' THEN s.used + CASE WHEN n.tokens > 0 THEN n.tokens ELSE coalesce(s.held, 0) END <= 300 ELSE true END,
  s.used + CASE n.phase WHEN 'ask' THEN 0 WHEN 'done' THEN CASE WHEN n.tokens > 0 THEN n.tokens ELSE coalesce(s.held, 0) END ELSE CASE WHEN n.amb THEN coalesce(s.held, 0) ELSE 0 END END,
  CASE n.phase WHEN 'ask' THEN s.reserved + CASE WHEN s.used + s.reserved + n.tokens <= 300 THEN n.tokens ELSE 0 END ELSE s.reserved - coalesce(s.held, 0) END,
  CASE n.phase WHEN 'ask' THEN CASE WHEN s.used + s.reserved + n.tokens <= 300 THEN n.tokens END END, n.request FROM st s JOIN nu n ON n.job_id = s.job_id AND n.rn = s.rn + 1)
SELECT job_id, id, allowed, used, reserved FROM st""",
        "q_key_claims": f"WITH {log} SELECT job_id AS key, id, (['owner', 'wait', CASE WHEN true THEN 'released' END, 'owner', 'committed', 'replay'])[id] AS role, (CASE WHEN id <= 2 THEN 1 WHEN id = 3 THEN NULL ELSE 4 END)::BIGINT AS owner FROM log WHERE id <= 6",
        "q_job_transitions": pair(STATES, journal.NEXT),
        "q_span_transitions": pair(SPAN_STATES, journal.SPAN_NEXT),
        "q_cancel_outcomes": f"WITH {snap} SELECT job_id, CASE WHEN status IN ('canceled', 'cancel_requested') THEN 'unchanged' WHEN status IN ('succeeded', 'failed', 'expired', 'awaiting_review') THEN 'refused' ELSE 'cancel_requested' END AS outcome, status IN ('succeeded', 'failed', 'canceled', 'expired') AS terminal FROM sn",
        "q_attempts": f"WITH {log} SELECT job_id, count(*) FILTER (name = 'click') AS attempts FROM log GROUP BY 1",
        "q_step_log": f"WITH {log} SELECT job_id AS run_id, printf('step_%04d', id) AS step_id, id * 3 AS seq, name FROM log",
        "q_progress": "SELECT conv_id AS recording_id, round(0.3::DOUBLE + 0.4::DOUBLE * (conv_id % 3) / greatest(count(*), 1), 6) AS fraction FROM conversations GROUP BY 1",
        "q_latest_result": f"WITH {log} SELECT job_id, max(id) AS id, arg_max(data, id) AS data FROM log WHERE name = 'purchase' GROUP BY 1 HAVING starts_with(arg_max(data, id), '{{')",
    }
