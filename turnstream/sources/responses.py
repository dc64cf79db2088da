"""Answers of model services as relations: word annotations, texts, tool calls, decisions, failures and their costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_fences, trimmed
from .payloads import transcript_segments

_WORD = "struct<type:string,text:string,speaker:string,start_offset:string,end_offset:string,start_index:int,end_index:int>"
_CONTENT = f"struct<type:string,text:string,annotations:array<{_WORD}>>"
STEPS = f"array<struct<type:string,id:string,name:string,arguments:string,content:array<{_CONTENT}>>>"
_RESPONSE = f"status string, steps {STEPS}, errors array<struct<code:string,message:string>>"

# fixed values: HTTP codes that are worth a retry, those after which tokens may have been spent, and words of errors of networks
TRANSIENT = (408, 425, 429, 500, 502, 503, 504)
MAY_HAVE_SPENT = (408, 425, 500, 502, 504)
RESET_WORDS = ("connection reset", "broken pipe", "forcibly closed by the remote host", "established connection was aborted")
REFUSED_WORDS = ("connection refused", "actively refused")


def milliseconds(offset: Column) -> Column:
    """Whole milliseconds of a duration such as 0.850s, 12ms or 1m2.5s, cut, not rounded; negative ones keep their sign; null if unreadable."""
    shape = r"^-?(?:[0-9]{1,6}h)?(?:[0-9]{1,8}m(?!s))?(?:[0-9]{1,9}(?:\.[0-9]{0,9})?s)?(?:[0-9]{1,9}(?:\.[0-9]{0,9})?ms)?\z"
    part = lambda unit, k: F.coalesce(F.regexp_extract(offset, rf"([0-9]+(?:\.[0-9]*)?){unit}", 1).try_cast("decimal(20,9)"), F.lit(0).cast("decimal(20,9)")) * k
    total = part("h", 3_600_000) + part("m(?!s)", 60_000) + part(r"(?<!m)s", 1000) + part("ms", 1)
    # the common shape of services, seconds alone, needs one reading of the text
    plain = F.regexp_extract(offset, r"^([0-9]{1,9}(?:\.[0-9]{0,9})?)s\z", 1)
    sign = F.when(F.startswith(offset, F.lit("-")), -1).otherwise(1)
    sized = F.when(offset.rlike(shape) & offset.rlike("[hms]") & ~offset.rlike("^-?$"), F.floor(total).cast("long") * sign)
    return F.when(plain != "", F.floor(plain.try_cast("decimal(20,9)") * 1000).cast("long")).otherwise(sized)


def word_units(responses: DataFrame) -> DataFrame:
    """Units of the word annotations of responses (recording_id, chunk_idx, offset_ms, payload).

    Returns recording_id, chunk_idx, unit_idx, text, speaker, start_ms, end_ms, repaired, error.  A word without text
    takes the bytes of its content that it names.  A start that is missing, unreadable or negative becomes the end of the
    word before; an end that is missing, unreadable or before the start becomes the start; repaired counts such words of
    the response.  An impossible byte range, and no usable start at all, are errors: one row each.  Units are
    numbered by start, equal ones as they come.

    A run of words without a start begins at the greatest end since the last good one, so no fold is needed.
    """
    keys = ["recording_id", "chunk_idx"]
    steps = F.from_json("payload", f"steps {STEPS}")["steps"]
    rows = responses.select(*keys, F.coalesce("offset_ms", F.lit(0)).cast("long").alias("offset_ms"), F.posexplode_outer(steps).alias("i", "step"))
    # what holds no words stays as a row without one, so that every response is read once and has a row
    rows = rows.select(*keys, "offset_ms", "i", F.posexplode_outer(F.when(F.col("step.type") == "model_output", F.col("step.content"))).alias("j", "content"))
    rows = rows.select(*keys, "offset_ms", "i", "j", F.col("content.text").alias("whole"), F.posexplode_outer(F.when(F.col("content.type") == "text", F.col("content.annotations"))).alias("k", "w"))
    a, b = F.col("w.start_index"), F.col("w.end_index")
    word = F.coalesce(F.col("w.type") == "word_info", F.lit(False))
    own = trimmed(F.coalesce("w.text", F.lit("")))
    ranged = (own == "") & (a.isNotNull() | b.isNotNull())
    size = F.octet_length(F.coalesce("whole", F.lit("")))
    bad_range = ranged & ~F.coalesce((a >= 0) & (b >= a) & (b <= size), F.lit(False))
    piece = F.substr(F.col("whole").cast("binary"), F.when(bad_range, 1).otherwise(F.coalesce(a, F.lit(0)) + 1), F.when(bad_range, 0).otherwise(F.coalesce(b - a, F.lit(0))))
    split = ranged & ~bad_range & ~F.is_valid_utf8(piece.cast("string"))
    wrong = F.when(word, F.when(bad_range, "invalid word byte range").when(split, "word byte range splits UTF-8 text"))
    said = F.when(word, F.when(ranged & ~bad_range & ~split, trimmed(piece.cast("string"))).otherwise(own)).otherwise("")
    rows = rows.select(*keys, "offset_ms", "i", "j", "k", said.alias("text"), wrong.alias("wrong"), F.coalesce("w.speaker", F.lit("")).alias("speaker"), F.when(word, milliseconds(F.col("w.start_offset"))).alias("a"), F.when(word, milliseconds(F.col("w.end_offset"))).alias("b"))
    # words take more room than the payloads they come from: they are spread anew, and all windows then find them in place
    rows = rows.withColumn("spoken", F.col("text") != "").withColumn("good", F.col("spoken") & F.coalesce(F.col("a") >= 0, F.lit(False))).repartition(*keys)
    each = Window.partitionBy(*keys)
    order = each.orderBy("i", "j", "k")
    rows = rows.withColumns({"run": F.sum(F.col("good").cast("int")).over(order), "nth": F.row_number().over(order)})
    in_run = Window.partitionBy(*keys, "run").orderBy("i", "j", "k")
    since = F.max(F.when(F.col("spoken"), F.greatest("b", F.when(F.col("good"), F.col("a"))))).over(in_run.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("start", F.when(F.col("good"), F.col("a")).otherwise(F.greatest(F.coalesce(since, F.lit(0)), F.lit(0))))
    fixed = F.col("spoken") & (~F.col("good") | F.coalesce(F.col("b") < F.col("start"), F.lit(True)))
    rank = F.row_number().over(each.orderBy(F.desc("spoken"), "start", "i", "j", "k")) - 1
    first_wrong = F.min(F.when(F.col("wrong").isNotNull(), F.struct("i", "j", "k", "wrong"))).over(each)["wrong"]
    rows = rows.withColumns({"unit_idx": rank.cast("long"), "repaired": F.count_if(fixed).over(each), "error": F.coalesce(first_wrong, F.when(~F.bool_or("good").over(each), "no word annotations"))})
    bad = F.col("error").isNotNull()
    kept = rows.where((bad & (F.col("nth") == 1)) | (~bad & F.col("spoken")))
    of = lambda c, name: F.when(~bad, c).alias(name)
    return kept.select(*keys, of(F.col("unit_idx"), "unit_idx"), of(F.col("text"), "text"), of(F.col("speaker"), "speaker"), of(F.col("offset_ms") + F.col("start"), "start_ms"), of(F.col("offset_ms") + F.greatest("start", F.coalesce("b", "start")), "end_ms"), of(F.col("repaired"), "repaired"), "error")


#: fixed values: what stands before a text that came without times, and who says it
UNTIMED, UNTRANSCRIBED = "[word timestamps unavailable] ", "Untranscribed"


def timed_units(responses: DataFrame) -> DataFrame:
    """word_units, with turn and untimed: a response that has text but no word annotations is one untimed unit at its offset instead of an error."""
    keys = ["recording_id", "chunk_idx"]
    units = word_units(responses)
    steps = F.coalesce(F.from_json("payload", f"steps {STEPS}")["steps"], F.array().cast(STEPS))
    texts = responses.select(F.col("recording_id").alias("of"), F.col("chunk_idx").alias("at"), F.coalesce("offset_ms", F.lit(0)).cast("long").alias("offset"), trimmed(response_text(steps)).alias("said")).where("said != ''")
    # the text belongs to rows of errors alone
    rows = units.join(texts, (F.col("recording_id") == F.col("of")) & (F.col("chunk_idx") == F.col("at")) & (F.col("error") == "no word annotations"), "left")
    bare = F.col("said").isNotNull()
    of = lambda c, name: F.when(bare, c).otherwise(F.col(name)).alias(name)
    return rows.select(
        *keys, of(F.lit(0).cast("long"), "unit_idx"), of(F.concat(F.lit(UNTIMED), "said"), "text"), of(F.lit(UNTRANSCRIBED), "speaker"), of(F.col("offset"), "start_ms"), of(F.col("offset"), "end_ms"), of(F.lit(0).cast("long"), "repaired"),
        F.when(~bare, F.col("error")).alias("error"), bare.alias("turn"), bare.alias("untimed"),
    )


def dispatched_segments(responses: DataFrame, direct: Column) -> DataFrame:
    """recording_id, chunk_idx, seg_idx, timestamp, speaker, text, error: the segments of answers by the kind of their model.

    responses: recording_id, chunk_idx, offset_ms, payload.  direct (a condition on a row): a speech model, whose words
    are labelled by first appearance and grouped; else a general one, whose answer holds segments with times from the
    chunk's start, which move to the recording's.  Each answer is a request of its own.
    """
    from ..functions.timecode import shift_timestamp
    from ..operators.folds import one_request_segments

    key = F.struct("recording_id", "chunk_idx")
    keyed = responses.withColumn("request", F.to_json(key))
    names = keyed.select("request", "recording_id", "chunk_idx", (F.coalesce("offset_ms", F.lit(0)) / 1000).alias("shift"))
    speech = timed_units(keyed.where(direct).select("recording_id", "chunk_idx", "offset_ms", "payload")).withColumn("request", F.to_json(key))
    grouped = one_request_segments(speech.where("error is null").select(F.col("request").alias("recording_id"), "unit_idx", "text", "speaker", "start_ms", "end_ms", "turn", "untimed")).withColumnRenamed("recording_id", "request")
    general = transcript_segments(keyed.where(~direct).select(F.col("request").alias("recording_id"), "payload")).withColumnRenamed("recording_id", "request")
    general = general.join(names.select("request", "shift"), "request").withColumn("timestamp", shift_timestamp(F.col("timestamp"), F.col("shift")))
    none = F.lit(None).cast("string").alias("error")
    failed = speech.where("error is not null").select("request", F.lit(None).cast("long").alias("seg_idx"), F.lit(None).cast("string").alias("timestamp"), F.lit(None).cast("string").alias("speaker"), F.lit(None).cast("string").alias("text"), "error")
    every = grouped.select("request", "seg_idx", "timestamp", "speaker", "text", none).unionByName(general.select("request", "seg_idx", "timestamp", "speaker", "text", "error")).unionByName(failed)
    return every.join(names.drop("shift"), "request").select("recording_id", "chunk_idx", "seg_idx", "timestamp", "speaker", "text", "error")


def alignment_errors(source: DataFrame, aligned: DataFrame) -> DataFrame:
    """recording_id, error of an aligner's answer: as many segments, and only timestamps may differ."""
    keys = ["recording_id", "seg_idx"]
    of = lambda d, n: d.select(*keys, F.struct("text", "speaker", "confidence").alias(n))
    rows = of(source, "x").join(of(aligned, "y"), keys, "full").withColumn("lost", F.col("x").isNull() | F.col("y").isNull())
    changed = F.min(F.when(~F.col("lost") & ~F.col("x").eqNullSafe(F.col("y")), F.col("seg_idx")))
    found = rows.groupBy("recording_id").agg(F.bool_or("lost").alias("lost"), changed.alias("changed"))
    return found.select("recording_id", F.when(F.col("lost"), "segment count differs").when(F.col("changed").isNotNull(), F.format_string("segment %d changed", "changed")).alias("error"))


def response_text(steps: Column) -> Column:
    """The text that a response ends with: its last texts without anything between them, else its last model output with text."""
    parts = F.flatten(F.transform(steps, lambda s: F.when((s["type"] == "model_output") & (F.size(F.coalesce(s["content"], F.array().cast(f"array<{_CONTENT}>"))) > 0), F.transform(s["content"], lambda c: F.when(c["type"] == "text", F.coalesce(c["text"], F.lit(""))))).otherwise(F.array(F.lit(None).cast("string")))))
    # what follows the last part that is no text
    run = F.aggregate(parts, F.lit(""), lambda acc, p: F.when(p.isNull(), "").otherwise(F.concat(acc, p)))
    outputs = F.transform(F.filter(steps, lambda s: s["type"] == "model_output"), lambda s: F.array_join(F.transform(F.filter(s["content"], lambda c: c["type"] == "text"), lambda c: F.coalesce(c["text"], F.lit(""))), ""))
    full = F.filter(outputs, lambda t: t != "")
    return F.when(run != "", run).otherwise(F.coalesce(F.try_element_at(full, F.lit(-1)), F.lit("")))


def answers(responses: DataFrame) -> DataFrame:
    """recording_id, text, n_calls, error of responses (recording_id, payload): their text, tool calls and whether their status fits."""
    d = F.from_json("payload", _RESPONSE)
    rows = responses.select("recording_id", d["status"].alias("status"), F.coalesce(d["steps"], F.array().cast(STEPS)).alias("steps"), d["errors"].alias("errors"))
    calls = F.size(function_calls(F.col("steps")))
    said = F.array_join(F.filter(F.transform(F.coalesce("errors", F.array().cast("array<struct<code:string,message:string>>")), lambda e: F.trim(F.concat_ws(" ", e["code"], e["message"]))), lambda x: x != ""), "; ")
    status = F.coalesce("status", F.lit(""))
    ended = F.concat(F.lit("interaction ended with status "), status, F.when(said != "", F.concat(F.lit(": "), said)).otherwise(""))
    error = (
        F.when(status == "completed", F.when(calls > 0, "completed interaction unexpectedly returned function calls"))
        .when(status.isin("failed", "cancelled", "incomplete", "budget_exceeded"), ended)
        .when(status.isin("queued", "in_progress"), F.concat(F.lit("synchronous interaction unexpectedly remained "), status))
        .when(status == "requires_action", F.when(calls == 0, "interaction requires action but returned no function calls"))
        .otherwise(F.concat(F.lit("interaction returned unknown status "), status))
    )
    return rows.select("recording_id", response_text(F.col("steps")).alias("text"), calls.cast("long").alias("n_calls"), error.alias("error"))


def function_calls(steps: Column) -> Column:
    """id, name and arguments of the tool calls of a response, in order."""
    return F.transform(F.filter(steps, lambda s: s["type"] == "function_call"), lambda s: F.struct(s["id"].alias("id"), s["name"].alias("name"), s["arguments"].alias("arguments")))


def decisions(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(header, segments) of judges' answers (recording_id, payload): selected ids and notes, and the segments as of transcript payloads."""
    raw = strip_fences(F.col("payload"))
    d = F.from_json(raw, "selected_candidate_ids array<string>, processing_notes array<string>, segments array<struct<timestamp:string,speaker:string,text:string,confidence:double>>")
    header = payloads.select("recording_id", d.alias("d"), raw.alias("raw")).select("recording_id", F.col("d.selected_candidate_ids").alias("selected"), F.col("d.processing_notes").alias("notes"), F.when(F.col("raw") == "", "empty judge output").when(F.col("d.segments").isNull(), "unreadable").alias("error"))
    return header, transcript_segments(payloads)


def reserved_tokens(body: Column, estimated: Column, most_output: Column) -> Column:
    """Tokens set aside for a request: its bytes, the input that is estimated and the output that is allowed."""
    return F.octet_length(body) + F.greatest(F.coalesce(estimated, F.lit(0)), F.lit(0)) + F.greatest(F.coalesce(most_output, F.lit(0)), F.lit(0))


def request_error(model: Column, has_input: Column, tier: Column, store: Column, previous: Column, background: Column) -> Column:
    """Why a request is not valid, or null."""
    off = F.coalesce(~store, F.lit(False))
    return (
        F.when(F.coalesce(trimmed(model) == "", F.lit(True)), "interaction model is required").when(~has_input, "interaction input is required")
        .when(~F.coalesce(tier, F.lit("")).isin("", "standard", "flex", "priority"), F.concat(F.lit("unsupported interaction service_tier "), tier))
        .when(off & (F.coalesce(previous, F.lit("")) != ""), "store=false cannot be combined with previous_interaction_id").when(off & F.coalesce(background, F.lit(False)), "store=false cannot be combined with background=true")
    )


def _says(message: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    found = F.lit(False)
    for w in words:
        found = found | F.contains(low, F.lit(w))
    return found


def retryable(code: Column, message: Column) -> Column:
    """Whether a failed call is worth another try: by its HTTP code, or without one by what the network said."""
    return F.when(code.isNotNull(), code.isin(*TRANSIENT)).otherwise(_says(message, (*RESET_WORDS, *REFUSED_WORDS, "no such host", "timeout", "unexpected eof", "eof")))


def may_have_spent(code: Column, message: Column) -> Column:
    """Whether a failed call may have been answered, so that its tokens stay charged."""
    return F.when(code.isNotNull(), code.isin(*MAY_HAVE_SPENT)).otherwise(~_says(message, (*REFUSED_WORDS, "no such host")))


def retry_after(header: Column, now: Column) -> Column:
    """Seconds to wait by a Retry-After header: a number, or a date after now; else 0."""
    number = F.when(header.rlike(r"^[0-9]{1,9}\z"), header.try_cast("long"))
    at = F.try_to_timestamp(F.regexp_extract(header, r"^[A-Za-z]{3}, (.*) GMT\z", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.coalesce(number, F.greatest(F.unix_seconds(at) - now, F.lit(0)), F.lit(0))


def output_cap(configured: Column, limit: Column, least: Column) -> Column:
    """Tokens that a request may return: its limit, or what its model needs if that is more, and never more than configured."""
    return F.least(configured, F.greatest(limit, least))
