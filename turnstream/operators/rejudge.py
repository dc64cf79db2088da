"""A bounded second pass: spans that a review of the whole run names go through judging again, all others stay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spans import judged, span_errors, span_id

_KEYS = ["recording_id", "span_idx"]
_REJECTED, _NONE_VALID = "fallback_out_of_span_judge_output", "degraded_no_valid_candidate"


def asked_spans(reviews: DataFrame, spans: DataFrame, most: int) -> DataFrame:
    """recording_id, pos, id, span_idx (null: unknown), fits: the spans that reviews want judged again; of the known ones of a recording the first `most` fit."""
    ids = reviews.where("verdict = 'rejudge'").select("recording_id", F.posexplode("span_ids").alias("pos", "id"))
    rows = ids.join(spans.select(*_KEYS, span_id(F.col("span_idx")).alias("id")), ["recording_id", "id"], "left")
    known = F.col("span_idx").isNotNull()
    return rows.withColumn("fits", known & (F.sum(known.cast("int")).over(Window.partitionBy("recording_id").orderBy("pos")) <= most))


def rejudged(first: DataFrame, reviews: DataFrame, decisions: DataFrame, decided: DataFrame, candidates: DataFrame, scores: DataFrame, spans: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(spans, reviews) after the second pass.

    first: the outcome of judged.  reviews: recording_id, verdict, span_ids, reasons (arrays).  decisions, decided:
    what the judge says the second time, as for judged; candidates, scores and spans are those of the first pass.
    The named spans alone are read again, by semi-join; all others pass by, and the two are united once.  A span
    whose new segments lie outside it, or that has no valid candidate, keeps its first outcome; that, an unknown id
    and one beyond the budget stay unresolved, and the run then needs a person.
    spans: as first, with rejudges (0 or 1).  reviews: recording_id, verdict, method, reasons.
    """
    asked = asked_spans(reviews, spans, most)
    named = asked.where("fits").select(*_KEYS).distinct()
    of_named = lambda df: df.join(named, _KEYS, "left_semi")
    second = judged(of_named(decisions), of_named(decided), of_named(candidates), of_named(scores), of_named(spans))
    stands = second.where(~F.col("method").isin(_REJECTED, _NONE_VALID))
    final = first.join(stands.select(*_KEYS), _KEYS, "left_anti").withColumn("rejudges", F.lit(0).cast("long")).unionByName(stands.withColumn("rejudges", F.lit(1).cast("long")))

    errors = span_errors(of_named(decided).withColumn("candidate_id", F.lit("judge")), of_named(spans)).select(*_KEYS, "error")
    seen = asked.join(second.select(*_KEYS, "method"), _KEYS, "left").join(errors, _KEYS, "left")
    # fixed values: the reasons
    reason = (
        F.when(F.col("span_idx").isNull(), F.concat("id", F.lit(" is not a known span")))
        .when(~F.col("fits"), F.concat(F.lit("Global reviewer requested "), "id", F.lit(" but the rejudge budget was exhausted.")))
        .when(F.col("method") == _NONE_VALID, F.concat("id", F.lit(" has no valid candidates for the requested rejudge.")))
        .when(F.col("method") == _REJECTED, F.concat("id", F.lit(" rejudge rejected: "), "error"))
    )
    open_ = seen.withColumn("reason", reason).where("reason is not null").groupBy("recording_id", "reason").agg(F.min("pos").alias("pos"))
    open_ = open_.groupBy("recording_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "reason"))), lambda x: x["reason"]).alias("open"))
    rows = reviews.join(open_, "recording_id", "left")
    none = F.array().cast("array<string>")
    unresolved = F.col("open").isNotNull()
    verdicts = rows.select(
        "recording_id", F.when(unresolved, "review_required").otherwise(F.col("verdict")).alias("verdict"), F.when(unresolved, "model_with_unresolved_rejudge").otherwise("model").alias("method"),
        F.array_distinct(F.concat(F.coalesce("reasons", none), F.coalesce("open", none))).alias("reasons"),
    )
    return final, verdicts
