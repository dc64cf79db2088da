"""Exact deduplication with a heavy-hitter split.

A Misra-Gries summary (the engine's frequent-items sketch, merged in two levels) names every digest that
may hold more than one in 4,096 rows.  Their exact counts are taken, and the winners - at most 4,096 rows by
counting alone - are broadcast, so that the rows of large groups are settled where they are read.
All other digests are grouped and joined by an ordinary shuffle, in which no group is large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialize, row_key, without

#: A digest is heavy if it holds more than one in SHARE rows; so at most SHARE digests are.
SHARE = 4096
#: Counters of a summary: its error is then under a third of the threshold.
COUNTERS = 4 * SHARE
#: Summaries merged by one task of the first level.
FAN_IN = 64


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, __key (see row_key), digest: SHA-256 of the text with A-Z lower-cased; a null text counts as empty."""
    text = lower_ascii(F.coalesce(F.col("text"), F.lit("")))
    return docs.select("doc_id", row_key(docs).alias("__key"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))


def heavy_digests(rows: DataFrame) -> DataFrame:
    """digest, keep_id, group_size of the digests that hold more than one in SHARE rows, verified by exact counts."""
    short = F.xxhash64("digest")
    parts = (
        rows.groupBy((F.spark_partition_id() % FAN_IN).alias("part"))
        .agg(F.expr(f"approx_top_k_accumulate(xxhash64(digest), {COUNTERS})").alias("summary"), F.count(F.lit(1)).alias("n"))
    )
    # grouped by a constant, as the sketch's merge fails on the empty buffers of tasks without rows
    merged = parts.groupBy(F.lit("all")).agg(
        F.expr(f"approx_top_k_estimate(approx_top_k_combine(summary, {COUNTERS}), {COUNTERS})").alias("top"), F.sum("n").alias("n")
    )
    frequent = merged.select(F.explode("top").alias("x"), "n").where(F.col("x.count") * SHARE > F.col("n")).select(F.col("x.item").alias("short"), "n")
    return (
        rows.withColumn("short", short)
        .join(F.broadcast(frequent), "short")
        .groupBy("digest")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.first("n").alias("n"))
        .where(F.col("group_size") * SHARE > F.col("n"))
        .drop("n")
    )


def exact_dedup(docs: DataFrame, keys: bool = False) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    docs: doc_id, text and any other columns.  Texts are equal if identical after lower-casing A-Z; of equal
    texts the row with the largest doc_id stays (null ids lose to any other; a group of null ids only keeps its
    rows).  Null and empty texts form one group.  Rows that repeat a doc_id and its text all stay or all go.
    An empty table gives an empty result.
    """
    rows = materialize(digests(docs), "digests")
    heavy = F.broadcast(materialize(heavy_digests(rows), "heavy"))
    hot = rows.join(heavy, "digest")
    cold = rows.join(heavy.select("digest"), "digest", "left_anti")
    groups = cold.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return hot.unionByName(cold.join(groups, "digest")).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        *(["__key"] if keys else []),
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with their columns; of rows that repeat a doc_id and its text, one."""
    found = materialize(exact_dedup(docs, keys=True).select("__key", "kept"), "exact")
    gone = found.where("not kept").select("__key").distinct()
    return without(docs, gone, found.where("kept").groupBy("__key").count().where("count > 1").select("__key"))
