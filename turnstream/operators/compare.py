"""Comparison of alternative transcripts by bag overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise


def candidates(seg: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two transcripts: all segments, and those whose recording and index do not add up to a multiple of 7."""
    return seg, seg.where((F.col("recording_id") + F.col("seg_idx")) % 7 != 0)


def candidate_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Shared normalised texts (as bags), and their share of the larger bag."""
    def bag(df, n):
        return df.select("recording_id", normalise(F.col("text")).alias("x")).where("x != ''").groupBy("recording_id", "x").agg(F.count(F.lit(1)).alias(n))

    j = bag(a, "na").join(bag(b, "nb"), ["recording_id", "x"], "full").na.fill(0, ["na", "nb"])
    g = j.groupBy("recording_id").agg(F.sum(F.least("na", "nb")).alias("shared"), F.sum("na").alias("n_a"), F.sum("nb").alias("n_b"))
    return g.select("*", F.round(F.col("shared") / F.greatest("n_a", "n_b"), 6).alias("ratio"))


def word_similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Multiset Jaccard of the ASCII words of two transcripts."""
    def bag(df, n):
        low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        return df.select("recording_id", F.explode(F.split(F.regexp_replace(low, "[^a-z0-9 ]", " "), " +")).alias("w")).where("w != ''").groupBy("recording_id", "w").agg(F.count(F.lit(1)).alias(n))

    j = bag(a, "na").join(bag(b, "nb"), ["recording_id", "w"], "full").na.fill(0, ["na", "nb"])
    g = j.groupBy("recording_id").agg(F.sum(F.least("na", "nb")).alias("shared"), (F.sum("na") + F.sum("nb")).alias("total"))
    return g.select("recording_id", F.round(F.col("shared") / (F.col("total") - F.col("shared")), 6).alias("similarity"))


def candidate_report(a: DataFrame, b: DataFrame) -> DataFrame:
    """candidate_diff with each side's number of speakers and estimated duration."""
    from . import quality

    def side(df, n):
        who = df.groupBy("recording_id").agg(F.count_distinct("speaker").alias(f"speakers_{n}"))
        return who.join(quality.duration_estimate(df).withColumnRenamed("seconds", f"seconds_{n}"), "recording_id", "left")

    return candidate_diff(a, b).join(side(a, "a"), "recording_id", "left").join(side(b, "b"), "recording_id", "left")
