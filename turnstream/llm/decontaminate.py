"""Benchmark decontamination as a prefix-filtered containment join.

A window is ITEM_WORDS consecutive words of an item (a shorter item is one window).  Texts and windows are sets of
shingles of SHINGLE words, ordered by their rarity in the corpus.  A text that contains a window holds all its
shingles, so the necessary prefix of a window is its rarest one.  That shingle's occurrences fetch the window; the
bounds on length and position and the exact comparison of the words in place decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SEPARATORS, lower_ascii, materialize, row_key, without

ITEM_WORDS = 10
#: Words of a shingle; a window of fewer words is one shingle.
SHINGLE = 2
#: Most window rows that are broadcast; a larger benchmark is joined by shuffle.
BROADCAST_WINDOWS = 200_000


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def item_windows(benchmark: DataFrame, size: int = ITEM_WORDS) -> DataFrame:
    """One row per different window: words, item_ids (strings)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where("size(w) > 0")
    last = F.greatest(F.size("w") - size + 1, F.lit(1))
    return (
        items.select("item", "w", F.explode(F.sequence(F.lit(1), last)).alias("at"))
        .select("item", F.slice("w", F.col("at"), F.lit(size)).alias("words"))
        .groupBy("words")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )


def shingles(w: Column, single: bool = False) -> Column:
    """The shingles of an array of words by place; with single, the words alone after them."""
    n = F.size(w)
    pairs = F.zip_with(F.slice(w, 1, F.greatest(n - 1, F.lit(0))), F.slice(w, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(pairs, w) if single else pairs


def contained(docs: DataFrame, benchmark: DataFrame, size: int = ITEM_WORDS) -> DataFrame:
    """(tokenised documents, hits): hits has doc (see row_key), start (from 1), stop, items of every occurrence of a window."""
    tokens = materialize(docs.select("doc_id", row_key(docs).alias("doc"), words(F.col("text")).alias("w")).withColumn("n_words", F.size("w").cast("long")), "words")
    windows = materialize(item_windows(benchmark, size), "windows")
    small = F.broadcast if windows.count() <= BROADCAST_WINDOWS else lambda x: x
    single = not windows.where("size(words) = 1").isEmpty()

    own = F.when(F.size("words") == 1, F.col("words")).otherwise(shingles(F.col("words")))
    vocabulary = windows.select(F.explode(own).alias("shingle")).distinct()
    texts = shingles(F.col("w"), single)
    counts = tokens.select(F.explode(texts).alias("shingle")).join(small(vocabulary), "shingle").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    # a window with a shingle that no document holds occurs nowhere: the inner join and the size drop it
    ranked = (
        windows.select(F.posexplode(own).alias("offset", "shingle"), "words", "items")
        .join(small(counts), "shingle")
        .groupBy("words", "items")
        .agg(F.min_by(F.struct("shingle", "offset"), F.struct("n", "shingle", "offset")).alias("rare"), F.count(F.lit(1)).alias("found"))
        .where(F.col("found") == F.greatest(F.size("words") - 1, F.lit(1)))
    )
    index = materialize(ranked.select(F.col("rare.shingle").alias("shingle"), F.col("rare.offset").alias("offset"), "words", "items", F.size("words").alias("length")), "index")
    # a word alone stands behind the n - 1 shingles
    place = F.when(F.col("at") >= F.greatest(F.col("n_words") - 1, F.lit(0)), F.col("at") - F.greatest(F.col("n_words") - 1, F.lit(0))).otherwise(F.col("at")) if single else F.col("at")
    start = F.col("pos") - F.col("offset") + 1
    bounds = (F.col("n_words") >= F.col("length")) & (start >= 1) & (start + F.col("length") - 1 <= F.col("n_words"))
    same = F.slice("w", start, F.col("length")) == F.col("words")
    large = windows.count() > BROADCAST_WINDOWS
    found = tokens.select("doc", "n_words", *([] if large else ["w"]), F.posexplode(texts).alias("at", "shingle")).withColumn("pos", place).join(small(index), "shingle").where(bounds)
    if large:
        # words are not shuffled with every shingle, but fetched once for each document that has a candidate
        found = materialize(found.select("doc", "pos", "offset", "length", "words", "items"), "candidates")
        some = tokens.select("doc", "w").join(found.select("doc").distinct(), "doc", "left_semi").dropDuplicates(["doc"])
        found = found.join(some, "doc")
    hits = found.where(same).select("doc", start.alias("start"), (start + F.col("length") - 1).alias("stop"), "items")
    return tokens, hits


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = ITEM_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored.  Null and empty texts have no
    words and no hits; items without words have no windows.  Repeated rows get equal results.  Either table
    may be empty.
    """
    tokens, hits = contained(docs, benchmark, size)
    hits = materialize(hits, "hits")
    before = Window.partitionBy("doc").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.groupBy("doc", "start").agg(F.max("stop").alias("stop")).withColumn("reached", F.coalesce(F.max("stop").over(before), F.lit(0)))
    covered = spans.groupBy("doc").agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("reached", F.col("start") - 1))).alias("n_hit"))
    found = hits.select("doc", F.explode("items").alias("item")).groupBy("doc").agg(F.array_sort(F.collect_set("item")).alias("items"))
    both = covered.join(found, "doc")
    return tokens.select("doc_id", "doc", "n_words").join(both, "doc", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no window of the benchmark, with their columns."""
    _, hits = contained(docs, benchmark)
    return without(docs, materialize(hits.select(F.col("doc").alias("__key")).distinct(), "contaminated"))
