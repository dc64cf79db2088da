"""Quality rules judged by host: rule failures are counted for each domain, their rates shrunk towards a prior that is
fitted to all domains, and the domains' verdicts joined back to their documents.

Every text is read once, by column expressions within its own row; what is written and grouped afterwards is a few
integers for each document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_groups, materialize

#: Words of a window; a window that a text holds twice or more is a repetition.
WINDOW = 8
SPACE, SYMBOLS = r"[\x20\x09-\x0D]+", r"[#*$%&|<>]"
#: A host is rejected where its shrunk rate of any rule's failures is above this.
MOST_FAILURES = 0.5

#: A document's failures, by rule, over its counts.
RULES: dict[str, str] = {
    "short": "n_words < 20",
    "repeated": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)",
}
BASE = ("short", "repeated")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once for the row, however often body names it."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column) -> Column:
    """Words that lie in windows found twice or more.

    Windows are compared by hash first; only texts in which hashes repeat sort them, and neighbours of equal hash count
    if their words are equal.
    """

    def window(at: Column) -> Column:
        return F.slice(words, at, F.lit(WINDOW))

    def covered(sorted_: Column) -> Column:
        def same(x: Column, k: Column) -> Column:
            y = F.get(sorted_, k)
            return F.coalesce((y["hash"] == x["hash"]) & (window(y["at"]) == window(x["at"])), F.lit(False))

        again = F.filter(sorted_, lambda x, k: same(x, k - 1) | same(x, k + 1))
        starts = F.array_sort(F.transform(again, lambda x: x["at"]))
        none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach"))
        return F.aggregate(
            starts,
            none,
            lambda got, at: F.struct((got["n"] + at + WINDOW - F.greatest(got["reach"], at.cast("long"))).alias("n"), (at + WINDOW).cast("long").alias("reach")),
            lambda got: got["n"],
        )

    def count(hashes: Column) -> Column:
        rows = F.transform(hashes, lambda h, k: F.struct(h.alias("hash"), (k + 1).alias("at")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_let(F.sort_array(rows), covered))

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda at: F.xxhash64(window(at)))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(_let(windows, count))


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source and the counts of each text: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words; null has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = _let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeated_words(w).alias("n_repeat_words"),
        ),
    )
    of_lines = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    rows = docs.select("doc_id", "source", of_words.alias("words"), of_lines.alias("lines"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"))
    return rows.select("doc_id", "source", "words.*", "lines.*", "n_symbols")


def shrunk_rates(hosts: DataFrame, rules: list[str]) -> DataFrame:
    """hosts (n_docs, and for each rule its failures) with the rule's rate_<rule>, shrunk by an empirical beta prior.

    The prior's mean is the rate over all documents.  Its weight, in documents, follows from the correlation within
    hosts, by the moments of the beta-binomial model with unequal numbers of trials: the sum of n (rate - mean)^2 over
    hosts is mean (1 - mean) times (1 - rho) (hosts - 1) + rho (N - sum of n^2 / N), and the weight is 1 / rho - 1.
    Where hosts differ no more than by chance, all get the mean.
    """
    n = F.sum("n_docs").cast("double")
    seen = hosts.agg(n.alias("n"), F.count(F.lit(1)).alias("hosts"), F.sum(F.col("n_docs").cast("double") * F.col("n_docs")).alias("nn"), *(F.sum(r).alias(f"x_{r}") for r in rules), *(F.sum(F.col(r).cast("double") * F.col(r) / F.col("n_docs")).alias(f"xx_{r}") for r in rules)).first()
    for r in rules:
        mean = seen[f"x_{r}"] / seen["n"] if seen["n"] else 0.0
        chance = mean * (1 - mean)
        room = seen["n"] - seen["nn"] / seen["n"] - (seen["hosts"] - 1) if seen["n"] else 0.0
        rho = ((seen[f"xx_{r}"] - seen["n"] * mean * mean) / chance - (seen["hosts"] - 1)) / room if chance > 0 and room > 0 else 0.0
        weight = 1 / min(1.0, rho) - 1 if rho > 1e-9 else None
        rate = F.lit(mean) if weight is None else (F.col(r) + mean * weight) / (F.col("n_docs") + weight)
        hosts = hosts.withColumn(f"rate_{r}", rate)
    return hosts


def host_verdicts(counts: DataFrame, rules: dict[str, str] | None = None, most: float = MOST_FAILURES) -> DataFrame:
    """host, n_docs, rate_<rule>, host_rejected of the hosts (column source) of text_counts; documents without one are left out."""
    rules = rules or RULES
    failures = [F.sum(F.expr(rule).cast("long")).alias(name) for name, rule in rules.items()]
    hosts = counts.where("source is not null").groupBy(F.col("source").alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), *failures)
    rated = shrunk_rates(materialize(hosts, "hosts"), list(rules))
    return rated.withColumn("host_rejected", F.greatest(F.lit(0.0), *(F.col(f"rate_{r}") for r in rules)) > most)


def host_rules(docs: DataFrame, rules: dict[str, str] | None = None, most: float = MOST_FAILURES) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host_rejected.

    docs: doc_id, text, source (the host) and any other columns, which are not read; rows that repeat count each.  A
    document is kept if neither it fails a base rule nor its host is rejected.  Null and empty texts have no words and
    fail; documents without a source are judged by themselves alone; an empty source is a host like any other.  Texts
    may be of any length: all counts take time linear in the text, but for a sort where windows repeat.  An empty table
    gives an empty result.
    """
    counts = materialize(text_counts(docs), "counts")
    verdicts = host_verdicts(counts, rules, most).select(F.col("host").alias("source"), "n_docs", "host_rejected")
    judged = join_groups(counts.where("source is not null"), verdicts, "source", "n_docs", counts.count()).drop("n_docs")
    whole = judged.unionByName(counts.where("source is null").withColumn("host_rejected", F.lit(False)))
    failed = F.expr(" or ".join(f"({RULES[r]})" for r in BASE))
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return whole.select("doc_id", *longs, failed.alias("base_failed"), (~failed & ~F.col("host_rejected")).alias("kept"), "host_rejected")


def drop_failed(docs: DataFrame, rules: dict[str, str] | None = None, most: float = MOST_FAILURES) -> DataFrame:
    """The rows of docs that host_rules keeps, with their columns."""
    from .common import row_key, without

    keyed = docs.select(row_key(docs).alias("doc_id"), "text", "source")
    gone = host_rules(keyed, rules, most).where("not kept").select(F.col("doc_id").alias("__key")).distinct()
    return without(docs, materialize(gone, "failed"))
