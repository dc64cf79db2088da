"""URL rules indexed by their rarest literal token.

Each rule is a regular expression over host and path, with the literal tokens that any URL it matches must
hold.  The tokens' frequencies are counted over all URLs; a rule is filed under its rarest token.  A URL's
tokens fetch its candidate rules, and only those run their expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rules whose index is broadcast; a larger list is joined by shuffle.
BROADCAST_RULES = 50_000


@dataclass(frozen=True)
class Rule:
    """name: what results carry; regex: over host and path; tokens: runs of [a-z0-9] that every match holds whole."""

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    listed: bool
    length: int


def host_rule(verdict: str, spec: str) -> Rule:
    """A rule such as `example.net/en/`: the host and its subdomains, and paths that start so."""
    host, _, path = spec.partition("/")
    tokens = set(re.findall("[a-z0-9]+", host)) | set(re.findall("(?<=/)[a-z0-9]+(?=/)", f"/{path}"))
    return Rule(spec, verdict, r"^(?:[^/]*\.)?" + re.escape(spec), tuple(sorted(tokens)), True, len(spec))


def pattern_rule(verdict: str, words: str) -> Rule:
    """A rule such as `ads-track`: these words, joined so, whole labels or segments of the host or path."""
    tokens = tuple(sorted(set(re.findall("[a-z0-9]+", words))))
    return Rule(words, verdict, rf"(?i)(?:^|[^a-z0-9]){re.escape(words)}(?:[^a-z0-9]|$)", tokens, False, len(words))


#: The rules that a result names.
LISTED = (host_rule("block", "net/"), host_rule("allow", "example.net/en/"), host_rule("block", "example.com/de/"), host_rule("allow", "org/fr/"))
#: Patterns of advertising and spam hosts, for URLs that no listed rule fits.
PATTERNS = tuple(pattern_rule("block", w) for w in ("ads-track", "spam-farm", "ad-server", "click-track", "link-farm", "doubleclick", "popunder"))


def split_url(pages: DataFrame) -> DataFrame:
    """pages with host and path: both empty for a null url or one without `://`."""
    tail = F.expr("substring(url, instr(url, '://') + 3)")
    inside = lambda pattern, group: F.when(F.instr("url", "://") > 0, F.regexp_extract(tail, pattern, group)).otherwise("")
    host = F.translate(inside("^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumns({"host": host, "path": inside("^[^/?#]*([^?#]*)", 1)})


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = LISTED + PATTERNS, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict, pattern for every row of pages.

    pages: page_id, url and any other columns.  Of the listed rules that fit, the longest decides and is named
    in `rule`; else the longest fitting pattern decides and is named in `pattern`; else the default holds.
    Null and malformed urls have empty host and path and the default.  Repeated rows are judged alike.
    """
    spark = pages.sparkSession
    split = split_url(pages.select("page_id", "url")).select("page_id", "host", "path")
    urls = split.select("host", "path").distinct().withColumn("hp", F.concat("host", "path"))
    tokens = F.explode(F.array_distinct(F.filter(F.split(F.lower("hp"), "[^a-z0-9]+"), lambda t: t != ""))).alias("token")
    if not rules:
        return split.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"), F.lit(None).cast("string").alias("pattern"))
    table = spark.createDataFrame(
        [(i, r.name, r.verdict, r.regex, list(r.tokens), r.listed, r.length) for i, r in enumerate(rules)],
        "id int, name string, outcome string, regex string, tokens array<string>, listed boolean, length int",
    )
    small = F.broadcast if len(rules) <= BROADCAST_RULES else lambda x: x
    by_token = table.select("id", F.explode("tokens").alias("token"))
    seen = urls.select(tokens).join(small(by_token.select("token").distinct()), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = by_token.join(small(seen), "token", "left").groupBy("id").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    index = table.drop("tokens").join(small(rarest), "id")
    best = (
        urls.select("host", "path", "hp", tokens)
        .join(small(index), "token")
        .where(F.expr("hp rlike regex"))
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("name", "outcome", "listed"), F.struct("listed", "length", "name")).alias("hit"))
    )
    named = F.when(F.col("hit.listed"), F.col("hit.name"))
    other = F.when(~F.col("hit.listed"), F.col("hit.name"))
    return split.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", named.alias("rule"), F.coalesce("hit.outcome", F.lit(default)).alias("verdict"), other.alias("pattern")
    )
