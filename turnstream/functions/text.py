"""Text clean-up as column expressions, safe where engines differ on white space and word bounds."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


# fixed value: white space in any script
SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def fields(c: Column) -> Column:
    """The words of a text between white space."""
    return F.filter(F.split(c, f"{SPACE}+"), lambda w: w != "")


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+\z", "")


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\t\n\f\r ]+", " "))


def fix_punctuation(c: Column) -> Column:
    """No space before marks, one after marks that a letter follows, repeated marks to one and dots to three."""
    for pattern, to in ((r"[\t\n\f\r ]+([,.!?;:])", "$1"), (r"([,!?;:])([A-Za-z])", "$1 $2"), (r"!!+", "!"), (r"\?\?+", "?"), (r"\.\.+", "...")):
        c = F.regexp_replace(c, pattern, to)
    return c


def normalise(c: Column) -> Column:
    """Lower case, ASCII word characters and apostrophes, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^A-Za-z0-9_\t\n\f\r ']", ""), r"[\t\n\f\r ]+", " "))


def escape_markdown(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\`*_\[\]<>#|])", r"\\$1")


def csv_safe(c: Column) -> Column:
    """A leading formula character is neutralised by an apostrophe."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def remove_fillers(c: Column, fillers: tuple[str, ...]) -> Column:
    """The text without the listed words, in list order where they overlap; spaces are tidied after."""
    if not fillers:
        return c
    listed = "|".join(re.escape(x) for x in fillers)
    # ASCII word bounds
    c = F.regexp_replace(c, rf"(?i)(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))(?:{listed})(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))", "")
    return F.regexp_replace(collapse_spaces(c), r"[\t\n\f\r ]+([,.!?;:])", "$1")


def count_matches(c: Column, query: str) -> Column:
    """How often the query occurs, without overlaps and regardless of case; 0 for an empty query."""
    q = query.lower()
    if not q:
        return F.lit(0).cast("long")
    return ((F.char_length(F.lower(c)) - F.char_length(F.replace(F.lower(c), F.lit(q), F.lit("")))) / len(q)).cast("long")


#: ASCII word bounds, whatever the engine's \b means.
_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"

# fixed values: proper nouns that are written with a capital
PROPER_NOUNS = (
    "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday",
    "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December",
    "English", "Spanish", "French", "German", "Chinese", "Japanese", "America", "American", "Europe", "European", "Asia", "Asian",
    "Google", "Microsoft", "Apple", "Amazon", "Facebook", "Twitter",
)


def _literal(to: str) -> str:
    """A replacement that holds no group reference."""
    return to.replace("\\", "\\\\").replace("$", "\\$")


def replace_phrases(c: Column, phrases: dict[str, str]) -> Column:
    """Whole-word phrases regardless of case, the longest first, each on the output of those before."""
    for find in sorted((k for k in phrases if k), key=lambda k: (-len(k.encode()), k)):
        c = F.regexp_replace(c, f"(?iu){_EDGE}{re.escape(find)}{_EDGE}", _literal(phrases[find]))
    return c


def find_and_replace(c: Column, find: str, to: str, case_sensitive: bool = False, whole_word: bool = False) -> tuple[Column, Column]:
    """(text with every match replaced, number of matches); an empty query changes nothing."""
    if not find:
        return c, F.lit(0).cast("long")
    edge = _EDGE if whole_word else ""
    pattern = f"{'' if case_sensitive else '(?iu)'}{edge}{re.escape(find)}{edge}"
    return F.regexp_replace(c, pattern, _literal(to)), F.regexp_count(c, F.lit(pattern)).cast("long")


def proper_nouns(c: Column) -> Column:
    """The listed nouns, as whole words, with their capital; texts that hold none are passed by one search."""
    fixed = c
    for noun in PROPER_NOUNS:
        fixed = F.regexp_replace(fixed, f"(?iu){_EDGE}{noun}{_EDGE}", noun)
    return F.when(c.rlike(f"(?iu){'|'.join(PROPER_NOUNS)}"), fixed).otherwise(c)


def sentence_case(c: Column) -> Column:
    """The first letter of each sentence in upper case and a lone i as I; white space and all else stay."""
    first = r"(?s)^([^\p{L}]*)(\p{L})(.*)$"

    def fix(part: Column) -> Column:
        big = F.upper(F.regexp_extract(part, first, 2))
        big = F.when(F.char_length(big) == 1, big).otherwise(F.regexp_extract(part, first, 2))
        grown = F.when(part.rlike(first), F.concat(F.regexp_extract(part, first, 1), big, F.regexp_extract(part, first, 3))).otherwise(part)
        return F.regexp_replace(grown, f"{_EDGE}i{_EDGE}", "I")

    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"[^.!?]+|[.!?]+"), F.lit(0)), fix), "")


def language_codes(c: Column) -> Column:
    """Canonical BCP-47 codes of a list, without repeats; null if one is malformed or more than ten remain."""
    tag = r"^([A-Za-z]{2,3})(?:-([A-Za-z]{4}))?(?:-([A-Za-z]{2}|[0-9]{3}))?$"
    codes = F.transform(F.filter(F.split(c, r"[,; \t\n]+"), lambda x: x != ""), lambda x: F.replace(x, F.lit("_"), F.lit("-")))

    def canon(x: Column) -> Column:
        script, region = F.regexp_extract(x, tag, 2), F.regexp_extract(x, tag, 3)
        return F.concat(F.lower(F.regexp_extract(x, tag, 1)), F.when(script != "", F.concat(F.lit("-"), F.initcap(script))).otherwise(""), F.when(region != "", F.concat(F.lit("-"), F.upper(region))).otherwise(""))

    found = F.array_distinct(F.transform(codes, canon))
    return F.when(F.forall(codes, lambda x: x.rlike(tag)) & (F.size(found) <= 10), found)


def escape_xml(c: Column) -> Column:
    for find, to in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(find), F.lit(to))
    return c


def strip_fences(c: Column) -> Column:
    """Text without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```[A-Za-z]*[\t\r ]*\n?", ""), r"\n?```$", ""))


def safe_id(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z0-9_-]{1,128}$"), F.lit(False))


def clean_text(c: Column, fillers: tuple[str, ...] = (), sentences: bool = True, phrases: dict[str, str] | None = None) -> tuple[Column, Column]:
    """(cleaned text, labels of the steps after which it differed from the original, comma-joined): spaces, punctuation, fillers, sentence case, phrases.

    A text that the steps would empty stays as it was.
    """
    labels, now = [], c
    for label, step in (("spaces", collapse_spaces), ("punctuation", fix_punctuation), ("fillers", lambda x: remove_fillers(x, fillers)), ("sentences", sentence_case if sentences else lambda x: x)):
        if label == "fillers" and not fillers or label == "sentences" and not sentences:
            continue
        now = step(now)
        labels.append(F.when(now != c, label))
    return F.when(F.trim(replace_phrases(now, phrases or {})) == "", c).otherwise(replace_phrases(now, phrases or {})), F.concat_ws(",", *labels)


def truncated(c: Column, most: int) -> Column:
    """A text of at most `most` bytes, cut between characters, with dots after a cut."""
    head = F.make_valid_utf8(F.substr(c.cast("binary"), F.lit(1), F.lit(most)).cast("string"))
    return F.when(F.octet_length(c) <= most, c).otherwise(F.concat(F.regexp_replace(head, "\uFFFD+\\z", ""), F.lit("...")))


def output_text(c: Column, auto_format: bool, fillers: tuple[str, ...]) -> Column:
    """A final text as settings ask: cleaned, or only without fillers where something is left."""
    if auto_format:
        return clean_text(c, (), False)[0]
    clean = remove_fillers(c, fillers)
    return F.when(clean != "", clean).otherwise(c) if fillers else c
