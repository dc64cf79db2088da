"""Documents of recordings in every format: the formats by name, and one call that renders them.

A document is one row for each recording, with its bytes.  Speakers are renamed first.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, csv_safe, trimmed
from ..functions.timecode import clock, format_timestamp, parse_timestamp, precise_clock
from ..sources.media import transcript_title
from . import subtitles
from .validate import rename_speakers


@dataclass(frozen=True)
class Format:
    name: str
    label: str
    extension: str
    content_type: str
    binary: bool = False
    timestamps: bool = False


# fixed values: the formats in the order they are shown, and other names of them
FORMATS = (
    Format("txt", "Plain text", "txt", "text/plain; charset=utf-8", timestamps=True),
    Format("md", "Markdown", "md", "text/markdown; charset=utf-8", timestamps=True),
    Format("docx", "Word document", "docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", True, True),
    Format("srt", "SubRip subtitles", "srt", "application/x-subrip; charset=utf-8"),
    Format("vtt", "WebVTT subtitles", "vtt", "text/vtt; charset=utf-8"),
    Format("csv", "Spreadsheet (CSV)", "csv", "text/csv; charset=utf-8"),
    Format("json", "JSON", "json", "application/json; charset=utf-8"),
)
ALIASES = {"text": "txt", "markdown": "md", "word": "docx", "subrip": "srt", "webvtt": "vtt"}


def lookup(name: str) -> Format:
    """The format of a name, alias or extension, in any case."""
    key = name.removeprefix(".").strip().lower()
    key = ALIASES.get(key, key)
    for f in FORMATS:
        if f.name == key:
            return f
    raise ValueError(f"unsupported export format {name!r} (supported: {', '.join(f.name for f in FORMATS)})")


@dataclass(frozen=True)
class Options:
    timestamps: bool = True
    names: dict[str, str] = field(default_factory=dict)
    title: str = "Transcript"


def start_seconds() -> Column:
    """The precise start of a segment, else that of its timestamp, else 0."""
    return F.coalesce(F.col("start"), parse_timestamp(F.col("timestamp")).cast("double"), F.lit(0.0))


def document_summaries(seg: DataFrame, recordings: DataFrame) -> DataFrame:
    """recording_id, summary of recordings (recording_id, duration, created_at): duration, speakers and date, joined by middle dots.

    Gap markers' label is no speaker; what is not known is left out.
    """
    who = seg.groupBy("recording_id").agg(F.count_distinct(F.when(F.col("speaker") != "Untranscribed", F.col("speaker"))).alias("n"))
    people = F.when(F.col("n") == 1, "1 speaker").when(F.col("n") > 1, F.format_string("%d speakers", "n"))
    length = F.when(F.col("duration") > 0, F.concat(F.lit("Duration "), clock(F.col("duration"))))
    rows = recordings.join(who, "recording_id", "left")
    return rows.select("recording_id", F.concat_ws(" · ", length, people, F.date_format("created_at", "d MMMM yyyy")).alias("summary"))


def _cell(c: Column) -> Column:
    """A CSV cell: neutralised where a spreadsheet would compute it, and quoted where it must be."""
    safe = csv_safe(F.coalesce(c, F.lit("")))
    quoted = F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(safe.rlike(rf'[,"\r\n]|^{SPACE}') | (safe == "\\."), quoted).otherwise(safe)


def with_starts(seg: DataFrame) -> DataFrame:
    return seg.withColumn("start", start_seconds())


def csv_rows(seg: DataFrame) -> DataFrame:
    """recording_id, seg_idx, line: start, end, speaker and text of each segment as a line of CSV."""
    ends = with_starts(seg)
    order = Window.partitionBy("recording_id").orderBy("seg_idx")
    stop = F.when(F.col("end") > F.col("start"), F.col("end")).otherwise(F.col("start") + F.greatest(F.lit(1.0), F.char_length("text") / subtitles.CHARS_PER_SECOND))
    ends = ends.withColumns({"stop": stop, "next": F.lead("start").over(order)})
    stop = F.when((F.col("next") > F.col("start")) & (F.col("next") < F.col("stop")), F.col("next")).otherwise(F.col("stop"))
    return ends.select("recording_id", "seg_idx", F.concat_ws(",", precise_clock(F.col("start"), "."), precise_clock(stop, "."), _cell(F.col("speaker")), _cell(F.col("text"))).alias("line"))


def render_csv(seg: DataFrame) -> DataFrame:
    """recording_id, document: a header and a line for each segment."""
    lines = F.array_sort(F.collect_list(F.struct("seg_idx", "line")))
    body = F.array_join(F.transform(lines, lambda x: F.concat(x["line"], F.lit("\n"))), "")
    return csv_rows(seg).groupBy("recording_id").agg(F.concat(F.lit("start,end,speaker,text\n"), body).alias("document"))


def render(seg: DataFrame, format_name: str, options: Options = Options(), recordings: DataFrame | None = None) -> DataFrame:
    """recording_id, document of each recording in a format; DOCX is binary, all others are text.

    recordings: recording_id, and what is known of duration, created_at and, for JSON, anything else.
    """
    f = lookup(format_name)
    named = with_starts(rename_speakers(seg, options.names))
    title = options.title.strip() and options.title or "Transcript"
    if f.name == "txt":
        return subtitles.render_text(named, options.timestamps)
    if f.name == "srt":
        return subtitles.render_srt(named)
    if f.name == "vtt":
        return subtitles.render_vtt(named)
    if f.name == "csv":
        return render_csv(named)
    if f.name == "json":
        return render_json(named.drop("start").join(seg.select("recording_id", "seg_idx", "start"), ["recording_id", "seg_idx"]), recordings)
    summaries = None if recordings is None else document_summaries(named, recordings)
    if f.name == "md":
        return subtitles.render_markdown(named, title, summaries, options.timestamps)
    return subtitles.render_docx(named, title, summaries, options.timestamps)


def render_json(seg: DataFrame, recordings: DataFrame | None = None) -> DataFrame:
    """recording_id, document: all that is known of a recording, with its segments in order, as indented JSON."""
    columns = [c for c in ("timestamp", "speaker", "text", "confidence", "start", "end") if c in seg.columns]
    one = F.struct("seg_idx", F.struct(*columns).alias("s"))
    lists = seg.groupBy("recording_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["s"]).alias("segments"))
    known = lists if recordings is None else recordings.join(lists, "recording_id")
    return known.select("recording_id", F.to_json(F.struct(*known.columns), {"pretty": "true"}).alias("document"))


def export_text(seg: DataFrame, format_name: str, recordings: DataFrame | None = None) -> DataFrame:
    """render with its defaults, for formats that are text; others are refused."""
    f = lookup(format_name)
    if f.binary:
        raise ValueError(f"{f.name} is a binary format; use render")
    return render(seg, format_name, Options(), recordings)


def formatted(seg: DataFrame) -> DataFrame:
    """recording_id, seg_idx, line: `[HH:MM:SS] speaker: text` by the precise start."""
    return with_starts(seg).select("recording_id", "seg_idx", F.concat(format_timestamp(F.col("start")), F.lit(" "), "speaker", F.lit(": "), "text").alias("line"))


# fixed values: the most names that a download renames, and the most bytes of each
MOST_NAMES, MOST_NAME_BYTES = 64, 120


def format_of(name: Column) -> Column:
    """The format that a column names, as lookup does; null for an unknown one."""
    key = F.lower(trimmed(F.regexp_replace(F.coalesce(name, F.lit("")), r"^\.", "")))
    known = F.create_map(*(F.lit(x) for pair in ({f.name: f.name for f in FORMATS} | ALIASES).items() for x in pair))
    return F.try_element_at(known, F.when(key == "", "txt").otherwise(key))


def downloads(requests: DataFrame, seg: DataFrame, recordings: DataFrame | None = None) -> DataFrame:
    """request_id, filename, content_type, document (binary), error of requests for documents of recordings.

    requests: request_id (long), recording_id, format (empty: txt), filename, timestamps, speakers (array of
    `<label>=<name>`).  Too many or unreadable names, an unknown format and a recording without segments are errors.
    Each request has names of its own: its segments are a copy of the recording's, renamed by a map.
    """
    pairs = F.coalesce("speakers", F.array().cast("array<string>"))
    of = lambda x, k: F.regexp_extract(x, r"(?s)^([^=]*)=(.*)\z", k)
    bad = F.exists(pairs, lambda x: F.coalesce((F.locate("=", x) == 0) | (trimmed(of(x, 1)) == "") | (F.octet_length(of(x, 1)) > MOST_NAME_BYTES) | (F.octet_length(of(x, 2)) > MOST_NAME_BYTES), F.lit(True)))
    ready = seg.select("recording_id").distinct().withColumn("ready", F.lit(True))
    rows = requests.join(ready, "recording_id", "left").withColumns({"kind": format_of(F.col("format")), "title": transcript_title(F.coalesce("filename", F.lit("")))})
    listed = ", ".join(f.name for f in FORMATS)
    # fixed values: the messages
    error = (
        F.when(F.col("kind").isNull(), F.format_string(f'unsupported export format "%s" (supported: {listed})', "format"))
        .when(F.col("ready").isNull(), "transcript is not ready")
        .when(F.size(pairs) > MOST_NAMES, f"at most {MOST_NAMES} speaker names")
        .when(bad, "speaker must be <label>=<name>")
    )
    # of names given twice the last counts
    names = F.aggregate(F.transform(pairs, lambda x: F.struct(trimmed(of(x, 1)).alias("label"), trimmed(of(x, 2)).alias("name"))), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["label"]), F.map_from_arrays(F.array(x["label"]), F.array(x["name"]))))
    rows = rows.withColumn("error", error)
    good = rows.where("error is null").select("request_id", "recording_id", "kind", "title", F.coalesce("timestamps", F.lit(True)).alias("timestamps"), names.alias("names"))
    made = []
    for f in FORMATS:
        for stamped in (True, False) if f.timestamps else (None,):
            mine = good.where(F.col("kind") == f.name).where(F.lit(True) if stamped is None else F.col("timestamps") == stamped)
            own = seg.join(mine.select("request_id", "recording_id", "names"), "recording_id").withColumn("recording_id", F.col("request_id"))
            own = own.withColumn("speaker", F.coalesce(F.nullif(F.try_element_at("names", F.col("speaker")), F.lit("")), "speaker")).select(*seg.columns)
            known = None if recordings is None else recordings.join(mine.select("request_id", "recording_id"), "recording_id").withColumn("recording_id", F.col("request_id")).select(*recordings.columns)
            made.append(render(own, f.name, Options(timestamps=stamped is not False), known).select(F.col("recording_id").alias("request_id"), F.col("document").cast("binary").alias("document"), F.lit(f.extension).alias("extension"), F.lit(f.content_type).alias("content_type")))
    documents = made[0]
    for x in made[1:]:
        documents = documents.unionByName(x)
    return rows.join(documents, "request_id", "left").select("request_id", F.concat_ws(".", "title", "extension").alias("filename"), "content_type", "document", "error")
