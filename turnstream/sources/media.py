"""Recordings as files: what a prober, a decoder and a cutter say of them, and adapters that run such programs.

Programs run once for each row where the rows are, through Arrow batches; all that is read from their output is a column
expression, so that it can be checked without them.
"""

from __future__ import annotations

import json
import shlex
import struct
import subprocess
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trimmed
from .payloads import whole_ms

# fixed values: formats that are read, their media types, those that a speech service takes, and the loudness of silence
FORMATS = ("mp3", "wav", "m4a", "flac", "ogg")
SERVICE_TYPES = ("audio/wav", "audio/mp3", "audio/aiff", "audio/aac", "audio/ogg", "audio/flac", "audio/mpeg", "audio/m4a", "audio/l16", "audio/opus", "audio/alaw", "audio/mulaw", "audio/webm")
SILENT_DB = -35.0
_PROBE = "format struct<duration:string>, streams array<struct<codec_type:string,sample_rate:string,channels:int>>"
_MB = 1024 * 1024


def extension(name: Column) -> Column:
    """The lower-case extension of a file name, without its dot; empty if there is none."""
    return F.lower(F.regexp_extract(F.regexp_extract(name, r"[^/\\]*\z", 0), r"\.([^.]*)\z", 1))


def supported(ext: Column) -> Column:
    """Whether an extension, with a dot or without, in any case, is one of FORMATS."""
    return F.coalesce(F.lower(F.regexp_replace(ext, r"^\.", "")).isin(*FORMATS), F.lit(False))


def file_error(name: Column, size: Column, most_mb: int) -> Column:
    """Why a file is not taken - its format or its size - or null."""
    large = F.format_string(f"file size (%.1fMB) exceeds limit ({most_mb}MB)", size / _MB)
    return F.when(~supported(extension(name)), F.concat(F.lit("unsupported file format: "), extension(name))).when(size > most_mb * _MB, large)


def probed(probes: DataFrame) -> DataFrame:
    """recording_id, format, duration_ms, size_bytes, sample_rate, channels, error of prober output (recording_id, name, size_bytes, json).

    The first audio stream counts.  Unreadable output, a duration not above 0, or no audio stream is an error.
    """
    d = F.from_json("json", _PROBE)
    seconds = d["format"]["duration"].try_cast("double")
    audio = F.filter(F.coalesce(d["streams"], F.array().cast("array<struct<codec_type:string,sample_rate:string,channels:int>>")), lambda s: s["codec_type"] == "audio")
    rows = probes.select("recording_id", "name", "size_bytes", seconds.alias("seconds"), whole_ms(d["format"]["duration"]).alias("ms"), F.try_element_at(audio, F.lit(1)).alias("a"))
    error = F.when(~F.coalesce(F.col("seconds") > 0, F.lit(False)), "invalid duration").when(F.col("a").isNull(), "no audio stream")
    good = lambda c: F.when(error.isNull(), c)
    return rows.select("recording_id", good(extension(F.col("name"))).alias("format"), good(F.col("ms")).alias("duration_ms"), "size_bytes", good(F.coalesce(F.col("a.sample_rate").try_cast("int"), F.lit(0))).alias("sample_rate"), good(F.coalesce("a.channels", F.lit(0))).alias("channels"), error.alias("error"))


def metadata(probes: DataFrame, chunks: DataFrame) -> DataFrame:
    """recording_id, duration (seconds), size_mb, format, sample_rate, channels, chunk_count, needs_chunking of probed recordings and their plans."""
    counts = chunks.groupBy("recording_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    rows = probes.where("error is null").join(counts, "recording_id", "left").na.fill(0, ["chunk_count"])
    return rows.select("recording_id", (F.col("duration_ms") / 1000).alias("duration"), (F.col("size_bytes") / _MB).alias("size_mb"), "format", "sample_rate", "channels", "chunk_count", (F.col("chunk_count") > 1).alias("needs_chunking"))


def silent(lines: DataFrame) -> DataFrame:
    """recording_id, silent of volume logs (recording_id, line): whether the loudest sample is below SILENT_DB; null without a figure."""
    found = F.regexp_extract("line", r"max_volume:[\t\n\f\r ]*(-?[0-9.]+|-inf) dB", 1)
    level = F.when(found == "-inf", F.lit(float("-inf"))).otherwise(found.try_cast("double"))
    return lines.groupBy("recording_id").agg((F.min(level) < SILENT_DB).alias("silent"))


def media_type(name: Column, uploaded: Column) -> Column:
    """The media type of a file for a speech service: m4a by its extension, else what the upload says if known, else by extension."""
    guess = F.when(extension(name).isin("mp3", "wav", "m4a", "ogg", "flac"), F.concat(F.lit("audio/"), extension(name))).otherwise("audio/wav")
    said = F.lower(trimmed(F.coalesce(uploaded, F.lit(""))))
    return F.when(extension(name) == "m4a", "audio/m4a").when(said.isin(*SERVICE_TYPES), said).otherwise(guess)


def safe_filename(name: Column) -> Column:
    """A file name that is safe to store: no folders, odd characters as _, names that systems reserve marked, never dots alone."""
    base = F.regexp_extract(F.regexp_replace(name, r"/+\z", ""), r"[^/]*\z", 0)
    base = F.when(base == "", F.when(F.startswith(name, F.lit("/")), "/").otherwise(".")).otherwise(base)
    ext = F.regexp_extract(base, r"\.[^.]*\z", 0)
    stem = F.regexp_replace(F.substr(base, F.lit(1), F.char_length(base) - F.char_length(ext)), "[^a-zA-Z0-9._-]", "_")
    stem = F.when(stem == "", "upload").otherwise(stem)
    ext = F.regexp_replace(ext, "[^a-zA-Z0-9._-]", "")
    ext = F.when(ext == "", ".audio").otherwise(ext)
    stem = F.when(stem.rlike(r"(?i)^(?:con|prn|aux|nul|com[0-9]|lpt[0-9])(?:\..*)?\z"), F.concat(F.lit("_"), stem)).otherwise(stem)
    whole = F.concat(stem, ext)
    return F.when(whole.rlike(r"^\.*\z"), "upload.audio").otherwise(whole)


def transcript_title(name: Column) -> Column:
    """A document's title from a file name: without folders, extension and characters that names may not hold."""
    base = F.regexp_extract(name, r"[^/\\]*\z", 0)
    base = trimmed(F.regexp_replace(F.regexp_replace(base, r"\.[^.]*\z", ""), r'[\x00-\x1F\x7F/\\:*?"<>|]', ""))
    return F.when(base.isin("", ".", "audio"), "Transcript").otherwise(base)


def seconds_code(ms: Column) -> Column:
    """Milliseconds as seconds with three digits, 0 at least."""
    return F.format_string("%d.%03d", F.floor(F.greatest(ms, F.lit(0)) / 1000), F.greatest(ms, F.lit(0)) % 1000)


def cut_command(path: Column, start_ms: Column, end_ms: Column, target: Column) -> Column:
    """The arguments that cut a chunk of a recording to 16 kHz mono WAV, as an array."""
    lit = lambda *xs: [F.lit(x) for x in xs]
    return F.array(*lit("ffmpeg", "-hide_banner", "-nostdin", "-y", "-ss"), seconds_code(start_ms), F.lit("-t"), seconds_code(end_ms - start_ms), F.lit("-i"), path, *lit("-vn", "-ac", "1", "-ar", "16000", "-c:a", "pcm_s16le"), target)


def probe_command(path: Column) -> Column:
    return F.array(*(F.lit(x) for x in ("ffprobe", "-v", "error", "-print_format", "json", "-show_format", "-show_streams")), path)


def analysis_command(path: Column, noise_db: int = -35, seconds: float = 0.4) -> Column:
    """Arguments that decode a whole recording, report its progress and find its silences."""
    return F.array(*(F.lit(x) for x in ("ffmpeg", "-hide_banner", "-nostdin", "-i")), path, *(F.lit(x) for x in ("-vn", "-af", f"silencedetect=noise={noise_db}dB:d={seconds}", "-progress", "pipe:1", "-f", "null", "-")))


def volume_command(path: Column) -> Column:
    return F.array(*(F.lit(x) for x in ("ffmpeg", "-hide_banner", "-nostdin", "-nostats", "-i")), path, *(F.lit(x) for x in ("-vn", "-af", "volumedetect", "-f", "null", "-")))


def split_command(text: str, windows: bool = False) -> list[str]:
    """The arguments of a configured command line: POSIX quoting, or quotes only where backslashes are part of paths."""
    if not windows:
        return shlex.split(text)
    return [x[1:-1] if len(x) > 1 and x[0] == x[-1] and x[0] in "\"'" else x for x in shlex.split(text, posix=False)]


def run_commands(rows: DataFrame, most_seconds: int = 600, most_bytes: int = 16 << 20) -> DataFrame:
    """recording_id, exit_code, output, error of programs (recording_id, argv array, stdin string or null).

    A program that cannot start, runs too long or says too much gives a row with an error; nothing is raised.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rec, argv, stdin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    done = subprocess.run(argv, input=(stdin or "").encode(), capture_output=True, timeout=most_seconds, check=False)
                    said = done.stdout + done.stderr
                    large = len(said) > most_bytes
                    out.append((rec, done.returncode, None if large else said.decode("utf-8", "replace"), "too much output" if large else None if done.returncode == 0 else f"exit code {done.returncode}"))
                except (OSError, subprocess.TimeoutExpired, IndexError) as e:
                    out.append((rec, None, None, type(e).__name__))
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string())
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["recording_id", "exit_code", "output", "error"])

    picked = rows.select(F.col("recording_id").cast("long").alias("recording_id"), "argv", F.col("stdin").cast("string").alias("stdin") if "stdin" in rows.columns else F.lit(None).cast("string").alias("stdin"))
    return picked.mapInArrow(run, "recording_id long, exit_code int, output string, error string")


def call_service(requests: DataFrame, call: Callable[[str], str], tries: int = 3) -> DataFrame:
    """recording_id, chunk_idx, payload, error of a speech service's answers to requests (recording_id, chunk_idx, body).

    call takes a body and returns a payload; what it raises is tried again, and the last is reported as the error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rec, chunk, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload, error = None, None
                for _ in range(tries):
                    try:
                        payload, error = call(body), None
                        break
                    except Exception as e:  # noqa: BLE001 - whatever a client raises is the row's error
                        error = f"{type(e).__name__}: {e}"
                out.append((rec, chunk, payload, error))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["recording_id", "chunk_idx", "payload", "error"])

    rows = requests.select(F.col("recording_id").cast("long").alias("recording_id"), F.col("chunk_idx").cast("long").alias("chunk_idx"), F.col("body").cast("string").alias("body"))
    return rows.mapInArrow(run, "recording_id long, chunk_idx long, payload string, error string")


def sidecar_request(path: Column, segments: Column | None = None) -> Column:
    """The JSON line that a local recogniser reads: to transcribe a file, or to align its segments."""
    return F.to_json(F.struct(F.lit("transcribe").alias("action"), path.alias("audio"))) if segments is None else F.to_json(F.struct(F.lit("align").alias("action"), path.alias("audio"), segments.alias("segments")))


def wave_data_bytes(content: bytes | None) -> int | None:
    """Size of the data chunk of a RIFF/WAVE file: 0 without one, what is left where a stream left it open, null for other files."""
    if content is None or len(content) < 12 or content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        return None
    at = 12
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
        if name == b"data":
            return len(content) - at - 8 if size in (0, 0xFFFFFFFF) else size
        at += 8 + size + size % 2
    return 0


def wave_sizes(files: DataFrame) -> DataFrame:
    """recording_id, data_bytes of files (recording_id, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([wave_data_bytes(x.as_py()) for x in batch.column(1)], pa.int64())], ["recording_id", "data_bytes"])

    return files.select(F.col("recording_id").cast("long").alias("recording_id"), "content").mapInArrow(run, "recording_id long, data_bytes long")


def sidecar_answer(payload: str) -> list[dict]:
    """The segments of a local recogniser's answer; [] if it cannot be read."""
    try:
        found = json.loads(payload)
    except ValueError:
        return []
    return [x for x in found.get("segments", []) if isinstance(x, dict)] if isinstance(found, dict) else []
