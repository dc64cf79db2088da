"""The engine's operators behind one object, each a DataFrame in and a DataFrame out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as texts
from .operators import compare, evidence, export, folds, quality, rejudge, spans, subtitles, timeline, tools, validate
from .plans.settings import FILLERS, Settings
from .sources import fixtures, payloads, responses


#: Tools by name: each takes segments, and a comparison takes two lists.
TOOLS = {
    "quality_metrics": quality.scorecard, "timestamp_analysis": evidence.timestamp_quality, "candidate_diff": compare.candidate_diff,
    "boundary_analysis": quality.boundary_analysis, "span_diagnostics": evidence.span_digest,
}


@dataclass
class Engine:
    """Settings and a session; every method is one step, and steps chain."""

    spark: SparkSession
    settings: Settings = field(default_factory=Settings)

    def segments(self, source: DataFrame | str) -> DataFrame:
        """Segments of transcript payloads (recording_id, payload), or of a folder of tables."""
        if isinstance(source, str):
            return fixtures.segments(self.spark, source)
        return payloads.transcript_segments(source)

    def units(self, source: DataFrame, annotated: bool = False) -> DataFrame:
        """Timed units of speech payloads, or of annotated words."""
        return responses.word_units(source) if annotated else payloads.speech_units(source)

    def plan(self, totals: DataFrame, silences: DataFrame) -> DataFrame:
        """Chunks of recordings by the settings."""
        s = self.settings.checked()
        none = silences if s.chunking == "adaptive" else silences.limit(0)
        return folds.adaptive_plan(totals, none, s.chunk_ms, s.overlap_ms)

    def stitch(self, units: DataFrame, plan: DataFrame) -> DataFrame:
        """Segments of the units of overlapping chunks."""
        windows = plan.join(timeline.cut_points(plan), ["recording_id", "chunk_idx"])
        return folds.segments_from_units(folds.stitch_chunks(units, windows))

    def transcript(self, units: DataFrame) -> DataFrame:
        """Segments of units that one request gave for each recording."""
        return folds.one_request_segments(units)

    def validate(self, seg: DataFrame) -> DataFrame:
        return validate.accepted_segments(seg)

    def quality(self, seg: DataFrame, recordings: DataFrame, settings: quality.QualitySettings = quality.QualitySettings()) -> DataFrame:
        return quality.quality_report(seg, recordings, settings)

    def diff(self, one: DataFrame, two: DataFrame) -> DataFrame:
        return compare.candidate_diff(one, two)

    def evidence(self, final: DataFrame, candidates: DataFrame, selected: tuple[str, ...] = ()) -> DataFrame:
        return evidence.run_evidence(final, candidates, selected)

    def repair(self, seg: DataFrame, plan: DataFrame) -> DataFrame:
        return spans.repaired(seg, spans.chunk_seams(plan))

    def autoformat(self, seg: DataFrame, phrases: dict[str, str] | None = None) -> DataFrame:
        """Texts cleaned as the settings say; one that cleaning would empty stays."""
        s = self.settings
        if s.auto_format:
            return seg.withColumn("text", texts.clean_text(F.col("text"), s.fillers if s.remove_fillers else (), False, phrases)[0])
        if s.remove_fillers:
            clean = texts.remove_fillers(F.col("text"), s.fillers or FILLERS)
            return seg.withColumn("text", F.when(clean != "", clean).otherwise(F.col("text")))
        return seg

    def turns(self, seg: DataFrame) -> DataFrame:
        return subtitles.turns(seg)

    def cues(self, seg: DataFrame) -> DataFrame:
        return subtitles.cues(seg)

    def render(self, seg: DataFrame, format_name: str, options: export.Options = export.Options(), recordings: DataFrame | None = None) -> DataFrame:
        return export.render(seg, format_name, options, recordings)

    def rejudge(self, first: DataFrame, reviews: DataFrame, decisions: DataFrame, decided: DataFrame, candidates: DataFrame, scores: DataFrame, spans_: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
        """Spans and reviews after a bounded second pass of judging."""
        return rejudge.rejudged(first, reviews, decisions, decided, candidates, scores, spans_, most)

    def tools(self, calls: DataFrame, results: dict[str, DataFrame]) -> DataFrame:
        """Answers to the calls of models, within the limits of an interaction."""
        return tools.tool_loop(calls, results)

    def tool(self, name: str, *candidates: DataFrame, allowed: tuple[str, ...] = ()) -> DataFrame:
        """Run a tool by name; an unknown or forbidden one, or a missing candidate, gives a row with an error."""
        if name not in TOOLS or (allowed and name not in allowed):
            return self.spark.createDataFrame([(name, "unknown tool")], "tool string, error string")
        if len(candidates) != (2 if name == "candidate_diff" else 1):
            return self.spark.createDataFrame([(name, "unknown candidate_id")], "tool string, error string")
        return TOOLS[name](*candidates)
