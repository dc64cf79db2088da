"""Settings of a run: their defaults and limits, the plan of candidates that they give, budgets, and packs of instructions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: the models that are known, their labels, the levels of thought and the output that each needs, other names, and tiers
SPEECH_MODEL = "gemini-3.5-transcribe"
EXTERNAL_MODELS = ("muse-voice-transcribe-1.0", "MAI-Transcribe-2")
MODELS = {SPEECH_MODEL: "Gemini 3.5 Transcribe", "gemini-3.5-flash-lite": "Gemini 3.5 Flash-Lite", "gemini-3.8-flash": "Gemini 3.8 Flash", "gemini-4-argon": "Gemini 4 Argon"}
MODEL_ALIASES = {"gemini-3-flash-preview": "gemini-3.8-flash", "gemini-3.1-flash-lite": "gemini-3.5-flash-lite", "gemini-3.1-flash-lite-preview": "gemini-3.5-flash-lite"}
THINKING = {"gemini-3.5-flash-lite": ("minimal", "low", "medium", "high"), "gemini-3.8-flash": ("low", "medium", "high"), "gemini-4-argon": ("low", "medium", "high")}
LEAST_OUTPUT = {"gemini-4-argon": 32768}
STRATEGIES = ("single_gemini", "single_speech", "dual_gemini", "gemini_plus_parakeet")
CHUNKINGS = ("adaptive", "fixed")
TIERS = ("", "standard", "flex", "priority")
KINDS = ("format", "strategy", "judge", "generic")
RESERVED_WORDS = ("anthropic", "claude")
#: Words that editing takes out.
FILLERS = ("um", "uh", "like", "you know", "I mean", "sort of", "kind of", "basically", "actually")


def normal_model(name: str) -> str:
    """A model's own name for a prefixed name or an alias."""
    name = name.removeprefix("google-gla:")
    return MODEL_ALIASES.get(name, name)


def model_label(name: str) -> str:
    return MODELS.get(name, f"Gemini {name}")


def second_model(primary: str) -> str:
    """The model of the second candidate beside a primary one."""
    return "gemini-3.8-flash" if primary == "gemini-3.5-flash-lite" else "gemini-3.5-flash-lite"


def normal_tier(tier: str) -> str:
    tier = tier.strip().lower()
    return "" if tier == "standard" else tier


def least_output(model: str) -> int:
    return LEAST_OUTPUT.get(model, 0)


@dataclass(frozen=True)
class Candidate:
    id: str
    label: str
    kind: str
    model: str


@dataclass(frozen=True)
class Settings:
    """All options of a run by keyword; `checked` gives them as a run takes them, or raises ValueError."""

    model: str = SPEECH_MODEL
    judge_model: str = "gemini-3.8-flash"
    strategy: str = "dual_gemini"
    most_file_mb: int = 200
    chunk_ms: int = 0
    overlap_ms: int = 5000
    chunking: str = "adaptive"
    concurrency: int = 3
    thinking: str = "high"
    judge_thinking: str = "high"
    most_output: int = 65536
    tier: str = ""
    sidecar_model: str = "nvidia/parakeet-ctc-0.6b"
    preserve_context: bool = True
    auto_format: bool = True
    remove_fillers: bool = False
    judge: bool = True
    speech_review: bool = False
    packs: bool = True
    router: bool = False
    agentic: bool = True
    candidate_runs: int = 3
    judge_calls: int = 4
    planner_turns: int = 3
    span_escalations: int = 4
    escalation_score: float = 78
    global_review: bool = True
    most_tokens: int = 1_000_000
    wall_seconds: int = 1800
    fillers: tuple[str, ...] = field(default=FILLERS)

    def checked(self) -> Settings:
        s = replace(self, model=normal_model(self.model), judge_model=normal_model(self.judge_model), tier=normal_tier(self.tier), chunking=self.chunking.strip().lower())
        speech = s.model == SPEECH_MODEL
        if not s.chunk_ms:
            s = replace(s, chunk_ms=1_500_000 if speech else 120_000)
        direct = speech or s.model in EXTERNAL_MODELS
        slack = 30_000 if s.chunking == "adaptive" else 0  # a cut in silence may come that much later
        longest = {SPEECH_MODEL: 1_800_000, EXTERNAL_MODELS[0]: 600_000}.get(s.model)
        thinker = s.judge_model if direct and s.judge_model in THINKING else s.model
        rules = [
            (s.model in MODELS or s.model in EXTERNAL_MODELS, f"unsupported model: {s.model}"),
            (s.judge_model in MODELS and s.judge_model != SPEECH_MODEL, f"unsupported judge model: {s.judge_model}"),
            (s.strategy in STRATEGIES, f"unsupported strategy: {s.strategy}"),
            (s.chunking in CHUNKINGS, f"unsupported chunking: {s.chunking}"),
            (s.tier in TIERS, f"unsupported tier: {s.tier}"),
            (s.thinking in THINKING.get("gemini-3.8-flash" if direct else thinker, ()), f"invalid thinking level: {s.thinking}"),
            (s.judge_thinking in THINKING.get(s.judge_model, ()), f"invalid judge thinking level: {s.judge_thinking}"),
            (longest is None or s.chunk_ms <= longest - slack, f"chunk_ms must not exceed {(longest or 0) - slack} with {s.chunking} chunking"),
            (0 <= s.overlap_ms < s.chunk_ms, "overlap_ms must be 0 or more and less than chunk_ms"),
        ]
        limits = {
            "most_file_mb": (1, 2048), "chunk_ms": (10_000, 3_600_000), "concurrency": (1, 16), "most_output": (1024, 65536), "candidate_runs": (1, 8), "judge_calls": (1, 16),
            "planner_turns": (1, 8), "span_escalations": (0, 32), "escalation_score": (0, 100), "most_tokens": (10_000, 10_000_000), "wall_seconds": (60, 86_400),
        }
        rules += [(lo <= getattr(s, name) <= hi, f"{name} must be between {lo} and {hi}") for name, (lo, hi) in limits.items()]
        for fine, problem in rules:
            if not fine:
                raise ValueError(problem)
        return s.by_capability()

    def by_capability(self) -> Settings:
        """Speech models go the direct way, whatever was asked, unless their output is to be reviewed."""
        if self.model != SPEECH_MODEL and self.model not in EXTERNAL_MODELS:
            return self
        if self.speech_review:
            return replace(self, judge=True)
        strategy = "single_speech" if self.model in EXTERNAL_MODELS else "single_gemini"
        return replace(self, judge=False, strategy=strategy, agentic=False, global_review=False, router=False, packs=False, preserve_context=False, auto_format=False)

    def candidates(self) -> list[Candidate]:
        """The candidates that the strategy asks for, the primary one first."""
        external = self.model in EXTERNAL_MODELS
        plan = [Candidate(self.model, self.model, "speech", self.model) if external else Candidate(self.model.replace("-", "_"), model_label(self.model), "gemini", self.model)]
        if self.strategy == "dual_gemini":
            other = second_model(self.model)
            plan.append(Candidate(other.replace("-", "_"), model_label(other), "gemini", other))
        if self.strategy == "gemini_plus_parakeet":
            plan.append(Candidate("parakeet_audio", "Parakeet Audio", "parakeet", self.sidecar_model))
        return plan

    def budget(self, spans: int) -> dict[str, int]:
        """How often each step may run for a recording of some spans."""
        spans = max(spans, 1)
        review = int(self.global_review and spans > 1)
        judge = self.judge_calls * spans + review
        if not self.judge:
            return {"candidate_runs": spans, "judge_calls": 0, "planner_turns": 0, "span_escalations": 0, "requests": spans + int(self.router), "tool_calls": 0, "global_reviews": 0, "tokens": self.most_tokens}
        runs = self.candidate_runs * spans
        return {"candidate_runs": runs, "judge_calls": judge, "planner_turns": self.planner_turns * spans, "span_escalations": self.span_escalations, "requests": runs + 3 * judge + 1, "tool_calls": 8 * judge, "global_reviews": 1, "tokens": self.most_tokens}


def settings_from(form: dict[str, str]) -> Settings:
    """Settings from form values; unknown names and blank values are left out."""
    kinds = {f.name: type(f.default) for f in Settings.__dataclass_fields__.values() if f.name != "fillers"}
    found: dict[str, object] = {}
    for name, raw in form.items():
        if name not in kinds or not raw.strip():
            continue
        kind = kinds[name]
        found[name] = parse_flag(raw, getattr(Settings, name)) if kind is bool else kind(raw.strip()) if kind in (int, float) else raw.strip()
    return Settings(**found)


def parse_flag(raw: str, default: bool = False) -> bool:
    word = raw.strip().lower()
    return True if word in ("1", "true", "on", "yes") else False if word in ("0", "false", "off", "no") else default


def candidate_errors(candidates: DataFrame) -> DataFrame:
    """plan, error of plans of candidates (plan, pos, id, kind, model): the first that has no id, repeats one, or names an unknown kind or model."""
    order = Window.partitionBy("plan").orderBy("pos")
    again = F.row_number().over(Window.partitionBy("plan", "id").orderBy("pos")) > 1
    place = F.row_number().over(order) - 1
    rows = candidates.withColumns({"place": place, "again": again})
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    error = (
        F.when(blank("id"), F.format_string("candidate spec %d has no candidate id", "place")).when(F.col("again"), F.concat(F.lit("duplicate candidate id "), "id"))
        .when((F.col("kind") == "gemini") & blank("model"), F.concat(F.lit("no model for "), "id")).when((F.col("kind") == "gemini") & ~F.col("model").isin(*MODELS), F.concat(F.lit("unsupported model "), "model"))
        .when((F.col("kind") == "speech") & ~F.coalesce(F.col("model").isin(*EXTERNAL_MODELS), F.lit(False)), F.concat(F.lit("unsupported speech model "), F.coalesce("model", F.lit(""))))
        .when(~F.coalesce(F.col("kind").isin("gemini", "parakeet", "speech"), F.lit(False)), F.concat(F.lit("unknown kind "), F.coalesce("kind", F.lit(""))))
    )
    return rows.withColumn("error", error).groupBy("plan").agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("place"))).alias("error"))


def planned_candidates(plans: DataFrame, primary: str, sidecar: str = "nvidia/parakeet-ctc-0.6b") -> DataFrame:
    """plan, pos, id, label, kind, model of plan texts (plan, text): `kind|id|model` tuples, separated by semicolons.

    @model is the primary model, @secondary-auto its second, @parakeet the sidecar's; an id of @auto, or none, follows
    from the model.  Tuples of other shapes, and without a model, are left out.
    """
    parts = F.transform(F.split("text", ";"), lambda t: F.transform(F.split(F.trim(t), r"\|"), lambda x: F.trim(x)))
    rows = plans.select("plan", F.posexplode(F.filter(parts, lambda p: F.size(p) == 3)).alias("pos", "p")).select("plan", "pos", *(F.element_at("p", i + 1).alias(n) for i, n in enumerate(("kind", "hint", "asked"))))
    model = F.col("asked")
    for sign, to in (("@model", primary), ("@secondary-auto", second_model(primary)), ("@parakeet", sidecar)):
        model = F.when(F.col("asked") == sign, to).otherwise(model)
    rows = rows.withColumn("model", model).where("model != ''")
    own = F.regexp_replace("model", "^google-gla:", "")
    for alias, to in MODEL_ALIASES.items():
        own = F.when(own == alias, to).otherwise(own)
    rows = rows.withColumn("model", F.when(F.col("kind") == "gemini", own).otherwise(F.col("model")))
    rows = rows.withColumn("kind", F.when((F.col("kind") == "gemini") & F.col("model").isin(*EXTERNAL_MODELS), "speech").otherwise(F.col("kind")))
    label = F.concat(F.lit("Gemini "), "model")
    for name, to in MODELS.items():
        label = F.when(F.col("model") == name, to).otherwise(label)
    label = F.when(F.col("kind") == "gemini", label).when(F.col("kind") == "parakeet", "Parakeet Audio").otherwise(F.col("model"))
    return rows.select("plan", "pos", F.when(F.col("hint").isin("", "@auto"), F.replace("model", F.lit("-"), F.lit("_"))).otherwise(F.col("hint")).alias("id"), label.alias("label"), "kind", "model")


# ---------------------------------------------------------------- packs


def parse_pack(text: str) -> tuple[dict, str]:
    """(front matter, body) of a pack's text: `name: value` lines, and names under `metadata:`, between lines of three dashes."""
    text = text.lstrip("﻿ \t\r\n")
    found = re.match(r"---[ \t\r]*\n(.*?)^---[ \t\r]*$\n?(.*)", text, re.S | re.M)
    if not found:
        raise ValueError("no front matter between lines of three dashes")
    meta: dict = {}
    for line in found[1].splitlines():
        m = re.match(r"(\s*)([A-Za-z0-9_-]+):\s*(.*?)\s*$", line)
        if not m:
            continue
        value = m[3].strip("\"'") if len(m[3]) > 1 and m[3][0] == m[3][-1] and m[3][0] in "\"'" else m[3]
        if m[1] and isinstance(meta.get("metadata"), dict):
            meta["metadata"][m[2]] = value
        elif not m[1]:
            meta[m[2]] = {} if m[2] == "metadata" else value
    return meta, found[2].strip()


def packs(files: DataFrame) -> DataFrame:
    """root, folder, name, kind, keys (array), description, body, error, chosen of packs (root, folder, content).

    Of packs that are valid and share a name, that of the first root, then folder, is chosen; others are not lost but not chosen.
    """
    import pyarrow as pa

    def read(batches):
        for batch in batches:
            out = []
            for root, folder, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    meta, body = parse_pack(content or "")
                except ValueError as e:
                    out.append((root, folder, None, None, [], None, None, str(e)))
                    continue
                more = meta.get("metadata") or {}
                kind = more.get("kind") or "generic"
                keys = [k for k in re.split(r"[, \t]+", more.get({"format": "formats", "strategy": "strategies", "judge": "judge_tools"}.get(kind, ""), "") or "") if k]
                name, about = meta.get("name") or "", (meta.get("description") or "").strip()
                rules = (
                    (name, "name is required"), (len(name.encode()) <= 64, "name exceeds 64 characters"), (re.fullmatch(r"[a-z0-9]+(-[a-z0-9]+)*", name), "name must be lowercase with single hyphens"),
                    (not any(w in name for w in RESERVED_WORDS), "name contains a reserved word"), (name == folder, "name must match its folder"), (about, "description is required"),
                    (len(about.encode()) <= 1024, "description exceeds 1024 characters"), (not re.search("[<>]", about), "description must not contain tags"),
                    (len((meta.get("compatibility") or "").encode()) <= 500, "compatibility exceeds 500 characters"), (kind in KINDS, "unknown kind"),
                )
                out.append((root, folder, name, kind, keys, about, body, next((text for fine, text in rules if not fine), None)))
            kinds = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string())
            columns = list(zip(*out, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["root", "folder", "name", "kind", "keys", "description", "body", "error"])

    rows = files.select(F.col("root").cast("int").alias("root"), "folder", "content").mapInArrow(read, "root int, folder string, name string, kind string, keys array<string>, description string, body string, error string")
    first = F.row_number().over(Window.partitionBy("name", F.col("error").isNull()).orderBy("root", "folder")) == 1
    return rows.withColumn("chosen", F.col("error").isNull() & first)


def pack_for(found: DataFrame, kind: str, key: str) -> DataFrame:
    """The chosen pack of a kind that names a key, in any case; the first by name."""
    return found.where("chosen").where(F.col("kind") == kind).where(F.exists("keys", lambda k: F.lower(k) == key.strip().lower())).orderBy("name").limit(1)


def scrubbed(text, secrets: tuple[str, ...]):
    """A text column without secrets."""
    for s in secrets:
        if s:
            text = F.replace(text, F.lit(s), F.lit("[redacted]"))
    return text
