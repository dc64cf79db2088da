"""Texts that a run sends to models, assembled from rows: context, candidates and transcription requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: what stands around the context
OPENING, CLOSING = "\n\n=== USER-PROVIDED CONTEXT ===\n", "\n=== END CONTEXT ===\n"


def _given(c: str) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def context_prompt(contexts: DataFrame) -> DataFrame:
    """recording_id, prompt of contexts (recording_id, speaker_names, topic, terms, instructions, language_hints, language_codes, keywords).

    Lists are arrays; what is not given is left out, and nothing given gives an empty prompt.
    """
    some = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0
    line = lambda cond, text, *more: [F.when(cond, text), *(F.when(cond, m) for m in more)]
    join = lambda label, c: F.concat(F.lit(label), F.array_join(c, ", "))
    parts = [
        *line(some("speaker_names"), join("KNOWN SPEAKERS: ", "speaker_names"), F.lit("IMPORTANT: You MUST use these exact speaker names in your transcription."), F.lit("Replace any 'Speaker 1', 'Speaker 2' etc. with the actual names provided above."), F.lit("If you can distinguish between voices, map them to these names based on context and voice characteristics.")),
        *line(_given("topic"), F.concat(F.lit("TOPIC/DOMAIN: "), "topic"), F.concat(F.lit("Pay special attention to technical terms and jargon related to: "), "topic")),
        *line(some("terms"), join("TECHNICAL VOCABULARY: ", "terms"), F.lit("Ensure these terms are spelled correctly and used appropriately.")),
        *line(_given("instructions"), F.concat(F.lit("SPECIAL INSTRUCTIONS: "), "instructions")),
        *line(_given("language_hints"), F.concat(F.lit("LANGUAGE/ACCENT INFO: "), "language_hints")),
        *line(some("language_codes"), join("EXPECTED LANGUAGES (BCP-47): ", "language_codes"), F.lit("Transcribe each language as spoken; do not translate.")),
        *line(some("keywords"), join("KEYWORDS TO VERIFY: ", "keywords")),
    ]
    body = F.concat_ws("\n", *parts)
    return contexts.select("recording_id", F.when(body == "", "").otherwise(F.concat(F.lit(OPENING), body, F.lit(CLOSING))).alias("prompt"))


def candidate_texts(candidates: DataFrame, headers: DataFrame) -> DataFrame:
    """recording_id, candidate_id, block of headers (recording_id, candidate_id, label, kind, model, notes): a candidate as a judge reads it."""
    line = F.concat("timestamp", F.lit(" "), "speaker", F.lit(": "), "text")
    texts = candidates.groupBy("recording_id", "candidate_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", line.alias("line")))), lambda x: x["line"]), "\n").alias("transcript"))
    rows = headers.join(texts, ["recording_id", "candidate_id"], "left")
    notes = F.when(F.size(F.coalesce("notes", F.array().cast("array<string>"))) > 0, F.array_join("notes", "; ")).otherwise("none")
    say = lambda label, c: F.concat(F.lit(f"{label}: "), c)
    block = F.concat_ws("\n", say("Candidate ID", F.col("candidate_id")), say("Label", F.col("label")), say("Kind", F.col("kind")), say("Model", F.col("model")), say("Notes", notes), F.lit("Transcript:"), F.coalesce("transcript", F.lit("[empty candidate]")))
    return rows.select("recording_id", "candidate_id", block.alias("block"))


def judge_prompt(blocks: DataFrame, order: str = "candidate_id", speakers: tuple[str, ...] = (), context: str = "", label: str = "") -> DataFrame:
    """recording_id, prompt: the blocks of a recording's candidates, in order, with what a judge is told."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "block"))), lambda x: x["block"]), "\n\n---\n\n")
    parts = (
        F.lit(f"Judge these transcript candidates for {label or 'the current audio span'}."), F.lit(f"Context: {context.strip() and context or 'None provided'}"), F.lit(f"Known speakers: {', '.join(speakers) or 'Auto-detect speakers'}"),
        F.lit("Ignore empty or unavailable candidates when at least one usable transcript candidate is present."),
        F.lit("You may call transcript-analysis tools before the final JSON decision. Tool results are advisory; the final transcript must still be supported by candidates."),
        F.lit("Candidates:"), F.col("listed"), F.lit("Return the final corrected transcript for this audio span."),
    )
    return blocks.groupBy("recording_id").agg(listed.alias("listed")).select("recording_id", F.concat_ws("\n\n", *parts).alias("prompt"))


def chunk_prompt(chunks: DataFrame, opening: str, speakers: tuple[str, ...] = (), custom: str = "") -> DataFrame:
    """recording_id, chunk_idx, prompt of chunks (recording_id, chunk_idx, start_ms, context): an opening and what is known of the chunk."""
    parts = (
        F.lit(opening), *(F.lit(x) for x in ((f"\nKNOWN SPEAKERS: {', '.join(speakers)}", "Use these exact speaker names in your transcription.") if speakers else ())),
        F.when(_given("context"), F.concat(F.lit("\nPREVIOUS CONTEXT:\n"), "context")),
        F.format_string("\nCHUNK INFO: This is chunk %d starting at %.1f seconds.", F.col("chunk_idx") + 1, F.col("start_ms") / 1000),
        F.lit("Start timestamps at [00:00:00] for this chunk; the workflow will apply the absolute offset after transcription."),
        *((F.lit(f"\nADDITIONAL INSTRUCTIONS:\n{custom}"),) if custom.strip() else ()),
    )
    return chunks.select("recording_id", "chunk_idx", F.concat_ws("\n", *parts).alias("prompt"))
