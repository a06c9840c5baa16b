"""Training examples from a knowledge base, and their split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import summary


def _or(c: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default))


def _chat(system: str, user: Column, answer: Column) -> Column:
    turn = lambda role, said: F.struct(F.lit(role).alias("role"), said.alias("content"))
    return F.array(turn("system", F.lit(system)), turn("user", user), turn("assistant", answer))


def _kind() -> Column:
    return F.replace(F.lower(_or("deficiency_type", "general")), F.lit(" "), F.lit("_"))


def _finding() -> Column:
    return F.concat(F.lit("Section: "), _or("cmc_section", "unknown"), F.lit("\nDeficiency type: "), _or("deficiency_type", "general"), F.lit("\nEvidence: "), _or("deficiency_text", ""))


def _correction(said: Column, why: Column, priority: str, kind: Column | None = None) -> Column:
    return F.struct((kind if kind is not None else _kind()).alias("flaw_category"), said.alias("suggestion"), why.alias("explanation"), F.lit(priority).alias("priority"))


def suggestions(kb: DataFrame, system: str) -> DataFrame:
    """One chat a record: the finding, and its historical response as a correction."""
    response = _or("deficiency_response", "")
    why = F.when(response == "", "No historical response available.").otherwise(F.substring(response, 1, 500))
    refs = F.when(_or("cmc_section", "unknown") == "unknown", F.array().cast("array<string>")).otherwise(F.array(F.col("cmc_section")))
    answer = F.to_json(F.array(_correction(summary(response), why, "medium").withField("references", refs)))
    return kb.select(_chat(system, F.concat(F.lit("Analyze the following deficiency finding and provide a correction.\n\n"), _finding()), answer).alias("messages"))


def verdicts(kb: DataFrame, system: str) -> DataFrame:
    """Three chats a record: the good correction passes, a vague one needs revision, one of another kind deeper review."""
    response = _or("deficiency_response", "")
    why = F.when(response == "", "Addressed per guidance.").otherwise(F.substring(response, 1, 300))
    cases = [
        ("pass", _correction(summary(response), why, "medium"), F.lit("")),
        ("minor_revision", _correction(F.lit("Review and update the relevant section."), F.lit("Please address the identified gap."), "low"), F.lit("The correction is too vague: it needs references and steps to take.")),
        ("deeper_review", _correction(F.lit("Add 6-month accelerated stability data."), F.lit("Stability studies are required."), "high", F.lit("stability_data")), F.concat(F.lit("The correction is about stability, the finding about "), _or("deficiency_type", "general"))),
    ]
    made = [
        F.struct(F.lit(v).alias("verdict"), _chat(system, F.concat(F.lit("Original finding:\n"), _finding(), F.lit("\n\nProposed correction:\n"), F.to_json(c)), F.to_json(F.struct(F.lit(v).alias("verdict"), note.alias("feedback"), F.lit(1).alias("corrections_reviewed")))).alias("messages"))
        for v, c, note in cases
    ]
    return kb.select(F.inline(F.array(*made)))


def split(df: DataFrame, key: str, train: int = 85, seed: int = 42) -> DataFrame:
    """Adds `part`: train or val by a seeded hash of the key, so a record keeps its part when others come or go."""
    return df.withColumn("part", F.when(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(100)) < train, "train").otherwise("val"))
