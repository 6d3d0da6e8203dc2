"""Weighted keyword relevance."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from feedloom.functions.binding import let
from feedloom.functions.text import text_or_empty


@dataclass(frozen=True)
class Keywords:
    """Phrases of one tier with their weight in the title and, failing that, in the summary."""

    phrases: tuple[str, ...]
    title: int
    summary: int


# Phrases and weights of the four tiers, and the phrases of the topic flag.
SECONDARY = Keywords(("coding assistant", "ai pair programming", "code generation"), 30, 20)
TERTIARY = Keywords(("generative ai", "llm", "large language model", "ai coding"), 15, 10)
COMPETITORS = Keywords(("github copilot", "anthropic claude", "openai", "gpt", "bard", "gemini"), 25, 15)
WORKFLOW_PRESET = (Keywords(("amazon q", "q developer", "codewhisperer"), 50, 30), SECONDARY, TERTIARY, COMPETITORS)
DIGEST_PRESET = (
    Keywords(("amazon q", "q developer", "codewhisperer", "kiro"), 50, 30), SECONDARY, TERTIARY, COMPETITORS,
)
TOPIC_PHRASES = (
    "amazon q", "q developer", "coding assistant", "ai pair programming", "code generation", "code completion",
    "ai coding", "generative ai", "llm", "large language model", "codewhisperer", "copilot",
)


def contains_any(c: Column, phrases) -> Column:
    """True when lower-cased text contains one of the phrases, also inside a word."""
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(p)) for p in phrases])


def score_lowered(title: Column, summary: Column, preset=WORKFLOW_PRESET) -> Column:
    """Score of lower-cased, non-null text: a phrase counts once, in the title before the summary."""
    hits = [
        F.when(F.contains(title, F.lit(p)), tier.title).when(F.contains(summary, F.lit(p)), tier.summary).otherwise(0)
        for tier in preset
        for p in tier.phrases
    ]
    return F.least(reduce(add, hits), F.lit(100))


def relevance_score(title, summary, preset=WORKFLOW_PRESET) -> Column:
    """Relevance from 0 to 100. Each text is lower-cased once, also where a filter repeats the expression."""
    return let(
        F.struct(F.lower(text_or_empty(title)).alias("t"), F.lower(text_or_empty(summary)).alias("s")),
        lambda texts: score_lowered(texts["t"], texts["s"], preset),
    )


def with_lowered(df: DataFrame) -> DataFrame:
    """Add lower-cased title and summary once, for several keyword tests on the same row."""
    return df.withColumns(
        {"title_lc": F.lower(text_or_empty("title")), "summary_lc": F.lower(text_or_empty("summary"))}
    )


def with_relevance(df: DataFrame, preset=WORKFLOW_PRESET) -> DataFrame:
    """Add ``relevance_score``."""
    return df.withColumn("relevance_score", relevance_score("title", "summary", preset))


def is_on_topic(title, summary, phrases=TOPIC_PHRASES) -> Column:
    """True when the title or the summary contains a topic phrase."""
    return contains_any(F.lower(text_or_empty(title)), phrases) | contains_any(
        F.lower(text_or_empty(summary)), phrases
    )


def mentions_competitor(title, summary, phrases=COMPETITORS.phrases) -> Column:
    """True when title, blank and summary taken together contain a phrase, even across the seam."""
    joined = F.concat_ws(" ", F.lower(text_or_empty(title)), F.lower(text_or_empty(summary)))
    return contains_any(joined, phrases)
