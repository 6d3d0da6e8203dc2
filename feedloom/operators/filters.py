"""Row filters and boolean columns. All are narrow: no operator here shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from feedloom.clock import days_before
from feedloom.functions.text import holds_at_least, text_or_empty
from feedloom.session import stage

RELEVANT = 30


def by_category(df: DataFrame, category: str) -> DataFrame:
    """Exact, case-sensitive category; a missing category never matches."""
    return df.filter(F.col("category") == category)


def recent(df: DataFrame, as_of, days) -> DataFrame:
    """Rows published at or after ``as_of`` minus ``days``; undated rows are dropped, future rows stay."""
    return df.filter(F.col("published_ts") >= days_before(as_of, days))


def recent_capped(df: DataFrame, as_of, days: int, cap: int = 2) -> DataFrame:
    """``recent`` with an upper limit on the days."""
    return recent(df, as_of, min(days, cap))


def maybe_recent(df: DataFrame, as_of, days) -> DataFrame:
    """Pre-filter that is safe below deduplication: keeps undated rows, which count as newest there."""
    return df.filter(F.col("published_ts").isNull() | (F.col("published_ts") >= days_before(as_of, days)))


def search(df: DataFrame, query: str) -> DataFrame:
    """Case-insensitive substring in the title or the summary."""
    needle = F.lit(query.lower())
    return df.filter(
        F.contains(F.lower(text_or_empty("title")), needle) | F.contains(F.lower(text_or_empty("summary")), needle)
    )


def valid_items(df: DataFrame) -> DataFrame:
    """Rows with a title and an http or https link."""
    return df.filter((F.col("title") != "") & F.col("link").rlike("^https?://"))


def relevant(df: DataFrame) -> DataFrame:
    """Scored rows at or above the relevance threshold."""
    return df.filter(F.col("relevance_score") >= RELEVANT)


def not_relevant(df: DataFrame) -> DataFrame:
    """Scored rows below the relevance threshold."""
    return df.filter(F.col("relevance_score") < RELEVANT)


def _blank(c: str) -> Column:
    return text_or_empty(c) == ""


def needs_summary(min_length: int = 50, min_score: float = 0.1, missing_score: float = 1.0) -> Column:
    """No summary yet, a description of some length, a score that is not too low."""
    score = F.coalesce(F.col("relevance_score").cast("double"), F.lit(missing_score))
    return (
        _blank("summary") & _blank("ai_summary")
        & (F.length(text_or_empty("description")) >= min_length) & (score >= min_score)
    )


def needs_summary_strict() -> Column:
    """Stricter gate: 200 characters of description, score 0.3, a missing score counts as zero."""
    score = F.coalesce(F.col("relevance_score").cast("double"), F.lit(0.0))
    return (F.length(text_or_empty("description")) >= 200) & _blank("summary") & (score >= 0.3)


def batch_gate(df: DataFrame, needs: Column, gate: str = "any", batch: str = "batch_index") -> DataFrame:
    """Add ``eligible``: with ``any``, one needy member opens its whole batch; with ``whole``, it opens the whole
    input; with ``row``, each row decides.

    The window is bounded by the batch size, so no key can grow hot. The whole input is a scalar aggregate over a stage
    table, so what leads to it is computed once.
    """
    if gate == "row":
        return df.withColumn("eligible", needs)
    if gate == "whole":
        df = stage(df, "gated")
        return df.withColumn("eligible", df.agg(F.coalesce(F.bool_or(needs), F.lit(False))).scalar())
    return df.withColumn("eligible", F.bool_or(needs).over(Window.partitionBy(batch)))


def summary_route(content: str = "summary", link: str = "link") -> Column:
    """Where a summary would come from: ``content``, ``url``, or null for neither."""
    long_enough = holds_at_least(text_or_empty(content), 100)
    return F.when(
        _blank("generated_summary"), F.when(long_enough, "content").when(~_blank(link), "url")
    )
