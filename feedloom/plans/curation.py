"""Composite jobs built from the operators. Each is one lazy chain, apart from deduplication's rounds.

``curate`` deduplicates all that its sources hold. The digest run applies the recency bound twice around deduplication: below
it in the form that keeps undated rows, which is safe because older rows never block newer ones and saves most of a long
history; above it in the strict form. Category and search stay above: a copy in another category may be the one that is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from feedloom.functions.scoring import WORKFLOW_PRESET, with_relevance
from feedloom.operators.dedup import deduplicate
from feedloom.operators.digest import html_digest
from feedloom.operators.filters import by_category, maybe_recent, recent, search
from feedloom.operators.ranking import preview, sort_newest, sort_relevant
from feedloom.operators.summaries import batch_summarise, publish_summaries
from feedloom.operators.unions import rank_order, union_sources
from feedloom.schema import with_published_ts
from feedloom.sources.storage import load_ordered_items, save_digest, save_items


@dataclass(frozen=True)
class Options:
    """Arguments of a run."""

    days: int = 7
    category: str | None = None
    search: str | None = None
    max_items: int = 10
    batch_size: int = 10
    sources: tuple[str, ...] | None = None
    load: str | None = None
    save_root: str | None = None
    run_ts: str = "latest"
    digest_path: str | None = None

    def __post_init__(self) -> None:
        for name, low, high in (("days", 1, 365), ("max_items", 1, 100), ("batch_size", 1, 50)):
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be between {low} and {high}")


def _gather(frames: dict[str, DataFrame], sources) -> DataFrame:
    return rank_order(union_sources(frames, sources))


def _category(df: DataFrame, category: str | None) -> DataFrame:
    return by_category(df, category) if category else df


def _summarisable(df: DataFrame) -> DataFrame:
    """Add the summary columns that the sources do not fill."""
    absent = {"description": "string", "relevance_score": "int", "generated_summary": "string", "ai_summary": "string"}
    return df.withColumns({n: F.lit(None).cast(t) for n, t in absent.items() if n not in df.columns})


def curate(frames: dict[str, DataFrame], as_of, options: Options = Options(), preset=WORKFLOW_PRESET) -> DataFrame:
    """Workflow run: union, deduplicate the whole of it, category, at most two days, score, highest score first."""
    days = min(options.days, 2)
    kept = deduplicate(_gather(frames, options.sources), as_of)
    kept = recent(_category(kept, options.category), as_of, days)
    return sort_relevant(with_relevance(kept, preset))


def ad_hoc(
    spark: SparkSession, frames: dict[str, DataFrame], as_of, options: Options = Options()
) -> dict[str, DataFrame]:
    """Query run: union or load, category, recency, search, save, digest, preview; no deduplication. A record that
    can't be read is an error."""
    found = with_published_ts(load_ordered_items(spark, options.load, refuse=True)) if options.load else _gather(frames, options.sources)
    found = recent(_category(found, options.category), as_of, options.days)
    if options.search:
        found = search(found, options.search)
    if options.save_root:
        save_items(found, options.save_root, options.run_ts)
    digest = html_digest(found, as_of, options.max_items)
    if options.digest_path:
        save_digest(digest, options.digest_path)
    return {"items": found, "digest": digest, "preview": preview(found)}


def digest_run(
    frames: dict[str, DataFrame], as_of, options: Options = Options(days=2), summarise=None, summaries: bool = False
) -> DataFrame:
    """Digest run: union, optional summaries, deduplicate, category, recency, HTML digest, save."""
    gathered = _gather(frames, options.sources)
    if summaries:
        gathered = publish_summaries(batch_summarise(_summarisable(gathered), summarise, gate="whole"))
    gathered = maybe_recent(gathered, as_of, options.days)
    kept = recent(_category(deduplicate(gathered, as_of), options.category), as_of, options.days)
    digest = html_digest(kept, as_of, options.max_items)
    if options.digest_path:
        save_digest(digest, options.digest_path)
    return digest


def aggregate_all(
    frames: dict[str, DataFrame], as_of, options: Options = Options(), dedup: bool = True, summarise=None,
    summaries: bool = False,
) -> DataFrame:
    """Full aggregation: union of the chosen sources, deduplicate, newest first, optional summaries."""
    gathered = _gather(frames, options.sources or ("rss", "github", "linkedin"))
    kept = deduplicate(gathered, as_of) if dedup else gathered
    if summaries:
        kept = batch_summarise(_summarisable(kept), summarise, gate="whole")
    return sort_newest(kept)
