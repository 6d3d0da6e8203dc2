"""Video listings to items."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from feedloom.clock import days_before
from feedloom.functions.dates import parse_published
from feedloom.functions.text import text_or_empty
from feedloom.operators.ranking import top_per_group


def channel_videos(videos: DataFrame, as_of, per_channel: int = 10, days: int = 30) -> DataFrame:
    """First videos of every channel, of those the ones from the last ``days``; undated ones pass.

    Reads ord, channel_name, category and snippet.{title, description, publishedAt, resourceId.videoId,
    thumbnails.high.url}. The cut per channel comes before the date filter. Channels are taken from the
    playlist in ``ord``.
    """
    first = top_per_group(videos, ["channel_name"], [F.col("ord").asc()], per_channel).drop("rn")
    video_id, published = F.col("snippet.resourceId.videoId"), F.col("snippet.publishedAt")
    shaped = first.filter(text_or_empty(video_id) != "").select(
        "ord",
        video_id.alias("id"),
        F.coalesce("snippet.title", F.lit("No title")).alias("title"),
        F.coalesce("snippet.description", F.lit("No description")).alias("summary"),
        F.concat(F.lit("https://www.youtube.com/watch?v="), video_id).alias("link"),
        published.alias("published"),
        parse_published(published).alias("published_ts"),
        F.concat(F.lit("YouTube - "), F.coalesce("channel_name", F.lit("Unknown Channel"))).alias("source"),
        F.coalesce("category", F.lit("YouTube")).alias("category"),
        F.coalesce("snippet.thumbnails.high.url", F.lit("")).alias("thumbnail"),
    )
    undated = text_or_empty("published") == ""
    return shaped.filter(undated | (F.col("published_ts") >= days_before(as_of, days)))
