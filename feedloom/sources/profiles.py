"""Profile pages to items."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from feedloom.clock import instant
from feedloom.functions.dates import iso_utc, relative_age
from feedloom.functions.html import PROFILE_POSTS, PostSelectors, page_posts
from feedloom.functions.urls import absolute_link


def profile_posts(
    pages: DataFrame, as_of, selectors: PostSelectors = PROFILE_POSTS,
    host: str = "https://www.linkedin.com", age_mode: str = "strict",
) -> DataFrame:
    """One item per post of ``pages(name, url, category, html)``.

    Posts are numbered while their page is parsed, so no window is needed; ``page_pos`` keeps the number.
    A post without a link takes the page's, and an id made of the name and the number.
    """
    posts = pages.select("name", "url", "category", F.explode(page_posts("html", selectors)).alias("post"))
    link = F.nullif(absolute_link(F.col("post.link"), host), F.lit(""))
    content = F.col("post.content")
    fallback_id = F.concat(F.lit("linkedin-"), F.col("name"), F.lit("-"), F.col("post.pos").cast("string"))
    title = F.when(F.length(content) > 100, F.concat(F.substring(content, 1, 100), F.lit("..."))).otherwise(content)
    at = relative_age(F.col("post.age"), as_of, age_mode)
    return posts.select(
        F.col("post.pos").alias("page_pos"),
        F.coalesce(link, fallback_id).alias("id"),
        title.alias("title"),
        F.coalesce(link, "url").alias("link"),
        content.alias("summary"),
        iso_utc(at).alias("published"),
        at.alias("published_ts"),
        F.concat(F.lit("LinkedIn - "), F.col("name")).alias("source"),
        F.coalesce("category", F.lit("linkedin")).alias("category"),
        F.lit("linkedin").alias("content_type"),
        F.col("name").alias("author"),
        instant(as_of).alias("fetched_at"),
    )
