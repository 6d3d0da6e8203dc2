"""Repository events (landed API payloads) to items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from feedloom.clock import days_before, instant
from feedloom.functions.dates import parse_published
from feedloom.functions.text import text_or_empty

_STRING = T.StringType()
_ACTOR = T.StructType([T.StructField("login", _STRING)])


def _schema(texts: str, *more: T.StructField) -> T.StructType:
    """Payload fields plus the repository columns every event carries."""
    names = [*texts.split(), "repo_name", "category"]
    return T.StructType([T.StructField("ord", T.LongType()), *[T.StructField(n, _STRING) for n in names], *more])


RELEASE = _schema(
    "id name tag_name body html_url published_at",
    T.StructField("draft", T.BooleanType()), T.StructField("author", _ACTOR),
)
PULL_REQUEST = _schema(
    "id title body html_url state merged_at updated_at created_at", T.StructField("user", _ACTOR)
)
ISSUE = _schema(
    "id title body html_url state updated_at created_at", T.StructField("user", _ACTOR),
    T.StructField("pull_request", T.StructType([T.StructField("url", _STRING)])),
)
COMMIT = _schema(
    "sha html_url",
    T.StructField(
        "commit",
        T.StructType(
            [
                T.StructField("message", _STRING),
                T.StructField("author", T.StructType([T.StructField("date", _STRING), T.StructField("name", _STRING)])),
            ]
        ),
    ),
    T.StructField("author", _ACTOR),
)


def _item(kind: str, key: str, title: Column, summary: Column, published: str, author: Column, as_of) -> list[Column]:
    return [
        F.col("ord"),
        F.concat(F.lit(f"github-{kind}-"), F.col(key)).alias("id"),
        title.alias("title"),
        F.col("html_url").alias("link"),
        summary.alias("summary"),
        F.col(published).alias("published"),
        parse_published(published).alias("published_ts"),
        F.concat(F.lit("GitHub - "), F.col("repo_name")).alias("source"),
        F.coalesce("category", F.lit("github")).alias("category"),
        F.lit(f"github_{kind}").alias("content_type"),
        author.alias("author"),
        instant(as_of).alias("fetched_at"),
    ]


def _login(actor: str) -> Column:
    return F.coalesce(F.col(f"{actor}.login"), F.lit("Unknown"))


def _filled(c: str) -> Column:
    return text_or_empty(c) != ""


def _updated_since(as_of, days: int) -> Column:
    return (parse_published("updated_at") >= days_before(as_of, days)) & _filled("created_at")


def releases(events: DataFrame, as_of) -> DataFrame:
    """Published, non-draft releases."""
    final = events.filter(~F.coalesce("draft", F.lit(False)) & _filled("published_at"))
    title = F.concat(F.lit("Release "), F.coalesce("name", "tag_name", F.lit("")))
    return final.select(*_item("release", "id", title, text_or_empty("body"), "published_at", _login("author"), as_of))


def pull_requests(events: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Pull requests updated within ``days``, dated by creation, with their status in the title."""
    status = F.when(_filled("merged_at"), "merged").otherwise(F.coalesce("state", F.lit("open")))
    title = F.concat(F.lit("PR: "), text_or_empty("title"), F.lit(" ("), status, F.lit(")"))
    return events.filter(_updated_since(as_of, days)).select(
        *_item("pr", "id", title, text_or_empty("body"), "created_at", _login("user"), as_of)
    )


def issues(events: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Issues proper (no pull requests) updated within ``days``."""
    title = F.concat(F.lit("Issue: "), text_or_empty("title"), F.lit(" ("), text_or_empty("state"), F.lit(")"))
    return events.filter(F.col("pull_request").isNull() & _updated_since(as_of, days)).select(
        *_item("issue", "id", title, text_or_empty("body"), "created_at", _login("user"), as_of)
    )


def commits(events: DataFrame, as_of, days: int = 3) -> DataFrame:
    """Commits since ``days`` ago; the title is the first line of the message, cut at 60 characters."""
    dated = events.withColumn("committed", F.col("commit.author.date"))
    line = F.substring_index(text_or_empty("commit.message"), "\n", 1)
    cut = F.when(F.length(line) > 60, F.concat(F.substring(line, 1, 60), F.lit("..."))).otherwise(line)
    author = F.coalesce("author.login", "commit.author.name", F.lit("Unknown"))
    return dated.filter(parse_published("committed") >= days_before(as_of, days)).select(
        *_item("commit", "sha", F.concat(F.lit("Commit: "), cut), text_or_empty("commit.message"), "committed",
               author, as_of)
    )


def repository_activity(parts: list[DataFrame], repositories: DataFrame | None = None) -> DataFrame:
    """Union of event items, newest first inside each repository, repositories in configuration order.

    Without ``repositories(source, source_ord)`` they are ordered by name.
    """
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    newest = [F.col("published_ts").desc_nulls_last(), F.col("content_type").desc(), F.col("ord")]
    if repositories is None:
        return both.orderBy("source", *newest)
    return both.join(repositories.select("source", "source_ord"), "source").orderBy("source_ord", *newest)
