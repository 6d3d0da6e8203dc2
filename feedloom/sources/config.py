"""Source configuration documents as small dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def _rows(*names: str) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in names]))


CONFIG = T.StructType(
    [
        T.StructField("rss_feeds", _rows("name", "url", "category")),
        T.StructField("github_repositories", _rows("name", "owner", "repo", "category")),
        T.StructField("youtube_channels", _rows("name", "channel_id", "username", "category")),
        T.StructField("linkedin_profiles", _rows("name", "url", "category")),
    ]
)


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """The configuration document, one row."""
    return spark.read.schema(CONFIG).option("multiLine", True).json(path)


def section(config: DataFrame, name: str) -> DataFrame:
    """One array of the configuration as rows, with its position as ``source_ord``."""
    rows = config.select(F.posexplode(name).alias("source_ord", "row"))
    return rows.select("source_ord", "row.*")


def valid_feeds(feeds: DataFrame) -> DataFrame:
    """Feeds with a name, an http(s) URL and a category, the texts within their length limits."""
    filled = (F.col("name") != "") & (F.col("url") != "") & (F.col("category") != "")
    return feeds.filter(
        filled & F.col("url").rlike("^https?://") & (F.length("name") <= 100) & (F.length("category") <= 50)
    )
