from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.catalog.base import AS_OF
from feedloom.operators import dedup
from feedloom.plans import curation

ROWS = [
    (0, "a release of the parser with long notes", "http://h/0", "2024-01-15 10:00:00", "view"),
    (1, "a release of the parser with long notes", "http://h/0", "2024-01-02 10:00:00", "view"),  # falls to 0
    (2, "an old story that nobody repeats", "http://h/2", "2023-11-30 10:00:00", "view"),
    (3, "an old story that nobody repeats", "http://h/2", "2023-11-29 10:00:00", "view"),  # falls to 2
    (4, "news about llm tools without a date", "http://h/4", None, "view"),
    (5, "news about llm tools without a date", "http://h/4", "2024-01-15 12:00:00", "view"),  # falls to 4
    (6, "just two days old and no copy", "http://h/6", "2024-01-14 00:00:00", "view"),
    (7, "a second too old for this run", "http://h/7", "2024-01-13 23:59:59", "view"),
    (8, "another category holds this one", "http://h/8", "2024-01-15 08:00:00", "click"),
    (9, "another category holds this one", "http://h/8", "2024-01-15 07:00:00", "view"),  # falls to 8
]


def test_curate_deduplicates_the_whole_table(spark, monkeypatch):
    """Rows of any age reach deduplication; those shown are recent, of the category, and kept."""
    held = []

    def deduplicate(items, as_of, **options):
        held.extend(r.ord for r in items.select("ord").collect())
        return dedup.deduplicate(items, as_of, **options)

    found = spark.createDataFrame(ROWS, "ord long, title string, link string, at string, category string")
    found = found.withColumn("summary", F.lit("")).withColumn("published_ts", F.to_timestamp("at"))
    monkeypatch.setattr(curation, "deduplicate", deduplicate)
    done = curation.curate({"rss": found}, AS_OF, curation.Options(category="view"))
    assert sorted(r.ord for r in done.collect()) == [0, 6]
    assert sorted(held) == [r[0] for r in ROWS]
