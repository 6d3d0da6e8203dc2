from __future__ import annotations

import datetime as dt

import pytest

from feedloom.operators import digest

AS_OF = dt.datetime(2024, 1, 16)
FIELDS = "ord long, title string, link string, summary string, published string, published_ts timestamp, " \
         "source string, category string, author string"


def frame(spark, rows):
    full = []
    for i, (title, summary, category, day, author) in enumerate(rows):
        at = dt.datetime(2024, 1, day, tzinfo=dt.timezone.utc)
        full.append((i, title, f"http://h/{i}", summary, at.strftime("%Y-%m-%dT%H:%M:%S"), at, "src", category, author))
    return spark.createDataFrame(full, FIELDS)


ROWS = [
    ("Old <news>", "plain", "b-side", 1, "Unknown"),
    ("New {{news}}", "<p>kept</p><script>gone</script>", "b-side", 2, "Ann & Co"),
    ("Amazon Q ships", "", "a", 3, None),
    ("GPT rival", None, "a", 4, "Bob"),
]

TEXT = """YOUR DAILY CONTENT DIGEST
Tuesday, January 16, 2024
============================================================

AMAZON Q & CODING ASSISTANT HIGHLIGHTS
----------------------------------------
* Amazon Q ships [Relevance: 50]
  Source: src
  Published: Jan 03, 2024
  Link: http://h/2


COMPETITIVE AWARENESS
----------------------------------------
* GPT rival
  Source: src
  Published: Jan 04, 2024
  By: Bob
  Link: http://h/3


GENERAL INDUSTRY NEWS
----------------------------------------
B-SIDE
* New {{news}}
  Source: src
  Link: http://h/1

* Old <news>
  Source: src
  Link: http://h/0


A
* GPT rival
  Source: src
  Link: http://h/3


============================================================
This digest was generated by feedloom."""


def test_text_digest(spark):
    assert digest.text_digest(frame(spark, ROWS), AS_OF).first().digest == TEXT


def test_text_digest_limits(spark):
    short = digest.text_digest(frame(spark, ROWS), AS_OF, 2).first().digest
    assert "* New {{news}}" in short and "* Old <news>" not in short
    headings_only = digest.text_digest(frame(spark, ROWS), AS_OF, 1).first().digest
    assert "B-SIDE\n\nA\n\n====" in headings_only


def test_empty_digests(spark):
    empty = frame(spark, ROWS).limit(0)
    assert digest.text_digest(empty, AS_OF).first().digest.count("\n") == 5
    assert "category-section" not in digest.html_digest(empty, AS_OF).first().digest


def test_html_digest(spark):
    page = digest.html_digest(frame(spark, ROWS), AS_OF).first().digest
    assert page.index("B-Side") < page.index(">A</div>")
    assert page.index("New &amp;#123;&amp;#123;news&amp;#125;&amp;#125;") < page.index("Old &lt;news&gt;")
    assert '<div class="item-summary"><p>kept</p></div>' in page and "gone" not in page
    assert "Published: Jan 02, 2024 | By: Ann &amp; Co<" in page and "Unknown" not in page
    assert "Tuesday, January 16, 2024" in page


@pytest.mark.parametrize("n", [1, 3])
def test_html_digest_limit(spark, n):
    many = frame(spark, [(f"t{i}", "", f"c{i % 2}", 1 + i, None) for i in range(10)])
    page = digest.html_digest(many, AS_OF, n).first().digest
    assert page.count('<div class="content-item">') == 2 * n and ">t9<" in page


def test_lexical_order(spark):
    mixed = frame(spark, ROWS[:2])
    first = lambda **o: digest.digest_rows(mixed, 1, **o).first().ord
    assert first() == first(lexical=True) == 1


def test_input_is_read_once(spark, tmp_path):
    path = str(tmp_path / "items")
    frame(spark, ROWS).write.parquet(path)
    items = spark.read.parquet(path)
    for page in (digest.html_digest(items, AS_OF), digest.text_digest(items, AS_OF)):
        assert page._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
