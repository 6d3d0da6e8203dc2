from __future__ import annotations

import datetime as dt
import hashlib
import re
from urllib.parse import parse_qs, urlparse

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from feedloom.functions import dates, html, scoring, text, urls

AS_OF = dt.datetime(2024, 1, 16)


# --- URLs --------------------------------------------------------------------------------------------


def comparable(url: str) -> str:
    """Normal form by the standard library's URL parser."""
    try:
        parts = urlparse(url)
        params = {k: v for k, v in parse_qs(parts.query).items() if k.lower() not in urls.TRACKING_KEYS}
    except ValueError:
        return url
    out = f"{parts.scheme}://{parts.netloc}{parts.path}"
    return out + ("?" + "&".join(f"{k}={v[0]}" for k, v in params.items()) if params else "")


URLS = [
    "https://u:p@h.com:80/a;x/b;y=1?z=1#f", "http://h/p?a=&b=1", "http://h/p?q=1&q=2", "HTTP://H/p?UTM_Source=x&k=%C3%A9",
    "http://h/p?x=%zz%20a", "http://h/p?x=a=b", "http://h/p#f?x=1", "foo/bar;p?x=1", "", "http://[h/p?x=1",
    "http://h/p?a+b=c+d&=v&&n", "//h/p", "1x://h/p", "a;b/c;d?e=f", "http://h?x=1", "mailto:x;y?z=1",
    "http://h/p?ref=1&fbclid=2", "http://h/a b?c d=e f", "http://h/é?ü=ß",
]


def test_normalise_url(evaluate):
    assert evaluate(urls.normalise_url, URLS) == [comparable(u) for u in URLS]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="abAZ/:?#&=;%+.2 Cé@", max_size=30).map(lambda t: "http://h/" + t), min_size=40, max_size=40))
def test_normalise_any_url(evaluate, many):
    many = [u.strip() for u in many]
    assert evaluate(urls.normalise_url, many) == [comparable(u) for u in many]


def test_netloc(evaluate):
    got = evaluate(urls.netloc, ["https://u:p@h.com:80/x", "//h/x", "h/x", "", None])
    assert got == ["u:p@h.com:80", "h", "", "", ""]


def test_absolute_link(evaluate):
    assert evaluate(urls.absolute_link, ["/in/x", "http://h/", ""]) == ["https://www.linkedin.com/in/x", "http://h/", ""]


# --- dates -------------------------------------------------------------------------------------------

DATES = {
    "2024-01-15T10:00:00Z": "2024-01-15 10:00:00", "2024-01-15T10:00:00": "2024-01-15 10:00:00",
    "2024-01-15T10:00:00.5+0530": "2024-01-15 04:30:00", "2024-01-15T10:00": "2024-01-15 10:00:00",
    "2024-01-15T10": "2024-01-15 10:00:00", "2024-01-15T10:00:00-05:00": "2024-01-15 15:00:00",
    "Tue, 16 Jan 2024 10:00:00 +0000": "2024-01-16 10:00:00", "Thu, 18 Jan 2024 1:02:03 GMT": "2024-01-18 01:02:03",
    "Mon, 15 Jan 2024 10:00:00 -0800": "2024-01-15 18:00:00", "2024-01-15 10:00:00": "2024-01-15 10:00:00",
    "15 Jan 2024 10:00:00": "2024-01-15 10:00:00", "2024/01/15 10:00:00": "2024-01-15 10:00:00",
    "2024-01-15T99:00:00": "2024-01-15 00:00:00", "2024-02-30T10:00:00": None, "2024-01-15": None, "": None,
    "junk": None, "Mon, 15 Foo 2024 10:00:00 +0000": None, "T10:00:00": None, "2024-1-1T10:00:00": None,
}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_parse_published(spark, evaluate, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        shown = lambda c: F.date_format(
            F.to_utc_timestamp(dates.parse_published(c), F.current_timezone()), "yyyy-MM-dd HH:mm:ss"
        )
        assert evaluate(shown, list(DATES)) == list(DATES.values())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_format_dates(evaluate):
    values = ["2024-01-02T23:00:00-05:00", "2024-01-02", "2024-01-02 10:00:00", "2024-01-02T99:00:00",
              "Tue, 02 Jan 2024 10:00:00 +0000", "soon", "", None]
    assert evaluate(dates.format_digest_date, values) == [
        "Jan 02, 2024", "Jan 02, 2024", "Jan 02, 2024", "2024-01-02T99:00:00", "Tue, 02 Jan 2024 10:00:00 +0000",
        "soon", "", None,
    ]
    assert evaluate(dates.format_date, values) == [
        "Jan 02, 2024", "2024-01-02", "Jan 02, 2024", "2024-01-02T99:00:00", "Jan 02, 2024", "soon", "", "",
    ]


AGES = {  # strict, reference
    "3h": (3, 3), "2d": (48, 48), "1w": (168, 168), "4mo": (2880, 2880), "1y": (8760, 8760), "now": (0, 0),
    "1w • Edited": (168, 24), "3 months": (2160, 3), "yesterday": (0, 0), "": (0, 0), "1d 2h": (24, 12),
}


@pytest.mark.parametrize("mode", ["strict", "reference"])
def test_relative_age(evaluate, mode):
    hours = lambda c: (
        F.unix_seconds(dates.instant(AS_OF)) - F.unix_seconds(dates.relative_age(c, AS_OF, mode))
    ) / 3600
    assert evaluate(hours, list(AGES)) == [float(a[mode == "reference"]) for a in AGES.values()]


# --- text --------------------------------------------------------------------------------------------


def words(value: str) -> str:
    value = re.sub(r"[^\w\s]", "", re.sub(r"<[^>]+>", "", value.lower()))
    return " ".join(w for w in value.split() if w not in text.STOP_WORDS)


def test_process_text(evaluate):
    values = ["the and of", "co-op Now", "<b>a</b>b", "Élan vital, déjà-vu!", "a\tb\n\nc\u00a0d\u2003e", "x_1 2² ٣", "", "it's (the) END…",
              "plain ascii\x1cwords,here"]
    assert evaluate(text.process_text, values) == [words(v) for v in values]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="aB é-<>/.!\t\n_1\u00a0ñ", max_size=40), min_size=40, max_size=40))
def test_process_any_text(evaluate, many):
    assert evaluate(text.process_text, many) == [words(v) for v in many]


def test_sanitise_and_strip(evaluate):
    assert evaluate(text.sanitise_text, [" \u00a0x \n", None, "y" * 5001, "   "]) == ["x", "", "y" * 5000 + "...", ""]


def test_truncate(evaluate):
    values = ["x" * 200, "x" * 201, "<b></b>", "<b>short</b>", "y" * 199 + "  z", None]
    assert evaluate(text.truncate_html, values) == [
        "x" * 200, "x" * 200 + "...", "<b></b>", "<b>short</b>", "y" * 199 + "...", "",
    ]
    assert evaluate(text.truncate_text, values)[1:3] == ["x" * 200 + "...", "<b></b>"]


def test_clean_and_escape(evaluate):
    assert evaluate(text.clean_html, ["a<script>x\ny</script>b<SCRIPT>z</SCRIPT><iframe src=q></iframe>", None]) == [
        "ab<SCRIPT>z</SCRIPT>", "",
    ]
    assert evaluate(text.escape_template, ["{{a}} {% b %}"]) == ["&#123;&#123;a&#125;&#125; &#123;% b %&#125;"]
    assert evaluate(text.escape_html, ["<a href=\"x\">'&'</a>"]) == ["&lt;a href=&#34;x&#34;&gt;&#39;&amp;&#39;&lt;/a&gt;"]
    assert evaluate(text.title_case, ["AI coding-ASSISTANTS (new [x])"]) == ["Ai Coding-Assistants (New [X])"]


PAGES = [
    "<p>a <b>b</b>c</p><script>x</script>d", "x  y\t z\n q", "&lt;b&gt; &#169; &#x1F600; &amp;lt; &bogus; &nbsp;",
    "<!-- c -->t<style>p</style>", "a < b and c > d", "<p>one<br>two<p>three   four", "<a href='x'>&copy; me</a>", "",
    "<div>unclosed <b>bold", "<script>never closed", "a&amp b&ampc &ampamp; &amp;amp &#65 &#x41;&#66;", "&lt", "x &#; &#xzz;",
]


def test_html_to_text_both_ways(evaluate):
    native, parsed = evaluate(text.html_to_text, PAGES), evaluate(html.page_text, PAGES)
    assert native == parsed
    assert native[0] == "a b c d" and native[2] == "<b> © 😀 &lt; &bogus;" and native[5] == "one two three four"


def test_prepare_and_fallback(evaluate):
    assert evaluate(text.prepare_for_summary, [" <p>x</p>", "x > y", "z" * 8001, None]) == ["x", "x > y", "z" * 8000 + "...", ""]
    assert evaluate(text.fallback_summary, ["short", "l" * 151, None, " " * 200]) == ["short", "l" * 150 + "...", "", " " * 200]


def test_prompt(evaluate):
    chat = evaluate(lambda c: text.summary_prompt(c, "anthropic.claude-v2", 100), ["X"])[0]
    assert chat.startswith("Human: Please summarize the following content in about 10-20 words. Focus")
    assert chat.endswith("takeaways:\n            \n            X\n            \n            Assistant:")
    assert evaluate(text.summary_prompt, ["X"])[0].startswith("Summarize the following content in about 15-30 words:\n")


def test_small_functions(evaluate):
    assert evaluate(text.byline, ["Ann", "Unknown", "", None]) == ["Ann", None, None, None]
    assert evaluate(text.safe_file_name, ['a/b:c*?"<>|\\d', "../x", "n" * 300]) == ["a_b_c_______d", "__x", "n" * 255]
    assert evaluate(text.scrub_control, ["a\nb\x7f", None]) == ["a b ", "None"]
    assert evaluate(text.content_hash, ["é"]) == [hashlib.md5("é".encode()).hexdigest()]
    assert evaluate(text.valid_email, [" a.b@c.org ", "a@b", "x" * 250 + "@c.org", None, "a@b.co\n"]) == [
        "a.b@c.org", None, None, None, "a@b.co",
    ]


# --- scoring -----------------------------------------------------------------------------------------


def scores(spark, rows, preset):
    df = spark.createDataFrame(rows, "title string, summary string")
    return [r[0] for r in df.select(scoring.relevance_score("title", "summary", preset)).collect()]


def test_relevance(spark):
    rows = [
        ("Amazon Q", "amazon q again"), ("x", "codewhisperer"), ("amazon q q developer codewhisperer", ""),
        ("bombard", ""), ("kiro", ""), (None, None), ("LLM", "openai"),
    ]
    assert scores(spark, rows, scoring.WORKFLOW_PRESET) == [50, 30, 100, 25, 0, 0, 30]
    assert scores(spark, rows, scoring.DIGEST_PRESET)[4] == 50


def test_competitor_may_span_fields(spark):
    df = spark.createDataFrame([("github", "copilot"), ("git", "hub copilot"), (None, "GPT")], "title string, summary string")
    assert [r[0] for r in df.select(scoring.mentions_competitor("title", "summary")).collect()] == [True, False, True]
    assert scores(spark, [("github", "copilot")], scoring.WORKFLOW_PRESET) == [0]


def test_topic(spark):
    df = spark.createDataFrame([("My CoPilot", ""), ("x", "code completion"), ("x", None)], "title string, summary string")
    assert [r[0] for r in df.select(scoring.is_on_topic("title", "summary")).collect()] == [True, True, False]


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab\n \t\x1c\x85\xa0\u2028é中🙂", max_size=14) | st.none(), max_size=40))
def test_holds_at_least(evaluate, values):
    values = [*values, None, "", " ", "a", "ab", " abcde ", "a   e", " a   e ", "  🙂🙂🙂🙂  ", "  🙂🙂🙂🙂🙂  ", "a" + " " * 9, "\n\na\n\n\nb\n"]
    want = evaluate(lambda c: F.length(text.strip(c)) >= 5, values)
    assert evaluate(lambda c: text.holds_at_least(c, 5), values) == want
