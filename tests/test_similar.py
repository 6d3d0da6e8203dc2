"""The similarity join loses no pair that the ratio accepts, and leaves few others."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from feedloom.catalog.base import AS_OF
from feedloom.functions.similarity import character_bound, reaches
from feedloom.operators import dedup
from feedloom.operators.similar import _marks, candidate_pairs, segment_pairs

LETTERS = "e" * 12 + "t" * 9 + "a" * 8 + "o" * 7 + "i" * 7 + "n" * 7 + "s" * 6 + "h" * 6 + "r" * 6 + "dlcumwfgypbvkxjqz"


def text_of(pick, n):
    words = []
    while sum(map(len, words)) + len(words) < n:
        words.append("".join(pick.choice(LETTERS) for _ in range(pick.randint(1, 9))))
    return " ".join(words)[:n]


def edited(pick, text, share):
    chars = list(text)
    for _ in range(int(len(chars) * share)):
        at = pick.randrange(len(chars) + 1)
        if pick.random() < 0.5 and chars:
            del chars[min(at, len(chars) - 1)]
        else:
            chars.insert(at, pick.choice(LETTERS + "é中 "))
    return "".join(chars)


@pytest.mark.parametrize("threshold", [0.6, 0.85, 0.95, 1.0])
def test_no_similar_pair_is_lost(spark, threshold):
    pick = random.Random(int(threshold * 100))
    later = [text_of(pick, pick.choice([1, 2, 3, 5, 9, 20, 45, 199, 200, 260, 700])) for _ in range(45)]
    later += ["a" * 50, "ab" * 30, "é" * 220, "中文" * 3, "", "x y" * 90]
    kept = []
    for text in later:
        for share in (0, 0.01, 0.03, 0.06, 0.1, 0.16, 0.25, 0.4):
            kept.append(edited(pick, text, share))
        kept.append(text[len(text) // 20:] + text[:len(text) // 20])
    rows = lambda texts, extra=(): [(i, "k", *extra, t) for i, t in enumerate(texts)]
    got = candidate_pairs(
        spark.createDataFrame(rows(later), "ord long, key string, text string"),
        spark.createDataFrame(rows(kept, (threshold,)), "ord long, key string, threshold double, text string"),
    ).collect()
    found = {(r.later_ord, r.kept_ord) for r in got}
    assert len(found) == len(got)
    want = {(i, j) for i, a in enumerate(later) for j, b in enumerate(kept) if reaches(a, b, threshold)}
    assert want <= found
    # At the thresholds in use few others are left of those that lengths alone would leave.
    by_length = sum(2 * min(len(a), len(b)) >= threshold * (len(a) + len(b)) for a in later for b in kept)
    if threshold >= 0.85:
        assert len(found) - len(want) < 0.25 * (by_length - len(want))


def titled(n, seed=1):
    """``n`` kept items of equally long titles within a day, and pairs that share a fingerprint but don't resemble."""
    pick = random.Random(seed)
    rows = [(i, text_of(pick, 45), "", f"http://h{i % 7}/{i}", "2024-01-10 00:00:00") for i in range(n)]
    for k in range(10):
        title = text_of(pick, 25)
        rows += [(n + 2 * k + j, f"<{letter * 30}>{title}"[:60], "", f"http://s/{k}/{j}", "2024-01-10 00:00:00") for j, letter in enumerate("kz")]
    return rows


def pairs_of(spark, rows):
    items = spark.createDataFrame(rows, "ord long, title string, summary string, link string, published string").withColumn(
        "published_ts", F.to_timestamp("published"))
    keys = dedup.stage(dedup.key_table(items, AS_OF), "test-keys")
    suspects = dedup.stage(dedup._suspects(keys, spark.createDataFrame([], "ord long")).select(*dedup.PARTNER), "test-suspects")
    partners = keys.select(*dedup.PARTNER).unionByName(dedup.linkless_rows(items, AS_OF))
    pairs = dedup.outside_pairs(items, suspects, partners, dedup.rule_of())
    return suspects.count(), pairs.count()


def test_pairs_stay_few_when_the_table_grows(spark):
    """Ten times the rows with equally long titles on the same day: no more pairs are compared."""
    few, many = pairs_of(spark, titled(300)), pairs_of(spark, titled(3000))
    assert few[0] == many[0] == 10
    # The suspects' own titles begin alike; nothing else is left.
    assert many[1] <= few[1] + 3 <= 60


def test_a_common_beginning_is_no_hot_key(spark):
    """All rows share half of their title; rows are looked up under what is rare in them."""
    pick = random.Random(5)
    rows = [(i, f"weekly digest of the news: {text_of(pick, 30)}", "", f"http://h/{i}", "2024-01-10 00:00:00") for i in range(2000)]
    for k in range(10):
        title = text_of(pick, 25)
        rows += [(2000 + 2 * k + j, f"<{letter * 30}>{title}"[:60], "", f"http://s/{k}/{j}", "2024-01-10 00:00:00") for j, letter in enumerate("kz")]
    suspects, pairs = pairs_of(spark, rows)
    assert suspects == 10 and pairs <= 60


def test_character_bound(spark):
    pick = random.Random(8)
    texts = [text_of(pick, n) for n in (1, 5, 30, 60) for _ in range(8)] + ["", "aab", "中中a", "🙂🙂b"]
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    for r in pairs.withColumn("bound", character_bound(F.col("a"), F.col("b"))).collect():
        assert r.bound == pytest.approx(SequenceMatcher(None, r.a, r.b).quick_ratio() if r.a and r.b else 0.0)


@pytest.mark.parametrize("threshold", [0.8, 0.85, 0.95, 1.0])
def test_no_pair_is_lost_by_segments(spark, threshold):
    pick = random.Random(int(threshold * 1000))
    texts = ["a" * 50, "ab" * 30, "é" * 220, "中文" * 3, "x y" * 90, "🙂🙂b🙂"]
    for n in [1, 2, 3, 5, 9, 20, 45, 60, 99, 100, 110, 199, 200, 260]:
        text = text_of(pick, n)
        texts += [edited(pick, text, share) for share in (0, 0.01, 0.03, 0.05, 0.09, 0.14, 0.2)] + [text[n // 20:] + text[:n // 20]]
    texts = sorted({t for t in texts if t})
    got = segment_pairs(spark.createDataFrame(list(enumerate(texts)), "ord long, text string"), threshold).collect()
    found = {(r.later_ord, r.kept_ord) for r in got}
    assert len(found) == len(got)
    assert {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i != j and reaches(a, b, threshold)} <= found


def test_titles_of_common_words_meet_in_few_pairs(spark):
    """Titles of 40 words share their segments with many others; of the pairs that meet, few are left beside the similar ones."""
    pick = random.Random(11)
    words = [text_of(pick, n).replace(" ", "e") for n in range(3, 11) for _ in range(5)]
    texts = [" ".join(pick.choice(words) for _ in range(20))[:100] for _ in range(1500)]
    texts += [edited(pick, text, share) for text in texts[:60] for share in (0.01, 0.03, 0.05)]
    texts = sorted(set(texts))
    found = {(r.later_ord, r.kept_ord) for r in segment_pairs(spark.createDataFrame(list(enumerate(texts)), "ord long, text string"), 0.95).collect()}
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i != j and reaches(a, b, 0.95)}
    assert want <= found and len(found) <= len(want) + 0.2 * len(texts)


def test_an_edit_changes_one_mark(spark):
    pick = random.Random(12)
    rows = []
    for _ in range(200):
        text, edits = text_of(pick, pick.randint(1, 130)), pick.randint(0, 12)
        other = text
        for _ in range(edits):
            at = pick.randrange(len(other) + 1)
            other = other[:at] + (pick.choice(LETTERS + "é中🙂 ") + other[at:] if pick.random() < 0.5 else other[at + 1:])
        rows.append((text, other, edits))
    marks = spark.createDataFrame(rows, "a string, b string, edits int").select(_marks(F.col("a")).alias("a"), _marks(F.col("b")).alias("b"), "edits")
    differing = [(bin((r.a ^ r.b) & (1 << 64) - 1).count("1"), r.edits) for r in marks.collect()]
    assert all(bits <= edits for bits, edits in differing) and any(bits > 6 for bits, _ in differing)
