"""Sequence similarity: the one scalar Spark has no built-in for, as Arrow-batched UDFs."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


#: ``SequenceMatcher`` looks blocks up under all characters of a text shorter than this, and under the rare ones of others.
AUTOJUNK = 200
#: Common runs of rare characters this long are left to ``SequenceMatcher``, as each length takes a table.
LONGEST_RUN = 64


def _rare_runs(kept: str) -> re.Pattern | None:
    """Finds runs of the characters of ``kept`` under which ``SequenceMatcher`` looks blocks up."""
    most = len(kept) // 100 + 1
    rare = [c for c, times in Counter(kept).items() if times <= most]
    return re.compile(f"[{''.join(map(re.escape, rare))}]+") if rare else None


def _run_tables(later: str, kept: str) -> list[tuple[list[int], list[list[int]]]] | None:
    """For each length of run, where one of that length that is in both texts begins in ``later``, and where in ``kept``.
    None if common runs are too long."""
    runs = _rare_runs(kept)
    if runs is None:
        return []
    places = [(i, m.end()) for m in runs.finditer(later) for i in range(m.start(), m.end())]
    others = [(j, m.end()) for m in runs.finditer(kept) for j in range(m.start(), m.end())]
    tables = []
    for length in range(1, LONGEST_RUN + 1):
        wanted = {later[i:i + length] for i, end in places if i + length <= end}
        found: dict[str, list[int]] = {}
        left = []
        for j, end in others:
            if j + length <= end and (gram := kept[j:j + length]) in wanted:
                found.setdefault(gram, []).append(j)
                left.append((j, end))
        others = left
        places = [(i, end) for i, end in places if i + length <= end and later[i:i + length] in found]
        if not places:
            return tables
        tables.append(([i for i, _ in places], [found[later[i:i + length]] for i, _ in places]))
    return None


def matched_characters(later: str, kept: str) -> int:
    """Characters in the matching blocks that ``SequenceMatcher(None, later, kept)`` finds.

    It takes the longest run of rare characters common to both texts, the earliest of these, widens it by whatever is equal
    beside it, and does the same with what is before and behind. Here runs are looked up by length. What is before the
    earliest run of a length has none of that length and what is behind has none longer, so every table is walked about
    once, where ``SequenceMatcher`` meets all pairs of places of a character anew for each block.
    """
    tables = _run_tables(later, kept) if len(kept) >= AUTOJUNK else None
    if tables is None:
        return sum(block.size for block in SequenceMatcher(None, later, kept).get_matching_blocks())
    total, ranges = 0, [(0, len(later), 0, len(kept), len(tables))]
    while ranges:
        start, end, other_start, other_end, longest = ranges.pop()
        i, j, size = start, other_start, 0
        while longest and not size:
            places, others = tables[longest - 1]
            for at in range(bisect_left(places, start), len(places)):
                if places[at] + longest > end:
                    break
                spots = others[at]
                k = bisect_left(spots, other_start)
                if k < len(spots) and spots[k] + longest <= other_end:
                    i, j, size = places[at], spots[k], longest
                    break
            longest -= not size
        while i > start and j > other_start and later[i - 1] == kept[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < end and j + size < other_end and later[i + size] == kept[j + size]:
            size += 1
        if not size:
            continue
        total += size
        if start < i and other_start < j:
            ranges.append((start, i, other_start, j, max(longest - 1, 0)))
        if i + size < end and j + size < other_end:
            ranges.append((i + size, end, j + size, other_end, longest))
    return total


def ratio(later: str | None, kept: str | None) -> float:
    """Matching-block ratio, that of ``SequenceMatcher``; not symmetric, zero when a side is empty."""
    if not later or not kept:
        return 0.0
    if later == kept:
        return 1.0
    return 2.0 * matched_characters(later, kept) / (len(later) + len(kept))


def reaches(later: str | None, kept: str | None, threshold: float) -> bool:
    """``ratio >= threshold``, asking the cheap upper bounds first."""
    if not later or not kept:
        return 0.0 >= threshold
    if later == kept:
        return 1.0 >= threshold
    both = len(later) + len(kept)
    return (
        2.0 * min(len(later), len(kept)) / both >= threshold
        and 2.0 * (Counter(later) & Counter(kept)).total() / both >= threshold
        and ratio(later, kept) >= threshold
    )


def is_duplicate(later_title, later_summary, title, summary, close, same_site, threshold, alone) -> bool:
    """Similar titles close in time, or similar summaries on one site, or nearly equal titles."""
    if reaches(later_title, title, min(threshold, alone) if close else alone):
        return True
    return bool(same_site) and reaches(later_summary, summary, threshold)


def ratio_bound(later_length: Column, kept_length: Column) -> Column:
    """Upper bound of the ratio from the two lengths; zero when a side is empty."""
    shorter = F.least(later_length, kept_length)
    return F.when(shorter > 0, 2.0 * shorter / (later_length + kept_length)).otherwise(0.0)


def character_bound(later: Column, kept: Column) -> Column:
    """Upper bound of the ratio from the characters that both texts have, repeats counted; zero when a side is empty."""
    times = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    characters = F.array_distinct(F.regexp_extract_all(later, F.lit("(?s)."), F.lit(0)))
    both = F.aggregate(characters, F.lit(0), lambda total, c: total + F.least(times(later, c), times(kept, c)))
    return F.when((later != "") & (kept != ""), 2.0 * both / (F.length(later) + F.length(kept))).otherwise(0.0)


def similarity_ratio(later, kept) -> Column:
    """Similarity of two texts after lower-casing, from 0 to 1."""

    @F.pandas_udf(T.DoubleType())
    def matched(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="float64")

    a, b = F.lower(_col(later)), F.lower(_col(kept))
    return F.when(a == b, F.when(a == "", 0.0).otherwise(1.0)).otherwise(matched(a, b))


def duplicate_verdict(pair: dict[str, str], threshold: float = 0.85, alone: float = 0.95) -> Column:
    """Verdict on lower-cased texts; ``pair`` names the columns of the later and the kept row."""

    @F.pandas_udf(T.BooleanType())
    def verdict(
        lt: pd.Series, ls: pd.Series, kt: pd.Series, ks: pd.Series, close: pd.Series, same: pd.Series
    ) -> pd.Series:
        rows = zip(lt, ls, kt, ks, close, same)
        return pd.Series([is_duplicate(*row, threshold, alone) for row in rows], dtype="bool")

    names = ("later_title", "later_summary", "kept_title", "kept_summary", "close", "same_site")
    return verdict(*[F.col(pair.get(n, n)) for n in names])


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c
