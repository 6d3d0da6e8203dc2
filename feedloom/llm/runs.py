"""Periodic runs of words, from a dictionary of basic factors.

The dictionary names every stretch of 1, 2, 4, ... words. Per length L, the next occurrence of a factor at most L words on
(so within twice its length) proposes that distance as a period: inside a run of smallest period q <= L, every factor that
fits twice has its next occurrence exactly q words on, so these occurrences form an arithmetic progression, and successive
positions of one progression extend to the whole run. With three periods or more in a run, the least power of two that is
not below q always fits. Several lengths propose the same run; it is kept once.

A position whose factor occurs once only is left out of all longer lengths, so texts without repetition end after a few.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from feedloom.llm.common import output_schema, slices
from feedloom.llm.factors import extended, repeated, word_names

LEAST_WORDS, LEAST_PERIODS = 24, 3
SLICE_BYTES = 2 << 20
RUNS = "array<struct<start: long, length: long, period: long>>"


def _proposed(at: np.ndarray, names: np.ndarray, length: int) -> np.ndarray:
    """``start, length, period`` of every progression of next occurrences at most ``length`` words on, extended."""
    order = np.argsort(names, kind="stable")
    same = names[order[1:]] == names[order[:-1]]
    step = np.zeros(len(at), np.int64)
    step[order[:-1][same]] = (at[order[1:]] - at[order[:-1]])[same]
    step[step > length] = 0
    goes_on = (step[1:] == step[:-1]) & (at[1:] == at[:-1] + 1) & (step[1:] > 0)
    first = np.flatnonzero((step > 0) & ~np.concatenate([[False], goes_on]))
    last = np.flatnonzero((step > 0) & ~np.concatenate([goes_on, [False]]))
    return np.stack([at[first], at[last] - at[first] + length + step[first], step[first]], axis=1)


def runs_of(texts: list[list[bytes]], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> tuple[np.ndarray, np.ndarray]:
    """Runs of several texts: ``start, length, period`` sorted by text, start and period, and the position at which each
    text starts. ``start`` counts from the first text's first word."""
    if least_periods < 3:
        raise ValueError("the factors propose runs of three periods or more")
    names, bounds = word_names(texts)
    at, length, found = np.arange(len(names)), 1, [np.empty((0, 3), np.int64)]
    at, names = repeated(at, names)
    while len(at):
        proposed = _proposed(at, names, length)
        found.append(proposed[proposed[:, 1] >= np.maximum(least_words, least_periods * proposed[:, 2])])
        at, names = repeated(*extended(at, names, length, at, names))
        length *= 2
    found = np.unique(np.concatenate(found)[:, [0, 2, 1]], axis=0)
    return found[:, [0, 2, 1]], bounds


def _kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each of ``n`` words stays when every run is cut to its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def find_runs(
    docs: DataFrame, *, text: str = "text", key: str | None = None, rewrite: Callable[[str, list[bytes]], list[bytes]] | None = None,
    least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS,
) -> DataFrame:
    """``docs`` without the text, with ``n_words``, ``runs`` (``start, length, period`` by start, then period) and
    ``collapsed``, the words left when each run keeps its first period only, joined by one space.

    A run is a stretch of words with smallest period ``period``, at least ``least_words`` words and ``least_periods``
    periods long, that no neighbouring word extends. Words lie between ASCII white space. ``rewrite(key, words)`` may
    replace a text's words before they are looked at; a null key is an empty text there.

    A null or empty text has no words, no runs and collapses to the empty text. Every row is judged by itself, so repeated
    rows and ids give the same result each time, and an empty table an empty one. A very long text is worked on by itself.
    Columns of ``docs`` with the names of added ones are replaced.
    """

    def words_of(part) -> list[list[bytes]]:
        texts = [(t or b"").split() for t in part.column(text).cast(pa.binary()).to_pylist()]
        if rewrite is None:
            return texts
        return [rewrite(k or "", words) for k, words in zip(part.column(key).cast(pa.string()).to_pylist(), texts)]

    def run(batches):
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                texts = words_of(part)
                runs, bounds = runs_of(texts, least_words, least_periods)
                cuts = np.searchsorted(runs[:, 0], bounds)
                kept = _kept(int(bounds[-1]), runs)
                collapsed = []
                for i, words in enumerate(texts):
                    if cuts[i] < cuts[i + 1]:
                        words = [words[k] for k in np.flatnonzero(kept[bounds[i]:bounds[i + 1]])]
                    collapsed.append(b" ".join(words))
                start = runs[:, 0] - np.repeat(bounds[:-1], np.diff(cuts))
                rows = pa.StructArray.from_arrays([pa.array(start), pa.array(runs[:, 1]), pa.array(runs[:, 2])], ["start", "length", "period"])
                yield pa.RecordBatch.from_pydict({
                    **{n: part.column(n) for n in part.schema.names if n not in (text, "n_words", "runs", "collapsed")},
                    "n_words": pa.array(np.diff(bounds)),
                    "runs": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), rows),
                    "collapsed": pa.array(collapsed, pa.binary()).cast(pa.string()),
                })

    return docs.mapInArrow(run, output_schema(docs.drop(text), n_words="long", runs=RUNS, collapsed="string"))


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period; ties go to the smallest start, then period; null without runs."""
    better = lambda best, r: r["length"] * best["period"] > best["length"] * r["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(better(best, r), r).otherwise(best))
