"""Hashed character n-grams of many texts at once, and bounded samples to learn from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

SPACE = 32
FACTOR, SALT = 0x9E3779B1, 0x85EBCA6B


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letters(texts: list[str | None], is_letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case letters of all texts as code points, any run of other characters as one space, with a space before and
    after each text; the text of each position; and the letters in each text. A null text is empty."""
    parts = [f" {(t or '').lower()} " for t in texts]
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), np.fromiter(map(len, parts), np.int64, len(parts)))
    good = is_letter[codes]
    keep = good | np.concatenate([[True], good[:-1] | (owner[1:] != owner[:-1])])
    codes, owner, good = np.where(good, codes, SPACE)[keep], owner[keep], good[keep]
    return codes, owner, np.bincount(owner[good], minlength=len(parts))


def grams(codes: np.ndarray, owner: np.ndarray, orders, bits: int):
    """``(owner, id)`` of the n-grams of each order: a hash of the characters and the order. None crosses two texts."""
    h = np.zeros(len(codes), np.uint32)
    for n in range(1, max(orders) + 1):
        if n > len(codes):
            return
        h = h[:len(codes) - n + 1] * np.uint32(FACTOR) + codes[n - 1:].astype(np.uint32)
        if n in orders:
            mixed = (h ^ np.uint32(n * SALT & 0xFFFFFFFF)) * np.uint32(SALT)
            mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(FACTOR)
            inside = owner[:len(h)] == owner[n - 1:]
            yield owner[:len(h)][inside], (mixed >> np.uint32(32 - bits))[inside].astype(np.int64)


def chance(key: str) -> Column:
    """A number from 0 to 1 from a hash of the key; null keys have that of an empty text."""
    return (F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)


def sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, those whose keys have the smallest hashes. All rows are counted, and all but about a
    fifth more than needed are dropped before any is moved."""
    share = min(1.0, 1.2 * most / max(1, rows.count()))
    return rows.withColumn("_chance", chance(key)).where(F.col("_chance") <= share).orderBy("_chance", key).limit(most).drop("_chance")
