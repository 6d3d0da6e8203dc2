"""Names of factors (stretches of words) of many texts at once: equal factors of one text have the same name.

Words of different texts never share a name, so a factor that crosses from one text into the next occurs once only.
"""

from __future__ import annotations

import numpy as np


def word_names(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Names of all words of all texts, one after another, and the position at which each text starts, with the end."""
    names, base = [], 0
    for words in texts:
        known = {w: base + i for i, w in enumerate(dict.fromkeys(words))}
        names.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        base += len(known)
    bounds = np.cumsum([0, *map(len, texts)], dtype=np.int64)
    return (np.concatenate(names) if names else np.empty(0, np.int64)), bounds


def repeated(at: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions whose names occur at least twice. Only those can begin a longer factor that does."""
    if not len(at):
        return at, names
    kept = np.bincount(names)[names] > 1
    return at[kept], names[kept]


def extended(at: np.ndarray, names: np.ndarray, by: int, other_at: np.ndarray, other_names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the factors that begin at ``at`` and go on with the other factor ``by`` words later."""
    if not len(at) or not len(other_at):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    found = np.minimum(np.searchsorted(other_at, at + by), len(other_at) - 1)
    whole = other_at[found] == at + by
    pairs = names[whole] * (int(other_names.max()) + 1) + other_names[found[whole]]
    return at[whole], np.unique(pairs, return_inverse=True)[1].astype(np.int64)
