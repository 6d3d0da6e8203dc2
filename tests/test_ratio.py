"""The ratio is that of ``SequenceMatcher`` to the last bit, in far fewer steps on long texts."""

from __future__ import annotations

import random
import time
from difflib import SequenceMatcher

import pytest

from feedloom.functions.similarity import ratio, reaches

LETTERS = "e" * 12 + "t" * 9 + "a" * 8 + "o" * 7 + "i" * 7 + "n" * 7 + "s" * 6 + "h" * 6 + "r" * 6 + "dlcumwfgypbvkxjqz"


def text_of(pick, n, letters=LETTERS):
    made = []
    while sum(map(len, made)) < n:
        made.append("".join(pick.choice(letters) for _ in range(pick.randint(1, 9))))
        made.append(pick.choice([" ", " ", " ", " ", ", ", ".\n", " 20", "-]^\\ ", ' "']))
    return "".join(made)[:n]


def edited(pick, text, share):
    chars = list(text)
    for _ in range(int(len(chars) * share)):
        at = pick.randrange(len(chars))
        chars[at:at + pick.randint(0, 2)] = pick.choice(["", "é", "Q", "zz", "1977", "中文", "e"])
    return "".join(chars)


@pytest.mark.parametrize("seed", range(40))
def test_the_same_ratio(seed):
    pick = random.Random(seed)
    letters = pick.choice([LETTERS, LETTERS, "ab", "abcdefghijklmnopqrstuvwxyz" * 2 + "".join(map(chr, range(0x4e00, 0x4f00)))])
    sizes = [1, 60, 199, 200, 201, 320, 900, 2500]
    for _ in range(12):
        kept = text_of(pick, pick.choice(sizes), letters)
        for later in (
            text_of(pick, pick.choice(sizes), letters), edited(pick, kept, 0.01), edited(pick, kept, 0.1), edited(pick, kept, 0.6),
            kept[len(kept) // 3:] + kept[:len(kept) // 3], kept + kept, kept[:-1],
        ):
            want = SequenceMatcher(None, later, kept).ratio() if later else 0.0
            assert ratio(later, kept) == want
            for threshold in (0.5, 0.85, want):
                assert reaches(later, kept, threshold) == (want >= threshold)


def test_long_texts_take_few_steps():
    """60,000 characters each: pairs of places are not met one by one."""
    pick = random.Random(3)
    later, kept = text_of(pick, 60_000), text_of(pick, 60_000)
    start = time.process_time()
    assert 0 < ratio(later, kept) < 0.2
    assert time.process_time() - start < 4
