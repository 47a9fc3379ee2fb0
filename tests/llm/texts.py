"""Helpers of these tests, importable by name."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary):x}" for _ in range(n))


def edit(rng, text, rate):
    return " ".join(f"x{rng.randrange(10**6)}" if rng.random() < rate else w for w in text.split(" "))
