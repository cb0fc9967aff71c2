"""Texts as numbers of distinct words, by the pattern of the byte-level tokenizers."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


def lexicon(texts: Iterable[str], pattern) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, the word number of every match, first match of each text and the end)."""
    number: dict[str, int] = {}
    find, put = pattern.findall, number.setdefault
    codes, sizes = [np.zeros(0, np.int32)], [0]
    for text in texts:
        own = np.fromiter((put(w, len(number)) for w in find(text)), np.int32)
        codes.append(own)
        sizes.append(len(own))
    return list(number), np.concatenate(codes), np.cumsum(sizes)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of values between consecutive offsets."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranges flat[start : start + size], one after another."""
    total = np.cumsum(sizes, dtype=np.int64)
    if not len(total):
        return flat[:0]
    return flat[np.repeat(starts - (total - sizes), sizes) + np.arange(total[-1])]
