"""Suffix arrays of integer texts in numpy, with common-prefix lengths."""

from __future__ import annotations

import numpy as np

from postline.llm import tokens


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffixes of text in order, by prefix doubling; only suffixes that still tie are sorted again."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    width = 1
    # rank: the place of the first suffix of its group, so that groups keep their places when they are split
    sorted_rank = rank[order]
    start = np.concatenate([[True], sorted_rank[1:] != sorted_rank[:-1]])
    place = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    rank[order] = place
    while width < 2 * n:
        sorted_rank = rank[order]
        same = sorted_rank[1:] == sorted_rank[:-1]
        tied = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
        if not len(tied):
            break
        suffix = order[tied]
        nxt = suffix + width
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        key = rank[suffix] * (n + 1) + second
        by = np.argsort(key)
        suffix, key = suffix[by], key[by]
        order[tied] = suffix
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        rank[suffix] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(tied)), 0))]
        width *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, longest: int) -> np.ndarray:
    """For each suffix in order, the length of its common prefix with the one before it, up to ``longest`` (a power of two less 1).

    Prefixes are compared by 64-bit hashes, and the length found by bisection, for all neighbours at once.
    """
    n = len(text)
    up, down = tokens.powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    a, b = order[:-1], order[1:]
    room = n - np.maximum(a, b)
    length = np.zeros(len(a), np.int64)
    step = (longest + 1) // 2
    while step:
        tried = length + step
        fits = np.flatnonzero(tried <= room)
        i, j, k = a[fits], b[fits], tried[fits]
        same = (total[i + k] - total[i]) * down[i] == (total[j + k] - total[j]) * down[j]
        length[fits[same]] = k[same]
        step //= 2
    return np.concatenate([[0], length])
