"""Runs of periodically repeated words: divide and conquer on interned word ids, after Main and Lorentz.

A run is a stretch of words with smallest period q and at least max(LEAST_WORDS, LEAST_PERIODS * q) words that no
neighbouring word extends. Every run lies within a text, and so crosses the midpoint of exactly one of the smallest blocks,
made by halving, that hold it whole. At a midpoint m and for each period p, the Z-function of what follows m tells how far the
words from m and from m + p agree, that of what precedes it (read backwards) how far those before them do; both together
give the repetition with p that crosses m and has a period on its right, and likewise on its left.

The blocks of one level of halving, of all texts of a piece, are worked on together, as numpy arrays. Most periods fail
within a few words; what is left asks tables of the ids of stretches of 2, 4, 8, ... words (equal id, equal stretch), which are
made as far as they are needed, for the texts that need them alone. Repetitions are extended over their text, intervals
that were found more than once keep the smallest period.

A text of n words takes some n log n steps, and memory of at most a few hundred bytes a word, most of it only where it
repeats itself at length.

Defined results: a null or empty text, or one of white space, has no words, no runs and an empty collapsed text; repeated
rows have the same runs; texts of any length are searched whole; columns named like those that are added are replaced,
others carried along; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from postline.llm import samples

LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words that are looked at one by one before tables of stretches are asked: a repetition of LEAST_WORDS words has so many on one side.
NEAR = 8
#: Words that are worked on at a time (more only for a longer text).
WORDS = 1 << 17
WORD = re.compile("[^\x20\x09-\x0d]+")
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
MADE = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]


@dataclass
class Stretches:
    """The words of some texts, one after another, and the ids of their stretches of 2 ** k words."""

    ids: np.ndarray

    def __post_init__(self) -> None:
        self.levels = [self.ids]

    def level(self, k: int) -> np.ndarray:
        """The id of the stretch of 2 ** k words from each place; what would reach past the end has an id of its own."""
        while len(self.levels) <= k:
            last, half = self.levels[-1], 1 << len(self.levels) - 1
            ahead = np.full(len(last), -1, np.int64)
            ahead[:-half or None] = last[half:] if half < len(last) else ahead[:-half or None]
            both = last.astype(np.int64) << 32 | ahead & 0xFFFFFFFF
            self.levels.append(np.unique(both, return_inverse=True)[1].astype(np.int32))
        return self.levels[k]

    def agreement(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool, known: int = 0) -> np.ndarray:
        """How many words agree from the places a and b on, at most ``most``; back: of those before them, backwards. known: so many
        are known to agree where ``most`` allows it."""
        got = np.minimum(known, most)
        sign = -1 if back else 1

        def agrees(at: np.ndarray, k: int) -> np.ndarray:
            """Which of these rows agree on 2 ** k words more."""
            size = 1 << k
            fits = got[at] + size <= most[at]
            out = np.zeros(len(at), bool)
            inside, table = at[fits], self.level(k)
            shift = sign * got[inside] - (size if back else 0)
            out[fits] = table[a[inside] + shift] == table[b[inside] + shift]
            return out

        rows, k, stopped = np.flatnonzero(got < most), 0, []
        while len(rows):
            hit = agrees(rows, k)
            stopped.append(rows[~hit])
            rows = rows[hit]
            got[rows] += 1 << k
            k += 1
        # what stopped at stretches of 2 ** k words may still agree on shorter ones
        rows = np.zeros(0, np.int64)
        for j in range(len(stopped) - 1, 0, -1):
            rows = np.concatenate([rows, stopped[j]])
            hit = agrees(rows, j - 1)
            got[rows[hit]] += 1 << j - 1
        return got


def near_agreement(ids: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """How many of the next NEAR words agree."""
    got, rows = np.zeros(len(a), np.int64), np.flatnonzero(most > 0)
    for step in range(NEAR):
        shift = -step - 1 if back else step
        rows = rows[ids[a[rows] + shift] == ids[b[rows] + shift]]
        got[rows] += 1
        rows = rows[most[rows] > step + 1]
    return got


def crossing(ids: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For blocks [low, high): places a, b = a + period whose surroundings may repeat with that period across the block's midpoint,
    and the block's bounds for them. side is 0 where the period lies on the midpoint's right, 1 where on its left."""
    mid = (low + high) // 2
    out = []
    for side in (0, 1):
        most = np.minimum((high - low) // LEAST_PERIODS, np.where(side, mid - low, high - mid))
        block = np.repeat(np.arange(len(low)), most)
        period = np.arange(len(block)) - np.repeat(np.cumsum(most) - most, most) + 1
        a = mid[block] - period if side else mid[block]
        b = a + period
        # the repetition has a word on the midpoint's other side
        there = ids[a] == ids[np.minimum(b, len(ids) - 1)] if side else ids[a - 1] == ids[b - 1]
        here = np.flatnonzero(there & (b < high[block]) if side else there)
        a, b, block = a[here], b[here], block[here]
        ahead = near_agreement(ids, a, b, high[block] - b, False)
        behind = near_agreement(ids, a, b, a - low[block], True)
        may = (ahead >= NEAR) | (behind >= NEAR)
        out.append((a[may], b[may], low[block[may]], high[block[may]], np.full(int(may.sum()), side)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def runs(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The runs of the texts whose words' ids stand at bounds[i] to bounds[i + 1]: rows (text, start, length, period), in order."""
    low, high = bounds[:-1], bounds[1:]
    found = []
    while len(low := low[keep := high - low >= LEAST_WORDS]):
        high = high[keep]
        found.append(crossing(ids, low, high))
        mid = (low + high) // 2
        low, high = np.concatenate([low, mid]), np.concatenate([mid, high])
    a, b, low, high = (np.concatenate(x) for x in zip(*[f[:4] for f in found], strict=True)) if found else [np.zeros(0, np.int64)] * 4
    if not len(a):
        return np.zeros((0, 4), np.int64)
    # the texts that may have runs, by themselves
    text = np.searchsorted(bounds, a, "right") - 1
    own = np.unique(text)
    size = bounds[own + 1] - bounds[own]
    first = np.cumsum(size) - size
    taken = np.repeat(bounds[own] - first, size) + np.arange(int(size.sum()))
    stretches = Stretches(np.unique(ids[taken], return_inverse=True)[1].astype(np.int32))
    place = np.searchsorted(own, text)
    shift = first[place] - bounds[text]
    a, b, low, high = a + shift, b + shift, low + shift, high + shift
    period = b - a
    start, end = a - stretches.agreement(a, b, a - low, True), b + stretches.agreement(a, b, high - b, False)
    long = np.flatnonzero(end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period))
    start, end, period, place = start[long], end[long], period[long], place[long]
    # extended over the text
    text_low, text_high = first[place], first[place] + size[place]
    start = start - stretches.agreement(start, start + period, start - text_low, True)
    end = end + stretches.agreement(end - period, end, text_high - end, False)
    order = np.lexsort([period, end, start])
    start, end, period, place = start[order], end[order], period[order], place[order]
    same = (start[1:] == start[:-1]) & (end[1:] == end[:-1])
    once = np.concatenate([[True], ~same])[: len(start)]
    start, end, period, place = start[once], end[once], period[once], place[once]
    order = np.lexsort([period, start])
    return np.stack([own[place], start - first[place], end - start, period], 1)[order]


def interned(texts: list[str | None]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    """The words of texts, their ids (equal words, equal ids), and the texts' bounds among these."""
    words = [WORD.findall(t or "") for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for own in words for w in own), np.int32, int(bounds[-1]))
    return words, ids, bounds


def collapsed(words: list[str], own: np.ndarray) -> str:
    """The words joined by a space, without those that a run has after its first period."""
    if not len(own):
        return " ".join(words)
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, own[:, 0] + own[:, 2], 1)
    np.add.at(step, own[:, 0] + own[:, 1], -1)
    return " ".join([words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()])


def groups(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in order, some WORDS at a time, but at least one."""
    held, filled = [], 0
    for t in texts:
        size = len(t or "") // 6 + 1
        if held and filled + size > WORDS:
            yield held
            held, filled = [], 0
        held.append(t)
        filled += size
    if held:
        yield held


def with_runs(docs: DataFrame) -> DataFrame:
    """docs with n_words, runs (start, length and period, in words, by start and period) and collapsed, the text less repetitions."""

    def make(text: pa.Array) -> list[pa.Array]:
        n_words, starts, rows, shown = [], [0], [], []
        for texts in groups(text.to_pylist()):
            words, ids, bounds = interned(texts)
            found = runs(ids, bounds)
            cut = np.searchsorted(found[:, 0], np.arange(len(texts) + 1))
            n_words += np.diff(bounds).tolist()
            starts += (cut[1:] + starts[-1]).tolist()
            rows.append(found[:, 1:])
            shown += [collapsed(words[i], found[cut[i] : cut[i + 1], 1:]) for i in range(len(texts))]
        flat = np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)
        made = pa.StructArray.from_arrays([pa.array(flat[:, k], pa.int64()) for k in range(3)], names=RUN.names)
        return [pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), made), pa.array(shown, pa.string())]

    return samples.with_column(docs, [f.name for f in MADE], MADE, make)
