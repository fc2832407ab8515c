"""Benchmark decontamination by an FM-index of each training shard.

A test phrase is a window of ``WIDTH`` consecutive words of a benchmark item (a shorter item is one phrase). A shard is a
piece of an Arrow batch of documents. Its text is written over the phrases' words: any other word, and the end of a
document, is symbol 0, which no phrase has, and a run of those is one 0. From its suffix array come the Burrows-Wheeler
transform, kept as a wavelet matrix, and the positions of every ``SAMPLED``-th suffix. All phrases are searched at once,
backwards, by ranks; occurrences are located by stepping to a sampled suffix; the words under them are merged into spans.

The phrases are broadcast in blocks of at most ``BLOCK_WORDS`` words, a bound that is checked: a larger benchmark takes
more passes, each over what the last has written. Words are compared by 64-bit hashes.

Defined results: null or empty texts have no words; an empty table gives an empty table; a text of any length is searched as
one, longer than a shard or not; items without words, or with a null id or text, have no phrase; equal
phrases of several items count for each; rows are judged one by one; other columns are carried along, but for those that
are added, which are replaced; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postline.llm import tokens
from postline.llm.common import cut
from postline.llm.suffixes import suffix_array

WIDTH = 10
#: Fixed value: a word, as ``tokens.letter_table`` has it.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SAMPLED = 8
BLOCK_WORDS = 2_000_000
SHARD_BYTES = 4 << 20
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ADDED = [T.StructField("n_words", T.LongType()), T.StructField("word_spans", SPANS), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.LongType()))]


@dataclass
class Phrases:
    """words: sorted hashes; word k is symbol k + 1. rows: symbols of each distinct phrase, right-aligned, 0 before its
    start. The items with phrase i are owners[first[i]:first[i + 1]]."""

    words: np.ndarray
    rows: np.ndarray
    lengths: np.ndarray
    owners: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, ids: list[int], texts: list[str], width: int = WIDTH) -> Phrases:
        column = pa.array(texts, pa.large_string())
        hashes, owner, at = [], [], 0
        for first, data, bounds in tokens.slices(column):
            w = tokens.Words(data, bounds, tokens.letter_table())
            h = w.hashes()
            for i in range(len(bounds) - 1):
                own = h[w.first[i] : w.first[i + 1]]
                n = min(width, len(own))
                for k in range(len(own) - n + 1 if n else 0):
                    hashes.append(own[k : k + n])
                    owner.append(ids[first + i])
        vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        rows = np.zeros((len(hashes), width), np.int64)
        for k, h in enumerate(hashes):
            rows[k, width - len(h) :] = np.searchsorted(vocabulary, h) + 1
        if not hashes:
            return cls(vocabulary, rows, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64))
        rows, which = np.unique(rows, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.ravel(), np.array(owner)], axis=1), axis=0)
        return cls(vocabulary, rows, (rows > 0).sum(axis=1), pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(rows) + 1)))


class WaveletMatrix:
    """Symbols by bits, most significant first; each level is stably split into zeros and ones."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for level in reversed(range(bits)):
            b = (symbols >> level) & 1
            count = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(b, out=count[1:])
            self.ones.append(count)
            self.zeros.append(len(symbols) - int(count[-1]))
            symbols = np.concatenate([symbols[b == 0], symbols[b == 1]])

    def moved(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where a boundary ``at`` lies at the bottom, among the copies of ``symbol``."""
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            one = (symbol >> (self.bits - 1 - level)) & 1
            r = ones[at]
            at = np.where(one == 1, zeros + r, at - r)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Copies of symbol before position ``at``."""
        return self.moved(symbol, at) - self.moved(symbol, np.zeros_like(at))


class FMIndex:
    def __init__(self, text: np.ndarray, n_symbols: int):
        """text: symbols below n_symbols, of which 0 is in no pattern. A last 0 closes it."""
        text = np.concatenate([text, [0]]).astype(np.int64)
        order = suffix_array(text)
        self.bwt = text[order - 1]
        self.tree = WaveletMatrix(self.bwt, max(1, int(n_symbols - 1).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])
        self.marked = order % SAMPLED == 0
        self.sample_rank = np.concatenate([[0], np.cumsum(self.marked)])
        self.samples = order[self.marked]

    def search(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that start with each pattern (right-aligned rows), all patterns a step at a time."""
        lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), len(self.bwt), np.int64)
        alive = np.arange(len(rows))
        for j in reversed(range(rows.shape[1])):
            c = rows[alive, j]
            go = c > 0
            use, c = alive[go], c[go]
            if not len(use):
                break
            lo[use] = self.before[c] + self.tree.rank(c, lo[use])
            hi[use] = self.before[c] + self.tree.rank(c, hi[use])
            alive = alive[hi[alive] > lo[alive]]
        return lo, np.maximum(hi, lo)

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes in these places: steps towards the start until a sampled one."""
        at, steps, out = at.copy(), np.zeros(len(at), np.int64), np.full(len(at), -1, np.int64)
        todo = np.arange(len(at))
        while len(todo):
            hit = self.marked[at[todo]]
            done = todo[hit]
            out[done] = self.samples[self.sample_rank[at[done]]] + steps[done]
            todo = todo[~hit]
            c = self.bwt[at[todo]]
            at[todo] = self.before[c] + self.tree.rank(c, at[todo])
            steps[todo] += 1
        return out


def find(phrases: Phrases, symbols: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, phrase) of each occurrence: the first word's index. symbols and docs: of each word of a shard."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(symbols) or not len(phrases.rows):
        return none
    # stretches of phrase words within a document; those shorter than any phrase hold none
    cut_ = np.concatenate([[True], (docs[1:] != docs[:-1]) | (symbols[1:] == 0) | (symbols[:-1] == 0)])
    run = np.cumsum(cut_) - 1
    keep = (np.bincount(run)[run] >= phrases.lengths.min()) & (symbols > 0)
    word = np.flatnonzero(keep)
    if not len(word):
        return none
    opens = np.concatenate([[True], run[word[1:]] != run[word[:-1]]])
    place = np.arange(len(word)) + np.cumsum(opens)
    text, back = np.zeros(int(place[-1]) + 1, np.int64), np.zeros(int(place[-1]) + 1, np.int64)
    text[place], back[place] = symbols[word], word
    index = FMIndex(text, len(phrases.words) + 1)
    lo, hi = index.search(phrases.rows)
    count = hi - lo
    which = np.repeat(np.arange(len(count)), count)
    rows = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(len(which))
    return back[index.locate(rows)], which


def spans_array(first: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["start", "end"]))


def shard(phrases: Phrases, data: np.ndarray, bounds: np.ndarray, before: tuple[list, list] | None) -> list[pa.Array]:
    """The added columns for the texts of a shard. before: word spans and items of earlier blocks."""
    n = len(bounds) - 1
    words = tokens.Words(data, bounds, tokens.letter_table())
    docs = words.docs
    h = words.hashes()
    at = np.minimum(np.searchsorted(phrases.words, h), max(len(phrases.words) - 1, 0))
    symbols = np.where(phrases.words[at] == h, at + 1, 0) if len(phrases.words) else np.zeros(len(h), np.int64)
    word, which = find(phrases, symbols, docs)
    change = np.zeros(len(h) + 1, np.int64)
    np.add.at(change, word, 1)
    np.add.at(change, word + phrases.lengths[which], -1)
    hit = np.cumsum(change)[:-1] > 0
    # a phrase that occurs often in a text, and that many items have, counts once for each of both
    doc, phrase = np.divmod(np.unique(docs[word].astype(np.int64) * max(len(phrases.lengths), 1) + which), max(len(phrases.lengths), 1))
    size = phrases.first[phrase + 1] - phrases.first[phrase]
    owner_at = np.repeat(phrases.first[phrase] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
    pairs = [np.stack([np.repeat(doc, size), phrases.owners[owner_at.astype(np.int64)]], axis=1)]
    if before:
        for i, (spans, items) in enumerate(zip(*before, strict=True)):
            for s in spans or []:
                hit[words.first[i] + s["start"] : words.first[i] + s["end"]] = True
            if items:
                pairs.append(np.stack([np.full(len(items), i), np.array(items)], axis=1))
    pairs = np.unique(np.concatenate(pairs), axis=0)
    opens = hit & np.concatenate([[True], ~hit[:-1] | (docs[1:] != docs[:-1])]) if len(h) else hit
    closes = hit & np.concatenate([~hit[1:] | (docs[1:] != docs[:-1]), [True]]) if len(h) else hit
    a, b = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    first = np.searchsorted(docs[a], np.arange(n + 1))
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    base = points[bounds[docs[a]]]
    items = pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs[:, 0], np.arange(n + 1)), pa.int32()), pa.array(pairs[:, 1], pa.int64()))
    own = words.first[docs[a]]
    return [
        pa.array(np.diff(words.first), pa.int64()),
        spans_array(first, a - own, b - own),
        spans_array(first, points[words.start[a]] - base, points[words.end[b - 1]] - base),
        items,
    ]


def mark(docs: DataFrame, items: DataFrame, width: int = WIDTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with n_words, word_spans (word numbers), spans (code points) and items (the ids with a phrase in the text)."""
    spark = docs.sparkSession
    items = items.select("item_id", "text").filter("item_id IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.regexp_count("text", F.lit(WORD)))).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    names = [f.name for f in ADDED]
    docs = docs.drop(*names)
    schema = T.StructType([*docs.schema.fields, *ADDED])
    out = docs
    for k in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).toArrow()
        held = spark.sparkContext.broadcast(Phrases.of(own["item_id"].to_pylist(), own["text"].to_pylist(), width))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                plain = [i for i, c in enumerate(b.schema.names) if c not in names]
                old = [b.column(b.schema.get_field_index(c)) for c in ("word_spans", "items")] if len(plain) < b.num_columns else None
                made = []
                for first, data, bounds in tokens.slices(b.column(b.schema.get_field_index("text")), SHARD_BYTES):
                    before = tuple(c.slice(first, len(bounds) - 1).to_pylist() for c in old) if old else None
                    made.append(shard(held.value, data, bounds, before))
                if made:
                    new = [pa.concat_arrays(x) for x in zip(*made, strict=True)]
                    yield pa.RecordBatch.from_arrays([*(b.column(i) for i in plain), *new], names=[*(b.schema.names[i] for i in plain), *names])

        out = (out if k == 0 else cut(out)).mapInArrow(run, schema)
    return out


def hit_words() -> Column:
    return F.aggregate("word_spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])


def without_spans(marked: DataFrame) -> DataFrame:
    """marked with its spans taken out of ``text``; a space stays between what stood on both sides."""
    n = F.size("spans")
    end = lambda i: F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get("spans", i - 1)["end"])
    start = lambda i: F.when(i == n, F.char_length("text").cast("bigint")).otherwise(F.get("spans", i)["start"])
    parts = F.transform(F.sequence(F.lit(0), n), lambda i: F.substr("text", (end(i) + 1).cast("int"), (start(i) - end(i)).cast("int")))
    return marked.withColumn("text", F.when(n > 0, F.array_join(parts, " ")).otherwise(F.col("text")))
