"""Suffix-array de-duplication by the common-prefix interval tree.

Of every string of ``LENGTH`` bytes that occurs twice or more, all occurrences but the first lose their bytes. First is by
doc_id, then by place. Texts of all documents can't be in one suffix array, so occurrences meet by content:

1. Anchors. In each window of LENGTH bytes, the ``GRAM``-byte string with the least hash is an anchor. Equal windows have
   equal anchors, so a repeated string has an anchor in common with its first occurrence, and its bytes lie within the
   anchor's context: the bytes that any window over the anchor can reach. Each anchor is sent on as two hashes, of the gram
   and of the context. Within a batch, equal contexts are reduced to the first at once.
2. Leaves. The tree has one leaf for each distinct context of a gram, with all occurrences of it, not one for each
   occurrence. A leaf of several occurrences is a maximal repeat as it stands, and all but its first lose its bytes; only
   the first goes on to be compared with other leaves, if its gram has any. (A context that a third of all documents have
   is thus never gathered.)
3. Around a common anchor, a common string of LENGTH bytes holds RIGHT bytes from the anchor on, or LEFT bytes before it:
   those are the keys by which leaves meet, if they meet any. Hashes of both sides, sent with the anchors, leave out leaves
   that meet none before their bytes are fetched. The contexts of a key are laid into a sparse enhanced suffix array: of the places from which LENGTH bytes recur, those whose occurrences differ in the
   byte to the left. A stack scan over its common-prefix lengths finds the intervals of at least LENGTH; one that is
   left-diverse is a maximal repeat, and all its occurrences but the first lose their bytes. Other intervals repeat what
   the interval one byte to the left has.
4. A side that more than CROWD contexts share, such as the last bytes of a passage that many documents go on from, isn't
   gathered. Each string of LENGTH bytes in its contexts is sent on as a hash and a place; those of a batch are reduced to the
   first, and what meets by hash streams by in order.

Grams, contexts, keys and the strings of crowded sides are compared by 64-bit hashes, sides before that by 32 bits beside
the gram's 64. Spark chooses each join by the tables' bytes, at every size alike; what a step wrote is deleted once read.

Defined results: a null text is empty; texts shorter than LENGTH lose nothing; rows that repeat a doc_id with the same
text are one document; those with other texts are documents of their own, told apart and ordered by 31 bits of a hash of
the text; texts of any length are worked on in whole, a piece of texts at a time; rows with a null doc_id lose nothing and take nothing from others; an empty table gives an empty table; other columns are carried along,
but for those that are added and names that begin with ``_r_``.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postline.llm import tokens
from postline.llm.common import Scratch

LENGTH = 100
GRAM = 24
#: Bytes before an anchor that a window over it can reach; after its start it can reach LENGTH.
REACH = LENGTH - GRAM
#: Of LENGTH bytes around an anchor, RIGHT at least follow its start or LEFT precede it.
RIGHT, LEFT = 62, 39
#: Bytes of contexts in one suffix array.
ARRAY_BYTES = 1 << 18
#: Contexts that share a side and may be laid into one suffix array; of more, the single strings are compared.
CROWD = 1 << 11
#: Bits of a side's hash that go with an anchor.
SIDE_BITS = 32
ROW = ["_r_doc", "_r_text"]


def text_hash(column: str = "text"):
    """31 bits of the text's hash, as they stand above the place in ``at``: they tell apart texts of one doc_id."""
    return F.shiftrightunsigned(F.xxhash64(column), 33)


class Piece:
    """The texts of a piece, with running sums for hashes of their substrings."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds
        up, self.down = tokens.powers(len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.total[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return tokens.mix((self.total[end] - self.total[start]) * self.down[start])

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text's number, place in the piece, gram hash) of each anchor."""
        n, width = len(self.data), LENGTH - GRAM + 1
        none = np.zeros(0, np.int64)
        if n < LENGTH:
            return none, none, np.zeros(0, np.uint64)
        at = np.arange(n - GRAM + 1)
        h = self.hashes(at, at + GRAM) | np.uint64(1)
        # windows that run over a text's end don't count
        valid = np.zeros(n - LENGTH + 1, bool)
        change = np.zeros(len(valid) + 1, np.int64)
        long = np.flatnonzero(np.diff(self.bounds) >= LENGTH)
        change[self.bounds[long]] += 1
        change[self.bounds[long + 1] - LENGTH + 1] -= 1
        valid = np.cumsum(change)[:-1] > 0
        least = running(h, width, np.minimum)[: len(valid)]
        least[~valid] = 0
        padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
        most = running(padded, width, np.maximum)[: len(h)]
        place = np.flatnonzero(most == h)
        return np.searchsorted(self.bounds, place, "right") - 1, place, h[place]

    def keys(self, doc: np.ndarray, place: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For either side: which anchors have its bytes within their text, and those anchors' keys."""
        out = []
        for fits, start, end in ((place + RIGHT <= self.bounds[doc + 1], place, place + RIGHT), (place - LEFT >= self.bounds[doc], place - LEFT, place + GRAM)):
            k = np.flatnonzero(fits)
            out.append((k, self.hashes(start[k], end[k]) + np.uint64(len(out))))
        return out

    def sides(self, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Both keys' first bits, 0 where a side is short."""
        out = np.zeros(len(place), np.uint64)
        for i, (k, key) in enumerate(self.keys(doc, place)):
            out[k] |= np.maximum(key >> np.uint64(64 - SIDE_BITS), np.uint64(1)) << np.uint64(SIDE_BITS * i)
        return out.view(np.int64)

    def contexts(self, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.maximum(self.bounds[doc], place - REACH), np.minimum(self.bounds[doc + 1], place + LENGTH)


def running(a: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over a[i:i + width] for each i, by doubling."""
    have = 1
    while have * 2 <= width:
        a = op(a[:-have], a[have:])
        have *= 2
    return op(a[: len(a) - (width - have)], a[width - have :]) if have < width else a


ANCHOR = "gram bigint, context bigint, _r_doc bigint, at bigint, sides bigint, stop bigint"


def anchors(docs: DataFrame) -> DataFrame:
    """A row for each anchor; ``at`` holds the text's hash and the place. Where an equal context precedes it in the batch, the
    context is done: such rows come as spans from ``at`` to stop, those of a text that overlap made one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "context", "_r_doc", "at", "sides", "stop"]
        for b in batches:
            ids = b.column(b.schema.get_field_index("_r_doc")).to_numpy(zero_copy_only=False)
            texts = b.column(b.schema.get_field_index("_r_text")).to_numpy(zero_copy_only=False)
            got = []
            for first, data, bounds in tokens.slices(b.column(b.schema.get_field_index("text"))):
                p = Piece(data, bounds)
                doc, place, gram = p.anchors()
                lo, hi = p.contexts(doc, place)
                context = tokens.mix(p.hashes(lo, hi) + (place - lo).astype(np.uint64) * np.uint64(1000003) + (hi - place).astype(np.uint64))
                at = (texts[first + doc].astype(np.int64) << 32) | (place - bounds[doc])
                got.append((gram.view(np.int64), context.view(np.int64), ids[first + doc], at, p.sides(doc, place), place - lo, hi - place))
            if not got:
                continue
            gram, context, ids, at, sides, left, right = (np.concatenate(x) for x in zip(*got, strict=True))
            by = np.lexsort((at, ids, context, gram))
            gram, context, ids, at, sides, left, right = (x[by] for x in (gram, context, ids, at, sides, left, right))
            same = (gram[1:] == gram[:-1]) & (context[1:] == context[:-1])
            twice = np.concatenate([[False], same & (ids[1:] == ids[:-1]) & (at[1:] == at[:-1])])
            done = np.concatenate([[False], same])
            # a repeated row of the first occurrence is no second one
            lead = np.maximum.accumulate(np.where(done, 0, np.arange(len(done))))
            done &= ~((ids == ids[lead]) & (at == at[lead]))
            keep = ~twice & ~done
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (gram, context, ids, at, sides, np.zeros(len(gram), np.int64))], names=names)
            if done.any():
                place = at[done] & 0xFFFFFFFF
                u = united(ids[done], at[done] >> 32, place - left[done], place + right[done])
                none = pa.array(np.zeros(u.num_rows, np.int64))
                yield pa.RecordBatch.from_arrays([none, none, u["_r_doc"], pa.array((u["_r_text"].to_numpy() << 32) | u["start"].to_numpy()), none, u["end"]], names=names)

    return docs.mapInArrow(run, ANCHOR)


def leaves(rows: DataFrame) -> DataFrame:
    """(_r_doc, at, gram, sides, stop): the occurrences that their leaf drops, as spans from ``at`` to stop; and, with stop 0, the
    first occurrence of each leaf whose gram has several leaves.

    Rows come sorted within a partition, so a neighbour tells what a row is; one row is held back between batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # the last anchor
        held: tuple | None = None  # the first leaf of a gram, until another one shows up
        for b in batches:
            gram, context, doc, at, sides, stop = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("gram", "context", "_r_doc", "at", "sides", "stop"))
            done = stop > 0
            out = [(doc[done], at[done], gram[done], sides[done], stop[done])]
            gram, context, doc, at, sides = (x[~done] for x in (gram, context, doc, at, sides))
            if not len(gram):
                yield of(out)
                continue
            carried = last is not None
            if carried:
                gram, context, doc, at, sides = (np.concatenate([[x], y]) for x, y in zip(last, (gram, context, doc, at, sides), strict=True))
            same_gram = gram[1:] == gram[:-1]
            same = same_gram & (context[1:] == context[:-1])
            equal = same & (doc[1:] == doc[:-1]) & (at[1:] == at[:-1])
            later = np.flatnonzero(same & ~equal) + 1
            place, zero = at[later] & 0xFFFFFFFF, np.zeros(len(later), np.int64)
            out.append((doc[later], (at[later] >> 32 << 32) | np.maximum(place - REACH, 0), zero, zero, place + LENGTH))
            fresh = np.flatnonzero(same_gram & ~same) + 1  # the second and later leaves of a gram
            out.append((doc[fresh], at[fresh], gram[fresh], sides[fresh], np.zeros(len(fresh), np.int64)))
            first = np.concatenate([[not carried], ~same_gram])
            leads = np.flatnonzero(first)
            lead_of = np.searchsorted(leads, fresh, "right") - 1
            asked = np.unique(leads[lead_of[lead_of >= 0]])
            out.append((doc[asked], at[asked], gram[asked], sides[asked], np.zeros(len(asked), np.int64)))
            if held is not None and (lead_of < 0).any():
                out.append(tuple(np.array([x]) for x in held) + (np.zeros(1, np.int64),))
                held = None
            if len(leads):
                held = None if leads[-1] in asked else (doc[leads[-1]], at[leads[-1]], gram[leads[-1]], sides[leads[-1]])
            last = (gram[-1], context[-1], doc[-1], at[-1], sides[-1])
            yield of(out)

    def of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["_r_doc", "at", "gram", "sides", "stop"])

    # what is done already needn't meet its gram, so it is dealt by itself
    meet = F.when(F.col("stop") > 0, F.xxhash64("_r_doc", "at")).otherwise(F.col("gram"))
    dealt = rows.repartition(meet).sortWithinPartitions("gram", "context", "_r_doc", "at")
    return dealt.mapInArrow(run, "_r_doc bigint, at bigint, gram bigint, sides bigint, stop bigint")


def meeting(asked: DataFrame) -> DataFrame:
    """(_r_doc, _r_text, spot, crowded) of the sides that another anchor in question of the same gram has too.

    spot: twice the anchor's place, plus 1 for the left side; crowded: more than CROWD anchors have that side.
    """
    side = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.shiftright("sides", SIDE_BITS * i).bitwiseAND(F.lit((1 << SIDE_BITS) - 1)).alias("bits")) for i in (0, 1)]))
    rows = asked.withColumn("s", side).filter("s.bits <> 0").select(*ROW, (F.col("place") * 2 + F.col("s.i")).alias("spot"), F.xxhash64("gram", "s.i", "s.bits").alias("meet"))
    met = rows.groupBy("meet").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("meet", (F.col("n") > CROWD).alias("crowded"))
    return rows.join(met, "meet").select(*ROW, "spot", "crowded")


def with_spots(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """The texts that have sides in question, with their spots."""
    return docs.select(*ROW, "text").join(asked.groupBy(*ROW).agg(F.sort_array(F.collect_set("spot")).alias("spots")), ROW)


def sides_of(b: pa.RecordBatch) -> Iterator[tuple]:
    """For each piece of a batch of ``with_spots``: the piece, its texts' ids and hashes, and for either side the text's number
    and the place of each anchor, its key, and start and end of what a common string with that side can reach."""
    column = {c: b.column(b.schema.get_field_index(c)) for c in (*ROW, "spots", "text")}
    ids, texts = column["_r_doc"].to_numpy(), column["_r_text"].to_numpy()
    for first, data, bounds in tokens.slices(column["text"]):
        p = Piece(data, bounds)
        lists = column["spots"].slice(first, len(bounds) - 1)
        doc = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        spot = lists.flatten().to_numpy().astype(np.int64)
        place = (spot >> 1) + bounds[doc]
        lo, hi = p.contexts(doc, place)
        reach = (np.maximum(lo, place - LEFT + 1), hi), (lo, np.minimum(hi, place + RIGHT - 1))
        found = []
        for i, ((k, key), (start, end)) in enumerate(zip(p.keys(doc, place), reach, strict=True)):
            asked = ((spot[k] & 1) == i) & (end[k] - start[k] >= LENGTH)
            k, key = k[asked], key[asked]
            found.append((doc[k], place[k], key, start[k], end[k]))
        yield p, ids[first : first + len(lists)], texts[first : first + len(lists)].astype(np.int64), found


def keyed_contexts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, _r_doc, at, before, context): the bytes around each anchor in question, once for each side that can be shared.

    Of a side, only what a common string with that side can reach.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, ids, texts, found in sides_of(b):
                raw = p.data.tobytes()
                for doc, place, key, start, end in found:
                    bytes_ = pa.array([raw[x:y] for x, y in zip(start.tolist(), end.tolist(), strict=True)], pa.binary())
                    at = (texts[doc] << 32) | (place - p.bounds[doc])
                    columns = [pa.array(key.view(np.int64)), pa.array(ids[doc]), pa.array(at), pa.array(place - start), bytes_]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "_r_doc", "at", "before", "context"])

    return with_spots(docs, asked).mapInArrow(run, "key bigint, _r_doc bigint, at bigint, before bigint, context binary")


def crowded_strings(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(same, _r_doc, at, stop, done): each string of LENGTH bytes that a crowded side can share, by its hash; ``at`` as in anchors.

    done: an equal string precedes it in the batch; those come as spans, with stop, and one string of a batch stays for each hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for p, ids, texts, found in sides_of(b):
                change = np.zeros(len(p.data) + 1, np.int64)
                for _, _, _, start, end in found:
                    np.add.at(change, start, 1)
                    np.add.at(change, end - LENGTH + 1, -1)
                where = np.flatnonzero(np.cumsum(change)[:-1] > 0)
                doc = np.searchsorted(p.bounds, where, "right") - 1
                got.append((p.hashes(where, where + LENGTH).view(np.int64), ids[doc], (texts[doc] << 32) | (where - p.bounds[doc])))
            if not got:
                continue
            same, doc, at = (np.concatenate(x) for x in zip(*got, strict=True))
            by = np.lexsort((at, doc, same))
            same, doc, at = same[by], doc[by], at[by]
            equal = same[1:] == same[:-1]
            twice = np.concatenate([[False], equal & (doc[1:] == doc[:-1]) & (at[1:] == at[:-1])])[: len(same)]
            same, doc, at = same[~twice], doc[~twice], at[~twice]
            done = np.concatenate([[False], same[1:] == same[:-1]])[: len(same)]
            names = ["same", "_r_doc", "at", "stop", "done"]
            if (~done).any():
                n = int((~done).sum())
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (same[~done], doc[~done], at[~done], np.zeros(n, np.int64), np.zeros(n, bool))], names=names)
            if done.any():
                start = at[done] & 0xFFFFFFFF
                u = united(doc[done], at[done] >> 32, start, start + LENGTH)
                place = (u["_r_text"].to_numpy() << 32) | u["start"].to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(u.num_rows, np.int64)), u["_r_doc"], pa.array(place), u["end"], pa.array(np.ones(u.num_rows, bool))], names=names)

    return with_spots(docs, asked).mapInArrow(run, "same bigint, _r_doc bigint, at bigint, stop bigint, done boolean")


def later_strings(rows: DataFrame) -> DataFrame:
    """(_r_doc, _r_text, start, end): bytes that go, from ``crowded_strings``: all but the first of each hash.

    Rows come sorted within a partition, so a neighbour tells what a row is; one row is held back between batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        for b in batches:
            same, doc, at, stop = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("same", "_r_doc", "at", "stop"))
            done = b.column(b.schema.get_field_index("done")).to_numpy(zero_copy_only=False)
            gone = [(doc[done], at[done] >> 32, at[done] & 0xFFFFFFFF, stop[done])]
            same, doc, at = same[~done], doc[~done], at[~done]
            if len(same):
                if last is not None:
                    same, doc, at = (np.concatenate([[x], y]) for x, y in zip(last, (same, doc, at), strict=True))
                # a repeated row of the first occurrence is no second one
                late = np.flatnonzero((same[1:] == same[:-1]) & ((doc[1:] != doc[:-1]) | (at[1:] != at[:-1]))) + 1
                start = at[late] & 0xFFFFFFFF
                gone.append((doc[late], at[late] >> 32, start, start + LENGTH))
                last = (same[-1], doc[-1], at[-1])
            columns = [np.concatenate(x) for x in zip(*gone, strict=True)]
            if len(columns[0]):
                yield united(*columns)

    # what is settled already needn't meet its equals, so it is dealt by itself
    meet = F.when(F.col("done"), F.xxhash64("_r_doc", "at")).otherwise(F.col("same"))
    dealt = rows.repartition(meet).sortWithinPartitions("same", "_r_doc", "at")
    return dealt.mapInArrow(run, "_r_doc bigint, _r_text bigint, start bigint, end bigint")


def maximal_repeats(order: np.ndarray, lcp: np.ndarray, left: np.ndarray, rank: np.ndarray) -> Iterator[tuple[int, list[int]]]:
    """(length, occurrences to drop) of the left-diverse intervals of at least LENGTH.

    order: the suffixes' numbers; lcp: with the one before; left: the byte before each (-1: none to compare, always diverse); rank:
    smaller is earlier. An interval drops the firsts of its parts but its own: later ones are dropped by a longer repeat.
    """
    cuts = np.flatnonzero(np.concatenate([lcp < LENGTH, [True]]))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a < 2:
            continue
        # stack of open intervals: [length, byte to the left or None if diverse, firsts of the parts]
        stack: list[list] = []
        for k in range(a, b + 1):
            depth = int(lcp[k]) if a < k < b else 0
            if k < b:
                s = int(order[k])
                leaf = [None, int(left[s]), [s]]
            part = None
            while stack and stack[-1][0] > depth:
                length, byte, firsts = stack.pop()
                if part is not None:
                    byte, firsts = joined_left(byte, part[1]), firsts + part[2]
                first = min(firsts, key=lambda s: rank[s])
                if byte is None:
                    yield length, [s for s in firsts if rank[s] != rank[first]]
                part = [None, byte, [first]]
            if k == b:
                break
            if part is not None:
                if stack and stack[-1][0] == depth:
                    stack[-1][1], stack[-1][2] = joined_left(stack[-1][1], part[1]), stack[-1][2] + part[2]
                elif depth:
                    stack.append([depth, part[1], part[2]])
            nxt = int(lcp[k + 1]) if k + 1 < b else 0
            if nxt and (not stack or stack[-1][0] < nxt):
                stack.append([nxt, leaf[1] if leaf[1] >= 0 else None, leaf[2]])
            elif stack:
                stack[-1][1], stack[-1][2] = joined_left(stack[-1][1], leaf[1] if leaf[1] >= 0 else None), stack[-1][2] + leaf[2]


def joined_left(a: int | None, b: int | None) -> int | None:
    return a if a is not None and a == b else None


def repeated(contexts: list[bytes], group: np.ndarray, doc: np.ndarray, at: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context's number, start, end) of what the contexts lose to earlier ones of their group; both count from the context's start."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = np.array([len(c) for c in contexts])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(contexts), np.uint8)
    p = Piece(data, begin)
    starts = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(contexts)), starts)
    offset = np.arange(int(starts.sum())) - np.repeat(np.cumsum(starts) - starts, starts)
    where = begin[owner] + offset
    # places by what LENGTH bytes they begin, and by group
    same = tokens.mix(p.hashes(where, where + LENGTH) + tokens.mix(group.view(np.uint64))[owner])
    left = np.where(offset > 0, data[np.maximum(where - 1, 0)].astype(np.int64), -1)
    by = np.argsort(same, kind="stable")
    edge = np.concatenate([[0], np.flatnonzero(np.diff(same[by])) + 1])
    count = np.diff(np.concatenate([edge, [len(by)]]))
    bytes_left = left[by]
    diverse = (np.minimum.reduceat(bytes_left, edge) < 0) | (np.minimum.reduceat(bytes_left, edge) != np.maximum.reduceat(bytes_left, edge))
    keep = np.sort(by[np.repeat((count > 1) & diverse, count)])
    if not len(keep):
        return none
    owner, where, left = owner[keep], where[keep], left[keep]
    room = begin[owner + 1] - where
    widest = int(room.max())
    padded = np.concatenate([data, np.zeros(widest, np.uint8)])
    # the suffixes, cut at their context's end, as rows of equal width; the group goes first
    rows = np.lib.stride_tricks.sliding_window_view(padded, widest)[where].copy()
    rows[np.arange(widest) >= room[:, None]] = 0
    head = np.unique(group[owner], return_inverse=True)[1].astype(">u4").view(np.uint8).reshape(-1, 4)
    key = np.ascontiguousarray(np.concatenate([head, rows], axis=1)).view(f"V{widest + 4}").ravel()
    order = np.argsort(key, kind="stable")
    lcp = prefixes_of(p, where[order], room[order], group[owner[order]])
    place = (at >> 32 << 32) + (at & 0xFFFFFFFF) - before
    absolute = place[owner] + where - begin[owner]
    sort = np.lexsort((absolute, doc[owner]))
    moved = (np.diff(absolute[sort]) != 0) | (np.diff(doc[owner][sort]) != 0)
    rank = np.zeros(len(where), np.int64)
    rank[sort] = np.concatenate([[0], np.cumsum(moved)])  # equal for a place that two contexts have
    found = [(s, length) for length, dropped in maximal_repeats(order, lcp, left, rank) for s in dropped]
    if not found:
        return none
    s, length = np.array(found, np.int64).T
    start = where[s] - begin[owner[s]]
    return owner[s], start, start + length


def prefixes_of(p: Piece, where: np.ndarray, room: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each suffix in order, its common prefix with the one before, within both contexts; 0 across groups. By bisection over hashes."""
    a, b, most = where[:-1], where[1:], np.minimum(room[:-1], room[1:])
    length = np.zeros(len(a), np.int64)
    step = 1 << int(room.max()).bit_length()
    while step := step // 2:
        tried = length + step
        fits = np.flatnonzero(tried <= most)
        hit = p.hashes(a[fits], a[fits] + tried[fits]) == p.hashes(b[fits], b[fits] + tried[fits])
        length[fits[hit]] = tried[fits[hit]]
    length[group[1:] != group[:-1]] = 0
    return np.concatenate([[0], length])


def united(doc: np.ndarray, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """The spans, with those of a text that overlap made one."""
    by = np.lexsort((start, text, doc))
    doc, text, start, end = doc[by], text[by], start[by], end[by]
    other = np.concatenate([[True], (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])])
    # the furthest end so far in a text: shifted by text so that one running maximum serves all
    shift = np.cumsum(other) * (int(end.max()) + 1)
    far = np.maximum.accumulate(end + shift)
    opens = other | np.concatenate([[True], start[1:] + shift[1:] > far[:-1]])
    first = np.flatnonzero(opens)
    last = np.concatenate([first[1:], [len(by)]]) - 1
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[first], text[first], start[first], (far - shift)[last])], names=[*ROW, "start", "end"])


def compared(rows: DataFrame) -> DataFrame:
    """(_r_doc, _r_text, start, end): bytes that go, from the contexts of each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def scan(t: pa.Table) -> Iterator[pa.RecordBatch]:
            key = t["key"].to_numpy()
            same = key[1:] == key[:-1]
            several = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            t = t.filter(pa.array(several))
            size = np.cumsum(pc.binary_length(t["context"]).to_numpy())
            key = t["key"].to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]) if len(key) else np.zeros(1, int)
            a = 0
            for e in edges[1:]:
                if e == len(key) or size[e - 1] - (size[a - 1] if a else 0) >= ARRAY_BYTES:
                    part = t.slice(a, int(e) - a)
                    doc, at, before = (part[c].to_numpy() for c in ("_r_doc", "at", "before"))
                    who, start, end = repeated(part["context"].to_pylist(), part["key"].to_numpy(), doc, at, before)
                    if len(who):
                        base = (at[who] & 0xFFFFFFFF) - before[who]
                        yield united(doc[who], at[who] >> 32, base + start, base + end)
                    a = int(e)

        for b in batches:
            kept.append(b)
            t = pa.Table.from_batches(kept)
            key = t["key"].to_numpy()
            whole = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last key may go on
            if whole and t.nbytes >= 4 * ARRAY_BYTES:
                yield from scan(t.slice(0, whole))
                kept = t.slice(whole).combine_chunks().to_batches()
        if kept:
            yield from scan(pa.Table.from_batches(kept))

    return rows.repartition("key").sortWithinPartitions("key", "_r_doc", "at").mapInArrow(run, "_r_doc bigint, _r_text bigint, start bigint, end bigint")


def merged_spans(rows: DataFrame) -> DataFrame:
    """(_r_doc, _r_text, _r_spans): a text's spans, made one where they touch, as pairs of 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for s in b.column(b.schema.get_field_index("s")):
                lo, hi = s.values.field("start").to_numpy(), s.values.field("end").to_numpy()
                by = np.argsort(lo)
                lo, far = lo[by], np.maximum.accumulate(hi[by])
                first = np.flatnonzero(np.concatenate([[True], lo[1:] > far[:-1]]))
                last = np.concatenate([first[1:], [len(lo)]]) - 1
                out.append(np.stack([lo[first], far[last]], axis=1).tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in ROW), pa.array(out, pa.binary())], names=[*ROW, "_r_spans"])

    lists = rows.groupBy(*ROW).agg(F.collect_set(F.struct("start", "end")).alias("s"))
    return lists.mapInArrow(run, "_r_doc bigint, _r_text bigint, _r_spans binary")


ADDED = [
    T.StructField("kept", T.BinaryType()),
    T.StructField("n_bytes", T.LongType()),
    T.StructField("n_removed", T.LongType()),
    T.StructField("n_spans", T.LongType()),
]


def dedup(docs: DataFrame) -> DataFrame:
    """docs with kept (the remaining bytes), n_bytes, n_removed and n_spans (maximal removed runs)."""
    docs = docs.drop(*(f.name for f in ADDED)).withColumn("text", F.coalesce("text", F.lit("")))
    named = docs.withColumns({ROW[0]: F.col("doc_id").cast("bigint"), ROW[1]: text_hash()})
    plain = named.filter("doc_id IS NOT NULL").select(*ROW, "text")
    with Scratch(docs.sparkSession) as scratch:
        found = scratch.cut(leaves(anchors(plain)))
        scratch.free()
        place = F.col("at").bitwiseAND(F.lit(0xFFFFFFFF))
        placed = found.select("_r_doc", F.shiftright("at", 32).alias("_r_text"), place.alias("place"), "gram", "sides", "stop")
        met = scratch.cut(meeting(placed.filter("stop = 0")))
        scratch.free()
        more = scratch.cut(compared(keyed_contexts(plain, met.filter("NOT crowded"))))
        dropped = [placed.filter("stop > 0").select(*ROW, F.col("place").alias("start"), F.col("stop").alias("end")), more]
        if not met.filter("crowded").isEmpty():
            dropped.append(scratch.cut(later_strings(crowded_strings(plain, met.filter("crowded")))))
        scratch.free(met)
        spans = scratch.keep(scratch.cut(merged_spans(functools.reduce(DataFrame.unionByName, dropped))))
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, numbers = [], []
            for text, spans_ in zip(b.column(b.schema.get_field_index("text")), b.column(b.schema.get_field_index("_r_spans")), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                if not spans_.is_valid:
                    kept.append(raw)
                    numbers.append((len(raw), 0, 0))
                    continue
                lo, hi = np.frombuffer(spans_.as_buffer(), np.int64).reshape(-1, 2).T
                change = np.zeros(len(raw) + 1, np.int64)
                np.add.at(change, np.maximum(lo, 0), 1)
                np.add.at(change, np.minimum(hi, len(raw)), -1)
                gone = np.cumsum(change)[:-1] > 0
                runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
                kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
                numbers.append((len(raw), int(gone.sum()), runs))
            own = [b.column(b.schema.get_field_index(c)) for c in columns]
            numbers_ = np.array(numbers, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*own, pa.array(kept, pa.binary()), *(pa.array(numbers_[:, k]) for k in range(3))], names=[*columns, *(f.name for f in ADDED)])

    return named.join(spans, ROW, "left").select(*columns, "_r_spans").mapInArrow(run, T.StructType([*docs.schema.fields, *ADDED]))
