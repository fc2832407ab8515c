"""N-gram Jaccard join by a token-group matrix.

Documents are sets of hashes of ``WIDTH``-word shingles. Equal sets are one set from the start. The join is exact for
sets with 100 * intersection >= 75 * union, and works in these steps, each a few Spark jobs:

1. Groups. Sets that share a pair of minhashes meet in a bucket, in chunks of bounded size, and are compared in passing
   with at most ``LEADERS`` of those before them. Verified links make components; a set's largest bucket, dealt by size
   into groups of about ``GROUP``, is its group, linked or not. A set that shares no bucket is a group of its own.
2. The matrix, sparsely: a set's prefix (its n - ceil(3n/4) + k first tokens, likely and frequent ones last) meets the
   prefixes of all others by token. If two sets link, their prefixes share k tokens. Tokens whose sets lie in one
   component are dropped; for the others, sets of smaller components become queries to the groups that hold larger ones,
   never pairs of sets, where the group's prefixes have k tokens of the query's. No list per token is built.
3. Opening. A query's overlap with a group's token union bounds its overlap with each member. Only a group whose bound
   reaches ceil(3n/4) is opened, and the query compared with its members, but for those that it is connected to.
4. Components over all links.

A token's first bits grow as its shingle gets shorter, so sorting puts long and unlikely shingles first. Frequent tokens
are found by a sketch of fixed size, summed before they are shuffled, and joined where a join may be split. Both only
decide the order in prefixes, never what is found: with those tokens last, common phrases and shared passages make no
candidates of documents that are otherwise unlike. Each distinct text is written once, in buckets
of its hash, and later steps join it there. Texts and prefixes are shuffled in passes, each a share of the hashes whose
shuffle goes before the next, so that disk never holds all of it at once. Spark chooses each join by the tables' bytes; none is told to broadcast. Shingles and sets are compared by 64-bit hashes.

Defined results: null or empty texts have the empty set and no links; with fewer than ``WIDTH`` words the whole sequence
is one shingle; texts of any length are read whole, in pieces of words but as one set; rows with a null doc_id link nothing
and have a null component; rows that repeat a doc_id each have their own set; equal sets are one class; an empty table gives
an empty table; other columns are not looked at.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postline.llm import tokens
from postline.llm.common import Scratch
from postline.llm.components import EDGE, components, forests

WIDTH = 5
NEED, OF = 75, 100
MINHASHES, PER_BUCKET = 6, 2
LEADERS = 64
GROUP = 128
#: Sets of a bucket, or queries of a group, that one task compares in a row.
CHUNK, QUERIES = 512, 256
#: Shares in which texts and the tokens of prefixes are shuffled, one after another.
TEXT_PASSES, TOKEN_PASSES = 2, 4
#: Tokens that the prefixes of linked sets share at least, where the sets are that large.
COMMON = 6
SKETCH_BITS = 22
#: Bytes of a shingle from which it is in the next earlier class of the order.
LENGTHS = np.array([42, 37, 33, 29, 25, 21, 17])
SEEDS = (np.arange(1, MINHASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(text: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    table = tokens.blank_table()
    for _, data, bounds in tokens.slices(text):
        words = tokens.Words(data, bounds, table)
        h = words.hashes()
        w = tokens.windows(h, WIDTH)
        letters = np.concatenate([[0], np.cumsum(words.end - words.start)])
        size = letters[WIDTH:] - letters[: max(len(letters) - WIDTH, 0)]
        w = (w >> np.uint64(3)) | (np.searchsorted(-LENGTHS, -size[: len(w)]).astype(np.uint64) << np.uint64(61))
        for i in range(len(bounds) - 1):
            a, b = words.first[i], words.first[i + 1]
            if b - a >= WIDTH:
                yield np.unique(w[a : b - WIDTH + 1])
            elif b > a:
                yield tokens.windows(h[a:b], int(b - a)) + np.uint64(b - a)
            else:
                yield np.zeros(0, np.uint64)


def set_key(s: np.ndarray) -> int:
    return int(tokens.mix(np.array([tokens.mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def needed(n: int) -> int:
    """The least intersection of a set of n with one that it links to."""
    return -(-NEED * n // OF)


def cells(s: np.ndarray) -> np.ndarray:
    """The tokens' cells in the sketch."""
    return (s & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int32)


def prefix_size(n: int) -> int:
    return n - needed(n) + min(COMMON, needed(n))


def links(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or OF * len(small) < NEED * len(large):
        return False
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return OF * both >= NEED * (len(a) + len(b) - both)


SIGNATURE = "doc_id bigint, mark bigint, n bigint, set_id bigint, " + ", ".join(f"m{j} bigint" for j in range(MINHASHES)) + ", cells array<int>"


def signatures(docs: DataFrame) -> DataFrame:
    """A row for each document: its text's hash, its set's size, key and minhashes; and a row for each task (n = -1) with the sketch's cells
    that stand out in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int32)
        for b in batches:
            n, ids, mins, part = [], [], [], []
            for s in shingle_sets(b.column(b.schema.get_field_index("text"))):
                n.append(len(s))
                ids.append(set_key(s) if len(s) else 0)
                mins.append([int(tokens.mix(s * k).min().view(np.int64)) if len(s) else 0 for k in SEEDS])
                part.append(cells(s))
                if len(part) == 500:
                    np.add.at(sketch, np.concatenate(part), 1)
                    part = []
            if part:
                np.add.at(sketch, np.concatenate(part), 1)
            m = np.array(mins, np.int64).reshape(-1, MINHASHES)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(b.schema.get_field_index(c)) for c in ("doc_id", "mark")), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), *(pa.array(m[:, j]) for j in range(MINHASHES))]
                + [pa.nulls(len(n), pa.list_(pa.int32()))],
                schema=arrow,
            )
        out = np.flatnonzero(sketch > 4 + 4 * sketch.mean()).astype(np.int32)
        yield pa.RecordBatch.from_pylist([{"n": -1, "cells": out.tolist()}], schema=arrow)

    arrow = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("set_id", pa.int64()), *((f"m{j}", pa.int64()) for j in range(MINHASHES)), ("cells", pa.list_(pa.int32()))])
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("mark"), "text").mapInArrow(run, SIGNATURE)


def buckets(sets: DataFrame) -> DataFrame:
    """(bucket, crowd, chunk, set_id, mark) of the sets that share a pair of minhashes with others: crowd is the bucket's
    size, a chunk has about CHUNK."""
    pairs = [F.xxhash64(F.lit(j), *[f"m{k}" for k in range(j, j + PER_BUCKET)]) for j in range(0, MINHASHES, PER_BUCKET)]
    rows = sets.select("set_id", "mark", F.explode(F.array(*pairs)).alias("bucket"))
    several = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("crowd")).filter("crowd > 1")
    # dealt anew in each bucket, so that chunks of one pair of minhashes are joined by those of another
    return rows.join(several, "bucket").withColumn("chunk", F.pmod(F.xxhash64("set_id", "bucket"), F.ceil(F.col("crowd") / CHUNK)))


def distinct_texts(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(mark, text): each distinct text once, in buckets of its mark. This is the one time that all texts move, a share at a time."""
    marked = docs.filter("text IS NOT NULL").select(F.xxhash64("text").alias("mark"), "text")
    return scratch.bucketed([share(marked, "mark", k, TEXT_PASSES).dropDuplicates(["mark"]) for k in range(TEXT_PASSES)], "mark")


def share(rows: DataFrame, key: str, k: int, of: int) -> DataFrame:
    """The rows whose key, a hash, is in the k-th of so many shares."""
    return rows.filter(F.pmod(key, F.lit(of)) == k)


def with_text(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (with set_id and mark) with the set's text; the texts stay in their buckets."""
    return texts.join(wanted, "mark")


def compared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Links (lo, hi), contracted, between the role 0 sets (members) and role 1 sets (queries) of each group of ``keys``.

    A group's rows come in a row within a partition, members first. A group holds few members; queries stream by. Each row
    has its component (comp, size): a query is compared with members of larger components, one link for each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, members, union = None, [], None
        for b in batches:
            col = {c: b.column(b.schema.get_field_index(c)).to_pylist() for c in (*keys, "role", "set_id", "comp", "size")}
            a_out, b_out = [], []
            for i, s in enumerate(shingle_sets(b.column(b.schema.get_field_index("text")))):
                if not len(s) or set_key(s) != col["set_id"][i]:
                    continue  # another text with this hash
                own, rank = tuple(col[k][i] for k in keys), (col["size"][i], col["comp"][i])
                if own != group:
                    group, members, union = own, [], None
                if col["role"][i] == 0:
                    members.append((col["set_id"][i], rank, s))
                    union = None
                    continue
                if not members:
                    continue
                if union is None:
                    union = members[0][2] if len(members) == 1 else np.unique(np.concatenate([m for *_, m in members]))
                # the bound: no member can share more with the query than the union does
                if int((union[np.minimum(np.searchsorted(union, s), len(union) - 1)] == s).sum()) < needed(len(s)):
                    continue
                linked = set()
                for key, theirs, m in members:
                    if theirs > rank and theirs not in linked and links(s, m):
                        linked.add(theirs)
                        a_out.append(key)
                        b_out.append(col["set_id"][i])
            if a_out:
                yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    return rows.repartition(*keys).sortWithinPartitions(*keys, "role", "set_id").mapInArrow(lambda batches: forests(run(batches)), EDGE)


def easy_links(texts: DataFrame, homes: DataFrame) -> DataFrame:
    """Links (lo, hi), contracted, found by passing each bucket's chunk once: a set is compared with leaders that it isn't connected to yet,
    and becomes one if it links to none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, leaders, part = None, [], {}
        for b in batches:
            col = {c: b.column(b.schema.get_field_index(c)).to_pylist() for c in ("bucket", "chunk", "set_id")}
            a_out, b_out = [], []
            for i, s in enumerate(shingle_sets(b.column(b.schema.get_field_index("text")))):
                own, key = (col["bucket"][i], col["chunk"][i]), col["set_id"][i]
                if not len(s) or set_key(s) != key:
                    continue  # another text with this hash
                if own != group:
                    group, leaders, part = own, [], {}
                mine: int | None = None
                for other, t in leaders:
                    if part[other] != mine and links(s, t):
                        a_out.append(other)
                        b_out.append(key)
                        if mine is None:
                            mine = part[other]
                        else:  # this set joins two parts
                            part = {k: mine if v == part[other] else v for k, v in part.items()}
                if mine is None and len(leaders) < LEADERS:
                    leaders.append((key, s))
                    part[key] = key
            if a_out:
                yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    rows = with_text(texts, homes.select("bucket", "chunk", "set_id", "mark"))
    return rows.repartition("bucket", "chunk").sortWithinPartitions("bucket", "chunk", "set_id").mapInArrow(lambda batches: forests(run(batches)), EDGE)


def prefixes(texts: DataFrame, owners: DataFrame, hot: np.ndarray) -> DataFrame:
    """(token, late, set_id, comp) of each set's prefix. late: the frequent tokens, which are in hot cells of the sketch and come last
    in the order.

    owners: set_id, mark and comp of each set. comp is left null where it is the set's own.
    """
    is_hot = np.zeros(1 << SKETCH_BITS, bool)
    is_hot[hot] = True
    held = texts.sparkSession.sparkContext.broadcast(np.packbits(is_hot))
    arrow = pa.schema([("token", pa.int64()), ("late", pa.bool_()), ("set_id", pa.int64()), ("comp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late_cells = np.unpackbits(held.value).astype(bool)
        for b in batches:
            want, comp = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("set_id", "comp"))
            token, ids, comps = [], [], []  # of each set, the early tokens and then the late ones

            def block() -> pa.RecordBatch:
                part = np.repeat(np.arange(len(token)), [len(t) for t in token])
                of = pa.array(part // 2)
                columns = [pa.array(np.concatenate(token).view(np.int64)), pa.array(part % 2 == 1), pa.array(ids, pa.int64()).take(of), pa.array(comps, pa.int64()).take(of)]
                return pa.RecordBatch.from_arrays(columns, schema=arrow)

            for i, s in enumerate(shingle_sets(b.column(b.schema.get_field_index("text")))):
                if not len(s) or set_key(s) != want[i]:
                    continue
                late = late_cells[cells(s)]
                size = prefix_size(len(s))
                early = s[~late][:size]
                token += [early, s[late][: size - len(early)]]
                ids.append(want[i])
                comps.append(comp[i])
                if len(ids) >= 1000:
                    yield block()
                    token, ids, comps = [], [], []
            if token:
                yield block()

    own = F.when(F.col("comp") != F.col("set_id"), F.col("comp")).alias("comp")
    return with_text(texts, owners.select("set_id", "mark", own)).select("set_id", "comp", "text").mapInArrow(run, "token bigint, late boolean, set_id bigint, comp bigint")


def meeting(tokens_of: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """(token, set_id) in several tables: the tokens of prefixes whose sets lie in more than one component."""
    comp, token = F.coalesce("comp", "set_id"), Window.partitionBy("token")
    rare, often = tokens_of.filter("NOT late"), tokens_of.filter("late")
    met = []
    for k in range(TOKEN_PASSES):  # few sets have a rare token: they meet once
        beside = share(rare, "token", k, TOKEN_PASSES).withColumns({"lo": F.min(comp).over(token), "hi": F.max(comp).over(token)})
        met.append(scratch.cut(beside.filter("lo <> hi").select("token", "set_id")))
        scratch.free()
    # a frequent token may be in a large part of all sets: it is summed before it is shuffled, and then joined
    shared = often.groupBy("token").agg(F.min(comp).alias("lo"), F.max(comp).alias("hi")).filter("lo <> hi").select("token")
    return [*met, scratch.cut(often.join(shared, "token").select("token", "set_id"))]


def group_queries(texts: DataFrame, owners: DataFrame, hot: np.ndarray, scratch: Scratch) -> DataFrame:
    """(set_id, home, band, salt): the queries, and the groups that their prefixes meet."""
    tokens_of = scratch.cut(prefixes(texts, owners, hot))
    scratch.free()
    parts = meeting(tokens_of, scratch)
    scratch.free(tokens_of)
    met = scratch.cut(functools.reduce(DataFrame.unionByName, parts).join(owners.drop("first_doc", "mark"), "set_id"))
    scratch.free(*parts)
    rank = F.struct("size", "comp")
    asking = met.select("token", "set_id", "n", F.col("band").alias("own_band"), rank.alias("own"))
    asked = met.groupBy("token", "home", "band", "salt").agg(F.max(rank).alias("theirs"))
    pairs = asking.join(asked, "token").filter((F.col("own") < F.col("theirs")) & (F.abs(F.col("own_band") - F.col("band")) <= 1))
    least = F.ceil(F.ceil(F.col("n") * NEED / OF) * NEED / OF)  # what the smallest set that links to one of n needs
    grouped = pairs.groupBy("set_id", "n", "home", "band", "salt").agg(F.count(F.lit(1)).alias("common"))
    queries = scratch.cut(grouped.filter(F.col("common") >= F.least(F.lit(COMMON), least)).select("set_id", "home", "band", "salt"))
    scratch.free(met)
    return queries


def band():
    """Sizes that can link are in the same band or in neighbours."""
    return F.floor(F.log("n") / F.lit(float(np.log(OF / NEED)))).cast("int")


def salt():
    return F.pmod(F.xxhash64("set_id"), F.ceil(F.col("crowd") / GROUP))


def ownership(sets: DataFrame, homes: DataFrame, known: DataFrame) -> DataFrame:
    """(set_id, first_doc, mark, n, comp, size, home, band, salt): each set with its component and group."""
    sizes = known.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    linked = known.join(sizes, "label").select(F.col("node").alias("set_id"), F.col("label").alias("comp"), "size")
    home = homes.groupBy("set_id").agg(F.max(F.struct("crowd", "bucket")).alias("h")).select("set_id", F.col("h.bucket").alias("home"), "h.crowd")
    one = F.lit(1).cast("bigint")
    each = sets.select("set_id", "first_doc", "mark", "n").join(linked, "set_id", "left").join(home, "set_id", "left")
    filled = each.withColumns({"comp": F.coalesce("comp", "set_id"), "size": F.coalesce("size", one), "home": F.coalesce("home", "set_id"), "crowd": F.coalesce("crowd", one)})
    return filled.withColumns({"band": band(), "salt": salt()}).drop("crowd")


def hot_cells(rows: DataFrame) -> np.ndarray:
    """The cells of the sketch that stand out in any task: at most 2 ** SKETCH_BITS numbers, whatever the input."""
    spots = rows.filter("n = -1").select(F.explode("cells").alias("cell"))
    packed = spots.groupBy(F.shiftright("cell", 12).alias("k")).agg(F.collect_set("cell").alias("cells")).toArrow()
    return packed["cells"].combine_chunks().flatten().to_numpy() if packed.num_rows else np.zeros(0, np.int32)


def similar(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs: its set's size and the smallest doc_id that links reach."""
    docs = docs.select("doc_id", "text")
    with Scratch(docs.sparkSession) as scratch:
        cut, free = scratch.cut, scratch.free
        rows = cut(signatures(docs))
        owned = rows.filter("n >= 0")
        mins = [F.min(f"m{j}").alias(f"m{j}") for j in range(MINHASHES)]
        sets = cut(owned.filter("n > 0 AND doc_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("first_doc"), F.min("mark").alias("mark"), F.min("n").alias("n"), *mins))
        hot = hot_cells(rows)
        homes = cut(buckets(sets))
        free()
        texts = distinct_texts(docs, scratch)
        free()
        known = components(easy_links(texts, homes), scratch)
        owners = cut(ownership(sets, homes, known))
        free(sets, homes)
        queries = group_queries(texts, owners, hot, scratch)
        group = ["home", "band", "salt"]
        chunks = queries.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("chunks"))
        use = ["set_id", "mark", "comp", "size"]
        members = owners.join(chunks, group).select(*use, *group, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("role"))
        asking = queries.join(chunks, group).join(owners.select(*use), "set_id").select(*use, *group, F.pmod(F.xxhash64("set_id"), "chunks").alias("chunk"), F.lit(1).alias("role"))
        hard = compared(with_text(texts, members.unionByName(asking)), [*group, "chunk"])
        chains = known.filter("node <> label").select(F.col("label").alias("lo"), F.col("node").alias("hi"))
        labels = components(chains.unionByName(hard), scratch)
        free(queries, known, texts)
        labelled = owners.select("set_id", "first_doc").join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
        least = labelled.groupBy("label").agg(F.min("first_doc").alias("component_id"))
        final = cut(labelled.join(least, "label").select("set_id", "component_id"))
        free(owners, labels)
        by_row = owned.select("doc_id", F.col("n").alias("n_shingles"), "set_id")
        classes = cut(by_row.join(final, "set_id", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))
        return scratch.keep(classes)
