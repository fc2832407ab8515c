"""Line de-duplication over levelled sorted runs of line hashes, with DataFrame operations only.

A line's key is the line without white space at its ends, A-Z lower-cased. A key of at least ``min_chars`` code points
belongs to the smallest document that holds it; every other document loses its lines with that key.

``LineIndex`` holds the keys that earlier batches own as runs: tables bucketed and sorted by hash, one file a bucket. A new
batch is merge-joined with the runs in their stored order, without shuffling or sorting a run; its keys that no run has
become a run of their own at level 0, and ``fanout`` runs of a level are merge-joined into one of the next, so a key is
rewritten once a level and a batch meets few runs. Batches must come in order of doc_id for the smallest document to own a
key. Only hashes are shuffled for this; each text moves once, to meet the numbers of its dropped lines.

Two independent 64-bit hashes stand for a key: at 10^12 lines a clash of both is less likely than 10^-14.

Defined results: a null or empty text is one empty line; rows with a null doc_id stay whole and own nothing; rows that
repeat a doc_id are one document, each with its own lines dropped by the same rule; an empty table gives an empty table;
other columns are carried along unless their names begin with ``_line_``; n_lines and n_dropped are replaced.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postline.llm.common import Scratch, remove, shared_path

MIN_CHARS = 10
BATCHES = 4
FANOUT = 2
#: A key with at least this share of a batch's lines is joined by broadcast; there are at most 1 / HOT of them.
HOT = 1 / 1000
BLANK_CHARS = " \t\n\x0b\x0c\r"
KEY = ["_line_h1", "_line_h2"]
ROW = ["_line_doc", "_line_text"]


def line_key(line: Column) -> Column:
    """``lower`` is right, and much faster, where all characters are ASCII."""
    key = F.btrim(line, F.lit(BLANK_CHARS))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.char_length(key) == F.octet_length(key), F.lower(key)).otherwise(F.translate(key, upper, lower))


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """A row for each line that has a key: the key's hashes, the document, its text's hash and the line's number."""
    lines = docs.filter("doc_id IS NOT NULL").select(
        F.col("doc_id").alias(ROW[0]), F.xxhash64("text").alias(ROW[1]), F.posexplode(F.split("text", "\n", -1)).alias("_line_no", "line")
    )
    keyed = lines.filter(F.octet_length("line") >= min_chars).withColumn("key", line_key(F.col("line"))).filter(F.char_length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias(KEY[0]), F.xxhash64(F.lit("second"), "key").alias(KEY[1]), *ROW, "_line_no")


class LineIndex:
    """The runs, while its ``with`` block lasts: ``add`` returns what a batch loses; at the end the tables are dropped.

    A run's table has its batch's keys: those that are fresh are the run, the others belong to an older one and are left
    out when it is merged. Spark takes a bucketed table's rows as sorted only under ``ORDERED``, so that is set meanwhile.
    """

    ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"

    def __init__(self, spark: SparkSession, scratch: Scratch, fanout: int = FANOUT):
        self.spark, self.scratch, self.fanout = spark, scratch, fanout
        self.levels: list[list[str]] = []
        self.places: dict[str, str] = {}  # of the runs' files, in the folder that all share
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def __enter__(self) -> LineIndex:
        self.before = self.spark.conf.get(self.ORDERED)
        self.spark.conf.set(self.ORDERED, "true")
        return self

    def __exit__(self, *_: object) -> None:
        self.spark.conf.set(self.ORDERED, self.before)
        for name in [run for level in self.levels for run in level]:
            self.drop(name)
        self.levels = []

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        if name in self.places:
            remove(self.spark, self.places.pop(name))

    def write_run(self, rows: DataFrame, level: int) -> str:
        """rows come partitioned by KEY into as many partitions as there are buckets."""
        name = f"line_run_{uuid.uuid4().hex}"
        while level >= len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        self.places[name] = shared_path(self.spark, name)
        rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", self.places[name]).saveAsTable(name)
        return name

    def run(self, name: str) -> DataFrame:
        return self.spark.table(name).filter("fresh").select(*KEY, F.col("owner").alias(f"in_{name}")).hint("merge")

    def compact(self, level: int = 0) -> None:
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            old, merged = list(self.levels[level]), None
            for name in old:  # no key is in two runs, so a merge join of all rows lays them in order
                merged = self.run(name) if merged is None else merged.join(self.run(name), KEY, "full_outer")
            owner = F.coalesce(*[f"in_{name}" for name in old]).alias("owner")
            self.write_run(merged.select(*KEY, owner, F.lit(True).alias("fresh"), *[F.lit(0).cast("bigint").alias(c) for c in ("n", "last")]), level + 1)
            for name in old:
                self.drop(name)
                self.levels[level].remove(name)
            level += 1

    def add(self, hashes: DataFrame) -> DataFrame:
        """The rows of ``hashes`` (of ``line_hashes``) that are dropped; their other keys join the index."""
        keys = hashes.groupBy(*KEY).agg(F.min(ROW[0]).alias("first"), F.max(ROW[0]).alias("last"), F.count(F.lit(1)).alias("n"))
        runs = [run for level in self.levels for run in level]
        for name in runs:
            keys = keys.join(self.run(name), KEY, "left")
        seen = F.coalesce(*[f"in_{name}" for name in runs]) if runs else F.lit(None).cast("bigint")
        own = self.write_run(keys.select(*KEY, F.coalesce(seen, "first").alias("owner"), seen.isNull().alias("fresh"), "n", "last"), 0)
        rows = self.spark.table(own)
        total = rows.agg(F.sum("n")).first()[0] or 0
        shared = rows.filter("last > owner").select(*KEY, "owner", "n")
        hot = F.col("n") >= F.lit(max(2.0, total * HOT))
        is_hot = shared.filter(hot).select(*KEY, F.col("owner").alias("hot_owner"))
        marked = hashes.join(F.broadcast(is_hot), KEY, "left")
        few = marked.filter("hot_owner IS NULL").join(shared.filter(~hot).hint("merge"), KEY).filter(F.col(ROW[0]) > F.col("owner"))
        many = marked.filter(F.col(ROW[0]) > F.col("hot_owner"))
        lost = self.scratch.cut(few.select(*ROW, "_line_no").unionByName(many.select(*ROW, "_line_no")))
        self.compact()
        return lost


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """docs with ``text`` less its dropped lines, and n_lines and n_dropped (long).

    The rows go through the index in ``batches`` ranges of doc_id of about equal size.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000)).first()[0] if batches > 1 else []
    batch = F.lit(0)
    for bound in cuts or []:
        batch = batch + (F.col(ROW[0]) > bound).cast("int")
    with Scratch(spark) as scratch:
        hashes = scratch.cut(line_hashes(docs, min_chars).withColumn("batch", batch), by=["batch"])
        with LineIndex(spark, scratch, fanout) as index:
            dropped = [index.add(hashes.filter(F.col("batch") == k).drop("batch")) for k in range(len(cuts or []) + 1)]
        lost = functools.reduce(DataFrame.unionByName, dropped).groupBy(*ROW).agg(F.collect_set("_line_no").alias("_line_lost"))
        lost = scratch.keep(scratch.cut(lost))
    keyed = docs.withColumns({ROW[0]: F.col("doc_id"), ROW[1]: F.xxhash64("text")})
    lines = F.split("text", "\n", -1)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_line_all") - 1), "_line_lost"), lambda i: F.get("_line_all", i))
    return (
        keyed.join(lost, ROW, "left")
        .withColumn("_line_all", lines)
        .withColumns(
            {
                "text": F.when(F.col("_line_lost").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")),
                "n_lines": F.size("_line_all").cast("bigint"),
                "n_dropped": F.coalesce(F.size("_line_lost"), F.lit(0)).cast("bigint"),
            }
        )
        .drop(*ROW, "_line_lost", "_line_all")
    )
