"""A training corpus from raw documents: five stages, each on all rows that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs; a table is deleted once the next is written. All but the last return the columns of ``docs``, whatever their
names: an operator sees doc_id and text alone, others by names that it doesn't add. A stage that changes texts sets n_chars
anew, if there is such a column. Texts of any length are worked on whole; an empty table stays empty in every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postline.llm import bpe, decontaminate, jaccard, lines, toxicity
from postline.llm.common import Scratch, crc_bucket, remove, shared_path, table
from postline.llm.queries import vocabulary_path

#: A document that is at least this likely to be toxic goes.
TOXIC = 0.5


def aside(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What the operator makes of docs, with the columns of docs: those beside doc_id and text pass by under other names."""
    others = {c: f"_beside_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    out = operator(docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(new) for c, new in others.items()]))
    return out.select(*[F.col(others.get(c, c)).alias(c) for c in docs.columns])


def recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier finds less than TOXIC likely to be toxic; rows without a text or an id
    are scored like any other; equal texts get equal scores, so ties and repeated rows go or stay together."""
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), crc_bucket(F.col("doc_id"), 4) != 2)
    return aside(docs, lambda d: toxicity.score(d, model).filter(F.col("score") < TOXIC))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that a smaller doc_id has. A document that loses all its lines stays, empty; a null text
    becomes empty; rows without a doc_id lose nothing."""
    return recounted(aside(docs, lines.dedup_lines))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: the smallest by doc_id, then by a hash of the text.

    Of rows that repeat doc_id and text, one stays (least by a hash of the row); rows that repeat a doc_id with another text are
    documents of their own. Documents without words link with none and stay, as do rows without a doc_id.
    """
    columns = docs.columns
    with Scratch(spark) as scratch:
        repeated = scratch.cut(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"))
        if repeated.isEmpty():
            named = docs.select(F.struct(*columns).alias("row"), F.col("doc_id").cast("bigint").alias("own"), F.col("text"))
        else:
            named = scratch.keep(scratch.cut(one_a_text(docs, repeated, scratch)))
        classes = jaccard.similar(named.select(F.col("own").alias("doc_id"), "text"))
        others = scratch.keep(scratch.cut(classes.filter("component_id IS NOT NULL AND component_id <> doc_id").select(F.col("doc_id").alias("own")).distinct()))
        return named.join(others, "own", "left_anti").select("row.*")


def one_a_text(docs: DataFrame, repeated: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, own, text): docs less repeated rows of a doc_id and text. own numbers the documents by doc_id, then by a hash of the
    text; it is null without a doc_id."""
    columns = docs.columns
    packed = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.struct(*columns).alias("row"))
    least = F.min(F.struct(F.xxhash64("row").alias("by"), "row", "text")).alias("m")
    several = packed.join(repeated, "doc_id", "left_semi").groupBy("doc_id", "hash").agg(least).select("doc_id", "hash", "m.row", "m.text")
    single = packed.filter("doc_id IS NOT NULL").join(repeated, "doc_id", "left_anti").select("doc_id", "hash", "row", "text")
    rows = scratch.cut(single.unionByName(several))
    # ranges of doc_id hold about as many rows each: numbers within one, and the rows before it
    ranged = scratch.cut(rows.select("doc_id", "hash").repartitionByRange("doc_id", "hash").withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each partition
    number = F.row_number().over(Window.partitionBy("part").orderBy("doc_id", "hash"))
    owned = ranged.join(before, "part").select("doc_id", "hash", (F.col("before") + number).alias("own"))
    nameless = packed.filter("doc_id IS NULL").select("row", F.lit(None).cast("bigint").alias("own"), "text")
    return rows.join(owned, ["doc_id", "hash"]).select("row", "own", "text").unionByName(nameless)


def remove_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the words under any benchmark phrase; a null text becomes empty. Rows are judged one by one."""

    def cleaned(d: DataFrame) -> DataFrame:
        marked = decontaminate.mark(d, table(spark, sf_dir, "benchmark"))
        return decontaminate.without_spans(marked.withColumn("text", F.coalesce("text", F.lit(""))))

    return recounted(aside(docs, cleaned))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the text that the ids decode to; a null or empty text has no ids. Repeated rows stay."""
    vocabulary = bpe.Vocabulary.load(vocabulary_path())
    encoded = bpe.with_ids(docs.select("doc_id", "text"), vocabulary, decoded=True)
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", remove_benchmark_passages),
    ("bpe_encoding", encode),
]

#: SQL can't express the trained first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        at = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if last:
            remove(spark, last)
        last = at
    return docs
