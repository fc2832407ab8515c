"""Source health: a source's newest finished run against the median of its own history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postline import config


def trends(runs: DataFrame, window: int = config.WINDOW) -> DataFrame:
    """One row for each source with a finished run that wasn't skipped.

    The window's row limit is applied before the shuffle, so a source with very many runs costs no more than others.
    """
    newest = Window.partitionBy("source").orderBy(F.col("id").desc())
    last = runs.filter("finished_at IS NOT NULL AND skipped IS NULL").withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= window)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    at = lambda c: F.max(F.when(F.col("age") == 1, zero(c)))
    before = lambda c: F.coalesce(F.median(F.when(F.col("age") > 1, zero(c))), F.lit(0.0))
    rows = last.groupBy("source").agg(
        F.count(F.lit(1)).alias("runs"),
        at("new_boards").alias("latest"),
        before("new_boards").alias("median"),
        at("refs_seen").alias("refs_latest"),
        before("refs_seen").alias("refs_median"),
        at("blocked").alias("blocked"),
        F.sum(F.when(F.col("age") <= config.SATURATION_RUNS, zero("new_boards"))).alias("recent"),
    )
    low = F.col("refs_latest") < config.COLLAPSE_RATIO * F.col("refs_median")
    fell = (F.col("runs") >= config.MIN_HISTORY) & (F.col("refs_median") > 0) & low
    collapsed = ((F.col("blocked") > 0) & (F.col("refs_latest") == 0)) | fell
    idle = (F.col("runs") >= config.SATURATION_RUNS) & (F.col("refs_latest") > 0) & (F.col("refs_median") > 0) & ~low & (F.col("recent") == 0)
    ratio = F.when(F.col("median") != 0, F.col("latest") / F.col("median")).otherwise(1.0)
    marked = rows.withColumns({"collapsed": collapsed, "saturated": ~collapsed & idle, "ratio": ratio})
    arrow = (
        F.when(F.col("collapsed"), "!")
        .when(F.col("saturated"), "=")
        .when(F.col("runs") < config.MIN_HISTORY, "-")
        .when(F.col("ratio") >= 1.5, "^")
        .when(F.col("ratio") <= 0.5, "v")
        .otherwise("=")
    )
    return marked.withColumn("arrow", arrow).drop("recent")


def collapsed(runs: DataFrame) -> DataFrame:
    return trends(runs).filter("collapsed").orderBy("source")


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest finished run of each source."""
    return runs.filter("finished_at IS NOT NULL").groupBy("source").agg(F.max_by(F.struct("id", "refs_seen", "new_boards"), "id").alias("r")).select("source", "r.*")
