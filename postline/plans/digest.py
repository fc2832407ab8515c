"""The digest: new postings past a consumer's watermark, grouped, deduplicated over a window, within a budget of characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postline import config

KEY = ["ats", "slug", "external_id"]


def pending(events: DataFrame, jobs: DataFrame, boards: DataFrame, notified: DataFrame, mark: int, now: int) -> DataFrame:
    """Events past the mark that the digest carries, by id."""
    levels = [level for _, level in config.DIGEST_GROUPS]
    right = jobs.filter(
        ((F.col("is_engineering") == 1) | (F.col("is_fde") == 1)) & F.col("seniority").isin(*levels) & F.col("region").isin(*config.DIGEST_REGIONS)
    ).select(*KEY, "is_fde", "role_family", "seniority", "location", "region")
    told = notified.filter(F.col("notified_at") > now - config.DEDUPE_SECONDS).select(*KEY)
    found = events.filter((F.col("id") > mark) & F.col("type").isin("new", "reopened")).select("id", "ts", "type", *KEY, "title", "url")
    named = boards.select("ats", "slug", "company_name")
    return found.join(right, KEY).join(told, KEY, "left_anti").join(named, ["ats", "slug"], "left").orderBy("id")


def span(rows: DataFrame, events: DataFrame, mark: int | None) -> DataFrame:
    """One row: from_id, to_id, pending and flooded. A consumer without a mark begins at the newest event and gets nothing."""
    top = events.agg(F.coalesce(F.max("id"), F.lit(0).cast("bigint")).alias("top"))
    if mark is None:
        return top.select(F.col("top").alias("from_id"), F.col("top").alias("to_id"), F.lit(0).cast("bigint").alias("pending"), F.lit(False).alias("flooded"))
    n = rows.agg(F.count(F.lit(1)).alias("pending"), F.max("id").alias("last"))
    both = n.join(F.broadcast(top))  # one row each
    return both.select(F.lit(mark).cast("bigint").alias("from_id"), F.coalesce("last", "top").alias("to_id"), "pending", (F.col("pending") > config.FLOOD).alias("flooded"))


def lines(rows: DataFrame, budget: int = config.CHAR_BUDGET, per_group: int = config.PER_GROUP) -> DataFrame:
    """The digest's lines in order, one for each posting until the first that doesn't fit the budget.

    Groups take turns, newest first. After the limit per group there are at most ``per_group`` rows a group, so the running
    sum is over a bounded table.
    """
    label = F.create_map(*[F.lit(x) for name, level in config.DIGEST_GROUPS for x in (level, name)])
    rank = F.create_map(*[F.lit(x) for i, (_, level) in enumerate(config.DIGEST_GROUPS) for x in (level, i)])
    grouped = rows.withColumns({"grp": label[F.col("seniority")], "turn_in_round": rank[F.col("seniority")]})
    place = F.row_number().over(Window.partitionBy("grp").orderBy(F.col("id").desc()))
    first = grouped.withColumn("place", place).filter(F.col("place") <= per_group)
    who = F.substring(F.coalesce(F.nullif(F.col("company_name"), F.lit("")), "slug", F.lit("?")), 1, 40)
    bits = F.array_compact(F.array(who, F.when(F.col("is_fde") == 1, "FDE"), F.nullif(F.substring("location", 1, 34), F.lit(""))))
    title = F.substring(F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("?")), 1, 80)
    linked = F.when(F.coalesce(F.col("url"), F.lit("")) != "", F.concat(F.lit("["), title, F.lit("]("), "url", F.lit(")"))).otherwise(title)
    drawn = first.withColumn("line", F.concat(linked, F.lit("  ·  "), F.array_join(bits, " · ")))
    totals = grouped.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("turn_in_round").alias("r"))
    parts = F.sort_array(F.collect_list(F.struct("r", F.concat(F.col("n").cast("string"), F.lit(" "), F.lower("grp")).alias("s"))))
    head = totals.agg(F.sum("n").alias("all"), F.array_join(F.transform(parts, lambda p: p["s"]), " · ").alias("s"))
    spent = head.select(F.char_length(F.concat(F.lit("**"), F.col("all").cast("string"), F.lit(" new** — "), "s", F.lit("  ·  US & remote"))).alias("head"))
    turn = Window.orderBy("place", "turn_in_round").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = drawn.join(F.broadcast(spent)).withColumn("used", F.col("head") + F.sum(F.char_length("line") + 1).over(turn))
    fits = running.withColumn("over", F.max((F.col("used") > budget).cast("int")).over(turn)).filter("over = 0")
    return fits.select("grp", F.col("place").cast("bigint").alias("place"), "id", "line", F.col("used").cast("bigint").alias("used"))


def mark_notified(notified: DataFrame, rows: DataFrame, now: int) -> DataFrame:
    """The next table of notified postings: the latest time of each."""
    told = rows.select(*KEY, F.lit(now).cast("bigint").alias("notified_at"))
    return notified.select(*KEY, "notified_at").unionByName(told).groupBy(*KEY).agg(F.max("notified_at").alias("notified_at"))


def pruned(notified: DataFrame, now: int) -> DataFrame:
    return notified.filter(F.col("notified_at") >= now - config.DEDUPE_SECONDS)
