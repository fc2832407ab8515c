"""Bookkeeping of sweeps: what discovery, validation and polling did, as one row for each source, platform or run.

``found`` has a row for each reference that a source gave: source, ord (its order within the source), ats and slug where it
is a board, company_name, domain, website and careers_url where it names a company, and external_id and title where it
carries a posting. ``sources`` has a row for each source that was asked: source, rank (the order of sources), blocked (how
many requests were refused), error (a source that died keeps what it gave before) and skipped (why it wasn't asked at all).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postline.operators import registry
from postline.operators.diff import KEY

BOARD = ["ats", "slug"]
#: Places of a source's references, below its rank in one order over all sources.
WITHIN = 1 << 40


def in_order(found: DataFrame, sources: DataFrame, limit: int | None = None) -> DataFrame:
    """The references of sources that weren't skipped, at most ``limit`` of each, with one order over all as ord."""
    asked = found.join(F.broadcast(sources.filter("skipped IS NULL").select("source", "rank")), "source")  # a row for each source
    if limit is not None:
        asked = asked.withColumn("_place", F.row_number().over(Window.partitionBy("source").orderBy("ord"))).filter(F.col("_place") <= limit).drop("_place")
    return asked.withColumn("ord", F.col("rank").cast("bigint") * WITHIN + F.col("ord"))


def company_rows(rows: DataFrame, *others: str) -> DataFrame:
    """The references that name a company, as ``registry.resolve_companies`` takes them, with other columns of theirs."""
    named = rows.filter("company_name IS NOT NULL OR website IS NOT NULL OR domain IS NOT NULL")
    return named.select(*others, F.col("company_name").alias("name"), "domain", "website", "careers_url", "ord")


def sweep_counts(found: DataFrame, sources: DataFrame, boards: DataFrame, companies: DataFrame, jobs: DataFrame, limit: int | None = None) -> DataFrame:
    """By source: refs_seen, new_boards, new_companies, seed_postings, blocked, error, skipped. What two sources find counts for
    the first in order. Sources that were skipped or found nothing have a row too."""
    rows = in_order(found, sources, limit)
    first = F.floor(F.min("ord") / WITHIN).cast("int").alias("rank")
    count = lambda df, name: df.groupBy("rank").agg(F.count(F.lit(1)).alias(name))
    new_boards = rows.filter("slug IS NOT NULL").groupBy(*BOARD).agg(first).join(boards, BOARD, "left_anti")
    seeds = rows.filter("external_id IS NOT NULL").groupBy(*KEY).agg(first).join(jobs, KEY, "left_anti")
    firms = registry.resolve_companies(companies, company_rows(rows)).filter("company_id IS NULL").select(F.floor(F.col("ord") / WITHIN).cast("int").alias("rank"))
    out = sources.join(count(rows, "refs_seen"), "rank", "left")
    for df, name in ((new_boards, "new_boards"), (firms, "new_companies"), (seeds, "seed_postings")):
        out = out.join(count(df, name), "rank", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("refs_seen", "new_boards", "new_companies", "seed_postings", "blocked")]
    return out.select("source", "rank", *numbers, "error", "skipped")


def dry_counts(found: DataFrame, sources: DataFrame, limit: int | None = None) -> DataFrame:
    """By source, without a look at any table: refs, distinct boards, companies that are no board's, and postings."""
    rows = in_order(found, sources, limit)
    board = F.col("slug").isNotNull()
    counts = rows.groupBy("source").agg(
        F.count_if(board).alias("refs"),
        F.countDistinct(F.when(board, F.struct(*BOARD))).alias("unique_refs"),
        F.count_if(~board).alias("companies"),
        F.count("external_id").alias("postings"),
    )
    blank = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("refs", "unique_refs", "companies", "postings")]
    return sources.join(counts, "source", "left").select("source", *blank, "error", "skipped")


def source_runs(counts: DataFrame, started: int, finished: int, last_id: int) -> DataFrame:
    """Finished rows for the table of source runs, numbered on from last_id in the order of sources (a row for each source)."""
    number = F.row_number().over(Window.orderBy("rank")).cast("bigint")
    columns = ["refs_seen", "new_boards", "new_companies", "seed_postings", "blocked", "error", "skipped"]
    return counts.select((number + last_id).alias("id"), "source", F.lit(started).cast("bigint").alias("started_at"), F.lit(finished).cast("bigint").alias("finished_at"), *columns)


def poll_run(polled: DataFrame, decisions: DataFrame, started: int, finished: int, last_id: int) -> DataFrame:
    """The finished row of one poll: boards polled and failed (polled: a row each, with fetch_status), and what its diff did."""
    action = lambda k: F.count_if(F.col("action") == k).cast("int")
    boards = polled.agg(F.count(F.lit(1)).cast("int").alias("boards_polled"), F.count_if(F.col("fetch_status") != "ok").cast("int").alias("boards_failed"))
    done = decisions.agg(action("new").alias("new_jobs"), action("edited").alias("edited_jobs"), action("closed").alias("closed_jobs"))
    times = [F.lit(v).cast("bigint").alias(c) for c, v in (("id", last_id + 1), ("started_at", started), ("finished_at", finished))]
    return boards.join(F.broadcast(done)).select(*times, "boards_polled", "boards_failed", "new_jobs", "edited_jobs", "closed_jobs")  # one row each


def validated(boards: DataFrame, probes: DataFrame, ts: int, revalidate: bool = False) -> tuple[DataFrame, DataFrame]:
    """(boards, tallies by ats) after a first look at unvalidated boards, or another one at dead ones.

    probes: ats, slug, fetch_status, job_count and error; those of other boards are left out.
    """
    asked = boards.filter(F.col("status") == ("dead" if revalidate else "unvalidated")).select(*BOARD)
    got = probes.join(asked, BOARD, "left_semi").withColumn("had_new", F.lit(False))
    ok = F.col("fetch_status") == "ok"
    tallies = got.groupBy("ats").agg(
        F.count(F.lit(1)).alias("checked"),
        F.count_if(ok & (F.col("job_count") > 0)).alias("active"),
        F.count_if(ok & (F.col("job_count") <= 0)).alias("empty"),
        F.count_if(F.col("fetch_status") == "permanent").alias("dead"),
        F.count_if(F.col("fetch_status") == "transient").alias("errored"),
        F.coalesce(F.sum(F.when(ok, F.col("job_count"))), F.lit(0)).cast("bigint").alias("jobs"),
    )
    return registry.after_poll(boards, got, ts), tallies


def by_size(boards: DataFrame, wanted: Column, limit: int | None = None) -> DataFrame:
    """A queue of boards: those with most postings first, unknown numbers last."""
    queue = boards.filter(wanted).orderBy(F.col("job_count").desc_nulls_last(), *BOARD)
    return queue.limit(limit) if limit else queue


def adoption_queue(boards: DataFrame, limit: int | None = None) -> DataFrame:
    """Boards without a company that name one."""
    return by_size(boards, F.col("company_id").isNull() & (F.col("company_name").isNotNull() | F.col("website").isNotNull()), limit)


def backfill_queue(boards: DataFrame, limit: int | None = None) -> DataFrame:
    """Live boards without a careers page."""
    return by_size(boards, F.col("careers_url").isNull() & F.col("status").isin("active", "empty"), limit)
