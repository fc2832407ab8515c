"""Read queries over jobs, boards, companies and events: filtered pages, roll-ups, counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postline import config
from postline.functions import labels

BOARD = ["ats", "slug"]
SORTABLE = {"posted": "posted_at", "source": "ats", "seen": "first_seen_at", "title": "title", "company": "company"}


def all_of(conditions: list[Column | None]) -> Column:
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def contains(column: str, text: str | None, escape: bool = False) -> Column | None:
    """Case-insensitive containment; ``%`` and ``_`` in text are wildcards unless escape is set."""
    if not text:
        return None
    return F.col(column).ilike(f"%{text.translate(str.maketrans({c: chr(92) + c for c in '%_' + chr(92)})) if escape else text}%")


def equals(column: str, value) -> Column | None:
    return None if value is None else F.col(column) == value


def with_company(jobs: DataFrame, boards: DataFrame, companies: DataFrame) -> DataFrame:
    """jobs with their board's company_id and company: the company's name, else the board's, else the slug."""
    b = boards.select(*BOARD, "company_id", F.col("company_name").alias("_board_name"))
    c = companies.select(F.col("id").alias("company_id"), F.col("name").alias("_company"))
    named = jobs.join(b, BOARD, "left").join(c, "company_id", "left")
    return named.withColumn("company", F.coalesce("_company", "_board_name", "slug")).drop("_board_name")


def jobs_page(
    jobs: DataFrame,
    boards: DataFrame,
    companies: DataFrame,
    *,
    family=None,
    seniority=None,
    engineering=None,
    fde=None,
    status="open",
    since=None,
    company_id=None,
    title=None,
    limit=config.PAGE,
    offset=0,
) -> DataFrame:
    """A page of jobs, the newest first. since 0 is no filter."""
    rows = with_company(jobs, boards, companies).filter(
        all_of(
            [
                equals("status", status),
                equals("role_family", family),
                equals("seniority", seniority),
                None if engineering is None else F.col("is_engineering") == int(engineering),
                None if fde is None else F.col("is_fde") == int(fde),
                F.col("first_seen_at") >= since if since else None,
                equals("company_id", company_id),
                contains("title", title),
            ]
        )
    )
    return rows.orderBy(F.col("first_seen_at").desc(), *BOARD, "external_id").offset(offset).limit(min(limit, config.JOBS_PAGE_MOST))


def open_jobs(jobs: DataFrame, boards: DataFrame, companies: DataFrame, *, family=None, seniority=None, ats=None, title=None, regions=(), company=None) -> DataFrame:
    """Open postings that pass the listing's filters; company is looked for in the company's name or the slug."""
    rows = with_company(jobs, boards, companies)
    named = None if not company else F.coalesce(contains("_company", company), F.lit(False)) | contains("slug", company)
    wanted = F.col("region").isin(*regions) if regions else None
    return rows.filter(all_of([F.col("status") == "open", equals("role_family", family), equals("seniority", seniority), equals("ats", ats), contains("title", title), wanted, named]))


def listing(rows: DataFrame, sort: str = "seen", descending: bool = True, page: int = 1, size: int = config.PAGE) -> DataFrame:
    """A page of open_jobs, with one row more where there is a next page. Nulls come last in either direction."""
    by = F.col(SORTABLE[sort])
    order = by.desc_nulls_last() if descending else by.asc_nulls_last()
    return rows.orderBy(order, "content_hash", *BOARD, "external_id").offset((page - 1) * size).limit(size + 1)


def company_rollup(companies: DataFrame, boards: DataFrame, *, has_careers=None, text=None, monitored=None) -> DataFrame:
    """Companies with their number of live boards, the most first."""
    live = boards.filter(F.col("status").isin("active", "empty") & F.col("company_id").isNotNull()).groupBy(F.col("company_id").alias("id")).agg(F.count(F.lit(1)).alias("monitored"))
    rows = companies.join(live, "id", "left").withColumn("monitored", F.coalesce("monitored", F.lit(0).cast("bigint")))
    page = None if has_careers is None else F.col("careers_url").isNotNull() == F.lit(has_careers)
    named = None if not text else F.coalesce(contains("name", text), F.lit(False)) | F.coalesce(contains("domain", text), F.lit(False))
    watched = None if monitored is None else (F.col("monitored") > 0) == F.lit(monitored)
    return rows.filter(all_of([page, named, watched])).orderBy(F.col("monitored").desc(), "id")


def company_jobs(jobs: DataFrame, boards: DataFrame, company_id: int, limit: int = config.COMPANY_JOBS_MOST) -> DataFrame:
    own = boards.filter(F.col("company_id") == company_id).select(*BOARD)
    return jobs.join(own, BOARD).orderBy(F.col("first_seen_at").desc(), *BOARD, "external_id").limit(limit)


def event_feed(events: DataFrame, jobs: DataFrame, boards: DataFrame | None = None, *, kind=None, since=None, engineering_only=False, limit=100) -> DataFrame:
    """The newest events; with boards, each with its company's name, else the board's own, and the location in its details."""
    rows = events.filter(all_of([equals("type", kind), F.col("ts") >= since if since else None]))
    if engineering_only:
        rows = rows.join(jobs.filter("is_engineering = 1").select(*BOARD, "external_id"), [*BOARD, "external_id"], "left_semi")
    newest = rows.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(limit)
    if boards is None:
        return newest
    named = newest.join(boards.select(*BOARD, "company_name"), BOARD, "left")
    who = F.coalesce("company_name", "slug", F.lit("-"))
    where = F.coalesce(F.get_json_object("detail_json", "$.location"), F.lit("")) if "detail_json" in events.columns else F.lit("")
    return named.withColumns({"company": who, "location": where}).drop("company_name").orderBy(F.col("ts").desc(), F.col("id").desc())


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) for each table."""
    each = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, each)


def pipeline_counts(companies: DataFrame, boards: DataFrame, jobs: DataFrame, events: DataFrame) -> DataFrame:
    stale = F.col("classified_by").isNull() | (F.col("classified_by") != labels.RULESET)
    return counts(
        {
            "companies": companies,
            "with_careers": companies.filter("careers_url IS NOT NULL"),
            "boards": boards,
            "active_boards": boards.filter("status = 'active'"),
            "open_jobs": jobs.filter("status = 'open'"),
            "events": events,
            "unclassified": jobs.filter(stale),
        }
    )


def boards_by_status(boards: DataFrame) -> DataFrame:
    return boards.groupBy("ats", "status").agg(F.count(F.lit(1)).alias("n")).orderBy("ats", "status")


def source_attribution(board_sources: DataFrame, boards: DataFrame) -> DataFrame:
    """By source: its boards, and how many are active or dead."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    return board_sources.join(boards, BOARD).groupBy("source").agg(F.count(F.lit(1)).alias("n"), of("active"), of("dead"))


def company_stats(companies: DataFrame, boards: DataFrame) -> DataFrame:
    """One row of totals; zero for empty tables."""
    live = boards.filter("company_id IS NOT NULL AND status IN ('active', 'empty')").select(F.col("company_id").alias("id")).distinct()
    rows = companies.join(live.withColumn("watched", F.lit(True)), "id", "left")
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count("domain").alias("with_domain"),
        F.count("careers_url").alias("with_careers"),
        F.count_if(F.col("careers_kind") == "ats").alias("on_ats"),
        F.count_if(F.col("careers_kind") == "html").alias("on_html"),
        F.count("watched").alias("monitored"),
        F.count_if(F.col("watched").isNull() & F.col("careers_url").isNotNull()).alias("unmonitored"),
    )


def family_share(jobs: DataFrame) -> DataFrame:
    """By family: postings, open ones, and the share of all in percent."""
    by = jobs.groupBy(F.coalesce("role_family", F.lit("none")).alias("family")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "open").alias("open_now"))
    total = jobs.agg(F.count(F.lit(1)).alias("total"))
    return by.join(F.broadcast(total)).select("family", "n", "open_now", F.round(F.col("n") * 100.0 / F.col("total"), 2).alias("share"))  # one row


def jobs_by_status(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(*BOARD).alias("boards"))


def coverage(jobs: DataFrame, columns: tuple[str, ...] = ("location", "posted_at", "region", "seniority", "url")) -> DataFrame:
    """How many postings have each field."""
    return jobs.agg(F.count(F.lit(1)).alias("total"), *[F.count(c).alias(f"has_{c}") for c in columns])


def events_by_type(events: DataFrame) -> DataFrame:
    return events.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def needing_careers(companies: DataFrame, boards: DataFrame) -> DataFrame:
    """Companies never looked up, those with the fewest boards first."""
    n = boards.groupBy(F.col("company_id").alias("id")).agg(F.count(F.lit(1)).alias("n_boards"))
    rows = companies.filter("careers_checked_at IS NULL").join(n, "id", "left")
    return rows.withColumn("n_boards", F.coalesce("n_boards", F.lit(0).cast("bigint"))).orderBy("n_boards", "id")


def unclassified_titles(jobs: DataFrame, seed: int = 0, limit: int = 100) -> DataFrame:
    """A sample of distinct titles that no rule places, by a seeded hash."""
    rows = jobs.filter("role_family = 'other' AND title IS NOT NULL").select("title").distinct()
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "title")), "title").limit(limit)


def last_polls(poll_runs: DataFrame, n: int = 5) -> DataFrame:
    """The newest polls."""
    return poll_runs.orderBy(F.col("id").desc()).limit(n)


def proposals_page(proposals: DataFrame, status: str | None = None, limit: int = 100) -> DataFrame:
    """Proposals, the newest first."""
    return proposals.filter(all_of([equals("status", status)])).orderBy(F.col("id").desc()).limit(limit)


def careers_due(boards: DataFrame, ts: int, days: int = 7, limit: int | None = None) -> DataFrame:
    """Boards whose careers page should be looked at again: never looked at first, then the longest ago."""
    late = F.col("careers_checked_at").isNull() | (F.col("careers_checked_at") < ts - days * config.DAY)
    queue = boards.filter(F.col("careers_url").isNotNull() & late).orderBy(F.col("careers_checked_at").asc_nulls_first(), *BOARD)
    return queue.limit(limit) if limit else queue
