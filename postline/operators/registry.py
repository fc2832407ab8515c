"""Boards and companies: upserts as joins that give the complete next table, and the polling state machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postline import config
from postline.functions.names import apex, base
from postline.sources.scratch import scratch_path

BOARD = ["ats", "slug"]
LINKS = ["company_name", "website", "careers_url"]


def add_boards(boards: DataFrame, refs: DataFrame, ts: int) -> DataFrame:
    """The next boards: unknown ones are added unvalidated, known ones get only what they lack. The first value named wins."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ord")))
    found = refs.groupBy(*BOARD).agg(*[first(c).alias(f"_{c}") for c in LINKS])
    both = boards.withColumn("_old", F.lit(True)).join(found, BOARD, "full_outer")
    new = F.col("_old").isNull()
    fresh = {"status": F.lit("unvalidated"), "tier": F.lit(1), "consecutive_failures": F.lit(0), "first_seen_at": F.lit(ts).cast("bigint")}
    columns = {c: F.coalesce(c, f"_{c}") for c in LINKS} | {c: F.when(new, v.cast(dict(boards.dtypes)[c])).otherwise(F.col(c)) for c, v in fresh.items()}
    return both.withColumns(columns).select(*boards.columns)


def add_counts(boards: DataFrame, board_sources: DataFrame, refs: DataFrame) -> DataFrame:
    """One row: refs seen, boards that are new, and (board, source) links that are new."""
    distinct = refs.select(*BOARD, "source").distinct()
    new = distinct.select(*BOARD).distinct().join(boards, BOARD, "left_anti").agg(F.count(F.lit(1)).alias("new_boards"))
    links = distinct.join(board_sources, [*BOARD, "source"], "left_anti").agg(F.count(F.lit(1)).alias("new_links"))
    seen = refs.agg(F.count(F.lit(1)).alias("seen"))
    return seen.join(F.broadcast(new)).join(F.broadcast(links))  # one row each


def resolve_companies(companies: DataFrame, refs: DataFrame) -> DataFrame:
    """refs (name, domain, website, careers_url, ord) by identity (domain, norm_name), with company_id where one is known.

    A row matches by domain; else by name, preferring a company with a domain and then the lowest id, unless that company
    claims another domain. Rows of one batch don't see one another. Each field is the first one named.
    """
    named = refs.withColumns({"_domain": F.coalesce(apex(F.col("domain")), apex(F.col("website"))), "_norm": base(F.col("name"))}).filter("_domain IS NOT NULL OR _norm <> ''")
    present = lambda c: F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col("ord"))
    fields = [F.min_by(c, present(c)).alias(c) for c in ("name", "website", "careers_url")]
    rows = named.groupBy("_domain", "_norm").agg(*fields, F.min("ord").alias("ord"))
    by_domain = companies.filter("domain IS NOT NULL").groupBy(F.col("domain").alias("_domain")).agg(F.min("id").alias("_by_domain"))
    best = F.min(F.struct(F.col("domain").isNull().alias("bare"), "id", "domain"))
    by_name = companies.filter("norm_name IS NOT NULL").groupBy(F.col("norm_name").alias("_norm")).agg(best.alias("_by_name"))
    found = rows.join(by_domain, "_domain", "left").join(by_name, "_norm", "left")
    clash = F.col("_domain").isNotNull() & F.col("_by_name.domain").isNotNull() & (F.col("_by_name.domain") != F.col("_domain"))
    company = F.coalesce("_by_domain", F.when((F.col("_norm") != "") & ~clash, F.col("_by_name.id")))
    site = F.coalesce("website", F.concat(F.lit("https://"), "_domain"))
    return found.select(
        F.col("_domain").alias("domain"), "name", F.nullif(F.col("_norm"), F.lit("")).alias("norm_name"), site.alias("website"), "careers_url", "ord", company.alias("company_id")
    )


def filled_companies(companies: DataFrame, resolved: DataFrame) -> DataFrame:
    """The companies that gain a value from their references, with it: what they lack, from their first row by ord."""
    known = resolved.filter("company_id IS NOT NULL")
    fields = ["domain", "name", "norm_name", "website", "careers_url"]
    fill = known.groupBy(F.col("company_id").alias("id")).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(f"_{c}") for c in fields])
    gains = F.lit(False)
    for c in fields:
        gains = gains | (F.col(c).isNull() & F.col(f"_{c}").isNotNull())
    return companies.join(fill, "id").filter(gains).withColumns({c: F.coalesce(c, f"_{c}") for c in fields}).select(*companies.columns)


def added_companies(companies: DataFrame, resolved: DataFrame, ts: int, source: str, top: int, held: list[DataFrame] | None = None) -> DataFrame:
    """The companies that no one knew, numbered on from top in the order of their references. held: see ``diff.numbered``."""
    from postline.operators.diff import numbered

    added = numbered(resolved.filter("company_id IS NULL"), ["ord"], top, held).withColumns({"first_seen_at": F.lit(ts).cast("bigint"), "source": F.lit(source)})
    return added.select(*[F.lit(None).cast(t).alias(c) if c not in added.columns else F.col(c).cast(t).alias(c) for c, t in companies.dtypes])


def upsert_companies(companies: DataFrame, refs: DataFrame, ts: int, source: str) -> DataFrame:
    """The next companies. Values that a company has stay; what it lacks is filled from its first row by ord."""
    resolved = resolve_companies(companies, refs)
    filled = filled_companies(companies, resolved)
    kept = companies.join(filled.select("id"), "id", "left_anti").select(*companies.columns).unionByName(filled)
    top = companies.agg(F.coalesce(F.max("id"), F.lit(0).cast("bigint"))).first()[0]
    return kept.unionByName(added_companies(companies, resolved, ts, source, top))


def company_links(refs: DataFrame, resolved: DataFrame, added: DataFrame) -> DataFrame:
    """(ats, slug, cid) of boards whose references name a company: the known one (resolved), or the one that was added for them. Of
    several the first one named by ord."""
    known = resolved.filter("company_id IS NOT NULL").select("domain", "norm_name", F.col("company_id").alias("cid"))
    ids = known.unionByName(added.select("domain", "norm_name", F.col("id").alias("cid"))).withColumnsRenamed({"domain": "_fd", "norm_name": "_fn"})
    named = refs.filter("slug IS NOT NULL").withColumns({"_d": F.coalesce(apex(F.col("domain")), apex(F.col("website"))), "_n": F.nullif(base(F.col("name")), F.lit(""))})
    hits = named.join(ids, named["_d"].eqNullSafe(ids["_fd"]) & named["_n"].eqNullSafe(ids["_fn"]))
    return hits.groupBy(*BOARD).agg(F.min_by("cid", "ord").alias("cid"))


def doubled(edges: DataFrame) -> DataFrame:
    """(id, to, steps, most) after following edges (id, to: one for each id) as far as they lead, or at least once through all of
    them where they lead in a circle; most is the greatest id that was left on the way. Pointers double with each round."""
    state = edges.select("id", "to", F.lit(1).cast("bigint").alias("steps"), F.col("id").alias("most")).checkpoint()
    reach, n = 1, state.count()
    while reach < n and not state.join(state.select(F.col("id").alias("to")), "to", "left_semi").isEmpty():
        step = state.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("steps").alias("_steps"), F.col("most").alias("_most"))
        both = state.join(step, "to", "left")
        nought = F.lit(0).cast("bigint")
        state = both.select("id", F.coalesce("_to", "to").alias("to"), (F.col("steps") + F.coalesce("_steps", nought)).alias("steps"), F.greatest("most", "_most").alias("most")).checkpoint()
        reach *= 2
    return state


def merge_targets(pairs: DataFrame) -> DataFrame:
    """(source_id, target_id, steps): what each company ends up in if pairs (source_id, target_id) are merged, and how far away it is.

    Of several targets of a source the least counts. A target that is merged itself passes on what it gets; of companies
    that are to be merged in a circle the greatest id stays.
    """
    first = pairs.filter("source_id <> target_id").groupBy(F.col("source_id").alias("id")).agg(F.min("target_id").alias("to"))
    scratch_path(pairs.sparkSession, "merge")  # checkpoints need their folder
    edges = first.checkpoint()
    ends = doubled(edges)
    circular = ends.join(edges.select(F.col("id").alias("to")), "to", "left_semi")
    if not circular.isEmpty():
        # the ends of circular ways are all the members of the circles, and each has been all through its own
        stays = ends.join(circular.select(F.col("to").alias("id")).distinct(), "id", "left_semi").select(F.col("most").alias("id")).distinct()
        ends = doubled(edges.join(stays, "id", "left_anti"))
    return ends.select(F.col("id").alias("source_id"), F.col("to").alias("target_id"), "steps")


def merge_companies(companies: DataFrame, boards: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(companies, boards) after merging each ``source_id`` of pairs into its ``target_id``, see ``merge_targets``: boards move, blanks
    are filled from the nearest of the merged, among equals from the least id."""
    ends = merge_targets(pairs)
    own = ends.select(F.col("source_id").alias("company_id"), F.col("target_id").alias("_to"))
    moved = boards.join(own, "company_id", "left").withColumn("company_id", F.coalesce("_to", "company_id")).select(*boards.columns)
    fields = [c for c in companies.columns if c != "id"]
    gone = ends.join(companies, ends["source_id"] == companies["id"])
    near = lambda c: F.when(F.col(c).isNotNull(), F.struct("steps", "source_id"))
    fill = gone.groupBy(F.col("target_id").alias("id")).agg(*[F.min_by(c, near(c)).alias(f"_{c}") for c in fields])
    left = companies.join(ends.select(F.col("source_id").alias("id")), "id", "left_anti").join(fill, "id", "left")
    return left.withColumns({c: F.coalesce(c, f"_{c}") for c in fields}).select(*companies.columns), moved


def link_boards(boards: DataFrame, links: DataFrame) -> DataFrame:
    """boards with company_id from links (ats, slug, cid) where they have none."""
    first = links.groupBy(*BOARD).agg(F.min("cid").alias("_cid"))
    return boards.join(first, BOARD, "left").withColumn("company_id", F.coalesce("company_id", "_cid")).select(*boards.columns)


def set_careers(companies: DataFrame, found: DataFrame, ts: int) -> DataFrame:
    """companies with careers pages from found (id, url, kind): a known page is kept if none is named; kind and time are set."""
    both = companies.join(found.select("id", F.col("url").alias("_url"), F.col("kind").alias("_kind"), F.lit(True).alias("_hit")), "id", "left")
    hit = F.col("_hit").isNotNull()
    columns = {
        "careers_url": F.coalesce("_url", "careers_url"),
        "careers_kind": F.when(hit, F.col("_kind")).otherwise(F.col("careers_kind")),
        "careers_checked_at": F.when(hit, F.lit(ts).cast("bigint")).otherwise(F.col("careers_checked_at")),
    }
    return both.withColumns(columns).select(*companies.columns)


def seed_new(jobs: DataFrame, postings: DataFrame) -> DataFrame:
    """Postings with a key that isn't stored, each key once."""
    from postline.operators.diff import KEY, first_of_key

    return first_of_key(postings).join(jobs, KEY, "left_anti")


def due(boards: DataFrame, ts: int, limit: int | None = None) -> DataFrame:
    """Live boards whose next poll is due: never polled ones first, then the longest due."""
    ready = boards.filter(F.col("status").isin("active", "empty") & (F.col("next_poll_at").isNull() | (F.col("next_poll_at") <= ts)))
    queue = ready.orderBy(F.col("next_poll_at").asc_nulls_first(), *BOARD)
    return queue.limit(limit) if limit else queue


def poll_seconds(tier: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in config.TIER_SECONDS.items() for x in pair])[tier], F.lit(config.TIER_SECONDS[1]))


def after_poll(boards: DataFrame, results: DataFrame, ts: int) -> DataFrame:
    """boards after polls: results has ats, slug, fetch_status (ok, transient, permanent), job_count, had_new, error."""
    got = results.select(*BOARD, F.col("fetch_status").alias("_s"), F.col("job_count").alias("_n"), F.col("had_new").alias("_new"), F.col("error").alias("_e"))
    both = boards.join(got, BOARD, "left")
    ok, failed = F.col("_s") == "ok", F.col("_s").isin("transient", "permanent")
    failures = F.col("consecutive_failures") + 1
    dead = (F.col("_s") == "permanent") | (failures >= config.DEAD_AFTER)
    # 2 ** 7 is past the most that backoff allows, so the shift stays small
    wait = F.least(F.lit(config.BACKOFF_FIRST) * F.pow(F.lit(2), F.least(failures - 1, F.lit(7))), F.lit(config.BACKOFF_MOST)).cast("bigint")
    now = F.lit(ts).cast("bigint")
    columns = {
        "status": F.when(ok, F.when(F.col("_n") > 0, "active").otherwise("empty")).when(failed & dead, "dead").otherwise(F.col("status")),
        "job_count": F.when(ok, F.col("_n").cast("int")).otherwise(F.col("job_count")),
        "next_poll_at": F.when(ok, now + poll_seconds(F.col("tier"))).when(failed & dead, F.lit(None)).when(failed, now + wait).otherwise(F.col("next_poll_at")).cast("bigint"),
        "last_polled_at": F.when(F.col("_s").isNotNull(), now).otherwise(F.col("last_polled_at")),
        "last_ok_at": F.when(ok, now).otherwise(F.col("last_ok_at")),
        "last_new_at": F.when(ok & F.col("_new"), now).otherwise(F.col("last_new_at")),
        "consecutive_failures": F.when(ok, 0).when(failed, failures).otherwise(F.col("consecutive_failures")).cast("int"),
        "last_error": F.when(ok, F.lit(None)).when(failed, F.substring("_e", 1, config.ERROR_CHARS)).otherwise(F.col("last_error")).cast("string"),
    }
    return both.withColumns(columns).select(*boards.columns)


def retier(boards: DataFrame, ts: int) -> DataFrame:
    """boards with quiet ones a tier slower: nothing new for QUIET_DAYS."""
    quiet = (F.col("status") == "active") & (F.coalesce("last_new_at", "first_seen_at") < ts - config.QUIET_DAYS * config.DAY)
    return boards.withColumn("tier", F.when(quiet, F.least(F.col("tier") + 1, F.lit(3))).otherwise(F.col("tier")).cast("int"))


def reclassified(jobs: DataFrame) -> DataFrame:
    """jobs with new labels where those are of another rule set; by title alone."""
    from postline.functions import labels

    stale = F.col("classified_by").isNull() | (F.col("classified_by") != labels.RULESET)
    family = labels.role_family(F.col("title"))
    new = jobs.withColumns({"_stale": stale, "_family": F.when(stale, family)})
    columns = {
        "role_family": F.when(F.col("_stale"), F.col("_family")).otherwise(F.col("role_family")),
        "is_engineering": F.when(F.col("_stale"), F.col("_family").isin("fde", "security", "ai", "data", "engineering").cast("int")).otherwise(F.col("is_engineering")),
        "is_fde": F.when(F.col("_stale"), (F.col("_family") == "fde").cast("int")).otherwise(F.col("is_fde")),
        "seniority": F.when(F.col("_stale"), F.when(F.col("_family") != "unknown", labels.seniority(F.col("title")))).otherwise(F.col("seniority")),
        "classified_by": F.lit(labels.RULESET),
    }
    return new.withColumns(columns).select(*jobs.columns)


def reregioned(jobs: DataFrame, country_of=None) -> DataFrame:
    """The next jobs under the present rules: an empty location of a platform that writes it into the posting's link is
    recovered from there, and each region is named anew, once for each distinct location."""
    from postline.functions import dates, labels

    lost = (F.coalesce("location", F.lit("")) == "") & (F.col("ats") == "workday")
    found = jobs.withColumn("location", F.when(lost, F.coalesce(dates.location_from_path(F.col("url")), "location")).otherwise(F.col("location")))
    return labels.label_distinct(found, "location", "_region", lambda c: labels.region(c, country_of)).withColumn("region", F.col("_region")).select(*jobs.columns)


def region_moves(jobs: DataFrame, country_of=None) -> DataFrame:
    """(before, after, n): how many postings change region under the present rules, and how many stay."""
    after = reregioned(jobs.withColumn("before", F.col("region")), country_of)
    return after.groupBy("before", F.col("region").alias("after")).agg(F.count(F.lit(1)).alias("n"))


def first_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")
