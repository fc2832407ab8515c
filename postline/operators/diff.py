"""The snapshot diff: stored postings against what boards list now, as one plan.

Inputs are the stored state, the fetched boards (ats, slug, fetched: how many postings the fetch returned before any filter)
and the staged postings. One full outer join on the posting's key decides what happens to each; the next state and the
events are two projections of it. Nothing is emitted for postings that are untouched, seen unchanged, or missing for the
first time. The state, not the snapshot, may be huge: partition it by ats.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postline import config

BOARD = ["ats", "slug"]
KEY = [*BOARD, "external_id"]
ATTRIBUTES = ["title", "location", "locations_json", "url", "content_hash", "role_family", "is_engineering", "is_fde", "seniority", "classified_by", "region"]
TIMES = ["posted_at", "first_seen_at", "last_seen_at", "closed_at"]
STATE = [*KEY, *ATTRIBUTES, *TIMES, "status", "missing_polls", "source"]
EVENT_RANK = {"new": 0, "reopened": 1, "edited": 2, "closed": 3}


def suspicious_boards(state: DataFrame, boards: DataFrame, guard: int = config.MASS_CLOSE_GUARD) -> DataFrame:
    """boards with open_before and suspicious: an empty fetch of a board that had more than ``guard`` open postings."""
    before = state.filter("status = 'open'").groupBy(*BOARD).agg(F.count(F.lit(1)).alias("open_before"))
    counted = boards.join(before, BOARD, "left").withColumn("open_before", F.coalesce("open_before", F.lit(0).cast("bigint")))
    return counted.withColumn("suspicious", (F.col("fetched") == 0) & (F.col("open_before") > guard))


def first_of_key(staged: DataFrame) -> DataFrame:
    """The first posting of each key by ``ord``; without such a column, and among equals, the least by all columns. It is the same
    row however often it is computed."""
    order = [c for c in ("ord", *sorted(staged.columns)) if c in staged.columns and c not in KEY]
    row = F.struct(*dict.fromkeys(order))
    first = staged.groupBy(*KEY).agg(F.min(row).alias("_first")) if order else staged.select(*KEY).distinct()
    return first.select(*[F.col(c) if c in KEY else F.col(f"_first.{c}") for c in staged.columns])


def decided(state: DataFrame, boards: DataFrame, staged: DataFrame, grace: int = config.GRACE, guard: int = config.MASS_CLOSE_GUARD) -> DataFrame:
    """Every posting of either side, with columns s_* (stored), n_* (now) and its action."""
    checked = suspicious_boards(state, boards, guard)
    trusted = checked.filter("NOT suspicious").select(*BOARD)
    now = first_of_key(staged).join(trusted, BOARD, "left_semi")
    now = now.select(*KEY, *[(F.col(c) if c in now.columns else F.lit(None)).alias(f"n_{c}") for c in (*ATTRIBUTES, "posted_at", "discovered_at")], F.lit(True).alias("n_here"))
    stored = state.select(*KEY, *[F.col(c).alias(f"s_{c}") for c in STATE if c not in KEY], F.lit(True).alias("s_here"))
    both = stored.join(now, KEY, "full_outer").join(trusted.withColumn("polled", F.lit(True)), BOARD, "left")
    closes = F.col("s_missing_polls") + 1 >= grace
    action = (
        F.when(F.col("s_here").isNull(), "new")
        .when(F.col("n_here") & (F.col("s_status") == "closed"), "reopened")
        .when(F.col("n_here") & ~F.col("s_content_hash").eqNullSafe(F.col("n_content_hash")), "edited")
        .when(F.col("n_here"), "touched")
        .when((F.col("s_status") == "open") & F.col("polled"), F.when(closes, "closed").otherwise("missing"))
        .otherwise("untouched")
    )
    return both.withColumn("action", action)


def next_state(decisions: DataFrame, ts: int) -> DataFrame:
    """The complete next state."""
    a = F.col("action")
    fresh = a.isin("new", "reopened", "edited")
    seen = F.col("n_here").isNotNull()
    now = F.lit(ts).cast("bigint")
    column: dict[str, Column] = {c: F.when(fresh, F.col(f"n_{c}")).otherwise(F.col(f"s_{c}")) for c in ATTRIBUTES}
    column |= {
        "posted_at": F.when(a == "new", F.coalesce("n_posted_at", "n_discovered_at"))
        .when(a.isin("reopened", "edited"), F.coalesce("n_posted_at", "s_posted_at"))
        .when(a == "touched", F.coalesce("s_posted_at", "n_posted_at"))
        .otherwise(F.col("s_posted_at")),
        "first_seen_at": F.coalesce("s_first_seen_at", now),
        "last_seen_at": F.when(seen, now).otherwise(F.col("s_last_seen_at")),
        "closed_at": F.when(a == "closed", now).when(a == "reopened", F.lit(None)).otherwise(F.col("s_closed_at")).cast("bigint"),
        "status": F.when(seen, "open").when(a == "closed", "closed").otherwise(F.col("s_status")),
        "missing_polls": F.when(seen, 0).when(a.isin("closed", "missing"), F.col("s_missing_polls") + 1).otherwise(F.col("s_missing_polls")).cast("int"),
        "source": F.coalesce("s_source", F.lit("poll")),
    }
    return decisions.select(*KEY, *[column[c].alias(c) for c in STATE if c not in KEY])


def events(decisions: DataFrame, ts: int, last_id: int, held: list[DataFrame] | None = None) -> DataFrame:
    """The events, numbered on from last_id board by board, then by kind and key. held: see ``numbered``."""
    rank = F.create_map(*[F.lit(x) for pair in EVENT_RANK.items() for x in pair])
    rows = decisions.filter(F.col("action").isin(*EVENT_RANK)).select(
        F.lit(ts).cast("bigint").alias("ts"),
        F.col("action").alias("type"),
        *KEY,
        F.coalesce(F.when(F.col("action") != "closed", F.col("n_title")), "s_title").alias("title"),
        F.coalesce(F.when(F.col("action") != "closed", F.col("n_url")), "s_url").alias("url"),
        F.when(F.col("action") == "closed", F.to_json(F.struct((F.col("s_missing_polls") + 1).alias("missing_polls")))).alias("detail_json"),
        rank[F.col("action")].alias("_rank"),
    )
    return numbered(rows, [*BOARD, "_rank", "external_id"], last_id, held).drop("_rank")


def numbered(rows: DataFrame, order: list[str], last_id: int, held: list[DataFrame] | None = None) -> DataFrame:
    """rows with gapless ids after last_id in this order.

    Rows are range-partitioned by the order, counted per partition, and numbered within it from the counts before: no
    single task sees them all. The ranges come from a sample, so the partitioned rows are persisted: counts and numbers
    must be of the same ranges. They are added to ``held``, for the caller to unpersist when the result has been used.
    """
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    spot = parts.withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).persist(StorageLevel.MEMORY_AND_DISK)
    if held is not None:
        held.append(spot)
    sizes = spot.groupBy("_part").agg(F.max("_at").alias("_most"))
    before = F.coalesce(F.sum(F.col("_most") + 1).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))  # a row for each partition
    return spot.join(F.broadcast(starts), "_part").withColumn("id", F.col("_before") + F.col("_at") + 1 + last_id).drop("_part", "_at", "_before")


def board_results(decisions: DataFrame) -> DataFrame:
    """Counts of what happened on each board."""
    kinds = [F.count_if(F.col("action") == k).alias(k) for k in (*EVENT_RANK, "touched", "missing")]
    return decisions.groupBy(*BOARD).agg(*kinds)
