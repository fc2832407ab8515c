"""What a fetched posting must be to be stored, and the labels it is stored with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postline import config
from postline.functions import labels
from postline.functions.dates import day_floor
from postline.functions.hashing import content_hash


def is_recent(cutoff: int | None, posted: str = "posted_at", bound: str = "posted_bound") -> Column:
    """False only where the newest time the posting may have is known and before the cutoff; 0 counts as unknown."""
    if not cutoff:
        return F.lit(True)
    newest = F.coalesce(F.nullif(F.col(posted), F.lit(0)), F.nullif(F.col(bound), F.lit(0)))
    return F.coalesce(newest >= cutoff, F.lit(True))


def labelled(postings: DataFrame, country_of=None) -> DataFrame:
    """postings with their role and region."""
    department = "department" if "department" in postings.columns else None
    return labels.with_role(postings, "title", department).withColumn("region", labels.region(F.col("location"), country_of))


def keep(families: tuple[str, ...] | None = config.KEPT_FAMILIES, regions: tuple[str, ...] = config.KEPT_REGIONS, cutoff: int | None = config.CUTOFF) -> Column:
    """The ingest predicate over labelled postings, the cheapest test first. No families: any family."""
    ok = is_recent(cutoff) & F.col("region").isin(*regions)
    return ok & F.col("role_family").isin(*families) if families else ok


def staged(postings: DataFrame, ts: int, country_of=None, families: tuple[str, ...] | None = config.KEPT_FAMILIES, cutoff: int | None = config.CUTOFF) -> DataFrame:
    """Postings as the diff takes them: recent ones first, then labels, filter, hash, and the day of discovery."""
    recent = postings.filter(is_recent(cutoff))
    kept = labelled(recent, country_of).filter(keep(families, cutoff=None))
    several = F.when(F.size("locations") > 1, F.to_json("locations")) if "locations" in kept.columns else F.lit(None).cast("string")
    return kept.withColumns(
        {"content_hash": content_hash(kept), "locations_json": several, "discovered_at": F.when(F.col("posted_at").isNull(), day_floor(F.lit(ts).cast("bigint")))}
    )
