"""Careers pages of companies and boards, from pages that were probed: what each proves, and what follows from it.

``probes`` has domain, path, path_rank, status and html, a row for each page that was tried. Nothing is written here: each
function gives the outcomes, which ``registry.set_careers``, ``link_boards``, ``merge_companies`` and ``add_boards`` apply.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postline.config import DAY, MAX_ATTRIBUTED_REFS
from postline.functions.names import ENDINGS, GUESS_SIZES, apex, base, candidate_domains
from postline.operators import registry
from postline.sources.refs import probed

BOARD = ["ats", "slug"]


def first_page(targets: DataFrame, probes: DataFrame, key: list[str]) -> DataFrame:
    """targets (key, domains: in order) with the first domain whose page has boards, else the first that answered."""
    pages = probed(probes).select(F.col("domain").alias("_d"), F.col("refs").alias("_refs"), F.col("path").alias("_path"))
    tried = targets.select(*key, F.posexplode("domains").alias("_at", "_d")).join(pages, "_d")
    order = F.struct(F.size("_refs") == 0, "_at")
    best = tried.groupBy(*key).agg(F.min_by(F.struct(F.col("_d").alias("found"), F.col("_refs").alias("refs"), F.col("_path").alias("path")), order).alias("p"))
    return targets.join(best, key, "left").withColumns({"found": F.col("p.found"), "refs": F.coalesce("p.refs", F.expr("array()").cast("array<struct<ats:string,slug:string>>")), "path": F.col("p.path")}).drop("p")


def resolved(companies: DataFrame, boards: DataFrame, probes: DataFrame) -> DataFrame:
    """(id, url, kind, learned, merge_into, owned, refs) of companies that were never looked up.

    A known domain's page is taken as it is. A domain guessed from the name counts only if its page carries a board of the
    company, or one that is called like it; it is then learned, or the company is merged into the one that has it. Boards of
    a page with many belong to nobody (owned is false).
    """
    low, high = GUESS_SIZES
    fits = F.char_length("norm_name").between(low, high)
    guesses = F.when(fits, F.array(*[F.concat("norm_name", F.lit("." + e)) for e in ENDINGS])).otherwise(F.array().cast("array<string>"))
    known = F.col("domain").isNotNull()
    asked = companies.filter("careers_checked_at IS NULL").select("id", "norm_name", known.alias("sure"), F.when(known, F.array("domain")).otherwise(guesses).alias("domains"))
    rows = first_page(asked.filter(F.size("domains") > 0), probes, ["id"])
    held = boards.filter("company_id IS NOT NULL").select(F.col("company_id").alias("id"), *BOARD)
    proof = rows.select("id", F.explode("refs").alias("r")).select("id", "r.ats", "r.slug").join(held, ["id", *BOARD]).select("id").distinct().withColumn("_held", F.lit(True))
    named = F.exists("refs", lambda r: (base(r["slug"]) == F.col("norm_name")) & (F.col("norm_name") != ""))
    proven = rows.join(proof, "id", "left").withColumn("ok", F.col("sure") | F.col("_held").isNotNull() | F.coalesce(named, F.lit(False)))
    owner = companies.filter("domain IS NOT NULL").select(F.col("domain").alias("found"), F.col("id").alias("_owner"))
    out = proven.join(owner, "found", "left")
    learns = F.col("ok") & ~F.col("sure") & F.col("found").isNotNull()
    kind = F.when(F.size("refs") > 0, "ats").when(F.col("found").isNotNull(), "html").otherwise("none")
    return out.select(
        "id",
        F.when(F.col("ok"), F.concat(F.lit("https://"), "found", "path")).alias("url"),
        F.when(F.col("ok"), kind).otherwise("none").alias("kind"),
        F.when(learns & F.col("_owner").isNull(), F.col("found")).alias("learned"),
        F.when(learns & (F.col("_owner") != F.col("id")), F.col("_owner")).alias("merge_into"),
        (F.col("ok") & (F.size("refs") <= MAX_ATTRIBUTED_REFS)).alias("owned"),
        F.when(F.col("ok"), F.col("refs")).otherwise(F.expr("array()").cast("array<struct<ats:string,slug:string>>")).alias("refs"),
    )


def backfilled(boards: DataFrame, probes: DataFrame) -> DataFrame:
    """(ats, slug, website, careers_url) of live boards without a careers page, where a likely domain's page links back to the board."""
    asked = boards.filter(F.col("careers_url").isNull() & F.col("status").isin("active", "empty"))
    tried = asked.select(*BOARD, F.posexplode(candidate_domains(F.col("company_name"), F.col("slug"), F.col("website"))).alias("at", "domain"))
    pages = probed(probes).select("domain", "path", F.explode("refs").alias("r")).select("domain", "path", "r.*")
    hits = tried.join(pages, ["domain", *BOARD]).groupBy(*BOARD).agg(F.min_by(F.struct("domain", "path"), "at").alias("p"))
    return hits.select(*BOARD, F.concat(F.lit("https://"), "p.domain").alias("website"), F.concat(F.lit("https://"), "p.domain", "p.path").alias("careers_url"))


def rechecked(boards: DataFrame, probes: DataFrame, ts: int, days: int = 7) -> DataFrame:
    """(ats, slug, outcome, now_on) of boards whose page was seen too long ago: confirmed, migrated (it names other boards
    only) or gone."""
    late = F.col("careers_checked_at").isNull() | (F.col("careers_checked_at") < ts - days * DAY)
    asked = boards.filter(F.col("careers_url").isNotNull() & late).withColumn("domain", F.coalesce(apex(F.col("careers_url")), apex(F.col("website"))))
    rows = asked.join(probed(probes).select("domain", "refs"), "domain", "left")
    mine = F.exists("refs", lambda r: (r["ats"] == F.col("ats")) & (r["slug"] == F.col("slug")))
    others = F.filter("refs", lambda r: (r["ats"] != F.col("ats")) | (r["slug"] != F.col("slug")))
    outcome = F.when(F.coalesce(F.size("refs"), F.lit(0)) <= 0, "gone").when(mine, "confirmed").otherwise("migrated")
    named = F.array_join(F.transform(others, lambda r: F.concat_ws(":", r["ats"], r["slug"])), ",")
    return rows.select(*BOARD, outcome.alias("outcome"), F.when(outcome != "gone", named).alias("now_on"))


def adopted(companies: DataFrame, boards: DataFrame, ts: int) -> tuple[DataFrame, DataFrame]:
    """(companies, boards) after a company was found or made for each unlinked board that names one."""
    unlinked = boards.filter("company_id IS NULL AND (company_name IS NOT NULL OR website IS NOT NULL)")
    refs = unlinked.select(*BOARD, F.col("company_name").alias("name"), F.col("website").alias("domain"), "website", "careers_url", F.xxhash64(*BOARD).alias("ord"))
    after = registry.upsert_companies(companies, refs, ts, "boards")
    keyed = refs.withColumn("ord", F.col("ord")).select(*BOARD, "name", "domain", "website", F.lit(None).cast("string").alias("careers_url"), "ord")
    found = registry.resolve_companies(after, keyed).select(F.col("domain").alias("_d"), F.col("norm_name").alias("_n"), F.col("company_id").alias("cid"))
    identity = keyed.select(*BOARD, apex(F.coalesce("domain", "website")).alias("_d"), F.nullif(base(F.col("name")), F.lit("")).alias("_n"))
    links = identity.join(found, identity["_d"].eqNullSafe(found["_d"]) & identity["_n"].eqNullSafe(found["_n"])).select(*BOARD, "cid").filter("cid IS NOT NULL")
    return after, registry.link_boards(boards, links)


def decided_proposals(proposals: DataFrame, verdicts: DataFrame, ts: int, by: str = "gate") -> DataFrame:
    """proposals after verdicts (id, status, score, evidence: JSON): evidence is merged, later keys win; others stay as they are."""
    got = verdicts.select("id", F.col("status").alias("_status"), F.col("score").alias("_score"), F.col("evidence").alias("_evidence"))
    both = proposals.join(got, "id", "left")
    hit = F.col("_status").isNotNull()
    as_map = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    new = as_map("_evidence")
    merged = F.map_concat(F.map_filter(as_map("evidence"), lambda k, v: ~F.map_contains_key(new, k)), new)
    columns = {
        "status": F.coalesce("_status", "status"),
        "score": F.when(hit, F.col("_score")).otherwise(F.col("score")),
        "evidence": F.when(hit, F.to_json(merged)).otherwise(F.col("evidence")),
        "decided_at": F.when(hit, F.lit(ts).cast("bigint")).otherwise(F.col("decided_at")),
        "decided_by": F.when(hit, F.lit(by)).otherwise(F.col("decided_by")),
    }
    return both.withColumns(columns).select(*proposals.columns)
