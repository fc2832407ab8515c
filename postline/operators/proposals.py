"""Proposals: filed by agents, judged by gates, enacted or not. An agent writes nothing else.

A proposal goes from drafted to pending, rejected or auto_applied, and from pending to accepted or rejected; whatever else is
asked for is left out, so that a decision that comes twice, or late, changes nothing. A kind without a gate waits for a
person; one that only can be read (a diagnosis) is never enacted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postline.functions.urls import extract_all
from postline.operators import registry
from postline.operators.careers import decided_proposals
from postline.operators.diff import numbered
from postline.plans import gates

DRAFTED, PENDING, REJECTED, AUTO, ACCEPTED = "drafted", gates.PENDING, gates.REJECTED, gates.AUTO, "accepted"
#: From which status a proposal may go to which.
STEPS = {DRAFTED: (PENDING, REJECTED, AUTO), PENDING: (ACCEPTED, REJECTED)}
#: Kinds that can be enacted. A rule that was accepted is code that a person writes: accepting it is all there is to do.
SOURCE, RULES = "source", "ruleset_patch"


def filed(proposals: DataFrame, drafts: DataFrame, ts: int) -> DataFrame:
    """The rows to append for drafts (ord, agent, kind, payload, evidence), numbered on in their order."""
    top = proposals.agg(F.coalesce(F.max("id"), F.lit(0).cast("bigint"))).first()[0]
    rows = numbered(drafts, ["ord"], top).withColumns({"status": F.lit(DRAFTED), "created_at": F.lit(ts).cast("bigint"), "evidence": F.coalesce("evidence", F.lit("{}"))})
    return rows.select(*[F.col(c).cast(t).alias(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in proposals.dtypes])


def allowed(proposals: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The verdicts (id, status, ...) whose step a proposal may take; of several for one proposal the first by status."""
    steps = F.lit(False)
    for before, after in STEPS.items():
        steps = steps | ((F.col("_before") == before) & F.col("status").isin(*after))
    first = registry.first_per_group(verdicts, ["id"], [F.col("status"), F.xxhash64(*verdicts.columns)])
    return first.join(proposals.select("id", F.col("status").alias("_before"), F.col("kind").alias("_kind")), "id").filter(steps).select(*verdicts.columns)


def judged(proposals: DataFrame, pages: DataFrame, boards: DataFrame, jobs: DataFrame) -> DataFrame:
    """(id, status, score, evidence): the gates' verdicts on drafted proposals. pages: url and html of what was fetched."""
    drafted = proposals.filter(F.col("status") == DRAFTED)
    url = F.get_json_object("payload", "$.url")
    asked = drafted.filter(F.col("kind") == SOURCE).select(F.col("id").alias("proposal"), url.alias("url")).join(pages, "url", "left")
    yields = gates.source_gate(asked.withColumn("html", F.coalesce("html", F.lit(""))).select("proposal", "html"), boards)
    sources = yields.select(F.col("proposal").alias("id"), F.col("verdict").alias("status"), F.col("boards_new").cast("double").alias("score"), F.to_json(F.struct(F.col("boards_found").cast("string"), F.col("boards_new").cast("string"))).alias("evidence"))
    patterns = drafted.filter(F.col("kind") == RULES).select("id", F.get_json_object("payload", "$.pattern").alias("pattern"), F.get_json_object("payload", "$.family").alias("family"))
    rules = gates.ruleset_gates(jobs, patterns).select("id", F.col("verdict").alias("status"), F.coalesce("precision", F.lit(0.0)).alias("score"), F.to_json(F.struct(F.col("hits").cast("string"), F.col("agree").cast("string"))).alias("evidence"))
    others = drafted.filter(~F.col("kind").isin(SOURCE, RULES)).select("id", F.lit(PENDING).alias("status"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("evidence"))
    return sources.unionByName(rules).unionByName(others)


def decided(proposals: DataFrame, verdicts: DataFrame, ts: int, by: str = "gate") -> DataFrame:
    """proposals after the verdicts that are allowed."""
    return decided_proposals(proposals, allowed(proposals, verdicts), ts, by)


def enacted(before: DataFrame, after: DataFrame, pages: DataFrame, boards: DataFrame, ts: int) -> tuple[DataFrame, DataFrame]:
    """(boards, sources) after the proposals that became auto_applied or accepted: the boards on proposed pages, each with the
    proposal that brought it first, and the rows for where boards were found."""
    new = after.filter(F.col("status").isin(AUTO, ACCEPTED) & (F.col("kind") == SOURCE)).join(before.filter(~F.col("status").isin(AUTO, ACCEPTED)).select("id"), "id", "left_semi")
    hits = new.select("id", F.get_json_object("payload", "$.url").alias("url")).join(pages, "url").select("id", "url", F.explode(extract_all(F.col("html"))).alias("r")).select("id", "url", "r.ats", "r.slug")
    first = hits.groupBy("ats", "slug").agg(F.min(F.struct("id", "url")).alias("p"))
    blank = [F.lit(None).cast("string").alias(c) for c in registry.LINKS]
    found = first.select("ats", "slug", *blank, F.col("p.id").alias("ord"))
    source = F.concat(F.lit("proposal:"), F.col("p.id").cast("string"))
    return registry.add_boards(boards, found, ts), first.select("ats", "slug", source.alias("source"), F.lit(ts).cast("bigint").alias("first_seen_at"), F.col("p.url").alias("detail"))
