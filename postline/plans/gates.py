"""Gates for proposals: how many boards a page brings that aren't known, and how precise patterns are on labelled titles.

Many patterns meet many titles by what they need: a literal of the pattern, or one of several, stands for it, and the literal's
rarest run of three characters is looked up in an index of the titles. Only what is found there is matched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postline import config
from postline.functions import labels
from postline.functions.literals import folded, needed_literals, portable, trigrams
from postline.functions.rules import JVM
from postline.functions.urls import extract_all

AUTO, PENDING, REJECTED = "auto_applied", "pending", "rejected"


def source_gate(pages: DataFrame, boards: DataFrame) -> DataFrame:
    """pages (proposal, html) → boards found, boards new, and the verdict."""
    refs = pages.select("proposal", F.explode(extract_all(F.col("html"))).alias("r")).select("proposal", "r.ats", "r.slug").distinct()
    return yields(pages.select("proposal"), refs, boards)


def yields(proposals: DataFrame, refs: DataFrame, boards: DataFrame) -> DataFrame:
    known = boards.select("ats", "slug").distinct().withColumn("known", F.lit(True))
    found = refs.join(known, ["ats", "slug"], "left").groupBy("proposal").agg(F.count(F.lit(1)).alias("boards_found"), F.count_if(F.col("known").isNull()).alias("boards_new"))
    rows = proposals.distinct().join(found, "proposal", "left").fillna(0, ["boards_found", "boards_new"])
    new = F.col("boards_new")
    return rows.withColumn("verdict", F.when(new >= config.GATE_AUTO_BOARDS, AUTO).when(new >= 1, PENDING).otherwise(REJECTED))


def compiles(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def ruleset_gate(jobs: DataFrame, pattern: str, family: str) -> DataFrame:
    """One row: hits among distinct labelled titles, those that agree, precision and the verdict.

    A hit agrees if its title has no family of its own, or this one, or the present rules give it this one.
    """
    rows = jobs.filter("title IS NOT NULL AND role_family IS NOT NULL").select("title", "role_family").distinct()
    hits = rows.filter(F.col("title").rlike(JVM + pattern))
    agrees = F.col("role_family").isin("other", family) | (labels.role_family(F.col("title")) == family)
    out = hits.agg(F.count(F.lit(1)).alias("hits"), F.count_if(agrees).alias("agree"))
    precision = F.try_divide("agree", "hits")
    verdict = F.when(F.col("hits") == 0, REJECTED).when(precision >= config.GATE_PRECISION, AUTO).otherwise(PENDING)
    return out.withColumns({"precision": F.round(precision, 3), "verdict": verdict})


def described(rules: DataFrame) -> DataFrame:
    """rules (pattern, family) with ok, whether the pattern can be used, and literals, what it needs: see ``needed_literals``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ok = [portable(p) and bool(family) for p, family in zip(f["pattern"], f["family"], strict=True)]
            yield f.assign(ok=ok, literals=[needed_literals(p) if good else [] for p, good in zip(f["pattern"], ok, strict=True)])

    return rules.select("pattern", "family").mapInPandas(run, rules.select("pattern", "family").schema.simpleString()[7:-1] + ",ok:boolean,literals:array<string>")


def pattern_hits(titles: DataFrame, rules: DataFrame) -> DataFrame:
    """(pattern, title) for each title that a usable pattern is found in. titles: distinct title; rules: as ``described`` gives them. A
    pattern counts once, however many rules have it."""
    usable = rules.filter("ok").select("pattern", "literals").dropDuplicates(["pattern"])
    found = F.expr(f"title RLIKE concat('{JVM}', pattern)")
    index = titles.select("title", F.explode(trigrams(folded(F.col("title")))).alias("gram"))
    often = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    wanted = usable.select("pattern", F.explode("literals").alias("literal")).withColumn("literal", folded(F.col("literal")))
    grams = wanted.select("pattern", "literal", F.explode(trigrams(F.col("literal"))).alias("gram")).join(often, "gram", "left")
    # a run that no title has rules the literal out
    rarest = grams.groupBy("pattern", "literal").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    near = rarest.join(index, "gram").filter(F.contains(folded(F.col("title")), F.col("literal"))).select("pattern", "title").distinct()
    # literals may have become shorter than a run when they were folded
    lost = wanted.filter(F.char_length("literal") < 3).select("pattern").distinct()
    free = usable.filter(F.size("literals") == 0).unionByName(usable.join(lost, "pattern", "left_semi")).select("pattern")
    out = near.filter(found)
    if free.isEmpty():
        return out
    # patterns without a literal meet all titles: part by part, so that no task holds either side whole, and each is compiled once a part
    return out.unionByName(free.join(titles.select("title").hint("shuffle_replicate_nl"), found)).distinct()


def ruleset_gates(jobs: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, hits, agree, precision, verdict) of all rules (id, pattern, family): ``ruleset_gate`` for each, in one plan. A rule
    without a family, or whose pattern can't be compiled, is rejected. Rules of one pattern and family are judged once."""
    kinds = described(rules.select("pattern", "family").distinct())
    rows = jobs.filter("title IS NOT NULL AND role_family IS NOT NULL").select("title", "role_family").distinct()
    titles = rows.select("title").distinct()
    named = titles.withColumn("own", labels.role_family(F.col("title")))
    # hits and labels of a pattern, counted before rules have their part in them
    labelled = pattern_hits(titles, kinds).join(named, "title").join(rows, "title").groupBy("pattern", "role_family", "own").agg(F.count(F.lit(1)).alias("n"))
    agrees = F.col("role_family").isin("other") | (F.col("role_family") == F.col("family")) | (F.col("own") == F.col("family"))
    hits = kinds.filter("ok").select("pattern", "family").join(labelled, "pattern")
    counts = hits.groupBy("pattern", "family").agg(F.sum("n").alias("hits"), F.coalesce(F.sum(F.when(agrees, F.col("n"))), F.lit(0)).alias("agree"))
    out = rules.select("id", "pattern", "family").join(counts, ["pattern", "family"], "left").fillna(0, ["hits", "agree"])
    precision = F.try_divide("agree", "hits")
    verdict = F.when(F.col("hits") == 0, REJECTED).when(precision >= config.GATE_PRECISION, AUTO).otherwise(PENDING)
    return out.select("id", "hits", "agree", F.round(precision, 3).alias("precision"), verdict.alias("verdict"))


def by_status(proposals: DataFrame) -> DataFrame:
    return proposals.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
