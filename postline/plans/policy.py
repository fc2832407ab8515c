"""What to do next: one row of counts, and ordered rules over it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postline import config
from postline.functions import labels
from postline.plans.health import collapsed

END = "end"


def snapshot(companies: DataFrame, boards: DataFrame, jobs: DataFrame, runs: DataFrame, now: int) -> DataFrame:
    """One row: the counts that the rules read. hours_since_discover is null before any run."""
    stale = F.col("classified_by").isNull() | (F.col("classified_by") != labels.RULESET)
    parts = [
        boards.agg(F.count_if(F.col("status") == "unvalidated").alias("unvalidated"), F.count_if(F.col("status") == "active").alias("active_boards")),
        jobs.agg(F.count_if(stale).alias("stale_classification"), F.count_if(F.col("status") == "open").alias("open_jobs")),
        companies.agg(F.count_if(F.col("careers_checked_at").isNull()).alias("unresolved_companies")),
        runs.agg(
            ((F.lit(now) - F.max("started_at")) / 3600.0).alias("hours_since_discover"),
            F.sum(F.when(F.col("started_at") >= now - 7 * config.DAY, F.col("new_boards"))).cast("bigint").alias("marginal_yield_7d"),
        ),
        collapsed(runs).agg(F.sort_array(F.collect_list("source")).alias("collapsed")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))  # one row each
    return out


def over(name: str, most: int) -> Callable[[dict], bool]:
    return lambda s: (s.get(name) or 0) > most


#: (rule, action, test), the first that holds decides.
RULES: tuple[tuple[str, str, Callable[[dict], bool]], ...] = (
    ("budget", END, lambda s: s.get("spent_s", 0) >= s.get("budget_s", float("inf"))),
    ("collapsed_source", "heal", lambda s: bool(s.get("collapsed"))),
    ("validate_backlog", "validate", over("unvalidated", config.MANY_UNVALIDATED)),
    ("stale_ruleset", "classify", over("stale_classification", config.MANY_STALE)),
    ("resolve_backlog", "resolve", over("unresolved_companies", config.MANY_UNRESOLVED)),
    ("discover_due", "discover", lambda s: s.get("hours_since_discover") is None or s["hours_since_discover"] >= config.DISCOVER_HOURS),
    ("yield_flat", "prospect", lambda s: s.get("marginal_yield_7d") is not None and s["marginal_yield_7d"] < config.LOW_YIELD),
)


def decide(row: dict, available: set[str]) -> tuple[str, str, list[str]]:
    """(action, rule, rules that hold but whose action isn't available)."""
    skipped = []
    for name, action, holds in RULES:
        if holds(row):
            if action == END or action in available:
                return action, name, skipped
            skipped.append(name)
    return END, "nothing", skipped


def explain(row: dict, available: set[str]) -> list[tuple[str, str, bool, bool]]:
    """(rule, action, holds, available) of every rule."""
    return [(name, action, holds(row), action == END or action in available) for name, action, holds in RULES]
