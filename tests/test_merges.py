"""Merges of companies along chains, from repeated sources and in circles, against one pair after another."""

import random

import pytest
from pyspark.sql import functions as F

from postline.operators import registry


def plain_targets(pairs):
    """One pair after another: each source's least target, circles broken at their greatest id, then followed to the end."""
    to = {}
    for s, t in sorted(pairs):
        if s != t:
            to.setdefault(s, t)
    for start in list(to):
        seen, at = [], start
        while at in to and at not in seen:
            seen.append(at)
            at = to[at]
        if at in seen:
            to.pop(max(seen[seen.index(at) :]))
    out = {}
    for s in to:
        at, steps = s, 0
        while at in to:
            at, steps = to[at], steps + 1
        out[s] = at, steps
    return out


@pytest.mark.parametrize("pairs", [[], [(3, 2), (2, 1)], [(2, 1), (3, 2)], [(5, 5)], [(3, 1), (3, 2), (3, 1)], [(1, 2), (2, 3), (3, 1), (9, 1), (8, 9)], [(k + 1, k) for k in range(40)], "random"])
def test_merge_targets(spark, pairs):
    rng = random.Random(2)
    if pairs == "random":
        pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 100 + (k + 1) % 7) for k in range(7)]
    df = spark.createDataFrame(pairs, "source_id bigint, target_id bigint")
    got = {r.source_id: (r.target_id, r.steps) for r in registry.merge_targets(df).collect()}
    assert got == plain_targets(pairs)


def test_merged_companies_equal_one_merge_after_another(spark):
    rng = random.Random(3)
    companies = [(k, rng.choice([None, f"d{k}"]), rng.choice([None, f"n{k}"]), rng.choice([None, f"u{k}"])) for k in range(40)]
    boards = [("lever", f"b{k}", rng.choice([None, *range(42)])) for k in range(80)]
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(25)] + [(30, 31), (31, 32), (32, 30), (33, 30)]
    rows, held = {c[0]: list(c[1:]) for c in companies}, {b[1]: b[2] for b in boards}
    ends = plain_targets(pairs)
    for s, (t, _) in sorted(ends.items(), key=lambda e: (e[1][1], e[0])):  # the nearest first
        rows[t] = [a if a is not None else b for a, b in zip(rows[t], rows[s], strict=True)]
        held = {slug: t if at == s else at for slug, at in held.items()}
    rows = {k: v for k, v in rows.items() if k not in ends}
    left, moved = registry.merge_companies(
        spark.createDataFrame(companies, "id bigint, domain string, name string, careers_url string"),
        spark.createDataFrame(boards, "ats string, slug string, company_id bigint"),
        spark.createDataFrame(pairs + pairs[:5], "source_id bigint, target_id bigint"),
    )
    assert {r.id: list(r)[1:] for r in left.collect()} == rows
    assert sorted((r.slug, r.company_id) for r in moved.filter(F.col("company_id").isNotNull()).collect()) == sorted((s, c) for s, c in held.items() if c is not None)
    assert moved.count() == len(boards)
