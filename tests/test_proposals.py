"""Many patterns against titles, and proposals from their filing to their effect."""

import random
import re

import pytest
from pyspark.sql import functions as F

from postline.functions.literals import needed_literals, portable
from postline.operators import proposals
from postline.plans import gates
from postline.sources.store import SCHEMAS


@pytest.mark.parametrize(
    "pattern, literals",
    [
        ("engineer", ["engineer"]), (r"\b(developer|engineer)\b", ["developer", "engineer"]), ("rust.*engineer", ["engineer"]), ("(rust|go) dev", [" dev"]), ("a|engineer", []), ("(?:abc)+x", ["abc"]),
        ("(?:abc)*x", []), ("[abc]def?", []), ("abc?def", ["def"]), ("^x.y$", []), ("(ab|abc)(def|xyz)", ["def", "xyz"]), ("(?=engineer)e", []), ("sta(ff|tion)", ["sta"]),
    ],
)
def test_needed_literals(pattern, literals):
    assert needed_literals(pattern) == literals


def test_portable():
    assert portable("a+") and not portable("(") and not portable("(?P<n>x)") and not portable(None) and not portable("(a)?(?(1)b|c)") and not portable("")


def test_needed_literals_are_in_every_match():
    rng = random.Random(5)
    atoms = ["abc", "de", "fgh", "x", "[ab]", "(abc|def)", "(?:ab|c)", "(fgh)+", "(ij)?", "k*", "(?:lmn){2}", ".", "^", r"\b"]
    texts = ["".join(rng.choice(["abc", "de", "fgh", "x", "ij", "lmnlmn", "k", " "]) for _ in range(6)) for _ in range(400)]
    for _ in range(300):
        pattern = "".join(rng.choice(atoms) for _ in range(rng.randrange(1, 5)))
        pattern = pattern + "|" + rng.choice(atoms) if rng.random() < 0.2 else pattern
        need = needed_literals(pattern)
        assert all(any(s in t for s in need) for t in texts if need and re.search(pattern, t))


TITLES = ["Rust Engineer", "Barista", "Data Analyst", "ENGINEER of Straßen", "Senior ſoftware Engineer", "İstanbul Engineer", "kelvin Kelvin", None, "", "Ingénieur", "go"]
PATTERNS = ["engineer", r"\brust\b", "a", "zzz", "(", "software", "istanbul", "kelvin", "straßen|barista", "^$", "ingénieur", None, "(data|barista)s?", "g.$", "(?P<x>a)"]


def test_ruleset_gates_equal_one_gate_after_another(spark):
    rng = random.Random(1)
    jobs = spark.createDataFrame([(t, rng.choice(["engineering", "other", "data", None])) for t in TITLES * 4], "title string, role_family string")
    rules = [(k, p, rng.choice(["engineering", "data"])) for k, p in enumerate(PATTERNS)] + [(90, "engineer", None)]
    got = {r.id: tuple(r)[1:] for r in gates.ruleset_gates(jobs, spark.createDataFrame(rules, "id bigint, pattern string, family string")).collect()}
    assert len(got) == len(rules)
    for k, pattern, family in rules:
        if not portable(pattern) or not family:
            assert got[k] == (0, 0, None, gates.REJECTED)
        else:
            assert got[k] == tuple(gates.ruleset_gate(jobs, pattern, family).first())
    assert got[0][0] > got[1][0] > 0 and got[5][0] and got[7][0] and got[9][0]


def test_patterns_meet_candidates_alone(spark):
    titles = spark.createDataFrame([(t,) for t in TITLES if t], "title string")
    rules = gates.described(spark.createDataFrame([(1, "engineer", "data"), (2, "(rust|data) ", "data")], "id bigint, pattern string, family string"))
    plan = gates.pattern_hits(titles, rules)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_many_rules_of_few_patterns_are_judged_once_each(spark):
    titles = spark.createDataFrame([(t,) for t in TITLES if t], "title string")
    one = [(k, p, "data") for k, p in enumerate(["a", "g.$", "engineer"])]
    many = [(3 * n + k, p, f) for n in range(900) for k, p, f in one]  # 1,800 of them have no literal
    columns = "id bigint, pattern string, family string"
    parts = [gates.pattern_hits(titles, gates.described(spark.createDataFrame(rows, columns))) for rows in (one, many)]
    assert parts[0].count() == parts[1].count() > 0
    plans = [p._jdf.queryExecution().optimizedPlan().toString().count("Join") for p in parts]
    assert plans[0] == plans[1]
    jobs = titles.withColumn("role_family", F.lit("data"))
    got = gates.ruleset_gates(jobs, spark.createDataFrame(many, columns)).groupBy((F.col("id") % 3).alias("k")).agg(F.countDistinct("hits", "agree").alias("kinds"), F.count("id").alias("n"))
    assert sorted(map(tuple, got.collect())) == [(k, 1, 900) for k in range(3)]


def test_proposals_from_filing_to_effect(spark):
    none = spark.createDataFrame([], SCHEMAS["proposals"])
    drafts = [(1, "scout", "source", '{"url":"u1"}', None), (2, "scout", "source", '{"url":"gone"}', None), (3, "healer", "diagnosis", "{}", '{"a":"b"}'), (4, "tagger", "ruleset_patch", '{"pattern":"rust","family":"engineering"}', None), (5, "scout", "source", '{"url":"u5"}', None)]
    rows = proposals.filed(none, spark.createDataFrame(drafts, "ord int, agent string, kind string, payload string, evidence string"), 7)
    assert [(r.id, r.kind, r.status, r.created_at) for r in rows.orderBy("id").collect()] == [(k, d[2], "drafted", 7) for k, d in enumerate(drafts, 1)]
    links = " ".join(f'"https://jobs.lever.co/s{k}"' for k in range(30))
    pages = spark.createDataFrame([("u1", links), ("u5", '"https://jobs.lever.co/s0" "https://jobs.lever.co/one"')], "url string, html string")
    boards = spark.createDataFrame([("lever", "s0")], "ats string, slug string").select("*", *[F.lit(None).cast(t).alias(c) for c, t in spark.createDataFrame([], SCHEMAS["boards"]).dtypes[2:]])
    jobs = spark.createDataFrame([("Rust Engineer", "engineering")], "title string, role_family string")
    verdicts = proposals.judged(rows, pages, boards, jobs)
    after = proposals.decided(rows, verdicts, 9)
    assert {r.id: r.status for r in after.collect()} == {1: "auto_applied", 2: "rejected", 3: "pending", 4: "auto_applied", 5: "pending"}
    next_boards, found = proposals.enacted(rows, after, pages, boards, 9)
    assert next_boards.count() == 30 and {(r.source, r.detail) for r in found.collect()} == {("proposal:1", "u1")} and found.count() == 30
    # a decision that comes again, or that a proposal can't take any more, changes nothing
    late = spark.createDataFrame([(1, "rejected", 0.0, "{}"), (2, "accepted", 1.0, "{}"), (5, "accepted", 1.0, "{}"), (5, "drafted", 1.0, "{}"), (3, "rejected", 0.0, "{}")], "id bigint, status string, score double, evidence string")
    last = proposals.decided(after, late, 11, by="human")
    assert {r.id: (r.status, r.decided_by) for r in last.collect()} == {1: ("auto_applied", "gate"), 2: ("rejected", "gate"), 3: ("rejected", "human"), 4: ("auto_applied", "gate"), 5: ("accepted", "human")}
    more, _ = proposals.enacted(after, last, pages, next_boards, 11)
    assert more.count() == 31 and proposals.enacted(last, proposals.decided(last, late, 12), pages, more, 12)[1].count() == 0
