"""Queries against their SQL, and what needs no volume: policy, gates, store, streams."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from postline import config
from postline.operators import careers
from postline.oracle import SQL
from postline.plans import digest, gates, health, listings, policy
from postline.queries import QUERIES
from postline.sources import refs, walk
from postline.sources.store import SCHEMAS, Store
from postline.streaming import streams

DATA = "/root/testdata/sf0.001"
RUNS = "id bigint, source string, started_at bigint, finished_at bigint, refs_seen bigint, new_boards bigint, blocked bigint, skipped string"


def shown(x):
    return f"{x:.6g}" if isinstance(x, float) else str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(shown(x) for x in r) for r in df.select(*columns).collect())
    want = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({SQL[name]})").fetchall()
    assert sorted(tuple(shown(float(x) if type(x).__name__ == "Decimal" else x) for x in r) for r in want) == got


@pytest.mark.parametrize(
    "history, collapsed, saturated",
    [
        ([(13000, 19000)] * 4 + [(0, 100)], True, False),
        ([(600, 5000), (700, 5000), (650, 5000), (642, 5000), (610, 5000)], False, False),
        ([(0, 5000)] * 4, False, True),
        ([(50, 900)], False, False),
    ],
)
def test_trends(spark, history, collapsed, saturated):
    rows = [(i, "s", i, i, r, n, 0, None) for i, (n, r) in enumerate(history)] + [(99, "s", 99, None, 0, 0, 0, None), (100, "s", 100, 100, 0, 0, 0, "no key")]
    t = health.trends(spark.createDataFrame(rows, RUNS)).first()
    assert (t.collapsed, t.saturated) == (collapsed, saturated)


def test_blocked_is_a_collapse_without_history(spark):
    assert health.trends(spark.createDataFrame([(1, "s", 1, 1, 0, 0, 6, None)], RUNS)).first().arrow == "!"


def test_policy_order():
    quiet = {"spent_s": 0, "budget_s": 10, "hours_since_discover": 1.0}
    every = {"heal", "validate", "classify", "resolve", "discover", "prospect"}
    assert policy.decide(quiet, every)[:2] == ("end", "nothing")
    assert policy.decide(quiet | {"spent_s": 10, "collapsed": ["x"]}, every)[1] == "budget"
    assert policy.decide(quiet | {"collapsed": ["x"], "unvalidated": 9_999}, every)[0] == "heal"
    assert policy.decide(quiet | {"collapsed": ["x"], "unvalidated": 9_999}, every - {"heal"}) == ("validate", "validate_backlog", ["collapsed_source"])
    assert policy.decide(quiet | {"hours_since_discover": None}, every)[0] == "discover"


def test_gates(spark):
    jobs = spark.createDataFrame([("Rust Engineer", "engineering"), ("Barista", "other"), ("Data Analyst", "data")], "title string, role_family string")
    assert gates.ruleset_gate(jobs, r"\brust\b", "engineering").first().verdict == gates.AUTO
    assert gates.ruleset_gate(jobs, r"a", "engineering").first().verdict == gates.PENDING
    assert gates.ruleset_gate(jobs, r"zzz", "engineering").first().verdict == gates.REJECTED
    assert gates.compiles("(") is False


def test_digest_without_mark_says_nothing(spark):
    events = spark.createDataFrame([(7, 1, "new", "a", "s", "x", "t", "u")], "id bigint, ts bigint, type string, ats string, slug string, external_id string, title string, url string")
    assert tuple(digest.span(events, events, None).first()) == (7, 7, 0, False)


def test_refs_and_walk(spark):
    lines = spark.createDataFrame([('{"url":"https://jobs.lever.co/acme/1"}',), ("garbage",), ('{"url":"https://x.com"}',)], "value string")
    assert [tuple(r) for r in refs.crawl_index(lines).collect()] == [("lever", "acme")]
    index = spark.createDataFrame([("D           Acme Robotics Inc        1234567   20260801  edgar/x",), ("D    Big Fund LP    1   20260801  x",), ("10-K  Y  2  20260801",)], "value string")
    assert [tuple(r) for r in refs.filings(index).collect()] == [("1234567", "Acme Robotics Inc", "20260801")]
    docs = spark.createDataFrame([(1, '{"a":[{"company":"Acme","website":"https://acme.com","u":"https://jobs.lever.co/acme"}]}'), (2, "not json"), (3, None), (4, '{"company":"B"}\n{"company":"C"}')], "doc bigint, text string")
    got = sorted((r.doc, r.name, r.domain, r.slug) for r in walk.references(docs).collect())
    assert got == [(1, "Acme", "acme.com", "acme"), (4, "B", None, None), (4, "C", None, None)]


def test_store_and_diff_stream(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.read("jobs").count() == 0
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, "ashby", "acme", "ok", 2), (1, "ashby", "down", "transient", 0)], streams.FETCHED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    fetched = spark.readStream.schema(streams.FETCHED).parquet(str(tmp_path / "in"))

    def staged_of(ok):
        return ok.select("ats", "slug", F.lit("1").alias("external_id"), F.lit("t").alias("title"), F.lit("h").alias("content_hash"), F.lit(None).cast("bigint").alias("posted_at"), F.lit(5).cast("bigint").alias("discovered_at"))

    for _ in range(2):  # the second run has nothing new
        streams.diff_stream(fetched, store, staged_of, str(tmp_path / "cp"), lambda i: 100 + i).awaitTermination()
    assert [(r.slug, r.status, r.posted_at) for r in store.read("jobs").collect()] == [("acme", "open", 5)]
    assert [(r.id, r.type) for r in store.read("events").collect()] == [(1, "new")]
    assert store.read("jobs").columns == spark.createDataFrame([], SCHEMAS["jobs"]).columns


def test_diff_stream_that_dies_between_its_writes(spark, tmp_path, monkeypatch):
    """Whatever write a batch dies before, the next start gives each event once, and no table is half a batch ahead."""
    rows = [(1, "ashby", f"b{k}", "ok", 9_000) for k in range(6)] + [(1, "ashby", "down", "transient", 0)]
    (tmp_path / "in").mkdir()
    spark.createDataFrame(rows, streams.FETCHED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    staged_of = lambda ok: ok.select("ats", "slug", F.lit("1").alias("external_id"), F.lit("t").alias("title"), F.lit("h").alias("content_hash"), F.lit(None).cast("bigint").alias("posted_at"))
    change, done = Store._change, []
    for dies_at in (2, 4, 7):
        store, calls = Store(spark, str(tmp_path / f"store{dies_at}")), []

        def dying(self, name, df, before, dies_at=dies_at, calls=calls):
            if self.open is not None:
                calls.append(name)
                if len(calls) == dies_at:
                    raise RuntimeError("lost")
            return change(self, name, df, before)

        run = lambda: streams.diff_stream(spark.readStream.schema(streams.FETCHED).parquet(str(tmp_path / "in")), store, staged_of, str(tmp_path / f"cp{dies_at}"), lambda i: 100 + i, most=20_000).awaitTermination()  # noqa: B023, E731
        monkeypatch.setattr(Store, "_change", dying)
        with pytest.raises(Exception, match="lost"):
            run()
        assert store.read("events").count() == store.read("jobs").count()
        monkeypatch.setattr(Store, "_change", change)
        run()
        assert sorted(r.id for r in store.read("events").collect()) == list(range(1, 7)) and store.read("jobs").count() == 6
        done.append([r.asDict() for r in store.read("poll_runs").orderBy("id").collect()])
        store.vacuum()
        assert store.read("events").count() == 6
    assert sum(r["boards_polled"] for r in done[0]) == 7 and sum(r["boards_failed"] for r in done[0]) == 1 and sum(r["new_jobs"] for r in done[0]) == 6 and len(done[0]) > 1


def test_store_transactions_appends_and_loads(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    events = lambda *ids: spark.createDataFrame([(i, i, "new", "a", "s", str(i), None, None, None) for i in ids], SCHEMAS["events"])
    store.write("events", events(1))
    store.append("events", events(2))
    with store.transaction():
        store.append("events", events(3))
        store.append("events", events(4))
        store.write("notifier_state", spark.createDataFrame([("k", 4, 1)], SCHEMAS["notifier_state"]))
        assert store.read("events").count() == 2
    assert sorted(r.id for r in store.read("events").collect()) == [1, 2, 3, 4] and store.read("notifier_state").count() == 1
    with pytest.raises(ZeroDivisionError), store.transaction():
        store.write("events", events(9))
        1 / 0
    assert store.read("events").count() == 4
    other = Store(spark, store.root)
    with pytest.raises(RuntimeError, match="written by another"), store.transaction():
        store.append("events", events(5))
        other.append("events", events(6))
    store.compact("events")
    assert sorted(r.id for r in store.read("events").collect()) == [1, 2, 3, 4, 6] and len(store.manifest()["events"]) == 1
    assert store.vacuum() > 0 and store.read("events").count() == 5
    assert store.load("events", events(7, 8)) == 2 and store.read("events").count() == 2
    change = Store._change
    monkeypatch.setattr(Store, "_change", lambda self, name, df, before: change(self, name, df.limit(1), before))
    with pytest.raises(RuntimeError, match="2 rows were to be loaded, 1 were"):
        store.load("events", events(1, 2))
    assert sorted(r.id for r in store.read("events").collect()) == [7, 8]


def test_digest_stream_records_only_what_was_sent(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.write("jobs", spark.createDataFrame([("a", "s", "x", 1, 0, "intern", "us")], "ats string, slug string, external_id string, is_engineering int, is_fde int, seniority string, region string"))
    events = spark.createDataFrame([(1, 1, "new", "a", "s", "x", "t", "u", None)], SCHEMAS["events"])
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMAS["events"]).parquet(str(tmp_path / "in"))
    sent = []
    streams.digest_stream(stream, store, lambda rows: sent.append(rows.count()) or True, str(tmp_path / "cp"), config.CUTOFF).awaitTermination()
    assert sent == [1] and store.read("notified_jobs").count() == 1


def test_digest_stream_of_a_flood_that_fails_first(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    n, old = config.FLOOD + 100, 20
    job = lambda i: ("a", "s", str(i), 1, 0, "intern", "us")
    store.write("jobs", spark.createDataFrame([job(i) for i in range(1, n + old + 1)], "ats string, slug string, external_id string, is_engineering int, is_fde int, seniority string, region string"))
    events = spark.createDataFrame([(i, 1, "new", "a", "s", str(i), "t", "u", None) for i in range(1, n + old + 1)], SCHEMAS["events"])
    store.write("events", events.filter(F.col("id") <= old))  # what was there before the consumer
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMAS["events"]).parquet(str(tmp_path / "in"))
    sent = []

    def run(ok):
        send = lambda rows: sent.append((rows.count(), *rows.select("from_id", "to_id", "pending", "flooded").distinct().collect())) or ok
        streams.digest_stream(stream, store, send, str(tmp_path / "cp"), config.CUTOFF).awaitTermination()

    with pytest.raises(Exception, match="was not sent"):
        run(False)
    assert streams.digest_mark(store) == old
    run(True)
    run(True)  # nothing is left
    assert sent == [(config.FLOOD, (old, n + old, n, True))] * 2
    assert streams.digest_mark(store) == n + old and store.read("notified_jobs").count() == 0


def test_adopted_boards_and_decided_proposals(spark):
    companies = spark.createDataFrame([(1, "acme.com", "Acme", "acme", None, None, None, None, 1, "s")], SCHEMAS["companies"])
    rows = [("lever", "acme", "Acme Inc", None), ("lever", "new", "Newco", "https://www.newco.io"), ("lever", "none", None, None)]
    boards = spark.createDataFrame(rows, "ats string, slug string, company_name string, website string").withColumns({"careers_url": F.lit(None).cast("string"), "company_id": F.lit(None).cast("bigint")})
    after, linked = careers.adopted(companies, boards, 5)
    assert {(r.id, r.domain) for r in after.collect()} == {(1, "acme.com"), (2, "newco.io")}
    assert {(r.slug, r.company_id) for r in linked.collect()} == {("acme", 1), ("new", 2), ("none", None)}
    proposals = spark.createDataFrame([(1, "a", "source", "{}", '{"x":"1","y":"2"}', "drafted", None, 1, None, None), (2, "a", "diagnosis", "{}", None, "drafted", None, 1, None, None)], SCHEMAS["proposals"])
    verdicts = spark.createDataFrame([(1, "pending", 3.0, '{"y":"3"}')], "id bigint, status string, score double, evidence string")
    got = {r.id: r for r in careers.decided_proposals(proposals, verdicts, 9).collect()}
    assert (got[1].status, got[1].evidence, got[1].decided_at) == ("pending", '{"x":"1","y":"3"}', 9) and got[2].status == "drafted"


def test_last_polls_proposals_and_careers_queue(spark):
    polls = spark.createDataFrame([(i, i * 10, None, 1, 0, 0, 0, 0) for i in (3, 1, 2)], SCHEMAS["poll_runs"])
    assert [r.id for r in listings.last_polls(polls, 2).collect()] == [3, 2]
    assert listings.last_polls(polls.limit(0)).count() == 0
    proposals = spark.createDataFrame([(i, "a", "source", "{}", None, status, None, i, None, None) for i, status in ((1, "pending"), (2, "drafted"), (3, "pending"), (4, None))], SCHEMAS["proposals"])
    assert [r.id for r in listings.proposals_page(proposals).collect()] == [4, 3, 2, 1]
    assert [r.id for r in listings.proposals_page(proposals, "pending", 1).collect()] == [3]
    now = 100 * config.DAY
    rows = [("fresh", "u", now - config.DAY), ("edge", "u", now - 7 * config.DAY), ("old", "u", now - 8 * config.DAY), ("older", "u", now - 9 * config.DAY), ("never", "u", None), ("nopage", None, None)]
    boards = spark.createDataFrame([("lever", *r) for r in rows], "ats string, slug string, careers_url string, careers_checked_at bigint")
    assert [r.slug for r in listings.careers_due(boards, now).collect()] == ["never", "older", "old"]
    assert [r.slug for r in listings.careers_due(boards, now, limit=1).collect()] == ["never"]
