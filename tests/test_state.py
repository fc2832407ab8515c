"""The state in buckets, shares of polls, and upgrades of older tables."""

import os
import random

import pytest
from pyspark.sql import functions as F

from postline.operators import diff, upgrades
from postline.sources.store import BUCKETS, SCHEMA_VERSION, SCHEMAS, Store, bucket_of
from postline.streaming import streams

COLUMNS = "ats string, slug string, fetched int"


@pytest.mark.parametrize("sizes", [[0] * 9, [20] * 7, [100, 1, 100, 51, 50, 49, 0, 3], [1_000], []])
def test_shares_hold_whole_boards_and_no_more_than_the_most(spark, sizes):
    rng = random.Random(len(sizes))
    sizes = sizes + [rng.choice([1, 9, 30, 50, 51, 99, 100]) for _ in range(60 if sizes else 0)]
    boards = spark.createDataFrame([("lever", f"b{k}", n) for k, n in enumerate(sizes)], COLUMNS)
    rows = streams.shares(boards, most=100).collect()
    assert sorted((r.slug, r.fetched) for r in rows) == sorted((f"b{k}", n) for k, n in enumerate(sizes))
    held = {}
    for r in rows:
        held.setdefault(r.share, []).append(r.fetched)
    assert all(sum(own) <= 100 or len(own) == 1 for own in held.values())
    assert len(held) <= 2 * sum(sizes) / 100 + 1 + sum(n > 50 for n in sizes)
    assert rows == sorted(rows, key=lambda r: r.bucket) or len({r.bucket for r in rows}) > 1


def posting(slug, k, title="t"):
    return ("lever", slug, str(k), title, "open", 0, "h", 5)


JOBS = "ats string, slug string, external_id string, title string, status string, missing_polls int, content_hash string, first_seen_at bigint"


def files(root):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, own in os.walk(root) for f in own if f.endswith(".parquet")}


def test_a_share_reads_and_writes_the_buckets_of_its_boards(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    jobs = spark.range(20_000).select(F.lit("lever").alias("ats"), F.concat(F.lit("b"), F.col("id") % 400).alias("slug"), F.col("id").cast("string").alias("external_id"), F.sha2(F.col("id").cast("string"), 256).alias("title"), F.lit("open").alias("status"), F.lit(0).alias("missing_polls"), F.lit("h").alias("content_hash"))
    store.write("jobs", jobs)
    before = files(store.root + "/jobs")
    fetched = spark.createDataFrame([(1, "lever", "b7", "ok", 1), (1, "lever", "b8", "ok", 1), (1, "lever", "b9", "transient", 0)], streams.FETCHED)
    fetched.coalesce(1).write.parquet(str(tmp_path / "in"))
    staged_of = lambda ok: ok.select("ats", "slug", F.lit("new").alias("external_id"), F.lit("t").alias("title"), F.lit("h").alias("content_hash"), F.lit(None).cast("bigint").alias("posted_at"))
    running = streams.diff_stream(spark.readStream.schema(streams.FETCHED).parquet(str(tmp_path / "in")), store, staged_of, str(tmp_path / "cp"), lambda i: 100 + i)
    running.awaitTermination()
    made = {k: v for k, v in files(store.root + "/jobs").items() if k not in before}
    touched = {r.b for r in spark.createDataFrame([("lever", "b7"), ("lever", "b8")], "ats string, slug string").select(bucket_of().alias("b")).collect()}
    assert {int(k.split("bucket=")[1].split("/")[0]) for k in made} == touched
    assert sum(made.values()) < sum(before.values()) * 3 * len(touched) / BUCKETS + 20_000
    expected = diff.next_state(diff.decided(jobs_state(spark, jobs), fetched.filter("fetch_status = 'ok'").select("ats", "slug", "fetched"), staged_of(fetched.filter("fetch_status = 'ok'"))), 100)
    key = ["ats", "slug", "external_id", "status", "missing_polls", "last_seen_at"]
    assert sorted(map(tuple, store.read("jobs").select(*key).collect()), key=str) == sorted(map(tuple, expected.select(*key).collect()), key=str)
    assert store.read("jobs", sorted(touched)).filter(bucket_of().isin(*touched)).count() == store.read("jobs", sorted(touched)).count() > 0
    assert streams.last_id(store, "events") == store.read("events").count() == 2
    plan = store.read("jobs", [min(touched)])._jdf.queryExecution().simpleString()
    assert len(store.read("jobs", [min(touched)]).inputFiles()) < 5, plan
    assert store.vacuum() >= len(touched) and store.read("jobs").count() == 20_002


def jobs_state(spark, jobs):
    blank = spark.createDataFrame([], SCHEMAS["jobs"])
    return jobs.select(*[F.col(c).cast(t).alias(c) if c in jobs.columns else F.lit(None).cast(t).alias(c) for c, t in blank.dtypes])


def test_many_shares_are_settled_in_few_transactions(spark, tmp_path, monkeypatch):
    todo = [(s, [s % 4]) for s in range(0, 200, 2)]
    runs = list(streams.rounds(todo, 5_000, None))
    assert len(runs) <= 8 and [s for *_, part in runs for s in part] == todo and [last for _, last, _ in runs] == [5_000 + at + len(part) - 1 for at, _, part in runs]
    # shares that are done stay done, however they were cut before
    assert [s for *_, part in streams.rounds(todo, 5_000, 5_036) for s in part] == todo[37:]
    assert list(streams.rounds(todo, 5_000, 5_099)) == list(streams.rounds(todo, 5_000, 6_000)) == [] and list(streams.rounds(todo, 5_000, 4_000)) == runs
    assert list(streams.rounds([(None, [])], 0, None)) == [(0, 0, [(None, [])])]
    store = Store(spark, str(tmp_path / "store"), buckets=2)
    fetched = spark.range(60).select(F.lit(1).cast("bigint").alias("snapshot_id"), F.lit("lever").alias("ats"), F.concat(F.lit("b"), "id").alias("slug"), F.lit("ok").alias("fetch_status"), F.lit(9).alias("fetched"))
    fetched.coalesce(1).write.parquet(str(tmp_path / "in"))
    staged_of = lambda ok: ok.select("ats", "slug", F.lit("1").alias("external_id"), F.lit("t").alias("title"), F.lit("h").alias("content_hash"), F.lit(None).cast("bigint").alias("posted_at"))
    streams.diff_stream(spark.readStream.schema(streams.FETCHED).parquet(str(tmp_path / "in")), store, staged_of, str(tmp_path / "cp"), lambda i: 100 + i, most=20).awaitTermination()
    polls = store.read("poll_runs").collect()
    assert 1 < len(polls) <= 8 and sum(r.boards_polled for r in polls) == sum(r.new_jobs for r in polls) == 60 == store.read("jobs").count()
    assert sorted(r.id for r in store.read("events").collect()) == list(range(1, 61))


def test_the_newest_snapshot_of_a_board_counts(spark):
    rows = [(1, "lever", "a", "ok", 9), (2, "lever", "a", "ok", 4), (2, "lever", "b", "ok", 1), (2, "lever", "b", "ok", 1)]
    got = streams.newest(spark.createDataFrame(rows, streams.FETCHED)).collect()
    assert sorted((r.slug, r.fetched) for r in got) == [("a", 4), ("b", 1)]


def test_an_old_store_is_upgraded_once_and_whole(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    assert store.schema_version() == SCHEMA_VERSION and store.migrate(upgrades.STEPS) == 0
    monkeypatch.setattr("postline.sources.store.BUCKETED", set())  # as the first version wrote them
    monkeypatch.setattr("postline.sources.store.SCHEMA_VERSION", 1)
    rows = [("lever", "a", "1", "Senior Data Engineer", "Berlin", '["Berlin"]', None, None), ("lever", "b", "2", "Nurse", "Oslo", '["Oslo","Rome"]', "r0", "kept"), ("lever", "b", "3", None, None, None, None, None)]
    store.write("jobs", spark.createDataFrame(rows, "ats string, slug string, external_id string, title string, location string, locations_json string, classified_by string, region string"))
    store.write("companies", spark.createDataFrame([(1, "Acme, Inc."), (2, None)], "id bigint, name string"))
    monkeypatch.undo()
    assert store.schema_version() == 1
    with pytest.raises(ValueError, match="older schema"):
        store.replace("jobs", store.read("jobs"), [1])
    version, steps = store.version(), dict(upgrades.STEPS)
    dying = steps | {3: lambda name, df: 1 / 0}
    with pytest.raises(ZeroDivisionError):
        store.migrate(dying)
    assert store.version() == version and store.schema_version() == 1
    assert store.migrate(steps) == 2 and store.schema_version() == SCHEMA_VERSION
    got = {r.external_id: r for r in store.read("jobs").collect()}
    assert [got[k].locations_json for k in "123"] == [None, '["Oslo","Rome"]', None]
    assert (got["1"].role_family, got["1"].seniority, got["1"].region, got["1"].is_engineering) == ("data", "senior", "europe", 1)
    assert (got["2"].classified_by, got["2"].region, got["2"].role_family) == ("r0", "kept", None) and got["3"].region == "unknown"
    assert {r.id: r.norm_name for r in store.read("companies").collect()} == {1: "acme", 2: None}
    assert store.migrate(steps) == 0 and store.version() == version + 1
    assert store.read("jobs", [b.b for b in store.read("jobs").select(bucket_of().alias("b")).distinct().collect()]).count() == 3
