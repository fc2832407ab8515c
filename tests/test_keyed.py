"""Keyed state against the batch diff and against plain windows, restarts included."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from postline.operators import diff
from postline.sources.store import SCHEMAS
from postline.streaming import keyed


@pytest.fixture(scope="module")
def state_session(spark):
    yield keyed.with_rocksdb(spark)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def drained(stream, path, spark):
    """Runs a stream until what is there is read; gives what it appended since the last time."""
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def snapshots(rng, boards, n):
    """(snapshot_id, ts, ats, slug, fetched, external_id, content_hash, title, url): some boards each time, some postings of each."""
    for s in range(1, n + 1):
        for slug in rng.sample(boards, 3):
            listed = [] if rng.random() < 0.25 else rng.sample(range(9), rng.randrange(9))
            yield s, (s, 100 + s, "lever", slug, len(listed), None, None, None, None)
            for p in listed:
                version = rng.choice("xxy")
                yield s, (s, 100 + s, "lever", slug, len(listed), str(p), f"h{version}", f"{slug}-{p}{version}", None)


def test_grace_events_equal_the_batch_diff(state_session, tmp_path):
    spark, rng = state_session, random.Random(8)
    n = 7
    polls = list(snapshots(rng, ["a", "b", "c", "d"], n))
    path = str(tmp_path / "in")
    state = spark.createDataFrame([], SCHEMAS["jobs"])
    expected = set()
    for s in range(1, n + 1):
        own = [r for k, r in polls if k == s]
        boards = spark.createDataFrame([r[2:5] for r in own if r[5] is None], "ats string, slug string, fetched int")
        staged = spark.createDataFrame([(r[2], r[3], r[5], r[6], r[7], r[8]) for r in own if r[5] is not None], "ats string, slug string, external_id string, content_hash string, title string, url string")
        staged = staged.withColumns({"posted_at": F.lit(None).cast("bigint"), "discovered_at": F.lit(1).cast("bigint")})
        decisions = diff.decided(state, boards, staged)
        rows = decisions.filter(F.col("action").isin(*diff.EVENT_RANK)).select("action", *diff.KEY, F.coalesce("n_title", "s_title").alias("title")).collect()
        expected |= {(s, *r) for r in rows}
        state = spark.createDataFrame(diff.next_state(decisions, 100 + s).collect(), SCHEMAS["jobs"])
    for part in ([1], [2, 3], [3, 4], [5, 6, 7]):  # a restart between parts; snapshot 3 is given twice
        own = [r for k, r in polls if k in part]
        rng.shuffle(own)
        spark.createDataFrame(own, keyed.POLLED).repartition(2).write.mode("append").parquet(path)
        got = drained(keyed.grace_events(spark.readStream.schema(keyed.POLLED).parquet(path)), str(tmp_path), spark)
    rows = [(r.snapshot_id, r.type, r.ats, r.slug, r.external_id, r.title) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected and {r[1] for r in rows} == set(diff.EVENT_RANK)
    assert all((r.missing_polls == 2) == (r.type == "closed") for r in got.collect())


def test_an_empty_answer_of_a_busy_board_leaves_no_trace(state_session, tmp_path):
    spark = state_session
    jobs = spark.createDataFrame([("lever", "busy", str(k), "open", 1, "h", "t", None) for k in range(6)] + [("lever", "small", "1", "open", 1, None, "t", None)], "ats string, slug string, external_id string, status string, missing_polls int, content_hash string, title string, url string")
    rows = [(1, 5, "lever", slug, 0, None, None, None, None) for slug in ("busy", "small")]
    spark.createDataFrame(rows, keyed.POLLED).write.parquet(str(tmp_path / "in"))
    got = drained(keyed.grace_events(spark.readStream.schema(keyed.POLLED).parquet(str(tmp_path / "in")), jobs), str(tmp_path), spark)
    assert [(r.slug, r.type, r.missing_polls) for r in got.collect()] == [("small", "closed", 2)]


ROWS = "id bigint, ts bigint, ats string, slug string, external_id string"


def test_nobody_is_told_twice_within_the_window(state_session, tmp_path):
    spark, rng = state_session, random.Random(9)
    day = 86_400
    at, rows = 1_780_000_000, []
    for k in range(160):
        at += rng.randrange(3 * day)
        rows.append((k, at, "lever", "a", str(rng.randrange(6))))
    told, expected = {}, []
    for i, ts, *_, p in rows:
        if p not in told or ts - told[p] >= 30 * day:
            told[p] = ts
            expected.append(i)
    path = str(tmp_path / "in")
    for k in range(0, 160, 40):  # restarts between
        spark.createDataFrame(rows[k : k + 40], ROWS).coalesce(1).write.mode("append").parquet(path)
        got = drained(keyed.told_once(spark.readStream.schema(ROWS).parquet(path)), str(tmp_path), spark)
    assert sorted(r.id for r in got.collect()) == expected


def test_told_once_takes_far_times_and_drops_what_comes_behind_the_watermark(state_session, tmp_path):
    spark, path = state_session, str(tmp_path / "in")
    month, far = 30 * 86_400, 20_000_000_000  # in the year 2603
    batches = [[(1, far, "1"), (2, far + 5, "1")], [(3, far + month, "1"), (4, far + 2 * month, "2")], [(5, far + 9, "3"), (6, far + month + 9, "1"), (7, far + 2 * month + 1, "1")]]
    for rows in batches:  # the last batch's first two rows come long after their time
        spark.createDataFrame([(i, ts, "lever", "a", p) for i, ts, p in rows], ROWS).coalesce(1).write.mode("append").parquet(path)
        got = drained(keyed.told_once(spark.readStream.schema(ROWS).parquet(path)), str(tmp_path), spark)
    assert sorted(r.id for r in got.collect()) == [1, 3, 4, 7]


def test_a_board_is_read_and_written_once_a_micro_batch():
    class Counted(dict):
        calls = 0

        def getMapState(self, *_):
            return self

        def getValue(self, key):
            self.calls += 1
            return self.get(key)

        def updateValue(self, key, value):
            self.calls += 1
            self[key] = value

    state, processor = Counted(), keyed.BoardDiff(2, 5)
    processor.init(state)
    names = [c.split(" ")[0] for c in keyed.POLLED.split(", ")]
    rows = [(s, s, "lever", f"b{b}", 20, str(p), f"h{s}", "t", None) for s in (2, 1, 3) for b in range(10) for p in range(s, s + 20)]
    frame = pd.DataFrame(rows, columns=names)
    got = pd.concat(processor.handleInputRows((0,), iter([frame[:250], frame[250:]]), None))
    assert state.calls == 20 and len(state) == 10 and all(v[0] == 3 and len(v[1]) == 22 for v in state.values())
    assert got["type"].value_counts().to_dict() == {"new": 220, "edited": 380, "closed": 10}
    assert len(pd.concat(processor.handleInputRows((0,), iter([frame]), None))) == 0 and state.calls == 30
