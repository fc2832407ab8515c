"""Keyed state: the grace counter of each posting, and who was told of what, kept by Spark instead of in tables of our own.

Both run on ``transformWithState``; the session needs ``with_rocksdb``. State is partitioned by its key, restored from the
checkpoint, and belongs to the micro-batch: one that fails, in whatever follows, has changed none of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from postline import config
from postline.operators.diff import BOARD, KEY

#: A row for each posting of a fetch, and one without an external_id for the fetch itself, with the number of postings that it returned.
POLLED = "snapshot_id bigint, ts bigint, ats string, slug string, fetched int, external_id string, content_hash string, title string, url string"
EVENTS = "snapshot_id bigint, ts bigint, type string, ats string, slug string, external_id string, title string, url string, missing_polls int"
#: A board's postings and the last snapshot of it that counted: a list for each of their columns.
HELD = "last bigint, external_id array<string>, status array<string>, missing array<int>, content_hash array<string>, title array<string>, url array<string>"
#: Groups of boards. A group is handed over, and its state restored, at once: a call for each board would cost more than its diff.
GROUPS = 4_096
BEGUN = ("external_id", "status", "missing", "content_hash", "title", "url")
POLLED_ROW = ("snapshot_id", "ts", "fetched", "external_id", "content_hash", "title", "url")


def with_rocksdb(spark: SparkSession) -> SparkSession:
    """The session, with the state store that keyed state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


class BoardDiff(StatefulProcessor):
    """What happens to the postings of a group's boards with each snapshot of them.

    A posting's absence shows only in a fetch of its board, so a board's postings are one value, in a map by board: it is read once
    and written once for all the snapshots of a micro-batch, and boards that weren't polled are left alone. Snapshots count
    in the order of their numbers; one that isn't newer than the last is left out, so that a repeat changes nothing.
    """

    def __init__(self, grace: int, guard: int):
        self.grace, self.guard = grace, guard

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.boards = handle.getMapState("boards", "ats string, slug string", HELD)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        for ats, slug, *lists in zip(*[initialState[c] for c in (*BOARD, *BEGUN)], strict=True):
            self.boards.updateValue((ats, slug), (None, *(v.tolist() for v in lists)))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        boards: dict[tuple, dict[int, list]] = {}
        for f in rows:
            columns = [f[c].astype(object).where(f[c].notna(), None) for c in (*BOARD, *POLLED_ROW)]
            for ats, slug, number, *row in zip(*columns, strict=True):
                boards.setdefault((ats, slug), {}).setdefault(int(number), []).append(row)
        made = []
        for board, snapshots in boards.items():
            made += self.polled(board, snapshots)
        yield pd.DataFrame(made, columns=[c.split(" ")[0] for c in EVENTS.split(", ")]).astype({"missing_polls": "Int32"})

    def polled(self, board: tuple, snapshots: dict[int, list]) -> Iterator[tuple]:
        """The events of a board's snapshots, whose state is written after the last of them."""
        last, *lists = self.boards.getValue(board) or (None,)
        held = {row[0]: tuple(row[1:]) for row in zip(*lists, strict=True)}
        begun = last
        for number in sorted(snapshots):
            if last is not None and number <= last:
                continue
            last, fetch = number, snapshots[number]
            ts, fetched = int(fetch[0][0]), max(int(r[1] or 0) for r in fetch)
            now: dict[str, tuple] = {}
            for _, _, name, *posting in fetch:
                if name is not None:
                    now.setdefault(name, tuple(posting))
            if fetched == 0 and sum(v[0] == "open" for v in held.values()) > self.guard:
                continue  # a bad answer, not the end of all postings
            for name, what, state in self.decided(held, now):
                held[name] = state
                if what:
                    yield number, ts, what, *board, name, state[3], state[4], state[1] if what == "closed" else None
        if last != begun:
            self.boards.updateValue(board, (last, list(held), *([state[k] for state in held.values()] for k in range(5))))

    def decided(self, held: dict, now: dict) -> Iterator[tuple[str, str | None, tuple]]:
        """(posting, event if any, its next state) of the board's postings, held and listed now."""
        for name, posting in now.items():
            old = held.get(name)
            state = ("open", 0, *posting)
            if old is None:
                yield name, "new", state
            elif old[0] == "closed":
                yield name, "reopened", state
            elif old[2] != posting[0]:
                yield name, "edited", state
            else:
                yield name, None, ("open", 0, *old[2:])
        for name, old in list(held.items()):
            if name not in now and old[0] == "open":
                missing = old[1] + 1
                closes = missing >= self.grace
                yield name, "closed" if closes else None, ("closed" if closes else "open", missing, *old[2:])


def grace_events(polled: DataFrame, jobs: DataFrame | None = None, grace: int = config.GRACE, guard: int = config.MASS_CLOSE_GUARD) -> DataFrame:
    """The events (EVENTS) of a stream of fetches (POLLED), as ``diff.decided`` decides them. jobs: stored postings to begin with."""
    begin = None
    if jobs is not None:
        posting = F.struct("external_id", "status", F.coalesce("missing_polls", F.lit(0)).cast("int").alias("missing"), "content_hash", "title", "url")
        whole = jobs.groupBy(*BOARD).agg(F.collect_list(posting).alias("_all"))
        begin = whole.select(group_of(), *BOARD, *[F.col(f"_all.{c}").alias(c) for c in BEGUN]).groupBy("group")
    return polled.select(group_of(), "*").groupBy("group").transformWithStateInPandas(BoardDiff(grace, guard), EVENTS, "append", "none", begin)


def group_of() -> Column:
    return F.pmod(F.xxhash64(*BOARD), F.lit(GROUPS)).cast("int").alias("group")


class ToldOnce(StatefulProcessor):
    """Lets through what a posting's readers weren't told of within the window. What was told is forgotten when the window is over."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.told = handle.getValueState("told", "ts bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "id"])
        events = events[events["ts"].astype(int) * 1_000 > timerValues.getCurrentWatermarkInMs()]  # of those before, what was told may be forgotten
        told = self.told.get()[0] if self.told.exists() else None
        new = []
        for at in events["ts"].astype(int):
            new.append(told is None or at - told >= self.seconds)
            told = at if new[-1] else told
        if any(new):
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
            self.told.update((told,))
            self.handle.registerTimer((told + self.seconds) * 1_000)
        yield events[new]

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.told.clear()
        return iter(())


def told_once(events: DataFrame, seconds: int = config.DEDUPE_SECONDS, late: str = "1 hour") -> DataFrame:
    """A stream of events (with id, ts and KEY) less those of postings that came through less than ``seconds`` before. Of a
    micro-batch the first by time and id counts. State is held for a window, not for ever: with the watermark it goes, and events
    that come behind it are dropped. The event time stays behind: pandas knows no time after the year 2262."""
    timed = events.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late).drop("at")
    return timed.groupBy(*KEY).transformWithStateInPandas(ToldOnce(seconds), events.schema, "append", "eventTime")
