"""The incremental forms of the diff and the digest, as Structured Streaming queries.

Each micro-batch runs the same pure functions as the batch engine: state and input give the next state and events. The
state lives in the store, and all that a batch writes (a diff's events, jobs, run and number; a digest's marks) is one
transaction there: a batch that dies at any point and runs again starts from where it did, and a repeat of a finished
batch changes nothing. Big snapshots are settled in shares of whole boards, some shares at once: however big a snapshot is, it
takes a few transactions, each of one plan over its part. They read and write the state's buckets that their boards lie in, and
no others, so that the bytes moved follow what was polled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postline import config
from postline.operators import diff, sweeps
from postline.plans import digest
from postline.sources.store import BUCKETS, Store, bucket_of

#: The keys in notifier_state: the digest's value is an event id, the diff's a batch's number times SHARES and a share's; those of
#: LAST and a table's name have the last id given there.
DIGEST, DIFF, LAST = "digest_mark", "diff", "last:"
SHARES = 1 << 20
FETCHED = "snapshot_id bigint, ats string, slug string, fetch_status string, fetched int"


def noted(store: Store, key: str) -> int | None:
    """A number of notifier_state."""
    return store.read("notifier_state").filter(F.col("key") == key).agg(F.max("last_event_id")).first()[0]


def advance(store: Store, name: str, batch_id: int) -> bool:
    """Whether a consumer's batch is new; its number is kept in notifier_state."""
    done = noted(store, name)
    return done is None or batch_id > done


def finish(store: Store, marks: dict[str, int], ts: int) -> None:
    """Notes numbers under their keys."""
    others = store.read("notifier_state").filter(~F.col("key").isin(*marks))
    rows = store.spark.createDataFrame([(key, mark, ts) for key, mark in marks.items()], "key string, last_event_id bigint, updated_at bigint")
    store.write("notifier_state", others.unionByName(rows))


def top_id(store: Store, table: str) -> int:
    """The greatest id of a table; 0 where it is empty."""
    return store.read(table).agg(F.coalesce(F.max("id"), F.lit(0).cast("bigint"))).first()[0]


def last_id(store: Store, table: str) -> int:
    """The last id of a table that only the diff writes: as noted, or where it isn't yet, as found."""
    have = noted(store, LAST + table)
    return have if have is not None else top_id(store, table)


def shares(boards: DataFrame, most: int = config.STAGED_MOST, buckets: int = BUCKETS) -> DataFrame:
    """boards (ats, slug, fetched) with ``bucket`` and ``share``: whole boards, packed by running sums in the order of buckets.

    The boards of a share fetched at most ``most`` postings together. One with more than half of that has a share of its own; the
    others, laid end to end, are cut at every half, so that a share holds less than a half and the board that reaches past it.
    Sums run within a bucket, from the sums of the buckets before it, of which there are few. Shares of buckets side by
    side touch few buckets each.
    """
    half = F.lit(most // 2)
    placed = boards.withColumn("bucket", bucket_of(buckets)).withColumn("_big", F.col("fetched") > half)
    rows = placed.withColumns({"_size": F.when(F.col("_big"), 0).otherwise(F.col("fetched")).cast("bigint"), "_one": F.col("_big").cast("bigint")})
    until = Window.partitionBy("bucket").orderBy(*diff.BOARD)
    rows = rows.withColumns({"_at": F.sum("_size").over(until) - F.col("_size"), "_nth": F.sum("_one").over(until)})
    sums = rows.groupBy("bucket").agg(F.sum("_size").alias("_sizes"), F.sum("_one").alias("_ones"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    nought = F.lit(0).cast("bigint")
    starts = sums.select("bucket", *[F.coalesce(F.sum(c).over(before), nought).alias(to) for c, to in (("_sizes", "_start"), ("_ones", "_first"))])
    joined = rows.join(F.broadcast(starts), "bucket")  # a row for each bucket
    # shares of small boards have even numbers, those of big ones odd numbers
    number = F.when(F.col("_big"), (F.col("_first") + F.col("_nth")) * 2 - 1).otherwise(F.floor((F.col("_start") + F.col("_at")) / half) * 2)
    return joined.withColumn("share", number.cast("bigint")).select(*boards.columns, "bucket", "share")


def settle_share(store: Store, boards: DataFrame, staged: DataFrame, buckets: list[int], ts: int) -> tuple[DataFrame, dict[str, int]]:
    """The diff of some boards, all of whose postings lie in these buckets: writes the buckets' next jobs and appends the events.
    Gives the decisions, persisted, and the last id of the events."""
    jobs = store.read("jobs", buckets)
    decisions, held = diff.decided(jobs, boards, staged).persist(), []
    top = last_id(store, "events")
    store.append("events", diff.events(decisions, ts, top, held))
    for df in held:
        df.unpersist()
    store.replace("jobs", diff.next_state(decisions, ts), buckets)
    return decisions, {LAST + "events": top + decisions.filter(F.col("action").isin(*diff.EVENT_RANK)).count()}


def rounds(todo: list, first: int, done: int | None, most: int = config.ROUNDS) -> Iterator[tuple[int, int, list]]:
    """The shares that are left, in order, in at most so many runs of equal length: each run's place in todo, the mark of its last
    share, and its shares. first: the first share's mark; done: that of the last one settled."""
    begin = 0 if done is None else min(max(done + 1 - first, 0), len(todo))
    size = -(-(len(todo) - begin) // most)
    for at in range(begin, len(todo), max(size, 1)):
        part = todo[at : at + size]
        yield at, first + at + len(part) - 1, part


def newest(batch: DataFrame) -> DataFrame:
    """The last snapshot of each board in a batch."""
    last = F.max(F.struct("snapshot_id", "fetched", "fetch_status")).alias("_last")
    return batch.groupBy(*diff.BOARD).agg(last).select(*diff.BOARD, "_last.*")


def diff_stream(fetched: DataFrame, store: Store, staged_of: Callable[[DataFrame], DataFrame], checkpoint: str, ts_of: Callable[[int], int], most: int = config.STAGED_MOST) -> StreamingQuery:
    """Diffs each micro-batch of successful fetches (one snapshot a board) against the stored jobs, by runs of shares (``rounds``).

    fetched: a stream with FETCHED's columns; staged_of gives some boards' postings; ts_of a batch's time. Failed fetches
    change nothing but the counts of the poll's run. Shares that are done are remembered, with the batch's number.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        ts = ts_of(batch_id)
        ok = shares(newest(batch.filter("fetch_status = 'ok'")), most, store.buckets).persist()
        failed = newest(batch.filter("fetch_status <> 'ok'"))
        # a row for each share, of some thousands of postings
        todo = ok.groupBy("share").agg(F.sort_array(F.collect_set("bucket")).alias("buckets")).orderBy("share").collect()
        for number, last, part in rounds([tuple(r) for r in todo] or [(None, [])], batch_id * SHARES, noted(store, DIFF)):
            own = ok.filter(F.col("share").between(part[0][0], part[-1][0])).drop("share", "bucket") if todo else ok.drop("share", "bucket")
            buckets = sorted({b for _, its in part for b in its})
            with store.transaction():
                decisions, marks = settle_share(store, own.select("ats", "slug", "fetched"), staged_of(own), buckets, ts)
                polled = own if number else own.unionByName(failed)
                top = last_id(store, "poll_runs")
                store.append("poll_runs", sweeps.poll_run(polled, decisions, ts, ts, top))
                finish(store, marks | {LAST + "poll_runs": top + 1, DIFF: last}, ts)
            decisions.unpersist()
        ok.unpersist()

    return fetched.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def digest_mark(store: Store) -> int:
    """The last event id that the digest has settled. A consumer without one begins at the newest stored event, not with all history."""
    have = noted(store, DIGEST)
    return have if have is not None else last_id(store, "events")


def digest_stream(events: DataFrame, store: Store, send: Callable[[DataFrame], bool], checkpoint: str, now: int) -> StreamingQuery:
    """Sends each micro-batch's pending postings; only a successful or empty send is recorded, and nobody is told twice in the window.

    send gets at most FLOOD postings by id, each with digest.span's from_id, to_id, pending and flooded: pending and to_id are
    exact however many wait. If it returns False the query fails, so that the micro-batch is offered again at the next start.
    Event ids rise from one micro-batch to the next.
    """
    finish(store, {DIGEST: digest_mark(store)}, now)

    def each(batch: DataFrame, batch_id: int) -> None:
        mark = digest_mark(store)
        told = store.read("notified_jobs")
        rows = digest.pending(batch, store.read("jobs"), store.read("boards"), told, mark, now).persist()
        span = digest.span(rows, batch, mark).first()
        first = store.spark.createDataFrame(rows.limit(config.FLOOD).toArrow())
        rows.unpersist()
        if span.pending:
            told_of = {"from_id": F.lit(span.from_id), "to_id": F.lit(span.to_id), "pending": F.lit(span.pending), "flooded": F.lit(span.flooded)}
            if not send(first.withColumns({c: v.cast("boolean" if c == "flooded" else "bigint") for c, v in told_of.items()})):
                raise RuntimeError(f"the digest of events {span.from_id + 1} to {span.to_id} was not sent")
            if not span.flooded:
                told = digest.mark_notified(told, first, now)
        with store.transaction():
            store.write("notified_jobs", digest.pruned(told, now))
            finish(store, {DIGEST: max(mark, span.to_id)}, now)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_rates(events: DataFrame, late: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """Events by type and window of event time, closed by a watermark. events: a stream with ts (seconds) and type."""
    timed = events.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window), "type").agg(F.count(F.lit(1)).alias("n")).select(F.unix_seconds("window.start").alias("start"), "type", "n")
