"""Tables as Parquet with fixed schemas and versions.

A mutation writes new folders beside those in use: a complete next table, or rows that are added to one. What counts is
named by a version file of the whole store, written to one side and then moved to its number, so that readers see all
changes of a transaction or none, however many tables it touches, and a writer that was overtaken is told so. Folders that
no version names any more (of earlier tables, or of writers that died) go with ``vacuum``.

The postings' state is huge, and a poll or a sweep touches little of it: its rows, like those of the boards, lie in buckets, folders by a
hash of their board. How many there are is settled when a store is first written: as many as make a bucket worth a task or a few.
``read`` takes some buckets alone, and ``replace`` writes those that changed and leaves the others where they are. Overwriting
partitions in place would cost as little, but readers would see a state whose events aren't there yet, and a batch that died
would meet its own half of the next state.

``migrate`` brings tables of an earlier schema up to date, one step for each version, all of them in one transaction.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2: jobs in buckets, single locations not repeated as JSON. 3: labels of jobs and names of companies that lack them.
SCHEMA_VERSION = 3
VERSION_KEY, BUCKETS_KEY = "_schema", "_buckets"
SCHEMAS = {
    "companies": "id bigint, domain string, name string, norm_name string, website string, careers_url string, careers_kind string, careers_checked_at bigint, first_seen_at bigint, source string",
    "boards": "ats string, slug string, company_name string, status string, tier int, job_count int, next_poll_at bigint, last_polled_at bigint, last_ok_at bigint, last_new_at bigint, consecutive_failures int, last_error string, first_seen_at bigint, website string, careers_url string, careers_checked_at bigint, company_id bigint",
    "board_sources": "ats string, slug string, source string, first_seen_at bigint, detail string",
    "jobs": "ats string, slug string, external_id string, title string, location string, locations_json string, url string, content_hash string, role_family string, is_engineering int, is_fde int, seniority string, classified_by string, region string, posted_at bigint, first_seen_at bigint, last_seen_at bigint, closed_at bigint, status string, missing_polls int, source string",
    "events": "id bigint, ts bigint, type string, ats string, slug string, external_id string, title string, url string, detail_json string",
    "poll_runs": "id bigint, started_at bigint, finished_at bigint, boards_polled int, boards_failed int, new_jobs int, edited_jobs int, closed_jobs int",
    "source_runs": "id bigint, source string, started_at bigint, finished_at bigint, refs_seen bigint, new_boards bigint, new_companies bigint, seed_postings bigint, blocked bigint, error string, skipped string",
    "sweep_batches": "run_id bigint, source string, batch_id bigint, refs_seen bigint, new_boards bigint, new_companies bigint, seed_postings bigint, blocked bigint",
    "proposals": "id bigint, agent string, kind string, payload string, evidence string, status string, score double, created_at bigint, decided_at bigint, decided_by string",
    "notifier_state": "key string, last_event_id bigint, updated_at bigint",
    "notified_jobs": "ats string, slug string, external_id string, notified_at bigint",
}
#: Tables in buckets, and how many.
BUCKETED = {"jobs", "boards"}
BUCKETS = 64


def bucket_of(buckets: int = BUCKETS) -> Column:
    """The bucket of a board's rows, by the first digits of a hash of ats and slug."""
    return (F.conv(F.substring(F.md5(F.concat_ws("/", "ats", "slug").cast("binary")), 1, 6), 16, 10).cast("int") % buckets).cast("int")


class Store:
    """The tables under a folder. buckets: how many a new store gets."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root = spark, root.rstrip("/")
        self.open: dict[str, list[str]] | None = None  # the changes of a transaction
        self.wanted, self.known = buckets, (0, {})  # the version that was read last, and its folders

    @property
    def buckets(self) -> int:
        return int(self.manifest().get(BUCKETS_KEY, [self.wanted])[0])

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest version's number; 0 before the first."""
        at = self._path("_versions")
        if not self._files().exists(at):
            return 0
        return max([int(f.getPath().getName()) for f in self._files().listStatus(at) if f.getPath().getName().isdigit()], default=0)

    def manifest(self) -> dict[str, list[str]]:
        """The folders of each table in the newest version."""
        version = self.version()
        if version != self.known[0]:
            out: dict[str, list[str]] = {}
            file = self._files().open(self._path(f"_versions/{version}"))
            for line in self.spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8").split("\n"):
                name, folder = line.split("\t")
                out.setdefault(name, []).append(folder)
            file.close()
            self.known = version, out
        return self.known[1] if version else {}

    @contextmanager
    def transaction(self) -> Iterator[Store]:
        """Changes within the block count together, when it ends; none does if it fails."""
        version, self.open = self.version(), {}
        try:
            yield self
            changes, folders = self.open, self.manifest() | self.open
            if changes:
                if not version:
                    folders[VERSION_KEY] = [str(SCHEMA_VERSION)]
                folders.setdefault(BUCKETS_KEY, [str(self.wanted)])
                beside, number = self._path(f"_versions/.{uuid.uuid4().hex}"), self._path(f"_versions/{version + 1}")
                out = self._files().create(beside)
                out.write("\n".join(f"{name}\t{folder}" for name, own in folders.items() for folder in own).encode())
                out.close()
                if self._files().exists(number) or not self._files().rename(beside, number):
                    raise RuntimeError(f"version {version + 1} of {self.root} was written by another")
        finally:
            self.open = None

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """The current table, or some buckets of it; columns that an older version lacks are null; empty where nothing was written. A
        transaction reads what it found."""
        empty = self.spark.createDataFrame([], SCHEMAS[name])  # a partition column would come last
        folders = [f for f in self.manifest().get(name, []) if buckets is None or bucket_number(f) is None or bucket_number(f) in buckets]
        if not folders:
            return empty
        return self.spark.read.schema(SCHEMAS[name]).parquet(*[f"{self.root}/{name}/{f}" for f in folders]).select(*empty.columns)

    def write(self, name: str, df: DataFrame) -> None:
        """Makes df the table's next version."""
        self._change(name, df, [])

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds rows in a folder of their own; what is there stays as it is."""
        own = self.open.get(name) if self.open else None
        self._change(name, rows, own if own is not None else self.manifest().get(name, []))

    def replace(self, name: str, rows: DataFrame, buckets: list[int]) -> None:
        """Makes rows, all of these buckets' rows, what the table has in them; other buckets are neither read nor written."""
        own = self.open.get(name) if self.open else None
        before = own if own is not None else self.manifest().get(name, [])
        if any(bucket_number(f) is None for f in before):
            raise ValueError(f"{name} of {self.root} is of an older schema: migrate() first")
        self._change(name, rows, [f for f in before if bucket_number(f) not in buckets])

    def schema_version(self) -> int:
        """The version that the tables are of: the present one where nothing was written, 1 where none was noted."""
        have = self.manifest()
        return int(have[VERSION_KEY][0]) if VERSION_KEY in have else 1 if have else SCHEMA_VERSION

    def migrate(self, steps: dict[int, Callable[[str, DataFrame], DataFrame]]) -> int:
        """Brings older tables up to date by the steps after their version, each of which makes of a table and its name the table
        that the step's version has; gives the number of tables written. All of it counts at once, and once: a store of the
        present version stays as it is."""
        todo = [steps[v] for v in sorted(steps) if self.schema_version() < v <= SCHEMA_VERSION]
        if self.schema_version() >= SCHEMA_VERSION:
            return 0
        with self.transaction():
            for name in [n for n in SCHEMAS if self.manifest().get(n)]:
                old = df = self.read(name)
                for step in todo:
                    df = step(name, df)
                if df is not old or name in BUCKETED:
                    self.write(name, df)
            self.open.setdefault(VERSION_KEY, [str(SCHEMA_VERSION)])
            return len(self.open) - 1

    def compact(self, name: str) -> None:
        """Writes a table that many appends have spread over folders as one."""
        if len(self.manifest().get(name, [])) > 1:
            self.write(name, self.read(name))

    def load(self, name: str, df: DataFrame) -> int:
        """Writes df as the table and counts it again: rows that were lost or doubled on the way fail the load, which then doesn't count."""
        expected = df.count()
        with self.transaction():
            self.write(name, df)
            folders = [f"{self.root}/{name}/{folder}" for folder in self.open[name]]
            found = self.spark.read.schema(SCHEMAS[name]).parquet(*folders).count() if folders else 0
            if found != expected:
                raise RuntimeError(f"{name}: {expected} rows were to be loaded, {found} were")
        return found

    def _change(self, name: str, df: DataFrame, before: list[str]) -> None:
        if self.open is None:
            with self.transaction():
                return self._change(name, df, before)
        folder = uuid.uuid4().hex
        empty = self.spark.createDataFrame([], SCHEMAS[name])
        known = [F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in empty.dtypes]
        if name not in BUCKETED:
            df.select(*known).write.parquet(f"{self.root}/{name}/{folder}")
            self.open[name] = [*before, folder]
            return None
        # a bucket's rows together, unless they are many: then Spark splits them
        rows = df.select(*known).withColumn("bucket", bucket_of(self.buckets)).hint("rebalance", "bucket")
        rows.write.partitionBy("bucket").parquet(f"{self.root}/{name}/{folder}")
        made = [f.getPath().getName() for f in self._files().listStatus(self._path(f"{name}/{folder}")) if f.isDirectory()]
        self.open[name] = [*before, *[f"{folder}/{b}" for b in sorted(made)]]

    def vacuum(self) -> int:
        """Deletes the folders and versions that the newest version doesn't need, and tells how many folders went. No other writer
        or reader of older versions may be at work."""
        current, gone = self.manifest(), 0
        for name in SCHEMAS:
            if self._files().exists(self._path(name)):
                named = {f.split("/")[0] for f in current.get(name, [])}
                for f in self._files().listStatus(self._path(name)):
                    parts = [b for b in self._files().listStatus(f.getPath()) if name in BUCKETED and b.isDirectory()]
                    left = [b for b in parts if f"{f.getPath().getName()}/{b.getPath().getName()}" in current.get(name, [])]
                    if f.getPath().getName() not in named:
                        gone += bool(self._files().delete(f.getPath(), True))
                    elif left:
                        for b in parts:
                            gone += b not in left and bool(self._files().delete(b.getPath(), True))
        for f in self._files().listStatus(self._path("_versions")) if current else []:
            if f.getPath().getName() != str(self.version()):
                self._files().delete(f.getPath(), True)
        return gone


def bucket_number(folder: str) -> int | None:
    """The bucket that a folder of a version has; None for one of no bucket."""
    _, _, last = folder.rpartition("/bucket=")
    return int(last) if "/bucket=" in folder else None
