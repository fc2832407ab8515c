"""Recorded pages of job boards as a Spark data source, to read and to write: ``format("board_pages")``.

A page lies at ``<path>/<ats>/<slug>/<number>.<fetch_status>``, as it was answered. A read has a partition for each group of boards
of one platform. With the option ``push`` a filter on ``ats`` is pushed to it, so that other platforms' folders aren't even listed;
Spark 4.1 keeps one such filter for each ``load``, whatever is made of it, so ``of_platform`` loads anew for each. The boards of a
paged platform must be whole: the pages' postings add up to the total that they state, and don't exceed the most that
is fetched. Under ``mode`` FAILFAST, the default, a board that isn't whole fails its partition; under PERMISSIVE it comes as one
row with the status ``transient`` and no body, as a poll takes a failed fetch: postings aren't closed for it.

Writing a page again replaces it, so tasks may be repeated. Options: ``path``, ``mode``, ``push`` and ``boards`` (boards a partition).
"""

from __future__ import annotations

import functools
import json
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from postline.sources import adapters
from postline.sources.adapters import LISTS, MOST, TOTALS

SCHEMA = "ats string, slug string, page int, fetch_status string, body string"
ARROW = pa.schema([("ats", pa.string()), ("slug", pa.string()), ("page", pa.int32()), ("fetch_status", pa.string()), ("body", pa.string())])
BOARDS = 200
#: A batch of rows ends with the board that reaches so many rows or characters.
ROWS, CHARS = 1_000, 4_000_000


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def folders(files: fs.FileSystem, at: str) -> list[str]:
    return sorted(posixpath.basename(f.path) for f in files.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.type == fs.FileType.Directory)


@dataclass
class Boards(InputPartition):
    """Some boards of one platform."""

    ats: str
    names: list[str]


def lacking(ats: str, bodies: list[str]) -> str | None:
    """What is wrong with a board's pages; None if they are whole."""
    if ats not in TOTALS:
        return None
    total, have = 0, 0
    for body in bodies:
        try:
            page = json.loads(body)
            have += len(page[LISTS[ats]])
            for name in TOTALS[ats].split("."):
                page = page[name]
            total = max(total, int(page or 0))
        except (ValueError, KeyError, TypeError):
            return "a page without its list or total"
    return f"{total} postings, more than {MOST}" if total > MOST else f"{have} postings of {total}" if have < total else None


class PagesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.strict, self.boards = options["path"], options.get("mode", "FAILFAST").upper() == "FAILFAST", int(options.get("boards", BOARDS))
        self.push = options.get("push", "false").lower() == "true"
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if self.push and isinstance(f, EqualTo | In) and f.attribute == ("ats",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f

    def partitions(self) -> list[Boards]:
        files, root = opened(self.path)
        out = []
        for ats in folders(files, root):
            if self.wanted is None or ats in self.wanted:
                names = folders(files, f"{root}/{ats}")
                out += [Boards(ats, names[k : k + self.boards]) for k in range(0, len(names), self.boards)]
        return out or [Boards("", [])]

    def read(self, partition: Boards) -> Iterator[pa.RecordBatch]:
        """Batches of many boards: one for each board would cost more than its pages."""
        rows, size = [], 0
        for name in partition.names:
            board = self.board(partition.ats, name)
            rows += board
            size += sum(len(r[-1] or "") for r in board)
            if len(rows) >= ROWS or size >= CHARS:
                yield batch_of(rows)
                rows, size = [], 0
        if rows:
            yield batch_of(rows)

    def board(self, ats: str, name: str) -> list[tuple]:
        """A board's pages as rows."""
        files, root = opened(self.path)
        pages = []
        for f in files.get_file_info(fs.FileSelector(f"{root}/{ats}/{name}")):
            number, _, status = posixpath.basename(f.path).partition(".")
            with files.open_input_stream(f.path) as stream:
                pages.append((int(number), status, stream.read().decode()))
        pages.sort()
        slug, wrong = unquote(name), lacking(ats, [body for _, status, body in pages if status == "ok"])
        if wrong and self.strict:
            raise ValueError(f"{ats}/{slug} is not whole: {wrong}")
        return [(ats, slug, *page) for page in ([(0, "transient", None)] if wrong else pages)]


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)


class PagesWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"]
        if overwrite:
            files, root = opened(self.path)
            if files.get_file_info(root).type == fs.FileType.Directory:
                files.delete_dir_contents(root)

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        files, root = opened(self.path)
        for row in iterator:
            board = f"{root}/{row.ats}/{quote(row.slug, safe='')}"
            files.create_dir(board, recursive=True)
            with files.open_output_stream(f"{board}/{row.page or 0}.{row.fetch_status}") as stream:
                stream.write((row.body or "").encode())
        return WriterCommitMessage()


class BoardPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "board_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagesReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return PagesWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> SparkSession:
    """The session, with the format and with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BoardPages)
    return spark


def of_platform(spark: SparkSession, path: str, ats: str, **options: str) -> DataFrame:
    """The recorded pages of one platform."""
    return spark.read.format("board_pages").options(**options).option("push", "true").load(path).filter(F.col("ats") == ats)


def postings(spark: SparkSession, path: str, now: int, **options: str) -> DataFrame:
    """The postings of all platforms' recorded boards; those of a board that isn't whole are none."""
    out = [adapters.postings(of_platform(spark, path, ats, mode="PERMISSIVE", **options), ats, now) for ats in adapters.MAPPINGS]
    return functools.reduce(DataFrame.unionByName, out)
