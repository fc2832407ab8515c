"""The sweep: each source's answers as a stream, whose references are applied to the registry batch by batch.

Sources are asked in turn, each by a streaming query of its own with a checkpoint of its own. A batch is as many answers as
arrive in ``files`` files: so much at most is done again after a death, and so much is lost of a source that fails. All that
a batch changes (boards, where they were found, companies, postings, counts and the batch's number) is one transaction:
a batch that comes again changes nothing. A source that dies keeps what it gave before, its error is noted, and the sweep goes on.

Bytes follow what is found: boards and postings are read and written by buckets, new companies are added, and known
companies are written again only if one of them gains a value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from postline.operators import ingest, registry, sweeps
from postline.operators.diff import KEY
from postline.sources.discovery import DEFAULT_ORDER, FOUND, REFUSED, SOURCES, Source
from postline.sources.scratch import remove_path
from postline.sources.store import Store, bucket_of
from postline.streaming.streams import advance, finish, top_id

#: In notifier_state, with a source's name: the number of its last batch.
SWEEP = "sweep:"
COUNTS = ("refs_seen", "new_boards", "new_companies", "seed_postings", "blocked")


@dataclass
class Sweep:
    """A sweep into a store. checkpoints: a folder for the streams' progress; settings: what sources need; sides: tables that they
    look things up in; limit: the most references that are applied of each source."""

    store: Store
    checkpoints: str
    ts: int
    settings: dict[str, str] = field(default_factory=dict)
    sides: dict[str, DataFrame] = field(default_factory=dict)
    limit: int | None = None
    catalogue: dict[str, Source] = field(default_factory=lambda: SOURCES)

    def run(self, answers: dict[str, DataFrame], names: list[str] | None = None, on_result: Callable[[dict], None] | None = None) -> list[dict]:
        """Asks the sources (by name, else those of DEFAULT_ORDER that have answers) in turn. answers: a stream for each source. Gives
        a result for each, as it is stored in source_runs; on_result gets each as soon as its source is done."""
        results = []
        for name in names or [n for n in DEFAULT_ORDER if n in answers]:
            source = self.catalogue.get(name)
            if source is None:
                result = blank(name, skipped="unknown source")
            elif why := source.missing(self.settings, self.sides) or (None if name in answers else "no answers"):
                result = self.record(blank(name, skipped=why), self.start(name))
            else:
                result = self.ask(source, answers[name])
            results.append(result)
            if on_result:
                on_result(result)
        return results

    def start(self, name: str) -> int:
        """A run's row that isn't finished, and its number."""
        number = top_id(self.store, "source_runs") + 1
        self.store.append("source_runs", self.store.spark.createDataFrame([(number, name, self.ts)], "id bigint, source string, started_at bigint"))
        return number

    def record(self, result: dict, number: int) -> dict:
        """The run's finished row. source_runs has a row for each source and sweep."""
        old = self.store.read("source_runs")
        row = self.store.spark.createDataFrame([{"id": number, "started_at": self.ts, "finished_at": self.ts, **result}], old.schema)
        self.store.write("source_runs", old.filter(F.col("id") != number).unionByName(row))
        return result

    def ask(self, source: Source, answers: DataFrame) -> dict:
        number, error = self.start(source.name), None

        def each(batch: DataFrame, batch_id: int) -> None:
            self.apply(source, batch, batch_id, number)

        try:
            running = answers.writeStream.foreachBatch(each).option("checkpointLocation", f"{self.checkpoints}/{source.name}").trigger(availableNow=True).start()
            running.awaitTermination()
        except StreamingQueryException as e:
            error = str(e).split("\n")[0][:500]
        done = self.store.read("sweep_batches").filter(F.col("run_id") == number)
        sums = done.agg(*[F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(c) for c in COUNTS]).first()
        return self.record(blank(source.name, error=error) | sums.asDict(), number)

    def apply(self, source: Source, answers: DataFrame, batch_id: int, number: int) -> None:
        """One batch. Its references are written to one side first; how many there are, and how many answers were refused, is
        observed on the way."""
        store, ts = self.store, self.ts
        if not advance(store, SWEEP + source.name, batch_id):
            return
        # the batch's own session: an empty result must not cut off what is observed below it
        answers.sparkSession.conf.set("spark.sql.adaptive.optimizer.excludedRules", "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation")
        asked, given, path = Observation(), Observation(), f"{self.checkpoints}/{source.name}-found/{batch_id}"
        refused = F.count_if(F.col("status").isin(*REFUSED)) if "status" in answers.columns else F.count_if(F.lit(False))
        rows = source.found(answers.observe(asked, refused.alias("blocked")), **self.sides)
        rows.observe(given, F.count(F.lit(1)).alias("refs")).write.mode("overwrite").parquet(path)
        found, refs = store.spark.read.schema(FOUND).parquet(path), given.get["refs"]
        if self.limit is not None:
            before = store.read("sweep_batches").filter(F.col("run_id") == number).agg(F.coalesce(F.sum("refs_seen"), F.lit(0))).first()[0]
            left = max(0, self.limit - before)
            found, refs = found.orderBy("ord").limit(left), min(refs, left)
        buckets = [r[0] for r in found.filter("slug IS NOT NULL").select(bucket_of(store.buckets)).distinct().collect()]
        with store.transaction():
            counts = {"refs_seen": refs, **apply_found(store, found, buckets, source.name, ts), "blocked": asked.get["blocked"]}
            row = store.spark.createDataFrame([{"run_id": number, "source": source.name, "batch_id": batch_id, **counts}], store.read("sweep_batches").schema)
            store.append("sweep_batches", row)
            finish(store, {SWEEP + source.name: batch_id}, ts)
        remove_path(store.spark, path)


def blank(name: str, error: str | None = None, skipped: str | None = None) -> dict:
    return {"source": name, **dict.fromkeys(COUNTS, 0), "error": error, "skipped": skipped}


def apply_found(store: Store, found: DataFrame, buckets: list[int], source: str, ts: int) -> dict[str, int]:
    """Applies references (FOUND) to the store's tables within its transaction; buckets: those of their boards. Gives what is new."""
    boards, jobs, companies = store.read("boards", buckets), store.read("jobs", buckets), store.read("companies")
    named = found.filter("slug IS NOT NULL")
    firms = sweeps.company_rows(found)
    # companies first: boards are linked to those that are new as well
    resolved = registry.resolve_companies(companies, firms).persist()
    top, held = top_id(store, "companies"), []
    added = registry.added_companies(companies, resolved, ts, source, top, held).persist()
    filled = registry.filled_companies(companies, resolved).persist()
    new_companies, gained = added.count(), filled.count()
    if gained:
        store.write("companies", companies.join(filled.select("id"), "id", "left_anti").unionByName(filled))
    if new_companies:
        store.append("companies", added)
    links = registry.company_links(sweeps.company_rows(found, "ats", "slug"), resolved, added)
    next_boards = registry.link_boards(registry.add_boards(boards, named, ts), links)
    new_boards = named.select("ats", "slug").distinct().join(boards, ["ats", "slug"], "left_anti").count()
    if buckets:
        store.replace("boards", next_boards, buckets)
    origins = named.groupBy("ats", "slug", "source").agg(F.min_by("detail", "ord").alias("detail")).withColumn("first_seen_at", F.lit(ts).cast("bigint"))
    store.append("board_sources", origins.join(store.read("board_sources"), ["ats", "slug", "source"], "left_anti"))
    seeds = seeded(found.filter("external_id IS NOT NULL"), jobs, source, ts).persist()
    new_jobs = seeds.count()
    if new_jobs:
        store.append("jobs", seeds)
    counts = {"new_boards": new_boards, "new_companies": new_companies, "seed_postings": new_jobs}
    for df in (resolved, added, filled, seeds, *held):
        df.unpersist()
    return counts


def seeded(postings: DataFrame, jobs: DataFrame, source: str, ts: int) -> DataFrame:
    """Jobs for postings that came with references: those that ingest keeps, each key once, and that aren't stored. What is stored
    is left alone: a polled row is worth more."""
    kept = ingest.staged(postings.drop("source").withColumn("posted_bound", F.lit(None).cast("bigint")), ts)
    rows = registry.first_per_group(kept, KEY, [F.col("ord")]).join(jobs, KEY, "left_anti")
    now = F.lit(ts).cast("bigint")
    added = {"posted_at": F.coalesce("posted_at", "discovered_at"), "first_seen_at": now, "last_seen_at": now, "status": F.lit("open"), "missing_polls": F.lit(0), "source": F.lit(source)}
    return rows.withColumns(added)
