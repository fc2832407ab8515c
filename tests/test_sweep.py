"""Sweeps: sources as streams, applied batch by batch."""

import os
import time

import pytest
from pyspark.sql import functions as F

from postline.sources import discovery as sources
from postline.sources.discovery import FOUND, SOURCES, Source
from postline.sources.store import Store
from postline.streaming import discovery
from postline.streaming.discovery import Sweep

ROW = "ats string, slug string, company_name string, domain string, external_id string, title string, location string, status int"
NAMES = [c.strip().split(" ")[0] for c in FOUND.split(",")]


def board(slug, **more):
    return {"ats": "lever", "slug": slug, "company_name": None, "domain": None, "external_id": None, "title": None, "location": None, "status": 200} | more


def written(spark, path, batches):
    """A file for each batch, in this order."""
    os.makedirs(path, exist_ok=True)
    for k, rows in enumerate(batches):
        if rows is None:
            with open(f"{path}/part-{k}.parquet", "wb") as f:
                f.write(b"no parquet at all")
        else:
            spark.createDataFrame(rows, ROW).coalesce(1).write.parquet(f"{path}-{k}")
            (only,) = [f for f in os.listdir(f"{path}-{k}") if f.endswith(".parquet")]
            os.rename(f"{path}-{k}/{only}", f"{path}/part-{k}.parquet")
        os.utime(f"{path}/part-{k}.parquet", (time.time() - 1_000 + 10 * k,) * 2)
    return spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(path)


def plain(name, **more):
    return Source(name, lambda rows: rows.drop("status"), **more)


@pytest.fixture
def sweep(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), buckets=4)
    return Sweep(store, str(tmp_path / "checkpoints"), 500, catalogue={"fake": plain("fake"), "good": plain("good"), "bad": plain("bad"), "keyed": plain("keyed", needs=("key",))})


def test_a_source_that_dies_keeps_what_it_gave_and_the_sweep_goes_on(spark, sweep, tmp_path):
    bad = written(spark, str(tmp_path / "bad"), [[board("a"), board("b")], [board("c", company_name="Cee Inc")], None, [board("never")]])
    good = written(spark, str(tmp_path / "good"), [[board("kept")]])
    told = []
    results = sweep.run({"bad": bad, "good": good}, ["bad", "keyed", "nobody", "good"], told.append)
    assert results == told and [r["source"] for r in results] == ["bad", "keyed", "nobody", "good"]
    assert results[0]["error"] and (results[0]["refs_seen"], results[0]["new_boards"], results[0]["new_companies"]) == (3, 3, 1)
    assert results[1]["skipped"] == "no key" and results[2]["skipped"] == "unknown source" and results[3]["new_boards"] == 1 and results[3]["error"] is None
    store = sweep.store
    assert {(r.slug, r.status, r.company_id) for r in store.read("boards").collect()} == {("a", "unvalidated", None), ("b", "unvalidated", None), ("c", "unvalidated", 1), ("kept", "unvalidated", None)}
    assert {(r.slug, r.source) for r in store.read("board_sources").collect()} == {("a", "bad"), ("b", "bad"), ("c", "bad"), ("kept", "good")}
    runs = {r.source: r for r in store.read("source_runs").collect()}
    assert set(runs) == {"bad", "keyed", "good"} and all(r.finished_at == 500 for r in runs.values()) and sorted(r.id for r in runs.values()) == [1, 2, 3]
    # the next sweep starts where the source died, and what was applied isn't again
    os.remove(str(tmp_path / "bad" / "part-2.parquet"))
    spark.createDataFrame([board("late"), board("a")], ROW).coalesce(1).write.parquet(str(tmp_path / "mended"))
    (only,) = [f for f in os.listdir(tmp_path / "mended") if f.endswith(".parquet")]
    os.rename(tmp_path / "mended" / only, tmp_path / "bad" / "part-2.parquet")
    (again,) = sweep.run({"bad": bad}, ["bad"])
    assert (again["refs_seen"], again["new_boards"], again["error"]) == (3, 2, None)
    assert store.read("boards").count() == 6 and store.read("board_sources").count() == 6


def test_a_batch_that_comes_again_changes_nothing(spark, sweep, monkeypatch):
    rows = spark.createDataFrame([board("a", company_name="Acme", domain="acme.com", external_id="1", title="Data Engineer", location="Berlin"), board("a"), board(None, company_name="Bee")], ROW)
    for _ in range(2):
        sweep.apply(sweep.catalogue["fake"], rows, 0, 1)
    store = sweep.store
    state = {n: sorted(map(repr, store.read(n).collect())) for n in ("boards", "companies", "jobs", "sweep_batches")}
    assert [len(v) for v in state.values()] == [1, 2, 1, 1]
    job = store.read("jobs").first()
    assert (job.external_id, job.role_family, job.region, job.source, job.status, job.first_seen_at, job.missing_polls) == ("1", "data", "europe", "fake", "open", 500, 0)
    assert store.read("boards").first().company_id == store.read("companies").filter("domain = 'acme.com'").first().id
    monkeypatch.setattr(discovery, "finish", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):  # dies within a transaction
        sweep.apply(sweep.catalogue["fake"], spark.createDataFrame([board("z", company_name="Zed")], ROW), 1, 1)
    assert {n: sorted(map(repr, store.read(n).collect())) for n in state} == state


def test_known_rows_are_filled_and_polled_postings_left_alone(spark, sweep):
    store = sweep.store
    store.write("companies", spark.createDataFrame([(7, None, "Acme", "acme")], "id bigint, domain string, name string, norm_name string"))
    store.write("boards", spark.createDataFrame([("lever", "a", "active", None, None)], "ats string, slug string, status string, company_name string, company_id bigint"))
    store.write("jobs", spark.createDataFrame([("lever", "a", "1", "As polled", "open")], "ats string, slug string, external_id string, title string, status string"))
    found = [board("a", company_name="Acme, Inc.", domain="www.acme.com", external_id="1", title="Data Engineer"), board("a", external_id="2", title="Nurse"), board("a", external_id="3", title="Rust Engineer")]
    sweep.apply(sweep.catalogue["fake"], spark.createDataFrame(found, ROW), 0, 1)
    assert [(r.id, r.domain, r.name) for r in store.read("companies").collect()] == [(7, "acme.com", "Acme")]
    assert [(r.status, r.company_name, r.company_id) for r in store.read("boards").collect()] == [("active", "Acme, Inc.", 7)]
    assert {r.external_id: r.title for r in store.read("jobs").collect()} == {"1": "As polled", "3": "Rust Engineer"}
    folder = store.manifest()["companies"]
    sweep.apply(sweep.catalogue["fake"], spark.createDataFrame(found, ROW), 1, 1)
    assert store.manifest()["companies"] == folder  # nothing was gained, so nothing is written again
    assert store.read("sweep_batches").filter("batch_id = 1").first()[3:7] == (3, 0, 0, 0)


def test_limit_and_refused_answers(spark, sweep, tmp_path):
    sweep.limit = 3
    many = written(spark, str(tmp_path / "fake"), [[board(f"c{k}{i}", status=429 if i else 200) for i in range(2)] for k in range(4)] + [[board(None, status=403)]])
    (r,) = sweep.run({"fake": many}, ["fake"])
    assert (r["refs_seen"], r["new_boards"], r["blocked"], r["error"]) == (3, 3, 5, None) and sweep.store.read("boards").count() == 3


def test_the_catalogue_gives_references_of_one_shape(spark):
    lines = spark.createDataFrame([("https://jobs.lever.co/acme",), ("lever:Bolt # a comment",), ("# none",)], "value string")
    pages = spark.createDataFrame([("firm", 1, 'x https://jobs.ashbyhq.com/one " https://jobs.lever.co/two"')], "firm string, page int, html string")
    got = {}
    for name, answers in (("seeds", lines), ("portfolios", pages), ("customers", pages)):
        df = SOURCES[name].found(answers)
        assert df.columns == NAMES
        got[name] = {(r.source, r.ats, r.slug) for r in df.collect()}
        assert {r.ord for r in df.collect()} == {r.ord for r in SOURCES[name].found(answers.repartition(3)).collect()}
    assert got["seeds"] == {("seeds", "lever", "acme"), ("seeds", "lever", "bolt")} and got["portfolios"] == {("portfolios", "ashby", "one"), ("portfolios", "lever", "two")}
    assert ("customers", "ashby", "one") in got["customers"]
    assert set(sources.DEFAULT_ORDER) < set(SOURCES) and SOURCES["searches"].missing({}, {}) == "no search_key; no table of pages"


def test_directory_names_the_member_only_where_the_board_is_its_own(spark):
    members = spark.createDataFrame([("Acme", "https://www.acme.com/about"), ("Visionary", "bought.io"), ("Many", "many.com"), ("None", None)], "name string, website string")
    page = lambda *slugs: " ".join(f'"https://jobs.lever.co/{s}"' for s in slugs)
    probes = spark.createDataFrame(
        [("acme.com", "/careers", 1, 200, page("acme")), ("bought.io", "/jobs", 1, 200, page("buyer", "acme")), ("many.com", "/jobs", 1, 200, page("p", "q", "r", "many"))],
        "domain string, path string, path_rank int, status int, html string",
    )
    got = {r.slug: (r.company_name, r.website, r.careers_url, r.detail) for r in SOURCES["directory"].found(members, probes=probes).collect()}
    assert got["acme"] == ("Acme", "https://acme.com", "https://acme.com/careers", "acme.com")
    assert got["buyer"] == (None, None, None, "bought.io") and got["many"] == (None, None, None, "many.com") and set(got) == {"acme", "buyer", "p", "q", "r", "many"}
