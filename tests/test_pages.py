"""Recorded pages of boards as a data source."""

import json
import os

import pytest
from pyspark.sql import functions as F

from postline.sources import adapters, pages

ROWS = "ats string, slug string, page int, fetch_status string, body string"


def workday(total, *titles):
    return json.dumps({"total": total, "jobPostings": [{"title": t, "externalPath": f"/job/Oslo/{t}_R{k}", "locationsText": "Oslo", "bulletFields": [f"R{t}{k}"]} for k, t in enumerate(titles)]})


@pytest.fixture
def recorded(spark, tmp_path):
    pages.register(spark)
    rows = [("workday", "acme.wd1/Ext", 0, "ok", workday(3, "a", "b")), ("workday", "acme.wd1/Ext", 1, "ok", workday(0, "c")), ("workday", "down.wd1/x", 0, "transient", None)]
    rows += [("lever", f"b{k}", 0, "ok", json.dumps([{"id": f"l{k}", "text": "Designer"}])) for k in range(9)] + [("lever", "bø/å", 0, "ok", "[]")]
    path = str(tmp_path / "recorded")
    spark.createDataFrame(rows, ROWS).repartition(3).write.format("board_pages").mode("append").save(path)
    return path, sorted(rows, key=str)


def test_what_was_written_is_read(spark, recorded):
    path, rows = recorded
    got = sorted((tuple(r) for r in spark.read.format("board_pages").load(path).collect()), key=str)
    assert [tuple(v or None for v in r) for r in got] == [tuple(v or None for v in r) for r in rows]
    assert {(r.slug, r.external_id) for r in adapters.postings(pages.of_platform(spark, path, "workday"), "workday", 1_788_000_000).collect()} == {("acme.wd1/Ext", x) for x in ("Ra0", "Rb1", "Rc0")}
    spark.createDataFrame([("lever", "b1", 0, "ok", "[]")], ROWS).write.format("board_pages").mode("append").save(path)
    assert spark.read.format("board_pages").load(path).filter("slug = 'b1'").first().body == "[]"
    spark.createDataFrame([("lever", "one", 0, "ok", "[]")], ROWS).write.format("board_pages").mode("overwrite").save(path)
    assert [r.slug for r in spark.read.format("board_pages").load(path).collect()] == ["one"]


def test_filters_reach_the_source_and_boards_are_dealt(spark, recorded):
    path, _ = recorded
    load = lambda **more: spark.read.format("board_pages").option("boards", 4).options(**more).load(path)
    assert load().rdd.getNumPartitions() == 3 + 1 and load(push="true").filter("ats = 'lever'").rdd.getNumPartitions() == 3
    assert load(push="true").filter("ats = 'workday' AND page = 1").rdd.getNumPartitions() == 1 and load(push="true").filter("ats = 'workday' AND page = 1").count() == 1
    assert load(push="true").filter(F.col("ats").isin("lever", "breezy")).count() == 10 and load(push="true").filter("ats = 'breezy'").count() == 0
    one = load()  # without push a load may be filtered in many ways
    assert one.filter("ats = 'lever'").unionByName(one.filter("ats = 'workday'")).count() == one.count() == 13
    assert pages.of_platform(spark, path, "workday").count() == 3 and pages.postings(spark, path, 1_788_000_000).count() == 12


def test_a_board_that_is_not_whole_fails_or_counts_as_failed(spark, recorded):
    path, _ = recorded
    os.remove(f"{path}/workday/acme.wd1%2FExt/1.ok")
    assert pages.of_platform(spark, path, "lever").count() == 10
    with pytest.raises(Exception, match="acme.wd1/Ext is not whole: 2 postings of 3"):
        spark.read.format("board_pages").load(path).collect()
    got = spark.read.format("board_pages").option("mode", "PERMISSIVE").load(path).filter("ats = 'workday'").collect()
    assert sorted((r.slug, r.fetch_status, r.body or None) for r in got) == [("acme.wd1/Ext", "transient", None), ("down.wd1/x", "transient", None)]
    assert pages.lacking("workday", ["not json"]) and pages.lacking("workday", [workday(30_000, "a")]).startswith("30000") and pages.lacking("lever", ["x"]) is None


def test_an_empty_folder_has_no_pages(spark, tmp_path):
    pages.register(spark)
    assert spark.read.format("board_pages").load(str(tmp_path / "none")).count() == 0


def test_boards_come_many_in_a_batch(tmp_path, monkeypatch):
    for k in range(25):
        at = tmp_path / "lever" / f"b{k:02}"
        at.mkdir(parents=True)
        for page in range(k % 3):
            (at / f"{page}.ok").write_text("x" * 10)
    monkeypatch.setattr(pages, "ROWS", 10)
    reader = pages.PagesReader({"path": str(tmp_path)})
    batches = [b for part in reader.partitions() for b in reader.read(part)]
    assert [b.num_rows for b in batches] == [10, 11, 3]
    monkeypatch.setattr(pages, "CHARS", 15)
    small = [b for part in reader.partitions() for b in reader.read(part)]
    assert len(small) > len(batches) and [r for b in small for r in b.to_pylist()] == [r for b in batches for r in b.to_pylist()]
