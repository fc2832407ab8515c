"""Boards and companies anywhere in JSON of unknown shape.

Spark has no recursive walk of JSON in its functions, so one small helper walks each document inside Arrow batches; what
comes out (name, site and link of each object) is then handled by DataFrame operations like any other reference.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postline.functions.names import apex
from postline.functions.urls import parse

# Keys that name an employer or its site, and how deep documents are read.
NAME_KEYS = ("company_name", "companyName", "company", "employer", "org", "organization", "organisation")
SITE_KEYS = ("companyDomain", "company_domain", "company_website", "companyWebsite", "company_url", "companyUrl", "website", "domain", "site")
DEPTH = 12
FOUND = "doc bigint, ord bigint, name string, site string, links array<string>"


def objects(text: str) -> Iterator[dict]:
    """Every object of a JSON document, or of JSON lines, outer ones first."""
    try:
        roots = [json.loads(text)]
    except ValueError:
        roots = []
        for line in text.splitlines():
            try:
                roots.append(json.loads(line))
            except ValueError:
                continue
    todo = [(r, 0) for r in reversed(roots)]
    while todo:
        node, depth = todo.pop()
        if isinstance(node, dict):
            yield node
        inner = node.values() if isinstance(node, dict) else node if isinstance(node, list) else ()
        if depth < DEPTH:
            todo += [(v, depth + 1) for v in reversed([*inner]) if isinstance(v, dict | list)]


def named(o: dict, keys: tuple[str, ...]) -> str | None:
    return next((v.strip() for v in map(o.get, keys) if isinstance(v, str) and v.strip()), None)


def walked(docs: DataFrame) -> DataFrame:
    """docs (doc, text) → a row for each object that has a name, a site or a link: see FOUND."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text in zip(b.column("doc").to_pylist(), b.column("text").to_pylist(), strict=True):
                for k, o in enumerate(objects(text or "")):
                    links = [v for v in o.values() if isinstance(v, str) and "/" in v]
                    name, site = named(o, NAME_KEYS), named(o, SITE_KEYS)
                    if name or site or links:
                        rows.append({"doc": doc, "ord": k, "name": name, "site": site, "links": links})
            schema = pa.schema([("doc", pa.int64()), ("ord", pa.int64()), ("name", pa.string()), ("site", pa.string()), ("links", pa.list_(pa.string()))])
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return docs.select(F.col("doc").cast("bigint").alias("doc"), "text").mapInArrow(run, FOUND)


def references(docs: DataFrame) -> DataFrame:
    """(doc, ord, name, domain, ats, slug): what each object names; the board is that of its first link to one."""
    refs = F.filter(F.transform("links", parse), lambda r: r.isNotNull())
    rows = walked(docs).select("doc", "ord", "name", apex(F.col("site")).alias("domain"), F.get(refs, F.lit(0)).alias("r"))
    return rows.select("doc", "ord", "name", "domain", F.col("r.ats").alias("ats"), F.col("r.slug").alias("slug")).filter("name IS NOT NULL OR domain IS NOT NULL OR slug IS NOT NULL")
