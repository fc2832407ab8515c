"""What every source of discovery gives, and the catalogue of sources.

A source turns answers that were fetched into references, and decides nothing: whether a board is real is found out when it is
validated. All sources give rows of one shape, FOUND. A row with a slug names a board, one with a name or a domain alone an
employer that is looked up later, and one with an external_id carries a posting as well.

``ord`` orders the references of a source: by its own order where it has one, else by a hash, so that it is the same
whenever it is computed. The answers of a source may come as a stream; tables that it looks things up in are its sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postline.operators.sweeps import WITHIN
from postline.sources import refs, walk

FOUND = (
    "source string, ord bigint, ats string, slug string, company_name string, domain string, website string, careers_url string, "
    "detail string, external_id string, title string, url string, location string, posted_at bigint"
)
#: Answers of a service that refused: too many requests, or forbidden.
REFUSED = (403, 429)


@dataclass(frozen=True)
class Source:
    """make: answers (and sides by name) to references; needs: settings without which it isn't asked; opt_in: only asked by name."""

    name: str
    make: Callable[..., DataFrame]
    sides: tuple[str, ...] = ()
    needs: tuple[str, ...] = ()
    opt_in: bool = False

    def missing(self, settings: dict[str, str], sides: dict[str, DataFrame]) -> str | None:
        """Why the source can't be asked; None if it can."""
        lacking = [f"no {n}" for n in self.needs if not settings.get(n)] + [f"no table of {s}" for s in self.sides if s not in sides]
        return "; ".join(lacking) or None

    def found(self, answers: DataFrame, **sides: DataFrame) -> DataFrame:
        """The references in these answers."""
        return as_found(self.make(answers, **{k: v for k, v in sides.items() if k in self.sides}), self.name)


def as_found(rows: DataFrame, source: str) -> DataFrame:
    """rows, which have some of FOUND's columns, as FOUND; those that name nothing are left out, repeated ones are one."""
    shape = dict(c.strip().split(" ") for c in FOUND.split(","))
    blank = lambda c, t: (F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c)
    own = rows.select(*[blank(c, t) for c, t in shape.items() if c not in ("source", "ord")], *(["ord"] if "ord" in rows.columns else [])).distinct()
    hashed = F.pmod(F.xxhash64(*[c for c in own.columns if c != "ord"]), F.lit(WITHIN))
    numbered = own.withColumns({"source": F.lit(source), "ord": F.col("ord").cast("bigint") if "ord" in rows.columns else hashed})
    return numbered.filter("slug IS NOT NULL OR company_name IS NOT NULL OR domain IS NOT NULL OR website IS NOT NULL").select(*shape)


def listings(docs: DataFrame) -> DataFrame:
    """Boards of a curated list; active postings come along."""
    rows = refs.listings_json(docs)
    posting = lambda c: F.when(F.col("seed"), F.col(c)).alias(c)
    return rows.select("ats", "slug", "company_name", posting("external_id"), posting("title"))


def objects(docs: DataFrame) -> DataFrame:
    """Employers and boards of JSON of unknown shape."""
    return walk.references(docs).select("ats", "slug", F.col("name").alias("company_name"), "domain")


def filed(lines: DataFrame) -> DataFrame:
    """Companies of a filings index."""
    return refs.filings(lines).select(F.col("company").alias("company_name"), F.col("cik").alias("detail"))


def directory(members: DataFrame, probes: DataFrame) -> DataFrame:
    """Boards on the careers pages of a directory's members (name, website), found by the pages that were probed.

    A page with few boards speaks for its owner, if the domain is called like the board or like the member (it may have been bought,
    and show its buyer's board): these boards get the member's name, site and page. Others come without a company.
    """
    return refs.directory(members, probes)


SOURCES = {
    s.name: s
    for s in (
        Source("seeds", lambda lines: refs.seed_lines(lines)),
        Source("customers", lambda pages: refs.customer_pages(pages)),
        Source("listings", listings),
        Source("objects", objects),
        Source("forum", lambda hits: refs.forum_hits(hits).withColumnRenamed("objectID", "detail")),
        Source("threads", lambda comments, stories: refs.thread_comments(stories, comments), ("stories",)),
        Source("scans", lambda pages: refs.scan_results(pages)),
        Source("portfolios", lambda pages: refs.portfolio_pages(pages)),
        Source("crawl", lambda lines: refs.crawl_index(lines)),
        Source("code", lambda pages: refs.code_search(pages), needs=("code_token",)),
        Source("filings", filed),
        Source("searches", lambda results, pages: refs.search_results(results, pages), ("pages",), ("search_key",)),
        Source("directory", directory, ("probes",)),
        Source("archive", lambda lines: refs.archive_index(lines), opt_in=True),
        Source("postings", lambda pages, numbers: refs.posting_pages(numbers, pages), ("numbers",), opt_in=True),
        Source("stories", lambda links: refs.story_links(links), opt_in=True),
    )
}
#: Cheap and precise ones first, so that a sweep that ends early is of use.
DEFAULT_ORDER = tuple(s.name for s in SOURCES.values() if not s.opt_in)
