"""References to boards and companies from files that discovery leaves behind: link lists, pages, crawl indexes, filings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postline.config import MAX_ATTRIBUTED_REFS
from postline.functions.names import apex, base, plausibly_same
from postline.functions.urls import extract_all, parse

BOARD = ["ats", "slug"]
# Names of investment vehicles, and the sizes of an operating company's name.
VEHICLES = r"(?i)\b(fund|funds|l\.?p\.?|llp|partners|holdings?|trust|spv|series|capital|ventures?|investors?|reit|properties|realty|acquisition)\b"
NAME_SIZES = (3, 39)


def of_links(df: DataFrame, column: str) -> DataFrame:
    """df with the parsed link's ats, slug and external_id, where it is a board's."""
    return df.withColumn("_r", parse(F.col(column))).filter("_r IS NOT NULL").select(*df.columns, "_r.*")


def of_pages(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, ats, slug) of every board that a text links to, each once a text."""
    return df.select(key, F.explode(extract_all(F.col(text))).alias("r")).select(key, "r.ats", "r.slug").distinct()


def seed_file(spark: SparkSession, path: str, ats: str) -> DataFrame:
    """The boards of a seed file: see ``seed_lines``."""
    return seed_lines(spark.read.text(path), ats)


def seed_lines(values: DataFrame, ats: str = "") -> DataFrame:
    """Boards of lines (value) with a slug or a link each; ``#`` starts a comment. A bare slug belongs to ``ats``; without one it
    is written ``ats:slug``."""
    lines = values.select(F.trim(F.split_part("value", F.lit("#"), F.lit(1))).alias("line")).filter("line <> ''")
    bare = ~F.col("line").contains("/") & ~F.col("line").contains(".")
    r = parse(F.col("line"))
    own = F.split_part("line", F.lit(":"), F.lit(1)) if not ats else F.lit(ats)
    slug = F.split_part("line", F.lit(":"), F.lit(2)) if not ats else F.col("line")
    rows = lines.select(F.when(bare, own).otherwise(r["ats"]).alias("ats"), F.nullif(F.when(bare, F.lower(slug)).otherwise(r["slug"]), F.lit("")).alias("slug"))
    return rows.filter("slug IS NOT NULL").distinct()


def crawl_index(lines: DataFrame) -> DataFrame:
    """Boards of a crawl index: JSON lines with a url; other lines are skipped."""
    found = lines.filter(F.col("value").startswith("{")).select(F.get_json_object("value", "$.url").alias("url")).filter("url IS NOT NULL")
    return of_links(found, "url").select(*BOARD).distinct()


def archive_index(lines: DataFrame) -> DataFrame:
    """Boards of a text index whose third field is the link."""
    found = lines.select(F.get(F.split("value", r"\s+"), F.lit(2)).alias("url")).filter("url IS NOT NULL")
    return of_links(found, "url").select(*BOARD).distinct()


def listings_json(docs: DataFrame) -> DataFrame:
    """A curated JSON array of postings: (ats, slug, external_id, company_name, title, seed): seed where it is active, visible and has an id."""
    rows = docs.select(F.explode(F.from_json("value", "array<struct<url:string,company_name:string,title:string,active:boolean,is_visible:boolean>>")).alias("p")).select("p.*")
    live = F.coalesce("active", F.lit(False)) & F.coalesce("is_visible", F.lit(True))
    return of_links(rows, "url").select(*BOARD, "external_id", "company_name", "title", (live & F.col("external_id").isNotNull()).alias("seed"))


def forum_hits(hits: DataFrame) -> DataFrame:
    """Boards named in a forum's hits: (objectID, story_text, comment_text, url)."""
    text = F.concat_ws(" ", "story_text", "comment_text", "url")
    return of_pages(hits.withColumn("_text", text), "_text", "objectID")


def hiring_threads(stories: DataFrame, limit: int = 60) -> DataFrame:
    """The newest threads that ask who is hiring."""
    title = F.lower("title")
    return stories.filter(title.contains("hiring") & title.contains("who")).orderBy(F.col("created_at").desc(), "objectID").limit(limit)


def probed(probes: DataFrame) -> DataFrame:
    """Per domain: boards of the first page with any, and the first page that answered. probes: domain, path, path_rank, status, html."""
    ok = probes.filter("status = 200").withColumn("refs", F.transform(extract_all(F.col("html")), lambda r: F.struct(r["ats"].alias("ats"), r["slug"].alias("slug"))))
    with_refs = F.when(F.size("refs") > 0, F.col("path_rank"))
    return ok.groupBy("domain").agg(F.min_by("refs", with_refs).alias("refs"), F.min_by("path", F.coalesce(with_refs, F.col("path_rank") + 1_000_000)).alias("path"))


def attributed(found: DataFrame, names: Column) -> DataFrame:
    """Boards of probed domains that may be called the domain's own: few of them, and of a like name."""
    rows = found.filter(F.size("refs").between(1, MAX_ATTRIBUTED_REFS)).select("*", F.explode("refs").alias("r"))
    return rows.filter(plausibly_same(F.col("domain"), F.col("r.slug"), names)).select("domain", "r.ats", "r.slug")


def directory(members: DataFrame, probes: DataFrame) -> DataFrame:
    """(ats, slug, company_name, website, careers_url, detail) of the boards on pages of a directory's members (name, website).

    The member is named where ``attributed`` says so. Each board once: with a member if any is named, of several the one of the
    least domain. detail is the domain it was found on.
    """
    sites = members.withColumn("domain", apex(F.col("website"))).filter("domain IS NOT NULL").groupBy("domain").agg(F.min("name").alias("name"))
    found = sites.join(probed(probes), "domain").filter(F.size("refs") > 0)
    own = attributed(found, F.col("name")).withColumn("mine", F.lit(True)).distinct()
    rows = found.select("domain", "name", "path", F.explode("refs").alias("r")).select("domain", "name", "path", "r.ats", "r.slug").distinct().join(own, ["domain", *BOARD], "left")
    first = F.min_by(F.struct("domain", "name", "path", "mine"), F.struct(F.col("mine").isNull(), F.col("domain"))).alias("m")
    site = F.concat(F.lit("https://"), F.col("m.domain"))
    named = lambda c, name: F.when(F.col("m.mine"), c).alias(name)
    return rows.groupBy(*BOARD).agg(first).select(*BOARD, named(F.col("m.name"), "company_name"), named(site, "website"), named(F.concat(site, "m.path"), "careers_url"), F.col("m.domain").alias("detail"))


def filings(lines: DataFrame) -> DataFrame:
    """Index lines ``D  <company>  <cik>  <yyyymmdd> ...`` of operating companies: company, cik, filed; each (cik, company) once."""
    pattern = r"^D(?:/A)?\s{2,}(.+?)\s{2,}(\d+)\s{2,}(\d{8})\b"
    part = lambda i: F.regexp_extract("value", pattern, i)
    rows = lines.filter(F.col("value").rlike(pattern)).select(part(1).alias("company"), part(2).alias("cik"), part(3).alias("filed"))
    return rows.filter(is_operating_company(F.col("company"))).groupBy("cik", "company").agg(F.min("filed").alias("filed"))


def is_operating_company(name: Column) -> Column:
    return ~name.rlike(VEHICLES) & F.char_length(base(name)).between(*NAME_SIZES)


def company_of(df: DataFrame, name: str, site: str) -> DataFrame:
    """df as company references: name and domain, where there is either."""
    rows = df.withColumns({"_name": F.trim(F.col(name)), "_domain": apex(F.col(site))})
    return rows.filter("coalesce(_name, '') <> '' OR _domain IS NOT NULL").select(F.col("_name").alias("name"), F.col("_domain").alias("domain")).distinct()


# Boards of a published list of customers; how a page links to a customer; how it links to a posting by number.
CUSTOMERS = (
    "ramp notion linear cursor replit clay harvey vanta retool posthog deel shopify snowflake zapier reddit mercury ironclad lemonade lime gorgias uipath "
    "deliveroo alan altura amo aurora-solar boomi brightline coder convictional dave eightsleep flock-safety form-energy fullstory hackerone january "
    "marqeta monte-carlo multiverse netgear sequoia stytch oyster hopper superhumanapp cohere supabase teal"
).split()
CUSTOMER_LINK = r"(?i)/customers/([a-z0-9][a-z0-9-]{1,60})"
POSTING_LINK = r"/jobs/view/[^/\"']*?(\d{8,})"
POSTINGS_MOST = 150


def first_refs(df: DataFrame, text: Column, order: list[str], detail: str) -> DataFrame:
    """(ats, slug, detail) of the boards that the texts link to: each board once, with the detail of the first text in order."""
    rows = df.select(F.explode(extract_all(text)).alias("r"), F.struct(*order).alias("o"), F.col(detail).alias("d")).select("r.ats", "r.slug", "o", "d")
    return rows.groupBy(*BOARD).agg(F.min_by("d", "o").alias("detail"))


def scan_results(pages: DataFrame) -> DataFrame:
    """Boards of a scan service's answers (host, page, body: JSON with results[].page.url), with the host asked for."""
    body = F.from_json("body", "struct<results:array<struct<page:struct<url:string>>>>")
    rows = pages.select("host", "page", F.posexplode(body["results"]).alias("at", "r")).select("host", "page", "at", F.col("r.page.url").alias("url"))
    return of_links(rows, "url").groupBy(*BOARD).agg(F.min_by("host", F.struct("host", "page", "at")).alias("detail"))


def code_search(pages: DataFrame) -> DataFrame:
    """Boards in the fragments of a code search's answers (variant, page, body), or in an item's link where it has none; with the repository."""
    item = "struct<text_matches:array<struct<fragment:string>>,html_url:string,repository:struct<full_name:string>>"
    rows = pages.select("variant", "page", F.posexplode(F.from_json("body", f"struct<items:array<{item}>>")["items"]).alias("at", "i"))
    fragments = F.array_join(F.transform(F.coalesce("i.text_matches", F.array().cast("array<struct<fragment:string>>")), lambda m: F.coalesce(m["fragment"], F.lit(""))), " ")
    text = F.coalesce(F.nullif(fragments, F.lit("")), F.col("i.html_url"))
    return first_refs(rows.withColumn("repository", F.col("i.repository.full_name")), text, ["variant", "page", "at"], "repository")


def portfolio_pages(pages: DataFrame) -> DataFrame:
    """Boards on investors' pages (firm, page, html), with the firm and page that has each first, as ``firm:page``."""
    named = pages.withColumn("where", F.concat_ws(":", "firm", F.col("page").cast("string")))
    return first_refs(named, F.col("html"), ["firm", "page"], "where")


def customer_pages(pages: DataFrame, published: list[str] = CUSTOMERS) -> DataFrame:
    """Boards of one platform's customers: a published list, then what pages (html) link to as a customer, then as a board."""
    spark = pages.sparkSession
    listed = spark.range(1).select(F.explode(F.split(F.lit(" ".join(published)), " ")).alias("slug"), F.lit(0).alias("o"), F.lit("published_list").alias("detail"))
    linked = pages.select(F.explode(F.regexp_extract_all("html", F.lit(CUSTOMER_LINK), F.lit(1))).alias("slug")).select(F.lower("slug").alias("slug"), F.lit(1).alias("o"), F.lit("page").alias("detail"))
    boards = pages.select(F.explode(extract_all(F.col("html"))).alias("r")).filter("r.ats = 'ashby'").select("r.slug", F.lit(2).alias("o"), F.lit("page_link").alias("detail"))
    rows = listed.unionByName(linked).unionByName(boards)
    return rows.groupBy("slug").agg(F.min_by("detail", "o").alias("detail")).select(F.lit("ashby").alias("ats"), "slug", "detail")


def search_results(results: DataFrame, pages: DataFrame) -> DataFrame:
    """Boards of a web search: those that a result's own link names, and those on the page of any other result, with the page.

    results: query (its number), rank, url; pages: url, text. A link counts where it comes first; one that names a board isn't
    looked into.
    """
    order = F.struct(F.col("query").alias("query"), F.col("rank").alias("rank"))
    once = results.groupBy("url").agg(F.min(order).alias("o")).withColumn("own", extract_all(F.col("url")))
    direct = once.select(F.explode("own").alias("r"), "o", F.lit("result_url").alias("d"))
    seen = once.filter(F.size("own") == 0).join(pages, "url").select(F.explode(extract_all(F.col("text"))).alias("r"), "o", F.substring("url", 1, 120).alias("d"))
    rows = direct.unionByName(seen).select("r.ats", "r.slug", "o", "d")
    return rows.groupBy(*BOARD).agg(F.min_by("d", F.struct("o", "d")).alias("detail"))


def posting_numbers(pages: DataFrame, most: int = POSTINGS_MOST) -> DataFrame:
    """(job_id, place) of the first ``most`` postings that result pages (keyword, page, html) link to, repeats counted, each once."""
    rows = pages.select("keyword", "page", F.posexplode(F.regexp_extract_all("html", F.lit(POSTING_LINK), F.lit(1))).alias("at", "job_id"))
    first = rows.orderBy("keyword", "page", "at").limit(most)
    return first.groupBy("job_id").agg(F.min(F.struct("keyword", "page", "at")).alias("place"))


def posting_pages(numbers: DataFrame, pages: DataFrame) -> DataFrame:
    """Boards on the pages (job_id, html) of these postings, with the posting's number."""
    return first_refs(pages.join(numbers, "job_id"), F.col("html"), ["place"], "job_id")


def story_links(links: DataFrame) -> DataFrame:
    """Boards that a story's links (ord, link) name, with the link."""
    return first_refs(links.withColumn("shown", F.substring("link", 1, 200)), F.col("link"), ["ord"], "shown")


def thread_comments(stories: DataFrame, comments: DataFrame, limit: int = 60) -> DataFrame:
    """Boards in the comments (story_id, page, ord, comment_text) of the newest hiring threads, with the thread."""
    threads = hiring_threads(stories, limit).select(F.col("objectID").alias("story_id"), F.col("created_at").alias("at"))
    rows = comments.join(threads, "story_id").withColumn("back", -F.col("at"))
    return first_refs(rows, F.col("comment_text"), ["back", "story_id", "page", "ord"], "story_id")
