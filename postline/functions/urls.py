"""Job-board links: a URL's platform, board and posting, and all such links of a text, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path segments that are no board, file endings, and the forms of parts.
ASHBY_PAGES = "meeting api b embed assets static _next favicon.ico robots.txt sitemap.xml manifest.json login signup app".split()
OTHER_PAGES = ["", *"jobs job search embed api static assets privacy terms legal login signin signup about help support contact pricing blog security".split()]
SUBDOMAIN_PAGES = "jobs www careers app api".split()
SLUG = r"^[a-z0-9][a-z0-9._-]{0,62}$"
FILE = r"\.(txt|xml|ico|html?|json|js|css|png|jpe?g|gif|svg|webp|pdf|php|aspx?)$"
UUID = r"^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
WORKDAY_HOST = r"^([a-z0-9-]+)\.(wd\d+)\.myworkdayjobs\.com$"
LANGUAGE = r"^[a-z]{2}(-[A-Z]{2})?$"
GREENHOUSE_HOSTS = "boards.greenhouse.io job-boards.greenhouse.io boards.eu.greenhouse.io job-boards.eu.greenhouse.io".split()
LEVER_HOSTS = "jobs.lever.co jobs.eu.lever.co".split()
SMARTRECRUITERS_HOSTS = "jobs.smartrecruiters.com careers.smartrecruiters.com".split()
SUBDOMAINS = {".recruitee.com": "recruitee", ".breezy.hr": "breezy", ".icims.com": "icims", ".bamboohr.com": "bamboohr", ".rippling.com": "rippling"}
IN_TEXT = (
    r"https?://(?:jobs\.ashbyhq\.com|(?:job-)?boards(?:\.eu)?\.greenhouse\.io|jobs(?:\.eu)?\.lever\.co|jobs\.smartrecruiters\.com"
    r"|[a-z0-9-]+\.wd\d+\.myworkdayjobs\.com|[a-z0-9-]+\.(?:recruitee\.com|breezy\.hr|icims\.com))"
    r"/[^\s\"'<>)\]}\\]*"
)
REF = "struct<ats:string,slug:string,external_id:string>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_scheme(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    return F.when(F.instr(url, F.lit("://")) > 0, url).otherwise(F.concat(F.lit("https://"), F.regexp_replace(url, "^/+", "")))


def host_of(url: Column) -> Column:
    """Lower case, without user, port or a leading www."""
    netloc = F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1)
    return F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(netloc, "^.*@", ""), r":\d*$", "")), r"^www\.", "")


def path_parts(url: Column) -> Column:
    return F.filter(F.split(F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), "/"), lambda p: p != "")


def query_value(url: Column, name: str) -> Column:
    """The first value of a query argument, decoded; null if it isn't there or empty."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    value = F.regexp_extract(query, rf"(?:^|&){name}=([^&]*)", 1)
    return F.when(value != "", F.coalesce(F.try_url_decode(value), value))


def clean_slug(raw: Column) -> Column:
    """A board's name in its one spelling; null for files and whatever can't be one."""
    s = F.lower(F.regexp_replace(F.trim(raw), "^/+|/+$", ""))
    s = F.regexp_replace(F.regexp_replace(s, "[?#].*$", ""), r"[.,);:'\"\]>]+$", "")
    return F.when(s.rlike(SLUG) & ~s.rlike(FILE), s)


def ref(ats: Column | str, slug: Column, external_id: Column | None = None) -> Column:
    ats = F.lit(ats) if isinstance(ats, str) else ats
    external_id = F.lit(None).cast("string") if external_id is None else external_id
    return F.when(slug.isNotNull(), F.struct(ats.alias("ats"), slug.alias("slug"), external_id.alias("external_id"))).otherwise(F.lit(None).cast(REF))


def split(raw: Column) -> Column:
    """struct(url, host, parts, first) of a link: its whole, its host, its path's segments, and the first as a slug."""
    url = with_scheme(raw)
    parts = path_parts(url)
    return F.struct(url.alias("url"), host_of(url).alias("host"), parts.alias("parts"), clean_slug(F.get(parts, F.lit(0))).alias("first"))


def parse(raw: Column) -> Column:
    """struct(ats, slug, external_id) of a link to a known platform, else null."""
    return let(split(raw), routed)


def routed(link: Column) -> Column:
    """``parse`` for what ``split`` made of a link."""
    url, host, parts, first = (link[c] for c in ("url", "host", "parts", "first"))
    part = lambda i: F.get(parts, F.lit(i))
    uuid = F.when(part(1).rlike(UUID), part(1))
    allowed = lambda pages: F.when(~first.isin(*pages), first)
    asked = query_value(url, "for")
    posting = F.when((F.size(parts) > 2) & (part(1) == "jobs"), part(2))
    greenhouse = F.when(asked.isNotNull(), ref("greenhouse", clean_slug(asked), query_value(url, "token"))).when(
        host.isin(*GREENHOUSE_HOSTS) & (F.size(parts) > 0) & ~part(0).isin("embed", "job_app"), ref("greenhouse", allowed(OTHER_PAGES), posting)
    )
    after_language = F.when((F.size(parts) > 1) & part(0).rlike(LANGUAGE), part(1)).otherwise(part(0))
    site = F.when((part(0) == "wday") & (F.size(parts) >= 4), part(3)).otherwise(after_language)
    board = F.lower(F.concat(F.regexp_extract(host, WORKDAY_HOST, 1), F.lit("."), F.regexp_extract(host, WORKDAY_HOST, 2), F.lit("/"), site))
    out = (
        F.when(host == "jobs.ashbyhq.com", ref("ashby", allowed(ASHBY_PAGES), uuid))
        .when(host.endswith("greenhouse.io"), greenhouse)
        .when(host.isin(*LEVER_HOSTS), ref("lever", allowed(OTHER_PAGES), uuid))
        .when(host.rlike(WORKDAY_HOST), ref("workday", board))
        .when(host.isin(*SMARTRECRUITERS_HOSTS) & (F.size(parts) > 0), ref("smartrecruiters", first, part(1)))
    )
    for suffix, ats in SUBDOMAINS.items():
        slug = clean_slug(F.substring(host, 1, F.char_length(host) - len(suffix)))
        out = out.when(host.endswith(suffix), ref(ats, F.when(~slug.isin(*SUBDOMAIN_PAGES), slug)))
    return out.when((host == "jobs.jobvite.com") & (F.size(parts) > 0), ref("jobvite", first))


#: A character reference, what lies between two, or an ampersand of its own.
REFERENCE = r"&#[xX][0-9a-fA-F]+;?|&#[0-9]+;?|&[A-Za-z][A-Za-z0-9]*;?|[^&]+|&"
#: The names come with Python. Those that need no semicolon also count at the beginning of a longer one, longest first.
BARE = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
OFTEN = ("amp;", "quot;", "lt;", "gt;", "nbsp;", "apos;")
#: Fixed value: what the numbers 128 to 159 mean, by the Windows code page; its gaps are the control characters themselves.
WINDOWS = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(128, 160))


def character(number: Column) -> Column:
    """The character of a numeric reference, by the rules of HTML; null is a number out of range."""
    usual = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    gone = number.between(1, 8) | (number == 11) | number.between(14, 31) | (number == 127) | number.between(0xFDD0, 0xFDEF) | (number.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    return (
        F.when(number.isNull() | (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF), "\ufffd")
        .when(number.between(128, 159), F.substring(F.lit(WINDOWS), (number - 127).cast("int"), F.lit(1)))
        .when(gone, "")
        .otherwise(usual)
    )


def named(name: Column) -> Column:
    """The characters of a named reference (without its ampersand), or the text itself where it names none."""
    end = "\x01"
    table = F.map_from_arrays(F.split(F.lit(" ".join(html5)), " "), F.split(F.lit(end.join(html5.values())), end))
    out = F.when(name == OFTEN[0], html5[OFTEN[0]])
    for n in OFTEN[1:]:
        out = out.when(name == n, html5[n])
    begins = F.regexp_extract(name, f"^(?:{'|'.join(BARE)})", 0)
    shorter = F.when(begins != "", F.concat(F.element_at(table, begins), F.substring(name, F.char_length(begins) + 1, F.char_length(name)))).otherwise(F.concat(F.lit("&"), name))
    return out.otherwise(F.coalesce(F.element_at(table, name), shorter))


def unescape(text: Column) -> Column:
    """text with its HTML character references, numeric and named, as characters. Without an ampersand it isn't looked at."""
    # more than 8 digits are out of range
    number = lambda p, at, base: F.conv(F.regexp_extract(p, f"^.{{{at}}}0*([0-9a-fA-F]{{1,8}})(?=;?$)", 1), base, 10).cast("bigint")

    def decoded(p: Column) -> Column:
        value = F.when(p.rlike("^&#[xX]?0+;?$"), 0).when(F.lower(F.substring(p, 1, 3)) == "&#x", number(p, 3, 16)).otherwise(number(p, 2, 10))
        return (
            F.when(F.substring(p, 1, 1) != "&", p)
            .when(F.substring(p, 1, 2) == "&#", let(value, character))
            .when(F.char_length(p) == 1, p)
            .otherwise(named(F.substring(p, F.lit(2), F.char_length(p))))
        )

    pieces = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))
    return F.when(F.instr(text, F.lit("&")) > 0, F.array_join(F.transform(pieces, decoded), "")).otherwise(text)


def extract_all(text: Column) -> Column:
    """The boards that a text or HTML links to, in order, each once: array of struct(ats, slug, external_id).

    Each distinct link is split and parsed once; a null or empty text has none.
    """
    found = F.regexp_extract_all(unescape(F.coalesce(text, F.lit(""))), F.lit("(?i)" + IN_TEXT), F.lit(0))
    refs = F.filter(F.transform(F.transform(F.array_distinct(found), split), routed), lambda r: r.isNotNull())
    key = lambda r: F.struct(r["ats"], r["slug"])
    return let(refs, lambda all_: let(F.transform(all_, key), lambda keys: F.filter(all_, lambda r, i: F.array_position(keys, key(r)) == i + 1)))
