"""Company names and domains, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postline.functions.urls import host_of

# Endings of a company's name, hosts that are nobody's own domain, prefixes of bought names, endings to guess.
LEGAL = r"(?i)([,\s]+(inc|inc\.|incorporated|corp|corp\.|corporation|co|co\.|company|plc|nv|bv|ag|gmbh|sa|pbc|pte|oy|ab)\.?\s*)+$"
VENDORS = (
    "greenhouse.io lever.co ashbyhq.com myworkdayjobs.com smartrecruiters.com recruitee.com breezy.hr icims.com bamboohr.com rippling.com jobvite.com "
    "linkedin.com indeed.com glassdoor.com github.com simplify.jobs google.com notion.site notion.so"
).split()
VERBS = "get use with try join hey go my the we".split()
ENDINGS = ("com", "io", "ai")
GUESS_SIZES = (3, 29)


def base(name: Column) -> Column:
    """A name without legal endings, in lower-case letters and digits: two spellings of a company agree."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), LEGAL, "")), "[^a-z0-9]+", "")


def apex(domain: Column) -> Column:
    """The host of a URL or bare domain; null without a dot, and for hosts of vendors."""
    raw = F.lower(F.trim(domain))
    host = host_of(F.when(F.instr(raw, F.lit("://")) > 0, raw).otherwise(F.concat(F.lit("https://"), raw)))
    vendor = host.rlike(r"(^|\.)(" + "|".join(v.replace(".", r"\.") for v in VENDORS) + ")$")
    return F.when((host != "") & (F.instr(host, F.lit(".")) > 0) & (F.instr(host, F.lit(" ")) == 0) & ~vendor, host)


def stem(domain: Column) -> Column:
    return F.regexp_replace(F.split_part(F.coalesce(apex(domain), F.lit("")), F.lit("."), F.lit(1)), "[^a-z0-9]+", "")


def plausibly_same(domain: Column, *identifiers: Column) -> Column:
    """Whether a domain may belong to what the identifiers name: one's stem holds the other's."""
    own = stem(domain)
    shorter = [F.when(own.startswith(v) & (F.char_length(own) > len(v) + 2), F.substring(own, len(v) + 1, 1000)) for v in VERBS]
    stems = F.filter(F.array(own, *shorter), lambda s: s.isNotNull())
    others = F.filter(F.array(*[base(i) for i in identifiers]), lambda o: o != "")
    same = F.exists(others, lambda o: F.exists(stems, lambda s: F.contains(o, s) | F.contains(s, o)))
    return (own != "") & same


def candidate_domains(name: Column, slug: Column, website: Column) -> Column:
    """Domains to try for a board, the best first and each once: its website's, then guesses from its name and its slug."""
    low, high = GUESS_SIZES
    plain = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "")
    stems = F.filter(F.array(plain(name), plain(slug)), lambda s: F.char_length(s).between(low, high))
    guesses = F.flatten(F.transform(stems, lambda s: F.array(*[F.concat(s, F.lit("." + e)) for e in ENDINGS])))
    return F.array_distinct(F.concat(F.array_compact(F.array(apex(website))), guesses))
