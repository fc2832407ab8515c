"""DuckDB SQL for each query, over the same views."""

from __future__ import annotations

import re

from postline import config
from postline.functions import names, rules as R, urls
from postline.plans.sample import NOW, with_views

COMPANY = "coalesce(c.name, b.company_name, j.slug)"
JOINED = "jobs j LEFT JOIN boards b USING (ats, slug) LEFT JOIN companies c ON c.id = b.company_id"
PAGE = f"ats, slug, external_id, title, {COMPANY} AS company, region, j.first_seen_at"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def matches(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {quoted(pattern)}, 'i')"


def first_match(cases: list[tuple[str, str | None]], otherwise: str | None) -> str:
    value = lambda v: "NULL" if v is None else quoted(v)
    return "CASE " + " ".join(f"WHEN {c} THEN {value(v)}" for c, v in cases) + f" ELSE {value(otherwise)} END"


def role_family(title: str) -> str:
    text = f"trim(coalesce({title}, ''))"
    cases = [(f"{text} = ''", "unknown")]
    for family, pattern, excuse in R.FAMILIES:
        cases.append((matches(text, pattern) + (f" AND NOT {matches(text, excuse)}" if excuse else ""), family))
    return first_match(cases, "other")


def seniority(title: str) -> str:
    return first_match([(matches(f"coalesce({title}, '')", R.words(terms)), level) for level, terms in R.SENIORITY], None)


def region(location: str, sure: str | None = None, found: str | None = None) -> str:
    """sure and found: what a gazetteer says of a city with its country's code, and of any name."""
    text, prefix = f"trim({location})", f"lower(regexp_extract(trim({location}), '^([A-Za-z]{{3}})[\\s-]', 1))"
    m = lambda terms: matches(text, R.words(terms))
    cases = [(f"{location} IS NULL OR {text} = ''", "unknown")]
    cases += [(f"{prefix} IN ({', '.join(map(quoted, codes.split()))})", name) for name, codes in R.ISO3.items()]
    cases += [
        (f"{m(R.NON_TARGET_COUNTRY)} OR {m(R.NON_TARGET_CITY)}", "other"),
        (f"{matches(text, R.US_COUNTRY)} OR {m(R.US_STATE)}", "us"),
        (m(R.EU_COUNTRY), "europe"),
        *[(f"{sure} = {quoted(name)}", name) for name in ("us", "europe", "other") if sure],
        (f"{matches(text, R.US_STATE_CODE_RE)} OR {matches(text, R.US_SHORTHAND_RE)}", "us"),
        (m(R.CA_PROVINCE), "other"),
        (m(R.US_CITY), "us"),
        (m(R.EU_CITY), "europe"),
        *[(f"{found} = {quoted(name)}", name) for name in ("us", "europe", "other") if found],
        (m(R.REMOTE), "remote"),
    ]
    return first_match(cases, "unknown")


def clean(raw: str) -> str:
    s = f"regexp_replace(regexp_replace(lower(trim(trim({raw}), '/')), '[?#].*$', ''), {quoted(r'''[.,);:'\"\]>]+$''')}, '')"
    return f"CASE WHEN regexp_matches({s}, '{urls.SLUG}') AND NOT regexp_matches({s}, '{urls.FILE}') THEN {s} END"


def in_list(values: list[str]) -> str:
    return "(" + ", ".join(map(quoted, values)) + ")"


def routed(source: str, link: str, carry: str) -> str:
    """CTEs that end in ``routed`` (carry, ats, slug, external_id), from table source."""
    sub = " ".join(f"WHEN host LIKE '%{s}' THEN {quoted(a)}" for s, a in urls.SUBDOMAINS.items())
    cut = " ".join(f"WHEN host LIKE '%{s}' THEN left(host, length(host) - {len(s)})" for s in urls.SUBDOMAINS)
    wd = "regexp_matches(host, '^([a-z0-9-]+)\\.(wd\\d+)\\.myworkdayjobs\\.com$')"
    uuid = "CASE WHEN regexp_matches(parts[2], '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$') THEN parts[2] END"
    return f"""
    full_ AS (SELECT *, CASE WHEN contains(coalesce({link}, ''), '://') THEN {link} ELSE 'https://' || ltrim(coalesce({link}, ''), '/') END AS u FROM {source}),
    cut_ AS (SELECT *, regexp_replace(lower(regexp_replace(regexp_replace(regexp_extract(u, '^[^:/?#]+://([^/?#]*)', 1), '^.*@', ''), ':\\d*$', '')), '^www\\.', '') AS host,
                    list_filter(string_split(regexp_extract(u, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/'), lambda p: p <> '') AS parts,
                    regexp_extract(u, '^[^?#]*\\?([^#]*)', 1) AS q FROM full_),
    named_ AS (SELECT *, {clean("parts[1]")} AS first_, nullif(regexp_extract(q, '(?:^|&)for=([^&]*)', 1), '') AS for_, nullif(regexp_extract(q, '(?:^|&)token=([^&]*)', 1), '') AS token_,
                    CASE {cut} END AS sub_, CASE WHEN parts[1] = 'wday' AND len(parts) >= 4 THEN parts[4] WHEN len(parts) > 1 AND regexp_matches(parts[1], '^[a-z]{{2}}(-[A-Z]{{2}})?$') THEN parts[2] ELSE parts[1] END AS site_
               FROM cut_),
    guess_ AS (SELECT *, CASE WHEN host = 'jobs.ashbyhq.com' THEN 'ashby' WHEN host LIKE '%greenhouse.io' THEN 'greenhouse' WHEN host IN {in_list(urls.LEVER_HOSTS)} THEN 'lever' WHEN {wd} THEN 'workday'
                    WHEN host IN {in_list(urls.SMARTRECRUITERS_HOSTS)} THEN 'smartrecruiters' {sub} WHEN host = 'jobs.jobvite.com' THEN 'jobvite' END AS a_ FROM named_),
    slugs_ AS (SELECT *, CASE a_ WHEN 'ashby' THEN CASE WHEN first_ NOT IN {in_list(urls.ASHBY_PAGES)} THEN first_ END WHEN 'lever' THEN CASE WHEN first_ NOT IN {in_list(urls.OTHER_PAGES)} THEN first_ END
                    WHEN 'greenhouse' THEN CASE WHEN for_ IS NOT NULL THEN {clean("for_")} WHEN host IN {in_list(urls.GREENHOUSE_HOSTS)} AND len(parts) > 0 AND parts[1] NOT IN ('embed', 'job_app') AND first_ NOT IN {in_list(urls.OTHER_PAGES)} THEN first_ END
                    WHEN 'workday' THEN lower(split_part(host, '.', 1) || '.' || split_part(host, '.', 2) || '/' || site_) WHEN 'smartrecruiters' THEN first_ WHEN 'jobvite' THEN first_
                    ELSE CASE WHEN {clean("sub_")} NOT IN {in_list(urls.SUBDOMAIN_PAGES)} THEN {clean("sub_")} END END AS s_ FROM guess_),
    routed AS (SELECT {carry}, CASE WHEN s_ IS NOT NULL THEN a_ END AS ats, s_ AS slug,
                    CASE WHEN s_ IS NULL THEN NULL WHEN a_ IN ('ashby', 'lever') THEN {uuid} WHEN a_ = 'greenhouse' AND for_ IS NOT NULL THEN token_
                         WHEN a_ = 'greenhouse' AND len(parts) > 2 AND parts[2] = 'jobs' THEN parts[3] WHEN a_ = 'smartrecruiters' THEN parts[2] END AS external_id FROM slugs_)"""


#: The references that occur in the sample's pages and links, ampersands last.
REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#x27;": "'", "&#39;": "'", "&apos;": "'", "&#x2F;": "/", "&#47;": "/", "&nbsp;": "\xa0", "&sol;": "/", "&#46;": ".", "&period;": ".", "&#0045;": "-", "&#X6a;": "j", "&amp;": "&"}
ENTITIES = "body"
for _entity, _plain in REFERENCES.items():
    ENTITIES = f"replace({ENTITIES}, {quoted(_entity)}, {quoted(_plain)})"
EXTRACTED = f"""
    hits AS (SELECT page_id, unnest(m) AS link, unnest(range(len(m))) AS k FROM (SELECT page_id, regexp_extract_all({ENTITIES}, {quoted(urls.IN_TEXT)}, 0, 'i') AS m FROM texts)),
    {routed("hits", "link", "page_id, k")},
    firsts AS (SELECT page_id, ats, slug, min(k) AS k FROM routed WHERE slug IS NOT NULL GROUP BY ALL)"""


def name_base(name: str) -> str:
    return f"regexp_replace(lower(regexp_replace(trim(coalesce({name}, '')), '{names.LEGAL}', '')), '[^a-z0-9]+', '', 'g')"


def apex(site: str) -> str:
    raw = f"lower(trim({site}))"
    url = f"CASE WHEN contains({raw}, '://') THEN {raw} ELSE 'https://' || {raw} END"
    host = f"regexp_replace(regexp_replace(regexp_extract({url}, '^[^:/?#]+://([^/?#]*)', 1), ':\\d*$', ''), '^www\\.', '')"
    vendors = "|".join(v.replace(".", r"\.") for v in names.VENDORS)
    return f"CASE WHEN contains({host}, '.') AND NOT contains({host}, ' ') AND NOT regexp_matches({host}, '(^|\\.)({vendors})$') THEN {host} END"


STEM = f"regexp_replace(split_part(coalesce({apex('site')}, ''), '.', 1), '[^a-z0-9]+', '', 'g')"
STEMS = "[own" + "".join(f", CASE WHEN starts_with(own, '{v}') AND length(own) > {len(v) + 2} THEN substr(own, {len(v) + 1}) END" for v in names.VERBS) + "]"
GUESSED = "".join(f" || CASE WHEN length({{0}}) BETWEEN 3 AND 29 THEN [{{0}} || '.{e}'] ELSE [] END" for e in names.ENDINGS)

DECIDED = f"""
    open_ AS (SELECT ats, slug, count(*) AS n FROM jobs WHERE status = 'open' GROUP BY ALL),
    checked AS (SELECT f.*, coalesce(n, 0) AS open_before, fetched = 0 AND coalesce(n, 0) > {config.MASS_CLOSE_GUARD} AS suspicious FROM fetched f LEFT JOIN open_ USING (ats, slug)),
    trusted AS (SELECT ats, slug FROM checked WHERE NOT suspicious),
    now_ AS (SELECT * FROM staged SEMI JOIN trusted USING (ats, slug)),
    x AS (SELECT coalesce(j.ats, s.ats) AS ats, coalesce(j.slug, s.slug) AS slug, coalesce(j.external_id, s.external_id) AS external_id,
                 j.title AS j_title, s.title AS s_title, j.url AS j_url, s.url AS s_url, j.content_hash AS j_hash, s.content_hash AS s_hash, j.posted_at AS j_posted, s.posted_at AS s_posted, s.discovered_at,
                 j.first_seen_at AS j_first, j.last_seen_at AS j_last, j.closed_at AS j_closed, j.status AS j_status, j.missing_polls AS j_missing, j.role_family AS j_family, s.role_family AS s_family,
                 CASE WHEN j.ats IS NULL THEN 'new' WHEN s.ats IS NOT NULL AND j.status = 'closed' THEN 'reopened' WHEN s.ats IS NOT NULL AND j.content_hash IS DISTINCT FROM s.content_hash THEN 'edited'
                      WHEN s.ats IS NOT NULL THEN 'touched' WHEN j.status = 'open' AND t.ats IS NOT NULL THEN CASE WHEN j.missing_polls + 1 >= {config.GRACE} THEN 'closed' ELSE 'missing' END ELSE 'untouched' END AS action
          FROM jobs j FULL OUTER JOIN now_ s ON j.ats = s.ats AND j.slug = s.slug AND j.external_id = s.external_id
          LEFT JOIN trusted t ON t.ats = coalesce(j.ats, s.ats) AND t.slug = coalesce(j.slug, s.slug))"""
FRESH = "action IN ('new', 'reopened', 'edited')"
TREND = f"""
    aged AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY id DESC) AS age FROM runs WHERE finished_at IS NOT NULL AND skipped IS NULL),
    sums AS (SELECT source, count(*) AS runs, max(CASE WHEN age = 1 THEN new_boards END) AS latest, coalesce(median(CASE WHEN age > 1 THEN new_boards END), 0.0) AS median,
                    max(CASE WHEN age = 1 THEN refs_seen END) AS refs_latest, coalesce(median(CASE WHEN age > 1 THEN refs_seen END), 0.0) AS refs_median, max(CASE WHEN age = 1 THEN blocked END) AS blocked,
                    sum(CASE WHEN age <= 3 THEN new_boards END) AS recent FROM aged WHERE age <= {config.WINDOW} GROUP BY source),
    judged AS (SELECT *, (blocked > 0 AND refs_latest = 0) OR (runs >= 3 AND refs_median > 0 AND refs_latest < 0.2 * refs_median) AS collapsed FROM sums),
    trend AS (SELECT *, NOT collapsed AND runs >= 3 AND refs_latest > 0 AND refs_median > 0 AND refs_latest >= 0.2 * refs_median AND recent = 0 AS saturated,
                    CASE WHEN median <> 0 THEN latest / median ELSE 1.0 END AS ratio FROM judged)"""
PENDING = f"""
    pending AS (SELECT e.id, e.ats, e.slug, e.external_id, e.title, e.url, j.is_fde, j.seniority, j.region, j.location, b.company_name FROM feed e JOIN jobs j USING (ats, slug, external_id) LEFT JOIN boards b USING (ats, slug)
                WHERE e.id > 100 AND e.type IN ('new', 'reopened') AND (j.is_engineering = 1 OR j.is_fde = 1) AND j.seniority IN ('new_grad', 'intern') AND j.region IN ('us', 'remote')
                  AND NOT EXISTS (SELECT 1 FROM notified n WHERE n.ats = e.ats AND n.slug = e.slug AND n.external_id = e.external_id AND n.notified_at > {NOW - config.DEDUPE_SECONDS}))"""
LIVE = "(SELECT count(*) FROM boards b WHERE b.company_id = c.id AND b.status IN ('active', 'empty'))"
STALE = "classified_by IS NULL OR classified_by <> 'r4'"
RESOLVED = f"""
    named AS (SELECT *, {apex("domain")} AS d, {name_base("name")} AS nn FROM company_refs),
    rows_ AS (SELECT d, nn, arg_min(name, ord) FILTER (name <> '') AS name, arg_min(website, ord) FILTER (website <> '') AS website, arg_min(careers_url, ord) FILTER (careers_url <> '') AS careers_url, min(ord) AS ord
              FROM named WHERE d IS NOT NULL OR nn <> '' GROUP BY d, nn),
    best AS (SELECT norm_name, arg_min(id, (domain IS NULL, id)) AS id, arg_min(coalesce(domain, ''), (domain IS NULL, id)) AS domain FROM companies WHERE norm_name IS NOT NULL GROUP BY norm_name),
    resolved AS (SELECT d AS domain, nullif(nn, '') AS norm_name, r.name, coalesce(r.website, 'https://' || d) AS website, r.careers_url, r.ord,
                        coalesce(x.id, CASE WHEN nn <> '' AND NOT (d IS NOT NULL AND coalesce(b.domain, '') <> '' AND b.domain <> d) THEN b.id END) AS company_id
                 FROM rows_ r LEFT JOIN (SELECT domain, min(id) AS id FROM companies WHERE domain IS NOT NULL GROUP BY domain) x ON x.domain = r.d LEFT JOIN best b ON b.norm_name = r.nn)"""

CAREERS = """
    pages AS (SELECT domain AS found, path, CASE WHEN contains(html, 'lever.co') THEN regexp_extract(html, 'lever.co/(n\\d+)', 1) END AS slug FROM probes WHERE status = 200),
           asked AS (SELECT id, norm_name, domain IS NOT NULL AS sure, CASE WHEN domain IS NOT NULL THEN [domain] WHEN length(norm_name) BETWEEN 3 AND 29 THEN [norm_name || '.com', norm_name || '.io', norm_name || '.ai'] ELSE [] END AS ds FROM companies WHERE careers_checked_at IS NULL),
           hits AS (SELECT id, arg_min({'f': found, 'p': path, 's': slug}, (slug IS NULL, k)) AS h FROM (SELECT id, unnest(ds) AS found, unnest(range(len(ds))) AS k FROM asked) JOIN pages USING (found) GROUP BY id),
           judged AS (SELECT id, norm_name, sure, h.f AS found, h.p AS path, h.s AS slug, sure OR coalesce(h.s = norm_name, false) OR EXISTS (SELECT 1 FROM boards b WHERE b.company_id = id AND b.ats = 'lever' AND b.slug = h.s) AS ok FROM asked LEFT JOIN hits USING (id) WHERE len(ds) > 0)"""
#: Where a Workday posting's link has its place, for postings without one.
FROM_LINK = """CASE WHEN coalesce(location, '') = '' AND ats = 'workday' THEN coalesce(CASE WHEN length(trim(replace(regexp_extract(url, '/job/([^/]+)/', 1), '-', ' '))) >= 2
    AND NOT regexp_matches(trim(replace(regexp_extract(url, '/job/([^/]+)/', 1), '-', ' ')), '^\\d+$') THEN trim(replace(regexp_extract(url, '/job/([^/]+)/', 1), '-', ' ')) END, location) ELSE location END"""

SQL: dict[str, str] = {
    "listing_top": with_views(
        f"SELECT {PAGE}, posted_at FROM {JOINED} WHERE j.status = 'open' AND region IN ('us', 'remote', 'unknown') AND title ILIKE '%engineer%' ORDER BY posted_at DESC NULLS LAST, content_hash NULLS FIRST, ats, slug, external_id LIMIT 51",
        "jobs", "boards", "companies",
    ),
    "listing_by_company": with_views(
        f"SELECT {PAGE} FROM {JOINED} WHERE j.status = 'open' AND (c.name ILIKE '%c1%' OR slug ILIKE '%c1%') ORDER BY company ASC NULLS LAST, content_hash NULLS FIRST, ats, slug, external_id LIMIT 21 OFFSET 20",
        "jobs", "boards", "companies",
    ),
    "listing_count": with_views("SELECT count(*) AS n FROM jobs WHERE status = 'open' AND seniority = 'intern' AND region IN ('us', 'europe')", "jobs"),
    "jobs_page": with_views(
        f"SELECT {PAGE} FROM {JOINED} WHERE j.status = 'open' AND is_engineering = 1 AND j.first_seen_at >= {NOW - 20 * 86_400} AND title ILIKE '%data%' ORDER BY j.first_seen_at DESC, ats, slug, external_id LIMIT 100 OFFSET 10",
        "jobs", "boards", "companies",
    ),
    "company_rollup": with_views(f"SELECT id, name, domain, {LIVE} AS monitored FROM companies c WHERE careers_url IS NOT NULL AND (name ILIKE '%supplier%' OR domain ILIKE '%supplier%')", "companies", "boards"),
    "company_unmonitored": with_views(f"SELECT id, name, {LIVE} AS monitored FROM companies c WHERE {LIVE} = 0", "companies", "boards"),
    "company_jobs": with_views("SELECT ats, slug, external_id, title, j.status FROM jobs j JOIN boards b USING (ats, slug) WHERE company_id = 7 ORDER BY j.first_seen_at DESC, ats, slug, external_id LIMIT 500", "jobs", "boards"),
    "event_feed": with_views(
        f"SELECT id, ts, ats, slug, external_id, title FROM feed e WHERE type = 'new' AND ts >= {NOW - 980_000} AND EXISTS (SELECT 1 FROM jobs j WHERE j.ats = e.ats AND j.slug = e.slug AND j.external_id = e.external_id AND is_engineering = 1) ORDER BY ts DESC, id DESC LIMIT 200",
        "feed", "jobs",
    ),
    "pipeline_counts": with_views(
        f"""SELECT 'companies' AS name, count(*) AS n FROM companies UNION ALL SELECT 'with_careers', count(careers_url) FROM companies UNION ALL SELECT 'boards', count(*) FROM boards
            UNION ALL SELECT 'active_boards', count(*) FROM boards WHERE status = 'active' UNION ALL SELECT 'open_jobs', count(*) FROM jobs WHERE status = 'open'
            UNION ALL SELECT 'events', count(*) FROM feed UNION ALL SELECT 'unclassified', count(*) FROM jobs WHERE {STALE}""",
        "companies", "boards", "jobs", "feed",
    ),
    "boards_by_status": with_views("SELECT ats, status, count(*) AS n FROM boards GROUP BY ALL", "boards"),
    "source_attribution": with_views("SELECT source, count(*) AS n, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'dead') AS dead FROM board_sources JOIN boards USING (ats, slug) GROUP BY source", "board_sources", "boards"),
    "company_stats": with_views(
        f"SELECT count(*) AS total, count(domain) AS with_domain, count(careers_url) AS with_careers, count(*) FILTER (careers_kind = 'ats') AS on_ats, count(*) FILTER (careers_kind = 'html') AS on_html, count(*) FILTER (n > 0) AS monitored, count(*) FILTER (n = 0 AND careers_url IS NOT NULL) AS unmonitored FROM (SELECT *, {LIVE} AS n FROM companies c)",
        "companies", "boards",
    ),
    "family_share": with_views("SELECT coalesce(role_family, 'none') AS family, count(*) AS n, count(*) FILTER (status = 'open') AS open_now, round(count(*) * 100.0 / (SELECT count(*) FROM jobs), 2) AS share FROM jobs GROUP BY 1", "jobs"),
    "jobs_by_status": with_views("SELECT status, count(*) AS n, count(DISTINCT ats || '/' || slug) AS boards FROM jobs GROUP BY status", "jobs"),
    "coverage": with_views("SELECT count(*) AS total, count(location) AS has_location, count(posted_at) AS has_posted_at, count(region) AS has_region, count(seniority) AS has_seniority, count(url) AS has_url FROM jobs", "jobs"),
    "events_by_type": with_views("SELECT type, count(*) AS n FROM feed GROUP BY type", "feed"),
    "needing_careers": with_views("SELECT id, (SELECT count(*) FROM boards b WHERE b.company_id = c.id) AS n_boards FROM companies c WHERE careers_checked_at IS NULL", "companies", "boards"),
    "family_labels": with_views(f"SELECT title, {role_family('title')} AS family, count(*) AS n FROM jobs GROUP BY ALL", "jobs"),
    "seniority_labels": with_views(f"SELECT title, {seniority('title')} AS level, count(*) AS n FROM jobs GROUP BY ALL", "jobs"),
    "region_labels": with_views(f"SELECT location, {region('location')} AS place, count(*) AS n FROM jobs GROUP BY ALL", "jobs"),
    "ingest_filter": with_views(
        f"SELECT ats, slug, external_id, role_family, region, posted_at FROM jobs WHERE coalesce(nullif(posted_at, 0), nullif(CASE WHEN posted_at IS NULL THEN first_seen_at END, 0), {NOW}) >= {NOW - 20 * 86_400} AND region IN {in_list(list(config.KEPT_REGIONS))} AND role_family IN {in_list(list(config.KEPT_FAMILIES))}",
        "jobs",
    ),
    "url_router": with_views(f"WITH {routed('texts', 'link', 'page_id')} SELECT page_id, ats, slug, external_id FROM routed", "texts"),
    "url_extract": with_views(f"WITH {EXTRACTED} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS pos, ats, slug FROM firsts", "texts"),
    "name_base": with_views(f"SELECT page_id, {name_base('name')} AS base FROM texts", "texts"),
    "apex_domain": with_views(f"SELECT page_id, {apex('site')} AS domain FROM texts", "texts"),
    "same_company": with_views(
        f"WITH stems AS (SELECT page_id, {name_base('name')} AS other, {STEM} AS own FROM texts) SELECT page_id, own <> '' AND other <> '' AND len(list_filter({STEMS}, lambda s: s IS NOT NULL AND (contains(other, s) OR contains(s, other)))) > 0 AS same FROM stems",
        "texts",
    ),
    "domain_guesses": with_views(
        f"""WITH stems AS (SELECT page_id, {apex('site')} AS known, regexp_replace(lower(coalesce(name, '')), '[^a-z0-9]+', '', 'g') AS a, 'acmeslug' AS b FROM texts),
            all_ AS (SELECT page_id, CASE WHEN known IS NULL THEN [] ELSE [known] END {GUESSED.format('a')} || CASE WHEN a = b THEN [] ELSE [b || '.com', b || '.io', b || '.ai'] END AS g FROM stems)
            SELECT page_id, array_to_string(list_filter(g, lambda x, i: list_position(g, x) = i), ',') AS guesses FROM all_""",
        "texts",
    ),
    "relative_dates": with_views(
        f"""WITH t AS (SELECT page_id, lower(trim(posted)) AS p FROM texts),
            d AS (SELECT page_id, CASE WHEN regexp_matches(p, 'posted\\s+today$') THEN 0 WHEN regexp_matches(p, 'posted\\s+yesterday$') THEN 1 ELSE TRY_CAST(regexp_extract(p, 'posted\\s+(\\d+)\\s+days?\\s+ago$', 1) AS BIGINT) END AS n,
                         TRY_CAST(regexp_extract(p, 'posted\\s+(\\d+)\\+\\s+days?\\s+ago$', 1) AS BIGINT) AS m FROM t)
            SELECT page_id, CAST({NOW} - n * 86400 AS BIGINT) AS posted_at, CAST({NOW} - coalesce(n, m) * 86400 AS BIGINT) AS bound FROM d""",
        "texts",
    ),
    "path_location": with_views("WITH t AS (SELECT page_id, trim(replace(regexp_extract(path, '/job/([^/]+)/', 1), '-', ' ')) AS p FROM texts) SELECT page_id, CASE WHEN length(p) >= 2 AND NOT regexp_matches(p, '^\\d+$') THEN p END AS place FROM t", "texts"),
    "day_floor": with_views("SELECT first_seen_at // 86400 * 86400 AS day, count(*) AS n FROM jobs GROUP BY ALL", "jobs"),
    "content_hash": with_views(
        "SELECT ats, slug, external_id, substr(sha256(concat_ws(chr(1), coalesce('=' || title, '-'), coalesce('=' || location, '-'), '-', '-', '-', '-', '-', '-', coalesce('=' || url, '-'), '-')), 1, 16) AS hash FROM jobs", "jobs"
    ),
    "diff_actions": with_views(f"WITH {DECIDED} SELECT ats, action, count(*) AS n FROM x GROUP BY ALL", "jobs", "fetched", "staged"),
    "diff_next_state": with_views(
        f"""WITH {DECIDED} SELECT ats, slug, external_id, CASE WHEN {FRESH} THEN s_title ELSE j_title END AS title, CASE WHEN {FRESH} THEN s_hash ELSE j_hash END AS content_hash,
            CASE action WHEN 'new' THEN coalesce(s_posted, discovered_at) WHEN 'reopened' THEN coalesce(s_posted, j_posted) WHEN 'edited' THEN coalesce(s_posted, j_posted) WHEN 'touched' THEN coalesce(j_posted, s_posted) ELSE j_posted END AS posted_at,
            coalesce(j_first, {NOW}) AS first_seen_at, CASE WHEN {FRESH} OR action = 'touched' THEN {NOW} ELSE j_last END AS last_seen_at,
            CASE action WHEN 'closed' THEN {NOW} WHEN 'reopened' THEN NULL ELSE j_closed END AS closed_at, CASE WHEN {FRESH} OR action = 'touched' THEN 'open' WHEN action = 'closed' THEN 'closed' ELSE j_status END AS status,
            CASE WHEN {FRESH} OR action = 'touched' THEN 0 WHEN action IN ('closed', 'missing') THEN j_missing + 1 ELSE j_missing END AS missing_polls, CASE WHEN {FRESH} THEN s_family ELSE j_family END AS role_family FROM x""",
        "jobs", "fetched", "staged",
    ),
    "diff_events": with_views(
        f"""WITH {DECIDED} SELECT 1000 + row_number() OVER (ORDER BY ats, slug, CASE action WHEN 'new' THEN 0 WHEN 'reopened' THEN 1 WHEN 'edited' THEN 2 ELSE 3 END, external_id) AS id, action AS type, ats, slug, external_id,
            CASE WHEN action = 'closed' THEN j_title ELSE coalesce(s_title, j_title) END AS title, CASE WHEN action = 'closed' THEN j_url ELSE coalesce(s_url, j_url) END AS url FROM x WHERE action IN ('new', 'reopened', 'edited', 'closed')""",
        "jobs", "fetched", "staged",
    ),
    "board_results": with_views(
        f"WITH {DECIDED} SELECT ats, slug, " + ", ".join(f"count(*) FILTER (action = '{k}') AS \"{k}\"" for k in ("new", "reopened", "edited", "closed", "touched", "missing")) + f" FROM x GROUP BY ats, slug HAVING count(*) FILTER ({FRESH} OR action = 'closed') > 0",
        "jobs", "fetched", "staged",
    ),
    "guard": with_views(f"WITH {DECIDED} SELECT ats, slug, open_before, suspicious FROM checked", "jobs", "fetched", "staged"),
    "seed_new": with_views("SELECT ats, slug, external_id, title FROM staged s ANTI JOIN jobs USING (ats, slug, external_id)", "jobs", "staged"),
    "reclassify": with_views(
        f"""WITH n AS (SELECT *, {STALE} AS stale, {role_family('title')} AS f, {seniority('title')} AS s FROM jobs)
            SELECT CASE WHEN stale THEN f ELSE role_family END AS role_family, CASE WHEN stale THEN CAST(f IN {in_list(list(R.TECHNICAL))} AS INT) ELSE is_engineering END AS is_engineering,
                   CASE WHEN stale THEN CAST(f = 'fde' AS INT) ELSE is_fde END AS is_fde, CASE WHEN stale THEN s ELSE seniority END AS seniority, 'r4' AS classified_by, count(*) AS n FROM n GROUP BY ALL""",
        "jobs",
    ),
    "reregion": with_views(f"WITH l AS (SELECT region AS before, {FROM_LINK} AS place FROM jobs) SELECT before, {region('place')} AS after, count(*) AS n FROM l GROUP BY ALL", "jobs"),
    "reregion_next": with_views(f"WITH l AS (SELECT {FROM_LINK} AS location FROM jobs) SELECT location, {region('location')} AS region, count(*) AS n FROM l GROUP BY ALL", "jobs"),
    "event_feed_named": with_views(
        f"""SELECT id, ts, type, coalesce(company_name, slug, '-') AS company, CASE WHEN detail_json LIKE '%Oslo%' THEN 'Oslo' ELSE '' END AS location, title FROM feed LEFT JOIN boards USING (ats, slug)
            WHERE ts >= {NOW - 990_000} ORDER BY ts DESC, id DESC LIMIT 300""",
        "feed", "boards",
    ),
    "unclassified_titles": with_views("SELECT title FROM (SELECT DISTINCT title FROM jobs WHERE role_family = 'other' AND title IS NOT NULL) ORDER BY md5('7:' || title), title LIMIT 20", "jobs"),
    "sweep_counts": with_views(
        f"""WITH rows__ AS (SELECT f.*, rank, rank * 1099511627776 + ord AS o FROM finds f JOIN sources USING (source) WHERE skipped IS NULL),
            company_refs AS (SELECT company_name AS name, domain, website, careers_url, o AS ord FROM rows__ WHERE company_name IS NOT NULL OR domain IS NOT NULL OR website IS NOT NULL), {RESOLVED},
            nb AS (SELECT rank, count(*) AS n FROM (SELECT ats, slug, min(rank) AS rank FROM rows__ WHERE slug IS NOT NULL GROUP BY ats, slug) ANTI JOIN boards USING (ats, slug) GROUP BY rank),
            ns AS (SELECT rank, count(*) AS n FROM (SELECT ats, slug, external_id, min(rank) AS rank FROM rows__ WHERE external_id IS NOT NULL GROUP BY ALL) ANTI JOIN jobs USING (ats, slug, external_id) GROUP BY rank),
            nc AS (SELECT CAST(ord // 1099511627776 AS INT) AS rank, count(*) AS n FROM resolved WHERE company_id IS NULL GROUP BY 1), nr AS (SELECT rank, count(*) AS n FROM rows__ GROUP BY rank)
            SELECT 40 + row_number() OVER (ORDER BY s.rank) AS id, source, CAST({NOW - 60} AS BIGINT) AS started_at, CAST({NOW} AS BIGINT) AS finished_at, coalesce(nr.n, 0) AS refs_seen, coalesce(nb.n, 0) AS new_boards, coalesce(nc.n, 0) AS new_companies,
                   coalesce(ns.n, 0) AS seed_postings, blocked, error, skipped FROM sources s LEFT JOIN nr ON nr.rank = s.rank LEFT JOIN nb ON nb.rank = s.rank LEFT JOIN ns ON ns.rank = s.rank LEFT JOIN nc ON nc.rank = s.rank""",
        "finds", "sources", "boards", "companies", "jobs",
    ),
    "sweep_dry": with_views(
        """WITH f AS (SELECT * FROM finds JOIN sources USING (source) WHERE skipped IS NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY ord) <= 100)
           SELECT source, count(slug) AS refs, count(DISTINCT ats || '/' || slug) AS unique_refs, count(*) FILTER (f.source IS NOT NULL AND slug IS NULL) AS companies, count(external_id) AS postings, any_value(s.error) AS error, any_value(s.skipped) AS skipped
           FROM sources s LEFT JOIN f USING (source) GROUP BY source""",
        "finds", "sources",
    ),
    "validate_sweep": with_views(
        """SELECT ats, count(*) AS checked, count(*) FILTER (fetch_status = 'ok' AND p.job_count > 0) AS active, count(*) FILTER (fetch_status = 'ok' AND p.job_count = 0) AS "empty", count(*) FILTER (fetch_status = 'permanent') AS dead,
                  count(*) FILTER (fetch_status = 'transient') AS errored, CAST(coalesce(sum(p.job_count) FILTER (fetch_status = 'ok'), 0) AS BIGINT) AS jobs FROM polls p JOIN boards b USING (ats, slug) WHERE status = 'unvalidated' GROUP BY ats""",
        "boards", "polls",
    ),
    "validate_next": with_views(
        """SELECT ats, slug, CASE WHEN status = 'dead' AND fetch_status = 'ok' THEN CASE WHEN p.job_count > 0 THEN 'active' ELSE 'empty' END ELSE status END AS status,
                  CASE WHEN status <> 'dead' OR fetch_status IS NULL THEN consecutive_failures WHEN fetch_status = 'ok' THEN 0 ELSE consecutive_failures + 1 END AS consecutive_failures FROM boards LEFT JOIN polls p USING (ats, slug)""",
        "boards", "polls",
    ),
    "poll_run": with_views(
        f"""WITH {DECIDED} SELECT CAST(7 AS BIGINT) AS id, CAST({NOW - 60} AS BIGINT) AS started_at, CAST({NOW} AS BIGINT) AS finished_at, CAST((SELECT count(*) FROM polls) AS INT) AS boards_polled, CAST((SELECT count(*) FROM polls WHERE fetch_status <> 'ok') AS INT) AS boards_failed,
            CAST(count(*) FILTER (action = 'new') AS INT) AS new_jobs, CAST(count(*) FILTER (action = 'edited') AS INT) AS edited_jobs, CAST(count(*) FILTER (action = 'closed') AS INT) AS closed_jobs FROM x""",
        "jobs", "fetched", "staged", "polls",
    ),
    "proposals_by_status": with_views("SELECT status, count(*) AS n FROM proposals GROUP BY status", "proposals"),
    "proposals_page": with_views("SELECT id, agent FROM proposals WHERE status = 'pending' ORDER BY id DESC LIMIT 40", "proposals"),
    "last_polls": with_views("SELECT * FROM poll_runs ORDER BY id DESC LIMIT 7", "poll_runs"),
    "careers_due": with_views(
        f"""WITH r AS (SELECT *, CASE WHEN tier > 1 THEN {NOW} - job_count * 86400 END AS seen FROM boards) SELECT ats, slug, CAST(seen AS BIGINT) AS careers_checked_at FROM r
            WHERE careers_url IS NOT NULL AND (seen IS NULL OR seen < {NOW - 7 * 86_400}) ORDER BY seen NULLS FIRST, ats, slug LIMIT 60""",
        "boards",
    ),
    "link_boards": with_views("SELECT ats, slug, coalesce(company_id, CASE WHEN tier = 2 THEN job_count + 3 END) AS company_id FROM boards", "boards"),
    "set_careers": with_views(
        f"""WITH {CAREERS} SELECT c.id, CASE WHEN ok AND found IS NOT NULL THEN 'https://' || found || path ELSE careers_url END AS careers_url,
            CASE WHEN j.id IS NULL THEN careers_kind WHEN NOT ok OR found IS NULL THEN 'none' WHEN slug IS NULL THEN 'html' ELSE 'ats' END AS careers_kind, CASE WHEN j.id IS NULL THEN careers_checked_at ELSE {NOW} END AS careers_checked_at
            FROM companies c LEFT JOIN judged j ON j.id = c.id""",
        "companies", "boards", "probes",
    ),
    "adopted_boards": with_views(f"SELECT ats, slug, CASE WHEN c.id IS NULL AND company_name IS NOT NULL THEN {name_base('company_name')} ELSE c.norm_name END AS norm_name FROM boards b LEFT JOIN companies c ON c.id = b.company_id", "companies", "boards"),
    "crawl_refs": "SELECT DISTINCT 'lever' AS ats, 'x' || page_id % 70 AS slug FROM pages WHERE page_id % 6 > 1",
    "archive_refs": "SELECT DISTINCT 'ashby' AS ats, 'y' || page_id % 50 AS slug FROM pages WHERE page_id % 4 <> 0",
    "listed_refs": "SELECT 'lever' AS ats, 'z' || page_id % 30 AS slug, '0a1b2c3d-1111-2222-3333-44445555' || 1000 + page_id % 9000 AS external_id, 'Z' AS company_name, 'Dev' AS title, page_id % 2 = 0 AS seed FROM pages",
    "filed_companies": "SELECT 'Orbit ' || page_id % 40 || ' Robotics Inc' AS company, CAST(100000 + page_id % 40 AS VARCHAR) AS cik, min('2026080' || 1 + page_id % 9) AS filed FROM pages WHERE page_id % 4 = 0 GROUP BY ALL",
    "forum_refs": """SELECT page_id AS "objectID", 'ashby' AS ats, 'k' || page_id % 20 || '-x' AS slug FROM pages UNION ALL SELECT page_id, 'lever', 'w' || page_id % 25 FROM pages WHERE page_id % 4 = 0""",
    "ages": """WITH g AS (SELECT page_id, page_id * page_id * 40 AS s FROM pages) SELECT page_id, CASE WHEN s < 3600 THEN s // 60 || 'm' WHEN s < 86400 THEN s // 3600 || 'h' WHEN s < 2592000 THEN s // 86400 || 'd' ELSE s // 2592000 || 'mo' END AS age FROM g""",
    "adoption_queue": with_views("SELECT ats, slug, job_count FROM boards WHERE company_id IS NULL AND (company_name IS NOT NULL OR website IS NOT NULL) ORDER BY job_count DESC NULLS LAST, ats, slug LIMIT 50", "boards"),
    "backfill_queue": with_views("SELECT ats, slug, job_count FROM boards WHERE careers_url IS NULL AND status IN ('active', 'empty') ORDER BY job_count DESC NULLS LAST, ats, slug LIMIT 50", "boards"),
    "scan_refs": "SELECT 'lever' AS ats, 'u' || page_id % 40 AS slug, CAST(min(page_id % 5) AS INT) AS detail FROM pages GROUP BY ALL",
    "code_refs": "SELECT CASE WHEN page_id % 3 = 0 THEN 'ashby' ELSE 'lever' END AS ats, CASE WHEN page_id % 3 = 0 THEN 'g' || page_id % 40 ELSE 'f' || page_id % 30 END AS slug, arg_min('r' || page_id, (page_id % 5) * 1000000000 + page_id) AS detail FROM pages GROUP BY ALL",
    "portfolio_refs": "SELECT 'ashby' AS ats, 'k' || page_id % 20 || '-x' AS slug, arg_min('firm' || page_id % 5 || ':' || page_id, (page_id % 5) * 1000000000 + page_id) AS detail FROM pages GROUP BY ALL",
    "customer_refs": """WITH r AS (SELECT unnest(['k3-x', 'one', 'two']) AS slug, 0 AS o UNION ALL SELECT 'k' || page_id % 12 || '-x', 1 FROM pages UNION ALL SELECT 'k' || page_id % 20 || '-x', 2 FROM pages)
        SELECT 'ashby' AS ats, slug, ['published_list', 'page', 'page_link'][min(o) + 1] AS detail FROM r GROUP BY slug""",
    "search_refs": with_views(
        """WITH once AS (SELECT result AS url, min(CAST(host AS BIGINT) * 1000000000 + page_id) AS o, min(listing) AS text FROM answers GROUP BY result),
           r AS (SELECT 'lever' AS ats, regexp_extract(url, 'w\\d+$') AS slug, o, 'result_url' AS d FROM once WHERE url LIKE '%lever%' UNION ALL SELECT 'ashby', regexp_extract(text, 'ashbyhq.com/(k\\d+-x)', 1), o, url FROM once WHERE url NOT LIKE '%lever%')
           SELECT ats, slug, arg_min(d, o) AS detail FROM r GROUP BY ALL""",
        "answers",
    ),
    "posting_refs": """WITH n AS (SELECT page_id % 300 AS j, (page_id % 5) * 1000000000 + page_id AS o FROM pages ORDER BY o LIMIT 150), f AS (SELECT j, min(o) AS o FROM n GROUP BY j)
        SELECT 'ashby' AS ats, 'k' || j % 20 || '-x' AS slug, arg_min(CAST(10000000 + j AS VARCHAR), o) AS detail FROM f JOIN pages ON page_id = j GROUP BY ALL""",
    "story_refs": "SELECT 'lever' AS ats, 'w' || page_id % 25 AS slug, arg_min('https://jobs.lever.co/w' || page_id % 25, page_id) AS detail FROM pages WHERE page_id % 4 = 0 GROUP BY ALL",
    "thread_refs": """WITH t AS (SELECT page_id AS s FROM pages WHERE page_id % 2 = 0 ORDER BY s DESC LIMIT 60)
        SELECT 'ashby' AS ats, 'k' || page_id % 20 || '-x' AS slug, CAST(max(s) AS VARCHAR) AS detail FROM pages JOIN t ON s = page_id % 200 GROUP BY ALL""",
    "board_upsert": with_views(
        f"""WITH found AS (SELECT ats, slug, arg_min(company_name, ord) AS company_name, arg_min(website, ord) AS website FROM refs GROUP BY ALL)
            SELECT ats, slug, coalesce(b.company_name, f.company_name) AS company_name, coalesce(b.website, f.website) AS website, coalesce(status, 'unvalidated') AS status, coalesce(tier, 1) AS tier,
                   coalesce(consecutive_failures, 0) AS consecutive_failures, coalesce(first_seen_at, {NOW}) AS first_seen_at FROM boards b FULL OUTER JOIN found f USING (ats, slug)""",
        "boards", "refs",
    ),
    "board_upsert_counts": with_views(
        "SELECT (SELECT count(*) FROM refs) AS seen, (SELECT count(*) FROM (SELECT DISTINCT ats, slug FROM refs) ANTI JOIN boards USING (ats, slug)) AS new_boards, (SELECT count(*) FROM (SELECT DISTINCT ats, slug, source FROM refs) ANTI JOIN board_sources USING (ats, slug, source)) AS new_links",
        "boards", "board_sources", "refs",
    ),
    "company_resolve": with_views(f"WITH {RESOLVED} SELECT domain, norm_name, name, website, careers_url, company_id FROM resolved", "companies", "company_refs"),
    "company_upsert": with_views(
        f"""WITH {RESOLVED},
            fill AS (SELECT company_id AS id, arg_min(domain, ord) AS domain, arg_min(norm_name, ord) AS norm_name, arg_min(name, ord) AS name, arg_min(careers_url, ord) AS careers_url FROM resolved WHERE company_id IS NOT NULL GROUP BY ALL)
            SELECT id, coalesce(c.domain, f.domain) AS domain, coalesce(c.norm_name, f.norm_name) AS norm_name, coalesce(c.name, f.name) AS name, coalesce(c.careers_url, f.careers_url) AS careers_url, source FROM companies c LEFT JOIN fill f USING (id)
            UNION ALL SELECT (SELECT max(id) FROM companies) + row_number() OVER (ORDER BY ord), domain, norm_name, name, careers_url, 'list' FROM resolved WHERE company_id IS NULL""",
        "companies", "company_refs",
    ),
    "company_merge": with_views(
        f"""WITH {CAREERS}, pairs AS (SELECT j.id AS s, c.id AS t FROM judged j JOIN companies c ON c.domain = found WHERE ok AND NOT sure AND c.id <> j.id),
           moved AS (SELECT coalesce(t, company_id) AS id, count(*) AS n FROM boards LEFT JOIN pairs ON company_id = s GROUP BY ALL),
           o AS (SELECT t AS id, arg_min(domain, s) FILTER (domain IS NOT NULL) AS domain, arg_min(careers_url, s) FILTER (careers_url IS NOT NULL) AS careers_url, arg_min(careers_kind, s) FILTER (careers_kind IS NOT NULL) AS careers_kind
                 FROM pairs JOIN companies ON companies.id = s GROUP BY t)
           SELECT c.id, coalesce(c.domain, o.domain) AS domain, coalesce(c.careers_url, o.careers_url) AS careers_url, coalesce(c.careers_kind, o.careers_kind) AS careers_kind, coalesce(n, 0) AS n_boards
           FROM companies c LEFT JOIN o ON o.id = c.id LEFT JOIN moved m ON m.id = c.id WHERE c.id NOT IN (SELECT s FROM pairs)""",
        "companies", "boards", "probes",
    ),
    "due_queue": with_views(f"SELECT ats, slug, next_poll_at, tier FROM boards WHERE status IN ('active', 'empty') AND (next_poll_at IS NULL OR next_poll_at <= {NOW}) ORDER BY next_poll_at NULLS FIRST, ats, slug LIMIT 100", "boards"),
    "poll_outcome": with_views(
        f"""WITH r AS (SELECT b.*, p.fetch_status AS s, p.job_count AS n, p.had_new, p.error, p.fetch_status = 'permanent' OR b.consecutive_failures + 1 >= 8 AS dead FROM boards b LEFT JOIN polls p USING (ats, slug))
            SELECT ats, slug, CASE WHEN s = 'ok' THEN CASE WHEN n > 0 THEN 'active' ELSE 'empty' END WHEN s IS NOT NULL AND dead THEN 'dead' ELSE status END AS status, CASE WHEN s = 'ok' THEN n ELSE job_count END AS job_count,
                   CASE WHEN s = 'ok' THEN {NOW} + CASE tier WHEN 1 THEN 3600 WHEN 2 THEN 21600 ELSE 86400 END WHEN s IS NOT NULL AND dead THEN NULL WHEN s IS NOT NULL THEN {NOW} + least(900 * 2 ** least(consecutive_failures, 7), 86400)::BIGINT ELSE next_poll_at END AS next_poll_at,
                   CASE WHEN s = 'ok' THEN {NOW} ELSE last_ok_at END AS last_ok_at, CASE WHEN s = 'ok' AND had_new THEN {NOW} ELSE last_new_at END AS last_new_at,
                   CASE WHEN s = 'ok' THEN 0 WHEN s IS NOT NULL THEN consecutive_failures + 1 ELSE consecutive_failures END AS consecutive_failures, CASE WHEN s = 'ok' THEN NULL WHEN s IS NOT NULL THEN left(error, 500) ELSE last_error END AS last_error FROM r""",
        "boards", "polls",
    ),
    "retier": with_views(f"SELECT ats, slug, CASE WHEN status = 'active' AND coalesce(last_new_at, first_seen_at) < {NOW - 14 * 86_400} THEN least(tier + 1, 3) ELSE tier END AS tier FROM boards", "boards"),
    "digest_pending": with_views(f"WITH {PENDING} SELECT id, ats, slug, external_id, seniority, region, company_name FROM pending", "feed", "jobs", "boards", "notified"),
    "digest_span": with_views(f"WITH {PENDING} SELECT CAST(100 AS BIGINT) AS from_id, coalesce(max(id), (SELECT max(id) FROM feed)) AS to_id, count(*) AS pending, count(*) > 600 AS flooded FROM pending", "feed", "jobs", "boards", "notified"),
    "digest_lines": with_views(
        f"""WITH {PENDING},
            g AS (SELECT *, CASE seniority WHEN 'new_grad' THEN 'New Grad' ELSE 'Internship' END AS grp, CASE seniority WHEN 'new_grad' THEN 0 ELSE 1 END AS r FROM pending),
            h AS (SELECT length('**' || (SELECT count(*) FROM g) || ' new** — ' || string_agg(n || ' ' || lower(grp), ' · ' ORDER BY r) || '  ·  US & remote') AS head FROM (SELECT grp, r, count(*) AS n FROM g GROUP BY ALL)),
            p AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY id DESC) AS place,
                         '[' || left(title, 80) || '](' || url || ')  ·  ' || array_to_string(list_filter([left(coalesce(company_name, slug), 40), CASE WHEN is_fde = 1 THEN 'FDE' END, left(location, 34)], lambda x: x IS NOT NULL AND x <> ''), ' · ') AS line FROM g),
            w AS (SELECT grp, place, id, line, CAST((SELECT head FROM h) + sum(length(line) + 1) OVER (ORDER BY place, r ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM p WHERE place <= 25)
            SELECT * FROM w WHERE used <= 2500""",
        "feed", "jobs", "boards", "notified",
    ),
    "notified_next": with_views(
        f"WITH {PENDING} SELECT ats, slug, external_id, max(notified_at) AS notified_at FROM (SELECT * FROM notified UNION ALL SELECT ats, slug, external_id, {NOW} FROM pending) GROUP BY ALL HAVING max(notified_at) >= {NOW - config.DEDUPE_SECONDS}",
        "feed", "jobs", "boards", "notified",
    ),
    "source_trend": with_views(
        f"""WITH {TREND} SELECT source, runs, latest, median, refs_latest, refs_median, blocked, collapsed, saturated,
            CASE WHEN collapsed THEN '!' WHEN saturated THEN '=' WHEN runs < 3 THEN '-' WHEN ratio >= 1.5 THEN '^' WHEN ratio <= 0.5 THEN 'v' ELSE '=' END AS arrow FROM trend""",
        "runs",
    ),
    "collapsed_sources": with_views(f"WITH {TREND} SELECT source, refs_latest, refs_median FROM trend WHERE collapsed", "runs"),
    "policy_snapshot": with_views(
        f"""WITH {TREND} SELECT (SELECT count(*) FROM boards WHERE status = 'unvalidated') AS unvalidated, (SELECT count(*) FROM boards WHERE status = 'active') AS active_boards, (SELECT count(*) FROM jobs WHERE {STALE}) AS stale_classification,
            (SELECT count(*) FROM jobs WHERE status = 'open') AS open_jobs, (SELECT count(*) FROM companies WHERE careers_checked_at IS NULL) AS unresolved_companies, (SELECT ({NOW} - max(started_at)) / 3600.0 FROM runs) AS hours_since_discover,
            (SELECT CAST(sum(new_boards) AS BIGINT) FROM runs WHERE started_at >= {NOW - 7 * 86_400}) AS marginal_yield_7d, (SELECT count(*) FROM trend WHERE collapsed) AS collapsed""",
        "companies", "boards", "jobs", "runs",
    ),
    "gate_yield": with_views(
        """WITH d AS (SELECT DISTINCT source AS proposal, ats, slug FROM refs), n AS (SELECT proposal, count(*) AS boards_found, count(*) FILTER (NOT EXISTS (SELECT 1 FROM boards b WHERE b.ats = d.ats AND b.slug = d.slug)) AS boards_new FROM d GROUP BY proposal)
           SELECT *, CASE WHEN boards_new >= 25 THEN 'auto_applied' WHEN boards_new >= 1 THEN 'pending' ELSE 'rejected' END AS verdict FROM n""",
        "refs", "boards",
    ),
    "gate_source_pages": with_views(
        f"""WITH {EXTRACTED}, n AS (SELECT page_id AS proposal, count(*) AS boards_found, count(*) FILTER (NOT EXISTS (SELECT 1 FROM boards b WHERE b.ats = f.ats AND b.slug = f.slug)) AS boards_new FROM firsts f GROUP BY page_id)
            SELECT page_id AS proposal, coalesce(boards_found, 0) AS boards_found, coalesce(boards_new, 0) AS boards_new, CASE WHEN boards_new >= 25 THEN 'auto_applied' WHEN boards_new >= 1 THEN 'pending' ELSE 'rejected' END AS verdict FROM texts LEFT JOIN n ON proposal = page_id""",
        "texts", "boards",
    ),
    "gate_precision": with_views(
        f"""WITH r AS (SELECT DISTINCT title, role_family FROM jobs WHERE title IS NOT NULL AND role_family IS NOT NULL), h AS (SELECT *, role_family IN ('other', 'engineering') OR {role_family('title')} = 'engineering' AS good FROM r WHERE {matches('title', chr(92) + 'b(developer|engineer)' + chr(92) + 'b')})
            SELECT count(*) AS hits, count(*) FILTER (good) AS agree, round(count(*) FILTER (good) / count(*), 3) AS precision, CASE WHEN count(*) = 0 THEN 'rejected' WHEN count(*) FILTER (good) / count(*) >= 0.9 THEN 'auto_applied' ELSE 'pending' END AS verdict FROM h""",
        "jobs",
    ),
}


def _postings(k: str = "c_custkey") -> str:
    """What the sample payloads hold, by platform, from the board's number alone."""
    row = lambda i, ats, slug, eid, title, url, place, n, posted, bound="NULL": (
        f"SELECT '{ats}' AS ats, {slug} AS slug, {eid} AS external_id, '{title}' AS title, {url} AS url, {quoted(place)} AS location, {n} AS n_locations, CAST({posted} AS BIGINT) AS posted_at, CAST({bound} AS BIGINT) AS posted_bound "
        f"FROM customer WHERE {k} % 8 = {i} AND {k} % 9 <> 0"
    )
    at = lambda t: f"epoch(TIMESTAMP '{t}')"
    slug, site = f"'c' || {k}", f"'c' || {k} || '.wd1/site'"
    wd = f"'https://c' || {k} || '.wd1.myworkdayjobs.com/site"
    rows = [
        row(0, "ashby", slug, f"'a' || {k}", "Data Engineer", f"'https://jobs.ashbyhq.com/c' || {k} || '/a' || {k}", "Berlin", 2, at("2026-08-01 10:00:00")),
        row(1, "greenhouse", slug, f"CAST({k} AS STRING)", "SRE", f"'https://g.io/' || {k}", "Remote", 1, at("2026-08-01 22:00:00")),
        row(2, "lever", slug, f"'l' || {k}", "Designer", f"'https://l.co/' || {k}", "Oslo", 2, 1_786_000_000),
        row(3, "workday", site, f"'JR' || {k}", "Analyst", f"{wd}/job/Austin-TX/Analyst_JR' || {k}", "Austin TX", 1, NOW - 5 * 86_400, str(NOW - 5 * 86_400)),
        row(3, "workday", site, f"'R-' || {k}", "Clerk", f"{wd}/job/77/Clerk_R-' || {k}", "Oslo", 1, "NULL", str(NOW - 30 * 86_400)),
        row(4, "recruitee", slug, f"CAST({k} AS STRING)", "Chef", f"'https://r.com/' || {k}", "Lyon", 1, at("2026-07-01 00:00:00")),
        row(5, "breezy", slug, f"'b' || {k}", "Barista", f"'https://b.hr/' || {k}", "Graz", 1, at("2026-06-01 00:00:00")),
        row(6, "smartrecruiters", slug, f"'s' || {k}", "Nurse", f"'https://jobs.smartrecruiters.com/c' || {k} || '/s' || {k}", "Gent, be", 1, at("2026-05-01 00:00:00")),
        row(7, "bamboohr", slug, f"CAST({k} AS STRING)", "Dev", f"'https://c' || {k} || '.bamboohr.com/careers/' || {k}", "Leeds, United Kingdom", 1, "NULL"),
    ]
    return " UNION ALL ".join(rows)


SQL |= {
    "adapter_postings": _postings(),
    "adapter_partial": "SELECT 'workday' AS ats, 'c' || c_custkey || '.wd1/site' AS slug FROM customer WHERE c_custkey % 8 = 3 AND c_custkey % 9 <> 0",
    "gazetteer_argmax": with_views(
        "WITH s AS (SELECT name AS name_key, country, sum(population) AS people FROM places GROUP BY ALL) SELECT name_key, arg_min(country, (-people, country)) AS country_code FROM s GROUP BY name_key", "places"
    ),
    "region_with_gazetteer": with_views(
        f"""WITH s AS (SELECT lower(name) AS k, country, sum(population) AS people FROM places GROUP BY ALL), g AS (SELECT k, arg_min(country, (-people, country)) AS code FROM s GROUP BY k),
            r AS (SELECT k, code, CASE WHEN code = 'US' THEN 'us' WHEN code IN ('FR', 'IE', 'DE') THEN 'europe' ELSE 'other' END AS region FROM g),
            l AS (SELECT location, count(*) AS n, trim(location) AS t FROM jobs GROUP BY location),
            sure AS (SELECT location, region AS sure FROM l JOIN r ON k = lower(trim(regexp_extract(t, '^(.*?)[,\\s]+([A-Za-z]{{2}})\\s*$', 1))) AND code = upper(regexp_extract(t, '^(.*?)[,\\s]+([A-Za-z]{{2}})\\s*$', 2))),
            f AS (SELECT location, list_filter(list_transform(regexp_split_to_array(t, '[,/|()\\[\\]]+|\\s+-\\s+|–|—'), lambda p: trim(p)), lambda p: p <> '') AS ps, t FROM l),
            p AS (SELECT location, unnest(list_prepend(t, ps)) AS name, unnest(range(len(ps) + 1)) AS i, false AS word FROM f
                  UNION ALL SELECT location, w, i + 1000, true FROM (SELECT location, unnest(regexp_split_to_array(array_to_string(ps, ' '), '\\s+')) AS w, unnest(range(len(regexp_split_to_array(array_to_string(ps, ' '), '\\s+')))) AS i FROM f) WHERE length(w) >= 4),
            found AS (SELECT location, arg_min(region, i) AS found FROM p JOIN r ON k = trim(regexp_replace(lower(name), '[^\\w ]+', ' ', 'g')) WHERE NOT (word AND region = 'other') GROUP BY location)
            SELECT location, {region('location', 'sure', 'found')} AS place, n FROM l LEFT JOIN sure USING (location) LEFT JOIN found USING (location)""",
        "jobs", "places",
    ),
    "json_walk": """SELECT page_id AS doc, 'C' || page_id AS name, 'c' || page_id || '.com' AS domain, NULL AS ats, NULL AS slug FROM pages
                    UNION ALL SELECT page_id, NULL, NULL, 'lever', 'c' || page_id FROM pages""",
    "page_boards": with_views(f"WITH {EXTRACTED} SELECT page_id, ats, slug FROM firsts", "texts"),
}
SQL |= {
    "careers_resolve": with_views(
        f"""WITH {CAREERS}
           SELECT j.id, CASE WHEN ok THEN 'https://' || found || path END AS url, CASE WHEN NOT ok OR found IS NULL THEN 'none' WHEN slug IS NULL THEN 'html' ELSE 'ats' END AS kind,
                  CASE WHEN ok AND NOT sure AND c.id IS NULL THEN found END AS learned, CASE WHEN ok AND NOT sure AND c.id <> j.id THEN c.id END AS merge_into, ok AS owned, CASE WHEN ok AND slug IS NOT NULL THEN 1 ELSE 0 END AS n_refs
           FROM judged j LEFT JOIN companies c ON c.domain = found""",
        "companies", "boards", "probes",
    ),
    "careers_recheck": with_views(
        """WITH pages AS (SELECT domain, CASE WHEN contains(html, 'lever.co') THEN regexp_extract(html, 'lever.co/(n\\d+)', 1) END AS s FROM probes WHERE status = 200)
           SELECT ats, slug, CASE WHEN s IS NULL THEN 'gone' WHEN ats = 'lever' AND slug = s THEN 'confirmed' ELSE 'migrated' END AS outcome, CASE WHEN s IS NOT NULL THEN 'lever:' || s END AS now_on
           FROM boards LEFT JOIN pages ON domain = 's' || substr(slug, 2) || '.com'""",
        "boards", "probes",
    ),
}
SQL["stream_event_rates"] = "SELECT CAST(epoch(ts) AS BIGINT) // 86400 * 86400 AS start, event_type AS type, count(*) AS n FROM events GROUP BY ALL"
SQL["stream_poll_next"] = SQL["diff_next_state"]
SQL["poll_shares"] = with_views(
    """WITH placed AS (SELECT ats, slug, job_count * job_count AS n, job_count * job_count > 1000 AS big, CAST('0x' || md5(ats || '/' || slug)[1:6] AS INT) % 64 AS bucket FROM boards),
       laid AS (SELECT *, sum(CASE WHEN big THEN 0 ELSE n END) OVER o - CASE WHEN big THEN 0 ELSE n END AS pos, count(*) FILTER (big) OVER o AS nth FROM placed WINDOW o AS (ORDER BY bucket, ats, slug))
       SELECT CAST(CASE WHEN big THEN nth * 2 - 1 ELSE pos // 1000 * 2 END AS BIGINT) AS share, count(*) AS boards, CAST(sum(n) AS BIGINT) AS postings, count(DISTINCT bucket) AS buckets FROM laid GROUP BY 1""",
    "boards",
)


def resolved_as(k: str, companies: str, refs: str) -> str:
    """RESOLVED over these tables, its own named with k behind."""
    own = re.sub(r"\b(named|rows_|best|resolved)\b", rf"\1{k}", RESOLVED)
    return re.sub(r"\bcompanies\b", companies, re.sub(r"\bcompany_refs\b", refs, own))


def swept(names: list[str]) -> str:
    """CTEs of a sweep over the leads of these sources in turn: companies<k> before source k, links<k> of the boards that it names."""
    out = ["companies0 AS (SELECT id, domain, name, norm_name, website, careers_url FROM companies)"]
    for k, name in enumerate(names):
        out.append(f"refs{k} AS (SELECT company_name AS name, domain, website, careers_url, ord, ats, slug FROM leads WHERE source = {quoted(name)} AND (company_name IS NOT NULL OR domain IS NOT NULL OR website IS NOT NULL))")
        out.append(resolved_as(f"_{k}", f"companies{k}", f"refs{k}").strip())
        first = ", ".join(f"arg_min({c}, ord) FILTER ({c} IS NOT NULL) AS {c}" for c in ("domain", "name", "norm_name", "website", "careers_url"))
        kept = ", ".join(f"coalesce(c.{c}, f.{c}) AS {c}" for c in ("domain", "name", "norm_name", "website", "careers_url"))
        out.append(f"fill{k} AS (SELECT company_id AS id, {first} FROM resolved_{k} WHERE company_id IS NOT NULL GROUP BY company_id)")
        out.append(f"new{k} AS (SELECT (SELECT max(id) FROM companies{k}) + row_number() OVER (ORDER BY ord) AS id, domain, name, norm_name, website, careers_url FROM resolved_{k} WHERE company_id IS NULL)")
        out.append(f"companies{k + 1} AS (SELECT id, {kept} FROM companies{k} c LEFT JOIN fill{k} f USING (id) UNION ALL SELECT * FROM new{k})")
        out.append(f"ids{k} AS (SELECT domain, norm_name, company_id AS cid FROM resolved_{k} WHERE company_id IS NOT NULL UNION ALL SELECT domain, norm_name, id FROM new{k})")
        out.append(f"links{k} AS (SELECT ats, slug, arg_min(cid, n.ord) AS cid FROM named_{k} n JOIN ids{k} r ON n.d IS NOT DISTINCT FROM r.domain AND nullif(n.nn, '') IS NOT DISTINCT FROM r.norm_name WHERE slug IS NOT NULL GROUP BY ALL)")
    return ",\n".join(out)


_ASKED = ["s0", "s1", "s2"]
_LEADS = f"asked AS (SELECT l.*, CAST(substr(source, 2) AS INT) AS k FROM leads l WHERE source IN {in_list(_ASKED)} AND (slug IS NOT NULL OR company_name IS NOT NULL OR domain IS NOT NULL))"
SQL["sweep_next"] = with_views(
    f"""WITH {swept(_ASKED)}, {_LEADS},
        found AS (SELECT ats, slug, min(k) AS k, arg_min(company_name, (k, ord)) FILTER (company_name IS NOT NULL) AS company_name FROM asked WHERE slug IS NOT NULL GROUP BY ats, slug),
        linked AS (SELECT ats, slug, arg_min(cid, k) AS cid FROM ({" UNION ALL ".join(f"SELECT *, {k} AS k FROM links{k}" for k in range(len(_ASKED)))}) GROUP BY ats, slug),
        labelled AS (SELECT *, {role_family("title")} AS family, {region("location")} AS place FROM asked WHERE external_id IS NOT NULL),
        seeds AS (SELECT * FROM labelled ANTI JOIN jobs USING (ats, slug, external_id) WHERE family IN {in_list(list(config.KEPT_FAMILIES))} AND place IN {in_list(list(config.KEPT_REGIONS))}
                  QUALIFY row_number() OVER (PARTITION BY ats, slug, external_id ORDER BY k, ord) = 1),
        runs AS (SELECT s.source, (SELECT count(*) FROM asked a WHERE a.source = s.source) AS refs, (SELECT count(*) FROM found f ANTI JOIN boards USING (ats, slug) WHERE f.k = s.k) AS b, c, (SELECT count(*) FROM seeds e WHERE e.k = s.k) AS j
                 FROM (VALUES {", ".join(f"({quoted(n)}, {int(n[1:])}, (SELECT count(*) FROM new{k}))" for k, n in enumerate(_ASKED))}) s(source, k, c))
        SELECT 'board' AS kind, ats AS a, slug AS b, coalesce(b.company_name, f.company_name) AS c, CAST(coalesce(b.company_id, cid) AS VARCHAR) AS d FROM boards b FULL JOIN found f USING (ats, slug) LEFT JOIN linked USING (ats, slug)
        UNION ALL SELECT 'link', ats, slug, source, NULL FROM (SELECT ats, slug, source FROM board_sources UNION SELECT ats, slug, source FROM asked WHERE slug IS NOT NULL)
        UNION ALL SELECT 'company', CAST(id AS VARCHAR), domain, norm_name, name FROM companies{len(_ASKED)}
        UNION ALL SELECT 'seed', ats, slug, external_id, family FROM seeds
        UNION ALL SELECT 'run', source, CAST(refs AS VARCHAR), b || '/' || c || '/' || j, NULL FROM runs
        UNION ALL VALUES ('run', 's4', '0', '0/0/0', 'no key'), ('run', 's6', '0', '0/0/0', 'no answers')""",
    "boards", "companies", "jobs", "board_sources", "finds", "leads",
)
_PAGES = "pages_ AS (SELECT domain, path, regexp_extract(html, 'lever.co/(n\\d+)', 1) AS slug FROM probes WHERE status = 200 AND contains(html, 'lever.co'))"
SQL |= {
    "directory_refs": with_views(
        f"""WITH sites AS (SELECT coalesce(domain, norm_name || '.io') AS domain, min(name) AS name FROM companies GROUP BY 1), {_PAGES},
            found AS (SELECT domain, name, path, slug, split_part(domain, '.', 1) AS own, {name_base("name")} AS other FROM sites JOIN pages_ USING (domain)),
            judged AS (SELECT *, contains(own, slug) OR contains(slug, own) OR contains(own, other) OR contains(other, own) AS mine FROM found)
            SELECT 'lever' AS ats, slug, CASE WHEN mine THEN name END AS company_name, CASE WHEN mine THEN 'https://' || domain END AS website, CASE WHEN mine THEN 'https://' || domain || path END AS careers_url, domain AS detail
            FROM judged QUALIFY row_number() OVER (PARTITION BY slug ORDER BY mine DESC, domain) = 1""",
        "companies", "probes",
    ),
    "seed_refs": with_views("SELECT DISTINCT 'lever' AS ats, CASE WHEN page_id % 3 = 0 THEN 's' || page_id % 90 ELSE 't' || page_id % 80 END AS slug FROM lines WHERE page_id % 3 < 2", "lines"),
    "ingest_staged": f"""
        WITH p AS (SELECT *, {role_family("title")} AS role_family, {region("location")} AS region FROM ({SQL["adapter_postings"]}))
        SELECT ats, slug, external_id, role_family, region, CASE ats WHEN 'ashby' THEN '["Berlin","Paris"]' WHEN 'lever' THEN '["Oslo","Rome"]' END AS locations_json, posted_at,
               CAST(CASE WHEN posted_at IS NULL THEN {NOW - NOW % 86_400} END AS BIGINT) AS discovered_at
        FROM p WHERE region IN {in_list(list(config.KEPT_REGIONS))} AND coalesce(nullif(posted_at, 0), nullif(posted_bound, 0), {NOW}) >= {config.CUTOFF}""",
    "first_of_key": with_views(
        """WITH r AS (SELECT *, substr(external_id, 1, 2) AS e, CAST(substr(url, 21) AS BIGINT) * 13 % 1000003 AS o FROM staged)
           SELECT ats, slug, e AS external_id, arg_min(title, o) AS title, arg_min(content_hash, o) AS content_hash FROM r GROUP BY ALL""",
        "staged",
    ),
    "careers_backfill": with_views(
        f"""WITH {_PAGES}, live AS (SELECT 'n' || substr(slug, 2) AS slug FROM boards WHERE status IN ('active', 'empty') AND (careers_url IS NULL OR tier <> 1) AND length(slug) BETWEEN 3 AND 29)
            SELECT DISTINCT 'lever' AS ats, slug, 'https://' || domain AS website, 'https://' || domain || path AS careers_url FROM live JOIN pages_ USING (slug) WHERE domain = slug || '.io'""",
        "boards", "probes",
    ),
}
_NEAREST = ", ".join(f"coalesce(any_value(c.{c}), arg_min(m.{c}, (steps, m.id)) FILTER (m.{c} IS NOT NULL)) AS {c}" for c in ("domain", "careers_url", "careers_kind", "careers_checked_at"))
SQL["company_merge_chain"] = with_views(
    f"""WITH pairs AS (SELECT id AS s, CASE WHEN id % 10 = 7 THEN id + 2 ELSE id - 1 END AS t FROM companies WHERE id % 10 NOT IN (0, 9)),
        way AS (SELECT s, t, 1 AS steps FROM pairs UNION ALL SELECT w.s, p.t, steps + 1 FROM way w JOIN pairs p ON p.s = w.t),
        ends AS (SELECT s, max(steps) AS steps, arg_max(t, steps) AS t FROM way GROUP BY s),
        held AS (SELECT coalesce(t, company_id) AS id, count(*) AS n FROM boards LEFT JOIN ends ON s = company_id GROUP BY 1)
        SELECT c.id, {_NEAREST}, coalesce(any_value(n), 0) AS n_boards FROM companies c LEFT JOIN ends ON t = c.id LEFT JOIN companies m ON m.id = s LEFT JOIN held h ON h.id = c.id WHERE c.id % 10 IN (0, 9) GROUP BY c.id""",
    "companies", "boards",
)
SQL["company_merge_chain"] = SQL["company_merge_chain"].replace("WITH ", "WITH RECURSIVE ", 1)
SQL["stream_grace"] = f"SELECT type, ats, slug, external_id, title, url FROM ({SQL['diff_events']})"
SQL["stream_told"] = with_views(
    f"""WITH e AS (SELECT id, {NOW} + id * 40000 + id * id % 977 * 1000 AS ts, CAST(id % 50 AS VARCHAR) AS external_id FROM feed),
        following AS (SELECT a.external_id, a.ts, min(b.ts) AS later FROM e a JOIN e b ON a.external_id = b.external_id AND b.ts >= a.ts + {config.DEDUPE_SECONDS} GROUP BY ALL),
        told AS (SELECT external_id, min(ts) AS ts FROM e GROUP BY ALL UNION ALL SELECT external_id, later FROM told JOIN following USING (external_id, ts))
        SELECT id, ts, external_id FROM told JOIN e USING (external_id, ts)""",
    "feed",
).replace("WITH ", "WITH RECURSIVE ", 1)
SQL["adapter_source"] = SQL["adapter_postings"]
SQL["gate_rulesets"] = with_views(
    f"""WITH usable AS (SELECT *, '(?i)' || pattern AS p FROM rules WHERE pattern IS NOT NULL AND pattern <> '(' AND family IS NOT NULL),
        r AS (SELECT DISTINCT title, role_family, {role_family("title")} AS own FROM jobs WHERE title IS NOT NULL AND role_family IS NOT NULL),
        h AS (SELECT id, role_family IN ('other', family) OR own = family AS good FROM r JOIN usable ON regexp_matches(title, p)),
        n AS (SELECT id, count(*) AS hits, count(*) FILTER (good) AS agree FROM h GROUP BY id)
        SELECT id, coalesce(hits, 0) AS hits, coalesce(agree, 0) AS agree, round(agree / hits, 3) AS precision,
               CASE WHEN hits IS NULL THEN 'rejected' WHEN agree / hits >= {config.GATE_PRECISION} THEN 'auto_applied' ELSE 'pending' END AS verdict FROM rules LEFT JOIN n USING (id)""",
    "jobs", "rules",
)
SQL["proposal_steps"] = with_views(
    f"""WITH v AS (SELECT id, CASE id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'accepted' ELSE 'rejected' END AS s FROM feed WHERE id % 7 <> 0),
        d AS (SELECT p.id, status, CASE WHEN (status = 'drafted' AND s IN ('pending', 'rejected')) OR (status = 'pending' AND s IN ('accepted', 'rejected')) THEN s END AS s FROM proposals p LEFT JOIN v USING (id))
        SELECT id, coalesce(s, status) AS status, CASE WHEN s IS NOT NULL THEN CAST(id % 9 AS DOUBLE) END AS score, CASE WHEN s IS NULL THEN '{{"a":"1"}}' ELSE '{{"a":"1","b":"2"}}' END AS evidence,
               CASE WHEN s IS NOT NULL THEN CAST({NOW} AS BIGINT) END AS decided_at, CASE WHEN s IS NOT NULL THEN 'gate' END AS decided_by FROM d""",
    "proposals", "feed",
)
