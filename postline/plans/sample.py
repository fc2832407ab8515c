"""The domain's tables, made from the driver's tables by their keys alone.

Each view is one SELECT that Spark and DuckDB both read, so a query and its SQL twin start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The time at which all sample queries run, and days before it.
NOW = 1_788_000_000
TITLES = (
    "Software Engineer", "Senior Backend Developer", "New Grad Software Engineer", "Software Engineering Intern", "Forward Deployed Engineer",
    "Machine Learning Engineer", "Staff Data Scientist", "Civil Engineer", "Registered Nurse", "Account Executive", "Product Manager", "UX Designer",
    "Security Engineer", "Adjunct Professor of Computer Science", "Sales Engineer", "Site Reliability Engineer", "Mechanical Design Engineer",
    "Data Engineer II", "Warehouse Associate", "Engineering Manager", "Principal Architect", "Junior Java Developer", "Embedded Firmware Engineer",
    "Quantitative Researcher", "AI Research Scientist", "Retail Store Associate", "Chief Technology Officer", "Director of Platform", "DevOps Lead",
    "Technical Account Manager", "Penetration Tester", "Business Development Representative", "Summer Internship - Machine Learning", "Quality Engineer",
    "SDET", "Barista", "Solutions Architect", "C++ Developer", "Member of Technical Staff", "Office Coordinator",
)
PLACES = (
    "San Francisco, CA", "New York, NY", "London", "Berlin, Germany", "Bengaluru", "Remote", "Remote - US", "Toronto, Ontario", "Paris, France", "Austin, tx",
    "Munich, DE", "Singapore", "Sao Paulo, Brazil", "Warsaw", "Hybrid", "Springfield", "USA-Denver", "IND-BLR-Tower", "Ontario, California", "EMEA",
    "Tbilisi, Georgia", "Atlanta, Georgia", "Vancouver, WA", "NYC", "Dublin, IE", "Tokyo", "Somewhere Nice", "Work in Progress", "Anywhere", "Amsterdam",
    "Chicago, IL", "Mexico City", "United Kingdom", "Lisbon", "Seattle", "", "Boise", "Nunavut", "Zurich", "Multiple Locations",
)
PLATFORMS = ("ashby", "greenhouse", "lever", "workday", "recruitee", "breezy", "smartrecruiters", "bamboohr")
LINKS = (
    "https://jobs.ashbyhq.com/Rampo", "jobs.lever.co/acme/", "https://boards.greenhouse.io/stripling/jobs/123", "https://boards.greenhouse.io/embed/job_board?for=Figura&token=77",
    "https://acme.wd5.myworkdayjobs.com/en-US/Careers/job/x", "https://www.example.com/jobs", "https://jobs.lever.co/robots.txt", "https://tulipan.recruitee.com/o/dev",
    "https://jobs.smartrecruiters.com/Viso/74399", "https://jobs.ashbyhq.com/api/x", "http://acme.breezy.hr/", "https://job-boards.eu.greenhouse.io/Nord",
    "https://jobs.ashbyhq.com/rampo/0a1b2c3d-1111-2222-3333-444455556666", "", "ftp://nowhere", "https://www.acme.bamboohr.com/careers/1",
    "https://acme.wd1.myworkdayjobs.com/wday/cxs/acme/Ext/jobs", "https://jobs.jobvite.com/acme/job/o1",
)
NAMES = ("Datalodge, Inc.", "Foo, Inc. Corp.", "Acme GmbH", "Simply AI", "Woven", "L'Aurelle SA", "Marama Health", "Acme Company", "", "Vesli", "Rampo LLC", "Nord 7 Oy")
SITES = ("https://www.datalodge.com/careers", "foo.io", "boards.greenhouse.io/stripling", "usesimply.ai", "wovenos.com", "LAURELLE.COM", "heymarama.co", "acme.com", "localhost", "figura.com", "http://rampo.com:80/x", "sub.lever.co")
AGES = ("Posted Today", "Posted Yesterday", "Posted 5 Days Ago", "Posted 30+ Days Ago", "posted 1 day ago", "Posted", "", "Reposted 3 days ago")
PATHS = ("/job/Southlake-TX/Engineer_R1", "/job/12345/X_R2", "/job/A/Y", "/careers", "/job/New-York--NY/Z_R-3", "")


def pick(key: str, values: tuple[str, ...]) -> str:
    """SQL for the value at key modulo their number; an empty one is null."""
    cases = " ".join(f"WHEN {i} THEN '{v.replace(chr(39), chr(39) * 2)}'" if v else f"WHEN {i} THEN NULL" for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {cases} END"


def numbered(text: str, name: str, key: str, many: int) -> str:
    """SQL for a text in which a name, where it occurs, has one of many numbers behind it."""
    return f"replace({text}, '{name}', '{name}' || CAST({key} % {many} AS STRING))"


VIEWS: dict[str, str] = {
    "boards": f"""
        SELECT {pick("c_custkey", PLATFORMS)} AS ats, 'c' || CAST(c_custkey AS STRING) AS slug,
               CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_name END AS company_name,
               CASE c_custkey % 5 WHEN 0 THEN 'unvalidated' WHEN 1 THEN 'active' WHEN 2 THEN 'empty' WHEN 3 THEN 'active' ELSE 'dead' END AS status,
               CAST(1 + c_custkey % 3 AS INT) AS tier, CAST(c_custkey % 50 AS INT) AS job_count,
               CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE {NOW} - 5000 + (c_custkey * 37) % 10000 END AS next_poll_at,
               CAST({NOW} - 9000 AS BIGINT) AS last_polled_at, CAST({NOW} - 9000 AS BIGINT) AS last_ok_at,
               CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE {NOW} - (c_custkey % 40) * 86400 END AS last_new_at,
               CAST(c_custkey % 9 AS INT) AS consecutive_failures, CAST(NULL AS STRING) AS last_error,
               CAST({NOW} - 90 * 86400 AS BIGINT) AS first_seen_at, CAST(NULL AS STRING) AS website,
               CASE WHEN c_custkey % 3 = 0 THEN 'https://c' || CAST(c_custkey AS STRING) || '.com/careers' ELSE NULL END AS careers_url,
               CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE CAST(1 + c_custkey % 40 AS BIGINT) END AS company_id
        FROM customer""",
    "companies": """
        SELECT s_suppkey AS id, CASE WHEN s_suppkey % 10 = 1 AND s_suppkey < 60 THEN 'n' || CAST(s_suppkey - 1 AS STRING) || '.io' WHEN s_suppkey % 5 = 0 THEN NULL ELSE 's' || CAST(s_suppkey AS STRING) || '.com' END AS domain,
               s_name AS name, 'n' || CAST(s_suppkey % 60 AS STRING) AS norm_name, CAST(NULL AS STRING) AS website,
               CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'https://s' || CAST(s_suppkey AS STRING) || '.com/jobs' END AS careers_url,
               CASE s_suppkey % 4 WHEN 0 THEN 'ats' WHEN 1 THEN 'html' WHEN 2 THEN 'none' ELSE NULL END AS careers_kind,
               CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE CAST(1780000000 + s_suppkey AS BIGINT) END AS careers_checked_at,
               CAST(1770000000 AS BIGINT) AS first_seen_at, 'seed' AS source
        FROM supplier""",
    "jobs": f"""
        SELECT {pick("o_custkey", PLATFORMS)} AS ats, 'c' || CAST(o_custkey AS STRING) AS slug, CAST(o_orderkey AS STRING) AS external_id,
               {pick("o_orderkey", TITLES)} AS title, {pick("(o_orderkey * 7 + o_custkey)", PLACES)} AS location, CAST(NULL AS STRING) AS locations_json,
               CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 10 < 4 THEN {pick("o_orderkey", PATHS)} || CAST(o_orderkey AS STRING) ELSE 'https://example.com/' || CAST(o_orderkey AS STRING) END AS url,
               CASE WHEN o_orderkey % 12 = 0 THEN NULL ELSE {NOW} - (o_orderkey % 60) * 86400 END AS posted_at,
               CAST({NOW} - (o_orderkey % 30) * 86400 - o_orderkey % 1000 AS BIGINT) AS first_seen_at, CAST({NOW} - 3600 AS BIGINT) AS last_seen_at,
               CASE WHEN o_orderkey % 4 = 0 THEN {NOW} - 7200 ELSE NULL END AS closed_at,
               CASE WHEN o_orderkey % 4 = 0 THEN 'closed' ELSE 'open' END AS status, CAST(CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE o_orderkey % 2 END AS INT) AS missing_polls,
               CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 'h' || CAST(o_orderkey % 997 AS STRING) END AS content_hash, 'poll' AS source,
               CASE o_orderkey % 7 WHEN 0 THEN 'engineering' WHEN 1 THEN 'data' WHEN 2 THEN 'other' WHEN 3 THEN 'fde' WHEN 4 THEN 'ai' WHEN 5 THEN 'product' ELSE NULL END AS role_family,
               CAST(CASE WHEN o_orderkey % 7 IN (0, 1, 3, 4) THEN 1 ELSE 0 END AS INT) AS is_engineering, CAST(CASE WHEN o_orderkey % 7 = 3 THEN 1 ELSE 0 END AS INT) AS is_fde,
               CASE o_orderkey % 5 WHEN 0 THEN 'new_grad' WHEN 1 THEN 'intern' WHEN 2 THEN 'senior' ELSE NULL END AS seniority,
               CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 9 = 1 THEN 'r3' ELSE 'r4' END AS classified_by,
               CASE o_orderkey % 6 WHEN 0 THEN 'us' WHEN 1 THEN 'europe' WHEN 2 THEN 'remote' WHEN 3 THEN 'other' ELSE 'unknown' END AS region
        FROM orders""",
    "staged": f"""
        SELECT {pick("o_custkey", PLATFORMS)} AS ats, 'c' || CAST(o_custkey AS STRING) AS slug,
               CASE WHEN o_orderkey % 13 = 0 THEN 'n' || CAST(o_orderkey AS STRING) ELSE CAST(o_orderkey AS STRING) END AS external_id,
               {pick("o_orderkey", TITLES)} AS title, {pick("o_orderkey", PLACES)} AS location, CAST(NULL AS STRING) AS locations_json,
               'https://example.com/' || CAST(o_orderkey AS STRING) AS url,
               CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE {NOW} - (o_orderkey % 50) * 86400 END AS posted_at, CAST({NOW} - {NOW} % 86400 AS BIGINT) AS discovered_at,
               CASE WHEN o_orderkey % 11 = 0 THEN 'e' || CAST(o_orderkey % 997 AS STRING) ELSE 'h' || CAST(o_orderkey % 997 AS STRING) END AS content_hash,
               'engineering' AS role_family, CAST(1 AS INT) AS is_engineering, CAST(0 AS INT) AS is_fde, 'senior' AS seniority, 'r4' AS classified_by, 'us' AS region
        FROM orders WHERE o_orderkey % 7 <> 0 AND o_custkey % 10 <> 3""",
    "fetched": f"""
        SELECT {pick("c_custkey", PLATFORMS)} AS ats, 'c' || CAST(c_custkey AS STRING) AS slug, CAST(CASE WHEN c_custkey % 10 = 3 THEN 0 ELSE 9 END AS INT) AS fetched
        FROM customer WHERE c_custkey % 4 <> 2""",
    "feed": f"""
        SELECT event_id AS id, CAST({NOW} - 1000000 + event_id * 10 AS BIGINT) AS ts,
               CASE event_id % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'reopened' WHEN 2 THEN 'edited' WHEN 3 THEN 'closed' ELSE 'new' END AS type,
               {pick("o_custkey", PLATFORMS)} AS ats, 'c' || CAST(o_custkey AS STRING) AS slug, CAST(o_orderkey AS STRING) AS external_id,
               {pick("o_orderkey", TITLES)} AS title, 'https://example.com/' || CAST(o_orderkey AS STRING) AS url,
               CASE event_id % 4 WHEN 0 THEN '{{"location":"Oslo"}}' WHEN 1 THEN 'not json' WHEN 2 THEN '{{"missing_polls":2}}' ELSE NULL END AS detail_json
        FROM events LEFT JOIN orders ON o_orderkey = 1 + event_id""",
    "notified": f"""
        SELECT {pick("o_custkey", PLATFORMS)} AS ats, 'c' || CAST(o_custkey AS STRING) AS slug, CAST(o_orderkey AS STRING) AS external_id,
               CAST({NOW} - (o_orderkey % 60) * 86400 AS BIGINT) AS notified_at
        FROM orders WHERE o_orderkey % 3 = 0""",
    "runs": f"""
        SELECT event_id AS id, event_type || CAST(user_id % 7 AS STRING) AS source, CAST({NOW} - (event_id % 4000) * 600 AS BIGINT) AS started_at,
               CASE WHEN event_id % 11 = 0 THEN NULL ELSE {NOW} END AS finished_at,
               CAST(CASE WHEN event_id % 6 = 0 THEN 10 ELSE 1000 + event_id % 100 END AS BIGINT) AS refs_seen, CAST(CASE WHEN user_id % 7 < 3 THEN 0 ELSE event_id % 30 END AS BIGINT) AS new_boards,
               CAST(CASE WHEN event_id % 19 = 0 THEN 3 ELSE 0 END AS BIGINT) AS blocked, CASE WHEN event_id % 13 = 0 THEN 'no key' ELSE NULL END AS skipped
        FROM events""",
    "board_sources": f"""
        SELECT {pick("c_custkey", PLATFORMS)} AS ats, 'c' || CAST(c_custkey AS STRING) AS slug, c_mktsegment AS source, CAST(1770000000 AS BIGINT) AS first_seen_at
        FROM customer WHERE c_custkey % 3 <> 0""",
    "refs": f"""
        SELECT {pick("p_partkey", PLATFORMS)} AS ats, 'c' || CAST(p_partkey AS STRING) AS slug, CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE p_name END AS company_name,
               p_brand AS source, CASE WHEN p_partkey % 3 = 0 THEN 'https://p' || CAST(p_partkey AS STRING) || '.io' ELSE NULL END AS website, CAST(NULL AS STRING) AS careers_url,
               p_partkey AS ord
        FROM part""",
    "company_refs": """
        SELECT CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'N' || CAST(p_partkey % 90 AS STRING) || ', Inc.' END AS name,
               CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN 'https://www.S' || CAST(p_partkey % 150 AS STRING) || '.com/about' ELSE 'q' || CAST(p_partkey AS STRING) || '.io' END AS domain,
               CAST(NULL AS STRING) AS website, CASE WHEN p_partkey % 5 = 0 THEN 'https://x.io/' || CAST(p_partkey AS STRING) ELSE NULL END AS careers_url, p_partkey AS ord
        FROM part""",
    "polls": f"""
        SELECT {pick("c_custkey", PLATFORMS)} AS ats, 'c' || CAST(c_custkey AS STRING) AS slug,
               CASE c_custkey % 6 WHEN 0 THEN 'transient' WHEN 1 THEN 'permanent' ELSE 'ok' END AS fetch_status, CAST(c_custkey % 4 AS INT) AS job_count,
               c_custkey % 2 = 0 AS had_new, CASE WHEN c_custkey % 6 < 2 THEN 'HTTP 500 for c' || CAST(c_custkey AS STRING) ELSE NULL END AS error
        FROM customer WHERE c_custkey % 5 <> 4""",
    "texts": f"""
        SELECT page_id, {numbered(numbered(pick("page_id", LINKS), "acme", "page_id", 97), "Figura", "page_id", 61)} AS link, {numbered(numbered(pick("page_id", NAMES), "Acme", "page_id", 89), "Foo", "page_id", 53)} AS name,
               {numbered(numbered(pick("page_id", SITES), "acme", "page_id", 83), "foo", "page_id", 47)} AS site, replace({pick("page_id", AGES)}, '5 Days', CAST(1 + page_id % 29 AS STRING) || ' Days') AS posted, {numbered(pick("page_id", PATHS), "X", "page_id", 71)} AS path,
               html || ' see ' || coalesce({pick("page_id", LINKS)}, '') || ' and "https://jobs.ashbyhq.com/p' || CAST(page_id % 9 AS STRING) || '", ' || coalesce({pick("(page_id + 3)", LINKS)}, '')
               || ' &quot;https:&#47;&sol;&#X6a;obs&#46;lever&period;co/n&#0045;' || CAST(page_id % 23 AS STRING) || '?a=1&amp;b=2&quot;' AS body
        FROM pages""",
}
#: One fetched payload for each platform, with k for the board's number: the text, with $k where the number stands.
PAYLOADS = {
    "ashby": '{"jobs":[{"id":"a$k","title":" Data Engineer ","location":"Berlin","secondaryLocations":[{"location":"Paris"},{"location":"Berlin"}],"publishedAt":"2026-08-01T10:00:00Z"},{"id":"h$k","isListed":false},{"title":"no id"}]}',
    "greenhouse": '{"jobs":[{"id":$k,"title":"SRE","absolute_url":"https://g.io/$k","location":{"name":"Remote"},"first_published":"","updated_at":"2026-08-02T00:00:00+02:00"}]}',
    "lever": '[{"id":"l$k","text":"Designer","hostedUrl":"https://l.co/$k","categories":{"allLocations":["Oslo","Rome"],"team":"X"},"createdAt":1786000000123}]',
    "workday": '{"total":2,"jobPostings":[{"title":"Analyst","externalPath":"/job/Austin-TX/Analyst_JR$k","locationsText":"3 Locations","postedOn":"Posted 5 Days Ago","bulletFields":["JR$k"]},{"title":"Clerk","externalPath":"/job/77/Clerk_R-$k","locationsText":"Oslo","postedOn":"Posted 30+ Days Ago","bulletFields":[]}]}',
    "recruitee": '{"offers":[{"id":$k,"title":"Chef","careers_url":"https://r.com/$k","locations":[{"city":"Lyon"}],"published_at":"2026-07-01 00:00:00 UTC"}]}',
    "breezy": '[{"id":"b$k","name":"Barista","url":"https://b.hr/$k","location":{"name":"Graz","is_remote":true},"published_date":"2026-06-01T00:00:00.000Z"}]',
    "smartrecruiters": '{"totalFound":1,"content":[{"id":"s$k","name":"Nurse","location":{"city":"Gent","country":"be"},"releasedDate":"2026-05-01T00:00:00Z"}]}',
    "bamboohr": '{"meta":{"totalCount":1},"result":[{"id":"$k","jobOpeningName":"Dev","location":{"city":null,"state":null},"atsLocation":{"city":"Leeds","country":"United Kingdom"}}]}',
}


def payload(number: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{PAYLOADS[p]}'" for i, p in enumerate(PLATFORMS))
    return f"replace(CASE c_custkey % {len(PLATFORMS)} {cases} END, '$k', CAST({number} AS STRING))"


VIEWS["fetches"] = f"""
    SELECT {pick("c_custkey", PLATFORMS)} AS ats, CASE WHEN c_custkey % 8 = 3 THEN 'c' || CAST(c_custkey AS STRING) || '.wd1/site' ELSE 'c' || CAST(c_custkey AS STRING) END AS slug,
           CASE WHEN c_custkey % 9 = 0 THEN 'transient' ELSE 'ok' END AS fetch_status, {payload("c_custkey")} AS body FROM customer"""
VIEWS["places"] = f"""
    SELECT {pick("c_custkey", ("Springfield", "Paris", "Birmingham", "London", "Vienna", "Dublin", "Munich", "Somewhere", "Nunavut"))} AS name, {pick("(c_custkey % 1000)", ("US", "FR", "IE", "CA", "DE"))} AS country,
           CAST(c_custkey % 977 AS BIGINT) AS population FROM customer"""
# a page for each supplier's own domain, and one for each name that a domain may be guessed from
VIEWS["probes"] = """
    SELECT domain, '/careers' AS path, CAST(1 AS INT) AS path_rank, CAST(CASE WHEN k % 9 = 0 THEN 404 ELSE 200 END AS INT) AS status,
           CASE WHEN k % 3 = 0 THEN 'no boards here' ELSE 'at https://jobs.lever.co/n' || CAST(k % 60 AS STRING) || '/1' END AS html
    FROM (SELECT 's' || CAST(s_suppkey AS STRING) || '.com' AS domain, s_suppkey AS k FROM supplier
          UNION ALL SELECT DISTINCT 'n' || CAST(s_suppkey % 60 AS STRING) || '.io', s_suppkey % 60 FROM supplier) AS pages_of"""
VIEWS["sources"] = """
    SELECT DISTINCT 's' || CAST(p_partkey % 7 AS STRING) AS source, CAST(p_partkey % 7 AS INT) AS rank, CAST(CASE WHEN p_partkey % 7 = 2 THEN 4 ELSE 0 END AS BIGINT) AS blocked,
           CASE WHEN p_partkey % 7 = 3 THEN 'TimeoutError: late' ELSE NULL END AS error, CASE WHEN p_partkey % 7 = 4 THEN 'no key' ELSE NULL END AS skipped
    FROM part"""
VIEWS["finds"] = f"""
    SELECT 's' || CAST((p_partkey * p_partkey + p_partkey) % 6 AS STRING) AS source, CAST(p_partkey AS BIGINT) AS ord, CASE WHEN p_partkey % 8 = 5 THEN NULL ELSE {pick("p_partkey", PLATFORMS)} END AS ats,
           CASE WHEN p_partkey % 8 = 5 THEN NULL ELSE 'c' || CAST(p_partkey % 700 AS STRING) END AS slug, CASE WHEN p_partkey % 3 = 0 THEN 'N' || CAST(p_partkey % 90 AS STRING) || ' GmbH' ELSE NULL END AS company_name,
           CASE WHEN p_partkey % 5 = 0 THEN 'www.s' || CAST(p_partkey % 150 AS STRING) || '.com' WHEN p_partkey % 8 = 5 THEN 'q' || CAST(p_partkey % 99 AS STRING) || '.io' ELSE NULL END AS domain,
           CAST(NULL AS STRING) AS website, CAST(NULL AS STRING) AS careers_url, CASE WHEN p_partkey % 4 = 0 THEN CAST(p_partkey % 500 AS STRING) ELSE NULL END AS external_id, p_name AS title
    FROM part"""
VIEWS["leads"] = f"""
    SELECT 's' || CAST(ord % 3 AS STRING) AS source, ord, ats, slug, company_name, domain, website, careers_url, external_id, {pick("ord", TITLES)} AS title, {pick("(ord * 7)", PLACES)} AS location FROM ({VIEWS["finds"]}) AS finds_"""
VIEWS["proposals"] = f"""
    SELECT event_id AS id, 'agent' || CAST(user_id % 3 AS STRING) AS agent, CASE event_id % 5 WHEN 0 THEN 'drafted' WHEN 1 THEN 'pending' WHEN 2 THEN NULL WHEN 3 THEN 'rejected' ELSE 'auto_applied' END AS status FROM events"""
WORDS = ("engineer", "developer", "analyst", "security", "data", "platform", "learning", "machine", "architect", "nurse", "sales", "manager", "research", "designer", "devops", "embedded", "intern", "graduate", "account", "quality", "staff", "lead", "java", "zzz")
_one, _other = pick("p_partkey", WORDS), pick("(p_partkey * 7 + 3)", WORDS)
VIEWS["rules"] = f"""
    SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN '(^|[^a-z])(' || {_one} || '|' || {_other} || ')([^a-z]|$)' WHEN 1 THEN {_one} || '.*' || {_other} WHEN 2 THEN '^' || {_one}
           WHEN 3 THEN '(?:' || {_one} || 's?|' || {_other} || ')' ELSE CASE p_partkey % 25 WHEN 4 THEN '(' WHEN 9 THEN '^[' || substring({_one}, 1, 2) || ']' WHEN 14 THEN NULL ELSE {_one} || '[ ]+[a-z]+' END END AS pattern,
           {pick("(p_partkey * 3)", ("engineering", "data", "ai", "security", "product", ""))} AS family FROM part"""
VIEWS["poll_runs"] = f"SELECT event_id AS id, CAST({NOW} + event_id AS BIGINT) AS started_at, CAST(event_id % 90 AS INT) AS boards_polled FROM events"
#: Files that discovery leaves behind: a line or document for each page.
VIEWS["lines"] = f"""
    SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'not json' WHEN page_id % 6 = 1 THEN '{{"status":"200"}}' ELSE '{{"url":"https://jobs.lever.co/x' || CAST(page_id % 70 AS STRING) || '/apply","status":"200"}}' END AS crawl,
           'com,ashbyhq,jobs)/y 2026 ' || CASE WHEN page_id % 4 = 0 THEN 'https://example.com/' ELSE 'https://jobs.ashbyhq.com/y' || CAST(page_id % 50 AS STRING) END || ' text/html 200' AS archive,
           '[{{"url":"https://jobs.lever.co/z' || CAST(page_id % 30 AS STRING) || '/0a1b2c3d-1111-2222-3333-44445555' || CAST(1000 + page_id % 9000 AS STRING) || '","company_name":"Z","title":"Dev","active":' || CASE WHEN page_id % 2 = 0 THEN 'true' ELSE 'false' END || '}},{{"url":"https://example.com","active":true}}]' AS listed,
           CASE page_id % 4 WHEN 0 THEN 'D     Orbit ' || CAST(page_id % 40 AS STRING) || ' Robotics Inc      ' || CAST(100000 + page_id % 40 AS STRING) || '   2026080' || CAST(1 + page_id % 9 AS STRING) || '   edgar/x.txt'
                WHEN 1 THEN 'D/A   Blue Lake Capital Fund LP   77   20260801  edgar/y.txt' WHEN 2 THEN '10-K  Orbit Inc   1   20260801' ELSE '' END AS filed,
           CAST({NOW} - page_id * page_id * 40 AS BIGINT) AS seen
    FROM pages"""
#: Answers of services, as they were fetched: a row for each page.
VIEWS["answers"] = f"""
    SELECT page_id, CAST(page_id % 5 AS INT) AS host, CAST(page_id % 11 AS INT) AS page, html,
           '{{"results":[{{"page":{{"url":"https://jobs.lever.co/u' || CAST(page_id % 40 AS STRING) || '"}}}},{{"page":{{}}}},{{"page":{{"url":"https://example.com/x"}}}}]}}' AS scan,
           CASE WHEN page_id % 3 = 0 THEN '{{"items":[{{"text_matches":[],"html_url":"https://jobs.ashbyhq.com/g' || CAST(page_id % 40 AS STRING) || '","repository":{{"full_name":"r' || CAST(page_id AS STRING) || '"}}}}]}}'
                ELSE '{{"items":[{{"text_matches":[{{"fragment":"x"}},{{"fragment":"https://jobs.lever.co/f' || CAST(page_id % 30 AS STRING) || '/1"}}],"html_url":"https://jobs.lever.co/no","repository":{{"full_name":"r' || CAST(page_id AS STRING) || '"}}}}]}}' END AS code,
           '<a href="/customers/K' || CAST(page_id % 12 AS STRING) || '-x">k</a> <a href="/jobs/view/a-dev-' || CAST(10000000 + page_id % 300 AS STRING) || '">j</a> https://jobs.ashbyhq.com/k' || CAST(page_id % 20 AS STRING) || '-x' AS listing,
           CASE WHEN page_id % 4 = 0 THEN 'https://jobs.lever.co/w' || CAST(page_id % 25 AS STRING) ELSE 'https://blog.example.com/' || CAST(page_id % 60 AS STRING) END AS result
    FROM pages"""
VIEWS["trees"] = """
    SELECT page_id AS doc, '{"org":{"company":"C' || CAST(page_id AS STRING) || '","website":"https://www.c' || CAST(page_id AS STRING) || '.com"},"list":[{"apply":"https://jobs.lever.co/c' || CAST(page_id AS STRING) || '/x"},{"n":1}]}' AS text
    FROM pages"""
TABLES = ("customer", "supplier", "orders", "events", "part", "pages")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"FROM {t}" in text or f"JOIN {t}" in text}
    text = text.replace("{", "{{").replace("}", "}}")
    for t in used:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(text, **used)


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL over these views."""
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    return f"WITH {ctes}{', ' + sql.strip()[5:] if sql.strip().upper().startswith('WITH ') else ' ' + sql.strip()}"
