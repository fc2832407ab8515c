"""Fixed values of the engine, in one place. Times are epoch seconds; nothing reads the clock."""

DAY = 86_400
#: Diff.
GRACE, MASS_CLOSE_GUARD = 2, 5
#: Postings of a share, the least that a stream settles at a time.
STAGED_MOST = 20_000
#: The most transactions that a stream's micro-batch is settled in.
ROUNDS = 8
#: Ingest filter.
KEPT_FAMILIES = ("engineering", "fde", "ai", "data")
KEPT_REGIONS = ("us", "europe", "remote", "unknown")
CUTOFF = 1_786_320_000
#: Polling: seconds between polls by tier, backoff, retirement.
TIER_SECONDS = {1: 3_600, 2: 21_600, 3: 86_400}
QUIET_DAYS = 14
BACKOFF_FIRST, BACKOFF_MOST, DEAD_AFTER = 900, 86_400, 8
ERROR_CHARS = 500
#: Source health.
COLLAPSE_RATIO, SATURATION_RUNS, MIN_HISTORY, WINDOW = 0.2, 3, 3, 10
#: Digest.
FLOOD, DEDUPE_SECONDS, PER_GROUP, CHAR_BUDGET = 600, 30 * DAY, 25, 5_200
DIGEST_GROUPS = (("New Grad", "new_grad"), ("Internship", "intern"))
DIGEST_REGIONS = ("us", "remote")
#: Gates.
GATE_AUTO_BOARDS, GATE_PRECISION = 25, 0.90
#: Policy.
MANY_UNVALIDATED, MANY_STALE, MANY_UNRESOLVED, DISCOVER_HOURS, LOW_YIELD = 1_500, 50_000, 5_000, 24, 100
MAX_ATTRIBUTED_REFS = 3
PAGE = 50
JOBS_PAGE_MOST, COMPANY_JOBS_MOST = 200, 500
