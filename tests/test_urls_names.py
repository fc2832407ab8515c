import html

from pyspark.sql import functions as F

from postline.functions import dates, names, urls

LINKS = {
    "https://jobs.ashbyhq.com/Ramp": ("ashby", "ramp", None),
    "jobs.ashbyhq.com/ramp/0a1b2c3d-1111-2222-3333-444455556666": ("ashby", "ramp", "0a1b2c3d-1111-2222-3333-444455556666"),
    "https://boards.greenhouse.io/stripe/jobs/123": ("greenhouse", "stripe", "123"),
    "https://boards.greenhouse.io/embed/job_board?for=Figma&token=7": ("greenhouse", "figma", "7"),
    "https://jobs.eu.lever.co/acme).": ("lever", "acme", None),
    "https://acme.wd5.myworkdayjobs.com/en-US/Careers/x": ("workday", "acme.wd5/careers", None),
    "https://acme.wd1.myworkdayjobs.com/wday/cxs/acme/Ext/jobs": ("workday", "acme.wd1/ext", None),
    "https://tulip.recruitee.com": ("recruitee", "tulip", None),
    "https://www.jobs.smartrecruiters.com/Visa/743": ("smartrecruiters", "visa", "743"),
    "https://jobs.lever.co/robots.txt": None,
    "https://jobs.ashbyhq.com/api": None,
    "https://boards.greenhouse.io/embed/x": None,
    "https://example.com/jobs": None,
    "": None,
    "http://[bad": None,
}


def test_router(spark):
    df = spark.createDataFrame([(u,) for u in [*LINKS, None]], "u string").select("u", urls.parse(F.col("u")).alias("r"))
    got = {r.u: r.r and tuple(r.r) for r in df.collect()}
    assert got == LINKS | {None: None}


def test_extract_all(spark):
    text = 'see &quot;https:&#x2F;&#x2F;jobs.lever.co&#x2F;acme&quot; and https://jobs.ashbyhq.com/Ramp, (https://jobs.ashbyhq.com/ramp/x) https://example.com/a https://acme.bamboohr.com/x'
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(urls.extract_all(F.col("t")).alias("r"))
    assert [[tuple(x)[:2] for x in r.r] for r in df.collect()] == [[("lever", "acme"), ("ashby", "ramp")], [], []]


def test_unescape_equals_the_standard_library(spark):
    texts = [
        "&lt;a href=&quot;https:&#x2F;&#x2f;jobs&period;lever&#46;co&sol;x&quot;&gt; &amp;amp; &copy;2026 &notit; &notin; &ampfoo &AMP; &nosuchname; & && &# &#; &#x; a&b",
        "&#0; &#x0; &#128; &#x9f; &#129; &#55296; &#1114112; &#99999999999999999999; &#xfffffffffff; &#1; &#11; &#x7f; &#xFDD0; &#65535; &#13; &#x1F642; &#128578 &#xe9",
        "&NewLine;&Tab;&nbsp;&CounterClockwiseContourIntegral;&bne;&frac12;&frac12x &AMPx &sup1 &sup11 &euro", "no reference", "", "&", "&#00065;&#x00000041;",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", urls.unescape(F.col("t")).alias("u"))
    assert {r.t: r.u for r in df.collect()} == {t: html.unescape(t) for t in texts}


def test_extract_all_of_numeric_references_keeps_the_first(spark):
    text = "https&#58;&#x2F;&#47;jobs&#46;lever&period;co&sol;n&#45;1 https://jobs.lever.co/n-1/0a1b2c3d-1111-2222-3333-444455556666 https://boards.greenhouse.io/a/jobs/7 https://boards.greenhouse.io/a/jobs/8"
    (row,) = spark.createDataFrame([(text,)], "t string").select(urls.extract_all(F.col("t")).alias("r")).collect()
    assert [tuple(x) for x in row.r] == [("lever", "n-1", None), ("greenhouse", "a", "7")]


def test_names(spark):
    df = spark.createDataFrame([("Foo, Inc. Corp.", "https://www.Foo.io/x"), ("Databricks, Inc.", "jobs.lever.co"), (None, None), ("Weave", "weaveos.com")], "n string, d string")
    rows = df.select(names.base(F.col("n")).alias("b"), names.apex(F.col("d")).alias("a"), names.plausibly_same(F.col("d"), F.col("n")).alias("s")).collect()
    assert [(r.b, r.a, r.s) for r in rows] == [("foo", "foo.io", True), ("databricks", None, False), ("", None, False), ("weave", "weaveos.com", True)]


def test_dates(spark):
    now = 1_000_000_000
    texts = ["Posted Today", "Posted Yesterday", "Posted 5 Days Ago", "Posted 30+ Days Ago", "x", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(dates.posted_from_relative(F.col("t"), now).alias("p"), dates.newest_possible(F.col("t"), now).alias("b"))
    assert [(r.p, r.b) for r in df.collect()] == [(now, now), (now - 86_400, now - 86_400), (now - 432_000, now - 432_000), (None, now - 2_592_000), (None, None), (None, None)]
