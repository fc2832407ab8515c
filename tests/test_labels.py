import pytest
from pyspark.sql import functions as F

from postline.functions import labels
from postline.sources import gazetteer

FAMILIES = {
    "Software Engineer": "engineering", "Forward Deployed Engineer": "fde", "Sales Engineer": "fde", "Machine Learning Engineer": "ai", "Data Engineer": "data", "Civil/Highway Engineer": "other",
    "Engineer - Water": "other", "Manufacturing Systems Software Engineer": "engineering", "Adjunct Instructor in Generative AI": "other", "Business Development Manager - Kubernetes": "other",
    "Security Engineer": "security", "Product Manager": "product", "UX Researcher": "design", "Registered Nurse": "other", "SQL Server DBA": "engineering", "DSP / SDR Receiver Engineer": "engineering",
    "Mobile Associate - Retail Sales": "other", "Quantitative Developer": "data", "": "unknown", "C++ Developer": "engineering", "INGÉNIEUR LOGICIEL": "other",
}
#: Literal expectations, apart from any rule list: titles by family, and titles by whether they count as engineering.
BY_FAMILY = {
    "fde": ["Forward-Deployed Software Engineer", "Solutions Engineer, Enterprise", "Senior Solutions Architect", "Field Engineer II", "Deployment Engineer", "Implementation Consultant", "Technical Account Manager", "Developer Advocate", "Forward Deployed AI Engineer", "Solutions Engineer"],
    "ai": ["Senior Machine Learning Engineer", "LLM Research Engineer", "MLOps Engineer", "Applied Scientist", "Computer Vision Engineer", "AI Infrastructure Engineer"],
    "data": ["Senior Data Scientist", "Analytics Engineer", "Data Scientist"],
    "security": ["Application Security Engineer", "Detection Engineer"],
    "design": ["Senior Product Designer"],
    "other": ["Sales Associate", "Seasonal Sales Associate", "Cashier Part Time Day", "Patient Care Technician - PCT", "Registered Nurse - ICU", "Grocery Clerk Part Time Day", "CDL A Truck Driver", "Retail Sales Associate", "Pharmacy Technician", "Senior Welding Engineer", "Manufacturing Engineer II", "Mechanical Engineer", "Civil Engineer", "Senior Structural Engineer", "Industrial Engineer"],
}
TECHNICAL = ["Senior Software Engineer", "Backend Developer", "Site Reliability Engineer", "Member of Technical Staff", "Embedded Firmware Engineer", "iOS Engineer", "Staff Compiler Engineer", "Software Quality Engineer", "Mechanical Engineer, Robotics Software", "Robotics Engineer", "Robotics Software Engineer", "Java Lead", "Core Java", "Oracle DBA", "Hadoop Administrator", "System Administrator", "Ruby on Rails", ".NET Architect"]
NOT_TECHNICAL = ["AI Visual Creator (Static Ads)", "SEO / AEO / GEO Lead (AI Search)", "Robotics Technician", "Robot Teleoperator (AI & Robotics)", "Robotics Operations Technician", "Fulfillment Associate", "Limited Licensed Master Social Worker (LLMSW)", "React to customer needs daily", "Ruby Tuesday Server"]
LEVELS = {"Senior Engineering Manager": "manager", "Software Engineering Intern": "intern", "New Grad SWE": "new_grad", "VP of Sales": "executive", "Staff Engineer": "staff", "Engineer": None, "Sr. Developer": "senior"}
REGIONS = {
    "Birmingham, UK": "europe", "Cambridge, MA": "us", "Tbilisi, Georgia": "other", "Atlanta, Georgia": "us", "New Mexico": "other", "Vancouver, WA": "other", "Remote - US": "us", "Remote": "remote",
    "Tarragona, CT, Spain": "europe", "Southlake TX": "us", "Work IN Progress": "unknown", "Waterloo Ontario": "other", "Ontario, California": "us", "IND-BLR-Tower": "other", "MÜNCHEN": "europe", "ŁÓDŹ": "europe",
    "": "unknown", "Munich, DE": "us", "Austin, tx": "us", "Télétravail": "remote",
}


def got(spark, values, f):
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", f(F.col("v")).alias("r"))
    return {r.v: r.r for r in df.collect()}


def test_families(spark):
    assert got(spark, FAMILIES, labels.role_family) == FAMILIES


def test_families_of_literal_titles(spark):
    want = {title: family for family, titles in BY_FAMILY.items() for title in titles}
    assert got(spark, want, labels.role_family) == want


def test_titles_that_count_as_engineering(spark):
    want = {title: 1 for title in TECHNICAL} | {title: 0 for title in NOT_TECHNICAL}
    rows = labels.with_role(spark.createDataFrame([(t,) for t in want], "title string"), "title").collect()
    assert {r.title: r.is_engineering for r in rows} == want


def test_levels(spark):
    assert got(spark, LEVELS, labels.seniority) == LEVELS


def test_regions_without_gazetteer(spark):
    assert got(spark, [*REGIONS, None], labels.region) == REGIONS | {None: "unknown"}


def test_regions_with_gazetteer(spark):
    table = {"munich": "DE", "paris": "FR", "woking": "GB", "surrey": "CA", "progress": "CN", "pullman": "US", "washington": "US"}
    want = {"Munich, DE": "europe", "Paris, TX": "us", "Woking, Surrey": "europe", "Work IN Progress": "unknown", "Washington - Pullman": "us"}
    assert got(spark, want, lambda c: labels.region(c, labels.gazetteer_lookup(table))) == want


def test_seniority_reads_the_title_alone(spark):
    df = spark.createDataFrame([("Engineer", "Internship Office"), (None, None)], "title string, department string")
    rows = labels.with_role(df, "title", "department").collect()
    assert rows[0].seniority is None and rows[1].role_family == "unknown" and rows[1].is_engineering == 0


def test_native(spark):
    df = spark.createDataFrame([("x",)], "v string").select(labels.role_family(F.col("v")), labels.region(F.col("v")))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("distinct", [True, False])
def test_label_distinct_keeps_rows_and_nulls(spark, distinct):
    df = spark.createDataFrame([("Remote",), ("Remote",), (None,)], "place string")
    out = labels.label_distinct(df, "place", "r", labels.region).collect() if distinct else df.withColumn("r", labels.region(F.col("place"))).collect()
    assert sorted((r.place or "", r.r) for r in out) == [("", "unknown"), ("Remote", "remote"), ("Remote", "remote")]


def test_regions_by_a_joined_gazetteer(spark):
    rows = [("Zwolsk", "PL", 10), ("Zwolsk", "US", 3), ("Obersdorf", "AT", 5), ("Żuków Wielki", "PL", 7), ("Qingfeng", "CN", 9), *[(f"place number {i}", "US", i) for i in range(3_000)]]
    table = gazetteer.build(spark.createDataFrame(rows, "name string, country string, population bigint"))
    want = {
        "Zwolsk": "europe", "Campus 7, Obersdorf": "europe", "Obersdorf, AT": "europe", "the Obersdorf office": "europe", "ZUKOW WIELKI": "europe", "Qingfeng": "other",
        "old Qingfeng road": "unknown", "Place Number 2999": "us", "nowhere at all": "unknown", "": "unknown", None: "unknown", "Qingfeng (Obersdorf)": "other",
    }
    df = spark.createDataFrame([(x,) for x in want] * 2, "location string")
    got = labels.label_regions(df, "location", "place", table).collect()
    assert len(got) == 2 * len(want) and {r.location: r.place for r in got} == want
