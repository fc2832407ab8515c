"""Vendors' job lists as postings: one mapping per platform over fetched JSON, with DataFrame operations only.

``fetches`` has a row for each fetched page: ats, slug, fetch_status (ok, transient, permanent), body (JSON) and fetched_at.
Only ok rows are mapped. A payload without its list is an error of the fetch, not an empty board: see ``broken``. Boards
that come in pages must be whole: see ``partial``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postline.functions import dates

BOARD = ["ats", "slug"]
COLUMNS = (
    "ats", "slug", "external_id", "title", "url", "apply_url", "location", "locations", "department", "team", "employment_type", "workplace_type", "is_remote", "posted_at", "posted_bound", "compensation",
)
#: The most postings of a paged board, and the forms of Workday's fields.
MOST = 25_000
REQUISITION, SEVERAL_PLACES = r"_([A-Za-z]*-?\d[\w-]*)$", r"^\d+\s+Locations?$"

_place = "location struct<name:string>"
SCHEMAS = {
    "ashby": "jobs array<struct<id:string,title:string,jobUrl:string,applyUrl:string,location:string,secondaryLocations:array<struct<location:string>>,department:string,team:string,employmentType:string,workplaceType:string,isRemote:boolean,isListed:boolean,publishedAt:string,compensation:map<string,string>>>",
    "greenhouse": f"jobs array<struct<id:string,title:string,absolute_url:string,{_place.replace(' ', ':', 1)},first_published:string,updated_at:string>>",
    "lever": "items array<struct<id:string,text:string,hostedUrl:string,applyUrl:string,categories:struct<location:string,allLocations:array<string>,team:string,department:string,commitment:string>,workplaceType:string,createdAt:double,salaryRange:map<string,string>,salaryDescription:string>>",
    "recruitee": "offers array<struct<id:string,title:string,careers_url:string,careers_apply_url:string,locations:array<struct<full_address:string,city:string>>,location:string,department:string,employment_type_code:string,remote:boolean,published_at:string,created_at:string>>",
    "breezy": "items array<struct<id:string,name:string,url:string,location:struct<name:string,is_remote:boolean>,locations:array<struct<name:string>>,department:string,type:struct<name:string>,published_date:string>>",
    "bamboohr": "meta struct<totalCount:bigint>, result array<struct<id:string,jobOpeningName:string,departmentLabel:string,employmentStatusLabel:string,isRemote:boolean,location:struct<city:string,state:string,country:string>,atsLocation:struct<city:string,state:string,province:string,country:string>>>",
    "smartrecruiters": "totalFound bigint, content array<struct<id:string,name:string,location:struct<fullLocation:string,city:string,region:string,country:string,remote:boolean>,department:struct<label:string>,typeOfEmployment:struct<label:string>,releasedDate:string>>",
    "workday": "total bigint, jobPostings array<struct<title:string,externalPath:string,locationsText:string,postedOn:string,bulletFields:array<string>>>",
}
LISTS = {"ashby": "jobs", "greenhouse": "jobs", "lever": "items", "recruitee": "offers", "breezy": "items", "bamboohr": "result", "smartrecruiters": "content", "workday": "jobPostings"}
TOTALS = {"bamboohr": "meta.totalCount", "smartrecruiters": "totalFound", "workday": "total"}


def filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def distinct_names(names: Column) -> Column:
    return F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (n != "")))


def parsed(fetches: DataFrame, ats: str) -> DataFrame:
    """ok fetches of a platform with ``doc``, the payload. A bare list is read as if it were a field of an object."""
    own = fetches.filter((F.col("ats") == ats) & (F.col("fetch_status") == "ok"))
    body = F.concat(F.lit('{"items":'), F.col("body"), F.lit("}")) if LISTS[ats] == "items" else F.col("body")
    return own.withColumn("doc", F.from_json(body, SCHEMAS[ats]))


def broken(fetches: DataFrame, ats: str) -> DataFrame:
    """(ats, slug) of ok fetches whose payload has no list: they count as failed."""
    return parsed(fetches, ats).filter(F.col(f"doc.{LISTS[ats]}").isNull()).select(*BOARD).distinct()


def partial(fetches: DataFrame, ats: str) -> DataFrame:
    """(ats, slug) of boards whose pages don't add up to the total, or that exceed MOST: refused, never cut."""
    pages = parsed(fetches, ats).groupBy(*BOARD).agg(F.max(f"doc.{TOTALS[ats]}").alias("total"), F.sum(F.size(f"doc.{LISTS[ats]}")).alias("have"))
    return pages.filter((F.col("total") > MOST) | (F.col("have") < F.col("total"))).select(*BOARD)


def _ashby(j: Column, slug: Column, now: int) -> dict[str, Column]:
    others = F.transform(F.coalesce(j["secondaryLocations"], F.array()), lambda s: s["location"])
    return {
        "title": j["title"], "url": filled(j["jobUrl"], F.concat(F.lit("https://jobs.ashbyhq.com/"), slug, F.lit("/"), j["id"])), "apply_url": j["applyUrl"], "location": j["location"],
        "locations": distinct_names(F.concat(F.array(j["location"]), others)), "department": j["department"], "team": j["team"], "employment_type": j["employmentType"],
        "workplace_type": j["workplaceType"], "is_remote": j["isRemote"], "posted_at": dates.iso_epoch(j["publishedAt"]), "compensation": j["compensation"],
    }


def _greenhouse(j: Column, slug: Column, now: int) -> dict[str, Column]:
    place = j["location"]["name"]
    return {"title": j["title"], "url": F.coalesce(j["absolute_url"], F.lit("")), "location": place, "locations": distinct_names(F.array(place)), "posted_at": dates.iso_epoch(filled(j["first_published"], j["updated_at"]))}


def _lever(j: Column, slug: Column, now: int) -> dict[str, Column]:
    c = j["categories"]
    listed = F.coalesce(c["allLocations"], F.array().cast("array<string>"))
    place = F.coalesce(filled(c["location"]), F.get(listed, F.lit(0)))
    several = F.when(place.isNotNull() & ~F.array_contains(listed, place), F.concat(F.array(place), listed)).otherwise(listed)
    words = filled(j["salaryDescription"])
    pay = F.when(words.isNotNull(), F.map_concat(F.coalesce(F.map_filter(j["salaryRange"], lambda k, v: k != "description"), F.create_map().cast("map<string,string>")), F.create_map(F.lit("description"), words))).otherwise(j["salaryRange"])
    return {
        "title": j["text"], "url": F.coalesce(j["hostedUrl"], F.lit("")), "apply_url": j["applyUrl"], "location": place, "locations": several, "team": c["team"], "department": c["department"],
        "employment_type": c["commitment"], "workplace_type": j["workplaceType"], "posted_at": F.floor(j["createdAt"] / 1000), "compensation": pay,
    }


def _recruitee(j: Column, slug: Column, now: int) -> dict[str, Column]:
    named = distinct_names(F.transform(F.coalesce(j["locations"], F.array()), lambda e: filled(e["full_address"], e["city"])))
    names = F.when(F.size(named) > 0, named).otherwise(distinct_names(F.array(j["location"])))
    return {
        "title": j["title"], "url": F.coalesce(j["careers_url"], F.lit("")), "apply_url": j["careers_apply_url"], "location": F.get(names, F.lit(0)), "locations": names, "department": j["department"],
        "employment_type": j["employment_type_code"], "is_remote": j["remote"], "posted_at": dates.utc_epoch(filled(j["published_at"], j["created_at"])),
    }


def _breezy(j: Column, slug: Column, now: int) -> dict[str, Column]:
    listed = F.when(F.size(j["locations"]) > 0, F.transform(j["locations"], lambda e: e["name"])).otherwise(F.array(j["location"]["name"]))
    names = distinct_names(listed)
    return {
        "title": j["name"], "url": F.coalesce(j["url"], F.lit("")), "location": F.get(names, F.lit(0)), "locations": names, "department": j["department"], "employment_type": j["type"]["name"],
        "is_remote": j["location"]["is_remote"], "posted_at": dates.iso_epoch(j["published_date"]),
    }


def _bamboohr(j: Column, slug: Column, now: int) -> dict[str, Column]:
    a, b = j["location"], j["atsLocation"]
    place = filled(F.concat_ws(", ", filled(a["city"], b["city"]), filled(a["state"], b["state"], b["province"]), filled(a["country"], b["country"])))
    return {
        "title": j["jobOpeningName"], "url": F.concat(F.lit("https://"), slug, F.lit(".bamboohr.com/careers/"), j["id"]), "location": place, "locations": distinct_names(F.array(place)),
        "department": j["departmentLabel"], "employment_type": j["employmentStatusLabel"], "is_remote": j["isRemote"],
    }


def _smartrecruiters(j: Column, slug: Column, now: int) -> dict[str, Column]:
    p = j["location"]
    place = filled(p["fullLocation"], F.concat_ws(", ", filled(p["city"]), filled(p["region"]), filled(p["country"])))
    return {
        "title": j["name"], "url": F.concat(F.lit("https://jobs.smartrecruiters.com/"), slug, F.lit("/"), j["id"]), "location": place, "locations": distinct_names(F.array(place)),
        "department": j["department"]["label"], "employment_type": j["typeOfEmployment"]["label"], "is_remote": p["remote"], "posted_at": dates.iso_epoch(j["releasedDate"]),
    }


def _workday(j: Column, slug: Column, now: int) -> dict[str, Column]:
    path = F.coalesce(j["externalPath"], F.lit(""))
    said = F.when(~F.trim(j["locationsText"]).rlike(SEVERAL_PLACES), filled(j["locationsText"]))
    place = F.coalesce(said, dates.location_from_path(path))
    host = F.concat(F.split_part(slug, F.lit("/"), F.lit(1)), F.lit(".myworkdayjobs.com/"), F.split_part(slug, F.lit("/"), F.lit(2)))
    return {
        "title": j["title"], "url": F.concat(F.lit("https://"), host, path), "location": place, "locations": distinct_names(F.array(place)),
        "posted_at": dates.posted_from_relative(j["postedOn"], now), "posted_bound": dates.newest_possible(j["postedOn"], now),
    }


MAPPINGS: dict[str, Callable[[Column, Column, int], dict[str, Column]]] = {
    "ashby": _ashby, "greenhouse": _greenhouse, "lever": _lever, "recruitee": _recruitee, "breezy": _breezy, "bamboohr": _bamboohr, "smartrecruiters": _smartrecruiters, "workday": _workday,
}


def external_id(ats: str, j: Column) -> Column:
    if ats != "workday":
        return filled(j["id"])
    path = F.coalesce(j["externalPath"], F.lit(""))
    return filled(F.get(j["bulletFields"], F.lit(0)), F.regexp_extract(path, REQUISITION, 1), path)


def postings(fetches: DataFrame, ats: str, now: int) -> DataFrame:
    """The postings of a platform's ok fetches; those without an id are left out, and hidden ones of Ashby."""
    rows = parsed(fetches, ats).select(*BOARD, F.explode(f"doc.{LISTS[ats]}").alias("j"))
    if ats == "ashby":
        rows = rows.filter(F.coalesce(F.col("j.isListed"), F.lit(True)))
    j = F.col("j")
    made = MAPPINGS[ats](j, F.col("slug"), now) | {"external_id": external_id(ats, j)}
    made["title"] = F.trim(F.coalesce(made["title"], F.lit("")))
    kinds = {"locations": "array<string>", "is_remote": "boolean", "posted_at": "bigint", "posted_bound": "bigint", "compensation": "map<string,string>"}
    return rows.select(*BOARD, *[made.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS if c not in BOARD]).filter("external_id IS NOT NULL")


def all_postings(fetches: DataFrame, now: int) -> DataFrame:
    """The postings of every platform, of boards whose fetch is whole."""
    out = None
    for ats in MAPPINGS:
        rows = postings(fetches, ats, now)
        if ats in ("smartrecruiters", "workday"):
            rows = rows.join(partial(fetches, ats), BOARD, "left_anti")
        out = rows if out is None else out.unionByName(rows)
    return out
