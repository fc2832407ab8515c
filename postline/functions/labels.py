"""Role family, seniority and region of postings, as Column expressions.

Each rule set is one ``CASE`` over regular expressions, so it stays in the JVM and stops at the first match. With many
repeated strings it pays to label the distinct ones and join back: ``label_distinct``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postline.functions import rules as R

RULESET = "r4"
SPACES = " \t\n\x0b\x0c\r"


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(R.JVM + pattern)


def first_match(cases: list[tuple[Column, str]], otherwise: str | None) -> Column:
    out = F.when(*cases[0])
    for case in cases[1:]:
        out = out.when(*case)
    return out.otherwise(F.lit(otherwise))


def role_family(title: Column, department: Column | None = None) -> Column:
    """The family of a title and department; "unknown" for nothing at all."""
    text = F.trim(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(department, F.lit("")) if department is not None else F.lit("")))
    cases = [(text == "", "unknown")]
    for family, pattern, excuse in R.FAMILIES:
        hit = matches(text, pattern)
        cases.append((hit & ~matches(text, excuse) if excuse else hit, family))
    return first_match(cases, "other")


def seniority(title: Column) -> Column:
    """By the title alone; null where no level is named."""
    title = F.coalesce(title, F.lit(""))
    return first_match([(matches(title, R.words(terms)), level) for level, terms in R.SENIORITY], None)


def with_role(df: DataFrame, title: str = "title", department: str | None = None) -> DataFrame:
    """df with role_family, is_engineering, is_fde (0 or 1), seniority and classified_by."""
    df = df.withColumn("role_family", role_family(F.col(title), F.col(department) if department else None))
    return df.withColumns(
        {
            "is_engineering": F.col("role_family").isin(*R.TECHNICAL).cast("int"),
            "is_fde": (F.col("role_family") == "fde").cast("int"),
            "seniority": F.when(F.col("role_family") != "unknown", seniority(F.col(title))),
            "classified_by": F.lit(RULESET),
        }
    )


def region_of_code(code: Column) -> Column:
    return F.when(code == "US", "us").when(code.isin(*R.EUROPE_CODES.split()), "europe").when(code.isNotNull(), "other")


def region(location: Column, country_of: Callable[[Column], Column] | None = None) -> Column:
    """us, europe, other, remote or unknown.

    country_of: looks a place name up in a gazetteer (a two-letter code or null). Without one, the rules that need it don't apply.
    """
    text = F.btrim(location, F.lit(SPACES))
    prefix = F.lower(F.regexp_extract(text, r"^([A-Za-z]{3})[\s-]", 1))
    m = lambda terms: matches(text, R.words(terms))
    cases = [(text.isNull() | (text == ""), "unknown")]
    cases += [(prefix.isin(*codes.split()), name) for name, codes in R.ISO3.items()]
    cases += [
        (m(R.NON_TARGET_COUNTRY) | m(R.NON_TARGET_CITY), "other"),
        (matches(text, R.US_COUNTRY) | m(R.US_STATE), "us"),
        (m(R.EU_COUNTRY), "europe"),
    ]
    if country_of is not None:
        city, code = city_and_code(text)
        sure = (city != "") & F.coalesce(country_of(city) == code, F.lit(False))
        cases += [(sure & (region_of_code(code) == name), name) for name in ("us", "europe", "other")]
    cases += [
        (matches(text, R.US_STATE_CODE_RE) | matches(text, R.US_SHORTHAND_RE), "us"),
        (m(R.CA_PROVINCE), "other"),
        (m(R.US_CITY), "us"),
        (m(R.EU_CITY), "europe"),
    ]
    if country_of is not None:
        found = gazetteer_region(text, country_of)
        cases += [(found == name, name) for name in ("us", "europe", "other")]
    cases.append((m(R.REMOTE), "remote"))
    return first_match(cases, "unknown")


def city_and_code(text: Column) -> tuple[Column, Column]:
    """What stands before two last letters, and those letters in upper case; empty where there are none."""
    part = lambda i: F.regexp_extract(text, r"^(.*?)[,\s]+([A-Za-z]{2})\s*$", i)
    return F.trim(part(1)), F.upper(part(2))


def fragments(text: Column) -> tuple[Column, Column]:
    """The parts of a location between separators, and their words of four characters or more."""
    parts = F.filter(F.transform(F.split(text, r"[,/|()\[\]]+|\s+-\s+|–|—"), lambda p: F.trim(p)), lambda p: p != "")
    return parts, F.filter(F.flatten(F.transform(parts, lambda p: F.split(p, r"\s+"))), lambda w: F.char_length(w) >= 4)


def gazetteer_region(text: Column, country_of: Callable[[Column], Column]) -> Column:
    """The whole string, then its fragments from the left, may name any region; then single words, which may not refuse."""
    parts, tokens = fragments(text)
    named = F.transform(F.concat(F.array(text), parts), lambda p: region_of_code(country_of(p)))
    kept = F.filter(F.transform(tokens, lambda w: region_of_code(country_of(w))), lambda r: r.isNotNull() & (r != "other"))
    return F.coalesce(F.get(F.filter(named, lambda r: r.isNotNull()), F.lit(0)), F.get(kept, F.lit(0)))


def place_keys(name: Column) -> tuple[Column, Column]:
    """A gazetteer key as written in lower case, and one folded to ASCII; null if under four characters."""
    low = F.trim(F.regexp_replace(F.lower(name), r"(?U)[^\w ]+", " "))
    ascii_ = F.regexp_replace(F.translate(F.lower(name), FOLD[0], FOLD[1]), r"[^\x00-\x7F]", "")
    folded = F.trim(F.regexp_replace(ascii_, "[^a-z0-9 ]+", " "))
    long = lambda k: F.when(F.char_length(k) >= 4, k)
    return long(low), long(folded)


def _fold() -> tuple[str, str]:
    """Letters that decompose into one ASCII letter and marks, and those ASCII letters."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode()) for c in [*range(0xDF, 0x250), *range(0x1E00, 0x1F00)]]
    pairs = [(c, a.lower()) for c, a in pairs if len(a) == 1]
    return "".join(c for c, _ in pairs), "".join(a for _, a in pairs)


FOLD = _fold()


def gazetteer_lookup(table: dict[str, str]) -> Callable[[Column], Column]:
    """A lookup in a small gazetteer held as a literal map; a large one is joined: ``label_regions``."""
    return lookup_in(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]))


def lookup_in(entries: Column) -> Callable[[Column], Column]:
    """A lookup in a map from keys to country codes."""

    def country_of(name: Column) -> Column:
        low, folded = place_keys(name)
        return F.coalesce(F.try_element_at(entries, F.coalesce(low, F.lit(""))), F.try_element_at(entries, F.coalesce(folded, F.lit(""))))

    return country_of


def label_distinct(df: DataFrame, column: str, out: str, label: Callable[[Column], Column]) -> DataFrame:
    """df with ``out``, computed once for each distinct value of ``column``."""
    known = df.select(F.col(column).alias("_value")).distinct().withColumn(out, label(F.col("_value")))
    return df.join(known, df[column].eqNullSafe(known["_value"]), "left").drop("_value")


def label_regions(df: DataFrame, column: str, out: str, table: DataFrame) -> DataFrame:
    """df with ``out``, the region of ``column`` by a gazetteer of any size: table has name_key (unique) and country_code.

    The keys of all names that the rules may look up are joined with the table, once for each distinct location; a location
    then has a map of its own keys.
    """
    known = df.select(F.col(column).alias("_value")).distinct()
    text = F.btrim("_value", F.lit(SPACES))
    names = F.concat(F.array(text, city_and_code(text)[0]), *fragments(text))
    keys = F.array_distinct(F.array_compact(F.flatten(F.transform(names, lambda n: F.array(*place_keys(n))))))
    hits = known.select("_value", F.explode(keys).alias("name_key")).join(table.select("name_key", "country_code"), "name_key")
    codes = hits.groupBy("_value").agg(F.map_from_entries(F.collect_list(F.struct("name_key", "country_code"))).alias("_codes"))
    labelled = known.join(codes, "_value", "left").withColumn(out, region(F.col("_value"), lookup_in(F.col("_codes")))).drop("_codes")
    return df.join(labelled, df[column].eqNullSafe(labelled["_value"]), "left").drop("_value")
