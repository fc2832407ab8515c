"""A gazetteer from a table of places: the country that most people with a place of that name live in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postline.functions.labels import place_keys

#: The columns of a place dump, by position, and names that are ordinary words.
COLUMNS = {"name": 1, "ascii_name": 2, "alternates": 3, "country": 8, "population": 14}
MIN_KEY = 3


def places(spark: SparkSession, path: str) -> DataFrame:
    """(name, country, population) of every spelling of every place of a tab-separated dump."""
    rows = spark.read.csv(path, sep="\t", quote="").select(*[F.col(f"_c{i}").alias(c) for c, i in COLUMNS.items()])
    spelled = F.explode(F.array_distinct(F.concat(F.array("name", "ascii_name"), F.split(F.coalesce("alternates", F.lit("")), ","))))
    return rows.select(spelled.alias("name"), "country", F.coalesce(F.col("population").try_cast("bigint"), F.lit(0)).alias("population"))


def by_population(rows: DataFrame, key: str = "name") -> DataFrame:
    """(name_key, country_code): for each key, the country with the most people; of equals, the first by code."""
    sums = rows.groupBy(F.col(key).alias("name_key"), "country").agg(F.sum("population").alias("people"))
    best = sums.groupBy("name_key").agg(F.min(F.struct((-F.col("people")).alias("less"), F.col("country").alias("country_code"))).alias("b"))
    return best.select("name_key", "b.country_code")


def build(rows: DataFrame, stop: tuple[str, ...] = ()) -> DataFrame:
    low, folded = place_keys(F.col("name"))
    keyed = rows.withColumn("name_key", F.explode(F.array_distinct(F.array_compact(F.array(low, folded))))).filter(F.char_length("name_key") >= MIN_KEY)
    return by_population(keyed.filter(~F.col("name_key").isin(*stop)) if stop else keyed, "name_key")
