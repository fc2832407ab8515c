"""What tables of an earlier schema lack, filled in: a step for each version of the store, for ``Store.migrate``.

A column that was added later is null in older rows, which says that its value was never worked out. The steps work out those
alone: values of an older rule set wait for ``registry.reclassified``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postline.functions import labels, names
from postline.operators import registry


def several_locations(name: str, df: DataFrame) -> DataFrame:
    """2: postings keep their list of locations only if it says more than ``location`` does."""
    if name != "jobs":
        return df
    return df.withColumn("locations_json", F.when(F.json_array_length("locations_json") > 1, F.col("locations_json")))


def labelled(name: str, df: DataFrame) -> DataFrame:
    """3: labels and regions of postings, and the names by which companies are found."""
    if name == "companies":
        return df.withColumn("norm_name", F.coalesce("norm_name", F.nullif(names.base(F.col("name")), F.lit(""))))
    if name != "jobs":
        return df
    never = F.col("classified_by").isNull()
    rows = registry.reclassified(df.filter(never)).unionByName(df.filter(~never))
    placed = labels.label_distinct(rows, "location", "_region", labels.region)
    return placed.withColumn("region", F.coalesce("region", "_region")).select(*df.columns)


STEPS = {2: several_locations, 3: labelled}
