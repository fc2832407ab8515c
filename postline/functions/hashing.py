"""A posting's content hash: what must differ for it to count as edited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields that count, in order.
HASHED = ("title", "location", "locations", "department", "team", "employment_type", "workplace_type", "is_remote", "url", "compensation")


def canonical(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    if kind.startswith("array"):
        return F.array_join(F.col(name), "\x02")
    if kind.startswith("map"):
        return F.array_join(F.transform(F.array_sort(F.map_entries(name)), lambda e: F.concat(e["key"], F.lit("\x03"), e["value"])), "\x02")
    return F.col(name).cast("string")


def content_hash(df: DataFrame) -> Column:
    """16 hexadecimal digits over the hashed fields that df has; null differs from empty."""
    parts = [F.coalesce(F.concat(F.lit("="), canonical(df, c)), F.lit("-")) if c in df.columns else F.lit("-") for c in HASHED]
    return F.substring(F.sha2(F.concat_ws("\x01", *parts), 256), 1, 16)
