"""Small helpers of the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def settle(df: DataFrame, places: int = 6) -> DataFrame:
    """Round doubles, whose last bits depend on the order of summation; no negative zero."""
    return df.select(*[
        (F.round(f.name, places) + 0.0).alias(f.name) if f.dataType.simpleString() == "double"
        else F.col(f.name) for f in df.schema.fields])
