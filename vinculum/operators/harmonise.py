"""Identifier harmonisation by lookup.

The maps are joined without a broadcast hint: Spark broadcasts a map whose
size it knows to be under its threshold and otherwise sorts and merges,
where AQE splits the partitions of ids that hold much of the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def harmonise(df: DataFrame, column: str, *maps: DataFrame | None, out: str | None = None) -> DataFrame:
    """``coalesce(map1[id], map2[id], ..., id)``.

    Each map is (key, value) with unique keys; absent maps (``None``) are skipped.
    """
    values = []
    for i, mapping in enumerate(m for m in maps if m is not None):
        key, value = f"_key{i}", f"_value{i}"
        renamed = mapping.select(F.col("key").alias(key), F.col("value").alias(value))
        df = df.join(renamed, df[column] == renamed[key], "left").drop(key)
        values.append(value)
    return df.withColumn(out or column, F.coalesce(*values, column)).drop(*values)
