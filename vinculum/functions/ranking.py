"""Keep-one-per-key and top-k.

Both reduce rows before the shuffle, so a key that holds a large part of
the table never lands whole in one task: ``first_per_key`` is an aggregate
with map-side combine, ``top_k`` cuts inside each task first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vinculum.session import write_through

# Spark cuts row_number() <= k inside each task before the shuffle up to this
# k (spark.sql.optimizer.windowGroupLimitThreshold). Larger k is cut by ranges.
GROUP_LIMIT = 1000


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = False) -> DataFrame:
    """One whole row per key: the smallest (or largest) by the ``order`` columns.

    Rows equal in ``order`` are told apart by their other columns, so the
    result is the same on any partitioning. Map columns cannot be compared
    and take no part in that.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    maps = [c for c in rest if "map<" in df.schema[c].dataType.simpleString()]
    ranked = F.struct(*order, *[c for c in rest if c not in maps])
    if maps:
        pick = F.max_by if last else F.min_by
        kept = pick(F.struct(*order, *rest), ranked)
    else:
        kept = (F.max if last else F.min)(ranked)
    # Rows of a whole struct are grouped by sorting. The keys' hash comes first, so that the sort compares
    # numbers; only rows with the same hash, nearly always copies of one key, have their keys compared.
    rows = df.groupBy(F.xxhash64(*keys).alias("_hash"), *keys).agg(kept.alias("_row"))
    return rows.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, numbered from 1 in column ``rank``."""
    if k > GROUP_LIMIT:
        return _top_k_by_ranges(df, by, order, k, rank)
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col(rank) <= k)


def _top_k_by_ranges(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str) -> DataFrame:
    """``top_k`` for a ``k`` that one task should not rank: rows are dealt by ranges of (group, order) and
    stored, so a large group has many ranges; a row's rank is its place in its range and the rows before that."""
    ranges = write_through(df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy(*by, "_range").count()
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("count").over(earlier), F.lit(0))).where(F.col("_before") < k)
    sizes = sizes.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_of"), "_before")
    same = F.col("_range") == F.col("_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    kept = ranges.join(sizes, same)
    place = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order)) + F.col("_before")
    ranked = kept.withColumn(rank, place.cast("int")).where(F.col(rank) <= k)
    return ranked.select(*df.columns, rank)


def first_rows(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of the whole table, for ``n`` of any size.

    The rows are dealt by ranges of their order and stored. Whole ranges before the cut are kept
    as they are; only the range that holds the cut is ranked, by itself.
    """
    ranges = write_through(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before, cut = 0, None
    for row in ranges.groupBy("_range").count().orderBy("_range").collect():  # a number for each range
        if before + row["count"] >= n:
            cut = row["_range"]
            break
        before += row["count"]
    if cut is None:
        return ranges.drop("_range")
    last = ranges.where(F.col("_range") == cut).orderBy(*order).limit(n - before)
    return ranges.where(F.col("_range") < cut).unionByName(last).drop("_range")
