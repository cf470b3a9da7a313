"""Taxonomy dumps -> descriptor, hierarchy, term and taxonomy tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vinculum.operators import taxonomy as ops
from vinculum.sources.taxonomy import read_years


def year_tables(spark: SparkSession, folder: str, year: int, include_supplementary: bool = True, limit: int | None = None) -> dict[str, DataFrame]:
    """All tables of one year; ``limit`` keeps the first records of each kind by id."""
    tables = read_years(spark, folder, year, include_supplementary, limit)
    descriptors = tables["descriptors"]
    pairs = ops.hierarchy_pairs(descriptors)
    nodes = ops.hierarchy_nodes(pairs, descriptors)
    return {
        **tables,
        "hierarchy": pairs,
        "hierarchy_nodes": nodes,
        "terms": ops.term_dictionary(descriptors),
        "taxonomy": ops.extract_taxonomy(descriptors, nodes),
    }


def all_year_tables(
    spark: SparkSession, folder: str, include_supplementary: bool = True, years: Sequence[int] | None = None, limit: int | None = None
) -> dict[str, DataFrame]:
    """Every year, or those of ``years``, with the latest of them set apart. Years not asked for are not read."""
    tables = read_years(spark, folder, years, include_supplementary, limit)
    descriptors = tables["descriptors"]
    newest = descriptors.agg(F.max("year")).scalar()
    latest = descriptors.where(F.col("year") == newest)
    return {
        **tables,
        "terms": ops.term_dictionary(descriptors, keep=["year"]),
        "latest_descriptors": latest,
        "latest_hierarchy": ops.hierarchy_pairs(latest),
    }


def load_years(spark: SparkSession, folder: str, store: str, years: Sequence[int]) -> DataFrame:
    """Load some years' descriptors into the reference at ``store`` and return all it holds.

    The reference is partitioned by year; only the partitions of the years loaded are replaced,
    the others are neither read nor written.
    """
    rows = read_years(spark, folder, years, include_supplementary=False)["descriptors"]
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(store)
    return spark.read.schema(rows.schema).parquet(store)


def combined_lookup(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Descriptors and terms of all years, later years overriding earlier ones."""
    return {
        "descriptors": ops.disease_lookup(tables["descriptors"]),
        "terms": ops.latest_per_key(tables["terms"], key="term").select("term", "id"),
    }
