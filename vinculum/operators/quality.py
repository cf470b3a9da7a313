"""Counts, data-quality reports, profiles and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vinculum.functions import columns as C
from vinculum.functions.ranking import first_per_key
from vinculum.sources.drugs import UNAPPROVED_GROUPS

# Fields whose absence is reported for drug records.
REPORTED = ("drugbank_id", "name", "inchikey", "indication", "targets", "synonyms", "mechanism_of_action")
REPORTED_BASIC = ("drugbank_id", "name", "inchikey")

EXAMPLE_LENGTH = 100


def _missing(df: DataFrame, name: str) -> Column:
    c, data_type = F.col(name), df.schema[name].dataType
    if isinstance(data_type, (T.ArrayType, T.MapType)):
        return C.list_size(c) == 0
    if isinstance(data_type, T.StringType):
        return c.isNull() | (c == "")
    return c.isNull()


def drug_statistics(drugs: DataFrame) -> DataFrame:
    """One row of record counts."""
    experimental = F.arrays_overlap("groups", F.array(*map(F.lit, UNAPPROVED_GROUPS)))
    return drugs.agg(
        F.count("*").alias("total_drugs"),
        F.count_if(F.array_contains("groups", "approved")).alias("approved_drugs"),
        F.count_if(experimental).alias("experimental_drugs"),
        F.count_if(~_missing(drugs, "targets")).alias("drugs_with_targets"),
        F.count_if(~_missing(drugs, "indication")).alias("drugs_with_indications"),
        F.count_if(F.coalesce("has_structure_data", F.lit(False))).alias("drugs_with_structures"),
    )


def missing_report(df: DataFrame, fields: tuple[str, ...] = REPORTED) -> DataFrame:
    """(field, missing, percentage), from one aggregation over all fields."""
    counts = df.agg(F.count("*").alias("n"), *[F.count_if(_missing(df, f)).alias(f) for f in fields])
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("missing")) for f in fields])
    rows = counts.select("n", F.inline(pairs))
    return rows.select("field", "missing", C.percent(F.col("missing"), F.col("n")).alias("percentage"))


def distribution(df: DataFrame, value: Column, name: str, unknown: str | None = None) -> DataFrame:
    """(name, n, percentage of all rows). An array value counts every item."""
    values = df.select(value.alias(name))
    if isinstance(values.schema[0].dataType, T.ArrayType):
        values = values.select(F.explode(name).alias(name))
    if unknown is not None:
        values = values.select(F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(unknown)).alias(name))
    total = df.agg(F.count("*")).scalar()
    counts = values.groupBy(name).agg(F.count("*").alias("n"))
    return counts.select(name, "n", C.percent(F.col("n"), total).alias("percentage"))


def graph_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(metric, value). An undirected match sees each edge from both ends, a loop once."""
    node_rows = nodes.agg(F.count("*").alias("value")).select(F.lit("node_count").alias("metric"), "value")
    counts = edges.agg(F.count("*").alias("edge_count"), F.count_if(F.col("source") == F.col("target")).alias("loops"))
    undirected = 2 * F.col("edge_count") - F.col("loops")
    metrics = F.array(
        F.struct(F.lit("edge_count").alias("metric"), F.col("edge_count").alias("value")),
        F.struct(F.lit("undirected_matches").alias("metric"), undirected.alias("value")),
    )
    return node_rows.unionByName(counts.select(F.inline(metrics)))


def build_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(item, n): nodes per label, all nodes, all edges."""
    by_label = nodes.rollup("type").agg(F.count("*").alias("n"), F.grouping("type").alias("all"))
    label = F.when(F.col("all") == 1, F.lit("nodes")).otherwise(F.concat(F.lit("nodes "), F.col("type")))
    edge_rows = edges.agg(F.count("*").alias("n")).select(F.lit("edges").alias("item"), "n")
    return by_label.select(label.alias("item"), "n").unionByName(edge_rows)


def counts_with_total(df: DataFrame, column: str, total: str = "total") -> DataFrame:
    """(column, n) per value plus one total row."""
    rows = df.rollup(column).agg(F.count("*").alias("n"), F.grouping(column).alias("all"))
    return rows.select(F.when(F.col("all") == 1, F.lit(total)).otherwise(F.col(column)).alias(column), "n")


def _example(field: T.StructField) -> Column:
    """A column as example text: long texts cut, nested values by their size."""
    c = F.col(field.name)
    if isinstance(field.dataType, T.ArrayType):
        return F.when(c.isNotNull(), F.concat(F.lit("list["), F.size(c), F.lit("]")))
    if isinstance(field.dataType, T.MapType):
        return F.when(c.isNotNull(), F.concat(F.lit("dict["), F.size(c), F.lit(" keys]")))
    if isinstance(field.dataType, T.StructType):
        return F.when(c.isNotNull(), F.lit(f"dict[{len(field.dataType.fields)} keys]"))
    return c.cast("string")


def table_profile(df: DataFrame) -> DataFrame:
    """(column, type, non_null, nulls, example_low, example_high), one pass over the table.

    The two examples are the smallest and the largest value as text, so they
    do not depend on row order and need no sample.
    """
    aggregates = [F.count("*").alias("n")]
    for i, field in enumerate(df.schema.fields):
        text = _example(field)
        aggregates += [
            F.count(field.name).alias(f"n{i}"),
            F.min(text).alias(f"lo{i}"),
            F.max(text).alias(f"hi{i}"),
        ]
    rows = F.array(
        *[
            F.struct(
                F.lit(field.name).alias("column"),
                F.lit(field.dataType.simpleString()).alias("type"),
                F.col(f"n{i}").alias("non_null"),
                (F.col("n") - F.col(f"n{i}")).alias("nulls"),
                C.preview(F.col(f"lo{i}"), EXAMPLE_LENGTH).alias("example_low"),
                C.preview(F.col(f"hi{i}"), EXAMPLE_LENGTH).alias("example_high"),
            )
            for i, field in enumerate(df.schema.fields)
        ]
    )
    return df.agg(*aggregates).select(F.inline(rows))


def key_profile(df: DataFrame, json_column: str, top: int | None = None) -> DataFrame:
    """(key, n, example_low, example_high) of the keys of JSON objects, most frequent first; ``top`` cuts the list."""
    entries = df.select(F.explode(F.from_json(json_column, "map<string,string>")).alias("key", "value"))
    counts = entries.groupBy("key").agg(
        F.count("*").alias("n"),
        C.preview(F.min("value"), EXAMPLE_LENGTH).alias("example_low"),
        C.preview(F.max("value"), EXAMPLE_LENGTH).alias("example_high"),
    )
    ordered = counts.orderBy(F.desc("n"), "key")
    return ordered if top is None else ordered.limit(top)


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all), the same ones for the same seed on any partitioning."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def first_per_type(df: DataFrame, type_column: str = "type", order: tuple[str, ...] = ("id",)) -> DataFrame:
    """One verification row per type: the smallest by ``order``."""
    return first_per_key(df, [type_column], list(order))


def union_reports(*reports: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, reports)
