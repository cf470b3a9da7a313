"""Clean-up of node and edge tables for import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns that hold boolean-like text, and columns that hold lists.
BOOLEAN_COLUMNS = ("has_structure_data", "lipinski_compliant", "isApproved", "hasBeenWithdrawn")
LIST_COLUMNS = ("mesh_terms", "tree_numbers")


def json_list(items: Column) -> Column:
    """JSON text of a list of texts, items separated by comma and blank."""
    quoted = F.transform(items, lambda i: F.regexp_extract(F.to_json(F.array(i)), r"(?s)^\[(.*)\]$", 1))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def _protein_ids(c: Column, data_type: T.DataType) -> Column:
    entries = F.from_json(c, "array<struct<id: string>>") if isinstance(data_type, T.StringType) else c
    ids = F.transform(F.filter(entries, lambda e: e.isNotNull()), lambda e: F.coalesce(e["id"], F.lit("")))
    return F.coalesce(json_list(ids), F.lit("[]"))


def _boolean(c: Column, data_type: T.DataType) -> Column:
    """true/false text as boolean, anything else null."""
    if isinstance(data_type, T.BooleanType):
        return c
    text = F.lower(c.cast("string"))
    return F.when(text == "true", F.lit(True)).when(text == "false", F.lit(False))


def _fill(c: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.StringType):
        return F.coalesce(c, F.lit(""))
    if isinstance(data_type, T.NumericType):
        return F.coalesce(c, F.lit(0).cast(data_type))
    return c


def clean_nodes(nodes: DataFrame) -> DataFrame:
    """Names fall back to the id, booleans typed, id lists as JSON, gaps filled."""
    out = {}
    for field in nodes.schema.fields:
        c, data_type = F.col(field.name), field.dataType
        if field.name == "name":
            out[field.name] = F.coalesce("name", "id")
        elif field.name in BOOLEAN_COLUMNS:
            out[field.name] = _boolean(c, data_type)
        elif field.name == "proteinIds":
            out[field.name] = _protein_ids(c, data_type)
        elif field.name in LIST_COLUMNS:
            text = c if isinstance(data_type, T.StringType) else json_list(c)
            out[field.name] = F.coalesce(text, F.lit("[]"))
        else:
            out[field.name] = _fill(c, data_type)
    return nodes.select(*[column.alias(name) for name, column in out.items()])


def clean_edges(edges: DataFrame) -> DataFrame:
    """``max_phase`` numeric, ``actions`` a JSON list, gaps filled."""
    out = {}
    for field in edges.schema.fields:
        c = F.col(field.name)
        if field.name == "max_phase":
            out[field.name] = F.coalesce(c.try_cast("double"), F.lit(0.0))
        elif field.name == "actions":
            bracketed = c.startswith("[") & c.endswith("]")
            out[field.name] = F.when(c.isNull(), F.lit("[]")).when(bracketed, c).otherwise(json_list(F.array(c)))
        else:
            out[field.name] = _fill(c, field.dataType)
    return edges.select(*[column.alias(name) for name, column in out.items()])
