"""Writers: record tables, bulk-import CSV, search corpus, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vinculum.functions import columns as C
from vinculum.operators.cleanup import clean_edges, clean_nodes

FORMATS = ("parquet", "json")

# CSV columns after the id, label, name and data source, by label.
NODE_EXTRAS = {
    "Drug": ("indication", "mechanism_of_action", "synonyms", "canonical_smiles", "molecular_weight", "state"),
    "Disease": ("mesh_description", "mesh_terms"),
    "Target": ("symbol", "proteinIds"),
    "Pathway": ("description", "source"),
}
# Edge CSV payload columns.
EDGE_EXTRAS = (
    "data_source", "evidence", "target_name", "actions", "organism",
    "max_phase", "efo_name", "pathwayName", "via_target",
)


def write_records(df: DataFrame, path: str, format: str = "parquet", partition_by: tuple[str, ...] = ()) -> str | None:
    """Write a record table; nothing is written, and ``None`` returned, when it is empty."""
    if format not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    if df.isEmpty():
        return None
    df.write.mode("overwrite").partitionBy(*partition_by).format(format).save(path)
    return path


def write_taxonomy_bundle(bundle: dict[str, DataFrame], path: str, version: str, format: str = "parquet") -> dict[str, str | None]:
    """One table per record kind, partitioned by year; the folder name carries the version."""
    return {
        name: write_records(df, f"{path}/mesh_data_{version}/{name}", format, ("year",) if "year" in df.columns else ())
        for name, df in bundle.items()
    }


def _cell(df: DataFrame, name: str) -> Column:
    """CSV cell: text on one line, null and absent columns empty."""
    if name not in df.columns:
        return F.lit("")
    return C.one_line(C.as_text(F.col(name), df.schema[name].dataType.simpleString()))


def node_csv_rows(nodes: DataFrame, label: str) -> DataFrame:
    """Rows of one label under bulk-import headers."""
    extras = NODE_EXTRAS.get(label, ())
    return nodes.where(F.col("type") == label).select(
        C.with_label(F.col("id"), F.col("type")).alias("id:ID"),
        F.col("type").alias(":LABEL"),
        *[_cell(nodes, name).alias(f"{name}:string") for name in ("name", "data_source", *extras)],
    )


def edge_csv_rows(edges: DataFrame) -> DataFrame:
    """Edge rows under bulk-import headers; the ends must carry their labels already."""
    return edges.select(
        F.col("source").alias(":START_ID"),
        F.col("target").alias(":END_ID"),
        F.col("type").alias(":TYPE"),
        *[_cell(edges, name).alias(f"{name}:string") for name in EDGE_EXTRAS],
    )


def _write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    return path


def write_node_csv(nodes: DataFrame, path: str, labels: tuple[str, ...] = tuple(NODE_EXTRAS)) -> dict[str, str]:
    """One CSV folder per label."""
    return {label: _write_csv(node_csv_rows(nodes, label), f"{path}/nodes_{label.lower()}") for label in labels}


def write_edge_csv(edges: DataFrame, path: str) -> str:
    return _write_csv(edge_csv_rows(edges), f"{path}/edges")


def write_optimised_csv(nodes: DataFrame, edges: DataFrame, path: str) -> dict[str, str]:
    """Cleaned node and edge tables with plain column names."""
    as_rows = lambda df: df.select(*[_cell(df, c).alias(c) for c in df.columns])
    return {
        "nodes": _write_csv(as_rows(clean_nodes(nodes)), f"{path}/nodes_optimized"),
        "edges": _write_csv(as_rows(clean_edges(edges)), f"{path}/edges_optimized"),
    }


def write_corpus(corpus: DataFrame, path: str) -> str:
    corpus.write.mode("overwrite").partitionBy("collection").parquet(path)
    return path


def write_report(report: DataFrame, path: str) -> str:
    report.write.mode("overwrite").json(path)
    return path
