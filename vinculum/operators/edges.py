"""Edge builders, dedupe, orphan removal, label suffixes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vinculum.functions import columns as C
from vinculum.functions.ranking import first_per_key
from vinculum.operators.harmonise import harmonise
from vinculum.schemas import EDGE_COLUMNS

# Edge type of each relation list of a drug record.
RELATION_EDGES = {
    "targets": "TARGETS",
    "enzymes": "METABOLIZED_BY",
    "transporters": "TRANSPORTED_BY",
    "carriers": "CARRIED_BY",
}


def edge(source: Column, target: Column, type_: str | Column, ends: tuple[str, str], **payload: Column | str):
    """Select list of one edge row; payload texts given as ``str`` are literals."""
    as_column = lambda v: F.lit(v) if isinstance(v, str) else v
    named = {
        "source": source,
        "target": target,
        "type": as_column(type_),
        "source_type": F.lit(ends[0]),
        "target_type": F.lit(ends[1]),
        **{name: as_column(value) for name, value in payload.items()},
    }
    return [value.cast(EDGE_COLUMNS[name]).alias(name) for name, value in named.items()]


def known_drug_edges(known_drugs: DataFrame, *target_maps: DataFrame | None) -> DataFrame:
    """TARGETS, one per row of (drugId, targetId[, evidence])."""
    rows = harmonise(known_drugs, "targetId", *target_maps)
    payload = {"evidence": F.col("evidence")} if "evidence" in known_drugs.columns else {}
    return rows.select(*edge(F.col("drugId"), F.col("targetId"), "TARGETS", ("Drug", "Target"), **payload))


def relation_edges(drugs: DataFrame) -> DataFrame:
    """Edges of the four relation lists of drug records, where a UniProt id is known.

    The lists are tagged and flattened inside the row, so the records are
    scanned once and nothing is shuffled.
    """

    def tagged(column: str, type_: str) -> Column:
        return F.transform(column, lambda r: F.struct(F.lit(type_).alias("type"), r.alias("r")))

    lists = [
        F.coalesce(tagged(column, type_), F.array().cast(_tagged_type(drugs, column)))
        for column, type_ in RELATION_EDGES.items()
    ]
    rows = drugs.select("drugbank_id", F.explode(F.concat(*lists)).alias("e")).where(
        ~C.is_blank(F.col("e.r.uniprot_id"))
    )
    return rows.select(
        *edge(
            F.col("drugbank_id"),
            F.col("e.r.uniprot_id"),
            F.col("e.type"),
            ("Drug", "Target"),
            target_name=F.coalesce("e.r.name", F.lit("")),
            actions=C.join_list(F.col("e.r.actions")),
            organism=F.coalesce("e.r.organism", F.lit("")),
            data_source="DrugBank",
        )
    )


def _tagged_type(drugs: DataFrame, column: str) -> str:
    item = drugs.schema[column].dataType.elementType.simpleString()
    return f"array<struct<type: string, r: {item}>>"


def indication_edges(indications: DataFrame, disease_map: DataFrame | None = None) -> DataFrame:
    """INDICATED_FOR from (id, indications[{disease, efoName, maxPhaseForIndication}])."""
    rows = indications.select("id", F.explode("indications").alias("i")).select(
        "id",
        F.col("i.disease").alias("disease"),
        F.coalesce("i.maxPhaseForIndication", F.lit(0)).alias("max_phase"),
        F.coalesce("i.efoName", F.lit("")).alias("efo_name"),
    )
    rows = harmonise(rows.where(~C.is_blank(F.col("disease"))), "disease", disease_map)
    return rows.select(
        *edge(
            F.col("id"),
            F.col("disease"),
            "INDICATED_FOR",
            ("Drug", "Disease"),
            max_phase=F.col("max_phase"),
            efo_name=F.col("efo_name"),
            data_source="OpenTargets_Indications",
        )
    )


def mechanism_edges(mechanisms: DataFrame, *target_maps: DataFrame | None) -> DataFrame:
    """HAS_MECHANISM for every molecule and target listed in one mechanism row."""
    text = ["actionType", "mechanismOfAction", "targetName", "targetType"]
    rows = (
        mechanisms.select("chemblIds", "targets", *[F.coalesce(c, F.lit("")).alias(c) for c in text])
        .withColumn("drug", F.explode("chemblIds"))
        .withColumn("target", F.explode("targets"))
        .drop("chemblIds", "targets")
    )
    return harmonise(rows, "target", *target_maps).select(
        *edge(
            F.col("drug"),
            F.col("target"),
            "HAS_MECHANISM",
            ("Drug", "Target"),
            action_type=F.col("actionType"),
            mechanism=F.col("mechanismOfAction"),
            target_name=F.col("targetName"),
            target_type_detailed=F.col("targetType"),
            data_source="OpenTargets_Mechanism",
        )
    )


def pathway_edges(targets: DataFrame, *target_maps: DataFrame | None) -> DataFrame:
    """INVOLVED_IN from (id, pathways[{pathwayId, pathway}])."""
    rows = targets.select("id", F.explode("pathways").alias("p")).where(~C.is_blank(F.col("p.pathwayId")))
    return harmonise(rows, "id", *target_maps).select(
        *edge(
            F.col("id"),
            F.col("p.pathwayId"),
            "INVOLVED_IN",
            ("Target", "Pathway"),
            pathwayName=F.coalesce("p.pathway", F.lit("")),
        )
    )


def union_edges(*builders: DataFrame | None) -> DataFrame:
    """All builders under one schema; ``builder`` numbers them in the order given.

    The schema has the columns at least one builder has, so rows stay as
    narrow as they can be through the dedupe.
    """
    present = [(i, b) for i, b in enumerate(builders) if b is not None]
    used = {c: t for c, t in EDGE_COLUMNS.items() if any(c in b.columns for _, b in present)}
    parts = [
        b.select(
            F.lit(i).alias("builder"),
            *[F.col(c) if c in b.columns else F.lit(None).cast(t).alias(c) for c, t in used.items()],
        )
        for i, b in present
    ]
    return reduce(DataFrame.unionByName, parts)


def dedupe_edges(edges: DataFrame, keys: Sequence[str] = ("source", "target", "type")) -> DataFrame:
    """One edge per (source, target, type): the earliest builder's, then the smallest payload."""
    payload = [c for c in edges.columns if c not in (*keys, "builder")]
    return first_per_key(edges, list(keys), ["builder", *payload])


LABELS = ("source_label", "target_label")


def label_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes, with the labels of these: one join for each end, for all later steps."""
    for end, label in zip(("source", "target"), LABELS, strict=True):
        side = nodes.select(F.col("id").alias("_id"), F.col("type").alias(label))
        edges = edges.join(side, edges[end] == side["_id"]).drop("_id")
    return edges


def remove_orphans(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select("id")
    kept = edges.join(ids, edges["source"] == ids["id"], "left_semi")
    return kept.join(ids, kept["target"] == ids["id"], "left_semi")


def orphan_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with at least one end missing from the nodes."""
    found = nodes.select("id", F.lit(True).alias("found"))
    for end in ("source", "target"):
        side = found.select(F.col("id").alias(f"_{end}"), F.col("found").alias(f"{end}_found"))
        edges = edges.join(side, edges[end] == side[f"_{end}"], "left").drop(f"_{end}")
    missing = F.col("source_found").isNull() | F.col("target_found").isNull()
    return edges.where(missing).drop("source_found", "target_found")


def suffix_edges(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Both ends as ``id(Label)``. Edges that ``label_ends`` has labelled need no nodes and no join."""
    if nodes is not None:
        edges = label_ends(edges, nodes)
    named = {end: C.with_label(F.col(end), F.col(label)) for end, label in zip(("source", "target"), LABELS, strict=True)}
    return edges.withColumns(named).drop(*LABELS)


def edge_post_pass_counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: edges built, duplicates removed, orphans removed, edges left."""
    unique = edges.groupBy("source", "target", "type").agg(F.count("*").alias("copies"))
    side = nodes.select("id")
    for end in ("source", "target"):
        found = side.select(F.col("id").alias(f"_{end}"))
        unique = unique.join(found, unique[end] == found[f"_{end}"], "left")
    kept = F.col("_source").isNotNull() & F.col("_target").isNotNull()
    return unique.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("built"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates"),
        F.count_if(~kept).alias("orphans"),
        F.count_if(kept).alias("kept"),
    )
