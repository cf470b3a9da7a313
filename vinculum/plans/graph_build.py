"""Source tables -> node and edge tables -> bulk-import CSV."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vinculum.operators import edges as E
from vinculum.operators import infer, nodes as N
from vinculum.operators.quality import build_summary
from vinculum.schemas import EDGE_COLUMNS
from vinculum.session import drop_stored, write_through
from vinculum.sources import readers, sinks


@dataclass
class Sources:
    """Input frames of a build. A missing one leaves its branch out."""

    target: DataFrame | None = None
    disease: DataFrame | None = None
    known_drug: DataFrame | None = None
    reactome: DataFrame | None = None
    drug_molecule: DataFrame | None = None
    association_overall_direct: DataFrame | None = None
    drug_indication: DataFrame | None = None
    drug_mechanism_of_action: DataFrame | None = None
    drugs: DataFrame | None = None
    descriptors: DataFrame | None = None
    disease_map: DataFrame | None = None
    target_map: DataFrame | None = None
    uniprot_map: DataFrame | None = None

    @classmethod
    def read(cls, spark: SparkSession, folder: str, mappings: str, **frames: DataFrame) -> "Sources":
        """Parquet tables by name and the three id maps; ``frames`` adds drugs and descriptors."""
        own = ("drugs", "descriptors", "disease_map", "target_map", "uniprot_map")
        tables = {f.name: readers.read_table(spark, f"{folder}/{f.name}.parquet") for f in fields(cls) if f.name not in own}
        maps = {
            "disease_map": readers.read_id_map(spark, f"{mappings}/disease_mapping.csv"),
            "target_map": readers.read_id_map(spark, f"{mappings}/target_mapping.csv"),
            "uniprot_map": readers.read_list_map(spark, f"{mappings}/ensembl_to_uniprot_full.json"),
        }
        return cls(**{**tables, **maps, **frames})


def _if(frame: DataFrame | None, build):
    return None if frame is None else build(frame)


def build_nodes(s: Sources) -> DataFrame:
    """All nodes merged by id, in the order diseases, targets, pathways, drug records, molecules."""
    return N.merge_nodes(
        N.union_nodes(
            _if(s.disease, lambda d: N.disease_nodes(d, s.disease_map, s.descriptors)),
            _if(s.target, lambda t: N.target_nodes(t, s.target_map, s.uniprot_map)),
            _if(s.reactome, N.pathway_nodes),
            _if(s.drugs, N.drug_record_nodes),
            _if(s.drug_molecule, N.molecule_nodes),
        )
    )


def build_edges(s: Sources, max_combinations: int | None = None, same_target_ids: bool = True) -> DataFrame:
    """Edges of all builders, not yet deduped."""
    groups = edge_groups(s, max_combinations, same_target_ids)
    return E.union_edges(*[builder for group in groups for builder in group])


def edge_groups(s: Sources, max_combinations: int | None = None, same_target_ids: bool = True) -> list[list[DataFrame | None]]:
    """The builders in order, in groups that have no edge type in common, so that none repeats an edge of another.

    ``same_target_ids`` gives edge targets the UniProt fallback target nodes
    have; without it such edges keep their raw id and end as orphans.
    """
    target_maps = (s.target_map, s.uniprot_map) if same_target_ids else (s.target_map,)
    inferred = None
    if s.association_overall_direct is not None and s.target is not None:
        inferred = infer.inferred_edges(
            infer.link_pathways(
                infer.target_disease_pairs(s.association_overall_direct, s.disease_map),
                infer.target_pathway_pairs(s.target),
                max_combinations,
            )
        )
    return [
        [_if(s.known_drug, lambda k: E.known_drug_edges(k, *target_maps)), _if(s.drugs, E.relation_edges)],
        [_if(s.drug_indication, lambda i: E.indication_edges(i, s.disease_map))],
        [_if(s.drug_mechanism_of_action, lambda m: E.mechanism_edges(m, *target_maps))],
        [_if(s.target, lambda t: E.pathway_edges(t, *target_maps))],
        [inferred],
    ]


def build_graph(s: Sources, **options) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): merged nodes, deduped edges with both ends among them and their labels.

    Each table is stored once, since every later step reads it again; the edges group by group, deduped
    and then labelled, so that what a step shuffles is gone when the next begins. The two joins that find
    orphans bring the labels the CSV needs.
    """
    nodes = write_through(build_nodes(s), "nodes")
    groups = [[b for b in group if b is not None] for group in edge_groups(s, **options)]
    inferred = len(groups) - 1  # links are one for each pathway and disease: nothing repeats
    kept = []
    for i, group in enumerate(groups):
        if group:
            edges = E.union_edges(*group)
            deduped = write_through((edges if i == inferred else E.dedupe_edges(edges)).drop("builder"), "deduped")
            kept.append(write_through(E.label_ends(deduped, nodes), "edges"))
            drop_stored(deduped)
    used = {c: t for c, t in EDGE_COLUMNS.items() if any(c in k.columns for k in kept)}
    same = [k.select(*[F.col(c) if c in k.columns else F.lit(None).cast(t).alias(c) for c, t in used.items()], *E.LABELS) for k in kept]
    return nodes, reduce(DataFrame.unionByName, same)


def write_graph(nodes: DataFrame, edges: DataFrame, output: str) -> DataFrame:
    """Import CSV of nodes and edges; returns the build summary."""
    sinks.write_node_csv(nodes, output)
    sinks.write_edge_csv(E.suffix_edges(edges), output)
    return build_summary(nodes, edges)
