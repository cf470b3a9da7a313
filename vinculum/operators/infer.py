"""Pathway-disease links inferred through shared targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinculum.functions.ranking import first_rows
from vinculum.operators.edges import edge
from vinculum.operators.harmonise import harmonise
from vinculum.session import write_through

# Fixed value: with the guard on, a target with more (disease, pathway) combinations is left out.
MAX_COMBINATIONS = 10_000

# A target with more combinations is split into parts of about this many.
PART_COMBINATIONS = 1_000_000


def target_disease_pairs(associations: DataFrame, disease_map: DataFrame | None = None) -> DataFrame:
    """Distinct (target, disease) with harmonised disease ids and raw target ids."""
    rows = harmonise(associations.select("targetId", "diseaseId"), "diseaseId", disease_map)
    return rows.select(F.col("targetId").alias("target"), F.col("diseaseId").alias("disease")).distinct()


def target_pathway_pairs(targets: DataFrame) -> DataFrame:
    """Distinct (target, pathway) from the nested pathway lists."""
    rows = targets.select(F.col("id").alias("target"), F.explode("pathways.pathwayId").alias("pathway"))
    return rows.where(F.col("pathway").isNotNull()).distinct()


def shared_targets(diseases: DataFrame, pathways: DataFrame) -> DataFrame:
    """Targets with both, and how many distinct diseases and pathways each has."""
    n_diseases = diseases.groupBy("target").agg(F.count("*").alias("diseases"))
    n_pathways = pathways.groupBy("target").agg(F.count("*").alias("pathways"))
    return n_diseases.join(n_pathways, "target")


def guarded_targets(diseases: DataFrame, pathways: DataFrame, max_combinations: int = MAX_COMBINATIONS) -> DataFrame:
    """(target, diseases, pathways) of the targets that the guard leaves out."""
    return shared_targets(diseases, pathways).where(F.col("diseases") * F.col("pathways") > max_combinations)


def link_pathways(
    diseases: DataFrame, pathways: DataFrame, max_combinations: int | None = None, part_combinations: int = PART_COMBINATIONS
) -> DataFrame:
    """(pathway, disease, support, via_target) over distinct pairs.

    ``support`` counts the shared targets, ``via_target`` is the smallest. The pairs are stored
    and counted by target. Targets are numbered in their order, as Spark sorts all combinations
    to find the least of texts, and hashes them to find the least of numbers. A target with more combinations than ``part_combinations`` has its
    diseases dealt to as many parts as its size asks for, each of which meets all its pathways;
    the others are joined as they are. With a guard, larger targets are left out before the join
    (``guarded_targets`` names them).
    """
    diseases, pathways = write_through(diseases, "target-diseases"), write_through(pathways, "target-pathways")
    sizes = shared_targets(diseases, pathways).withColumn("n", F.col("diseases") * F.col("pathways"))
    if max_combinations is not None:
        sizes = sizes.where(F.col("n") <= max_combinations)
    # Numbers that follow the order of the targets: the smallest is found without comparing texts.
    numbered = sizes.repartitionByRange("target").sortWithinPartitions("target").withColumn("number", F.monotonically_increasing_id())
    numbered = write_through(numbered, "shared-targets")
    parts = F.ceil(F.col("n") / part_combinations).cast("int").alias("parts")
    hot = write_through(numbered.where(F.col("n") > part_combinations).select("target", parts), "hot-targets")
    pathways = pathways.join(numbered.select("target", "number"), "target")
    by = ["target"]
    if not hot.isEmpty():
        part = F.pmod(F.xxhash64("disease"), F.coalesce("parts", F.lit(1))).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
        diseases = diseases.join(hot, "target", "left").withColumn("part", part).drop("parts")
        pathways = pathways.join(hot, "target", "left").withColumn("part", every).drop("parts")
        by = ["target", "part"]
    links = diseases.join(pathways, by).groupBy("pathway", "disease").agg(F.count("*").alias("support"), F.min("number").alias("number"))
    via = numbered.select("number", F.col("target").alias("via_target"))
    return links.join(via, "number").select("pathway", "disease", "support", "via_target")


def inferred_edges(links: DataFrame, cap: int | None = None) -> DataFrame:
    """ASSOCIATED_WITH edges of the links; ``cap`` keeps the best supported ones."""
    if cap is not None:
        links = first_rows(links, [F.desc("support"), F.col("pathway"), F.col("disease")], cap)
    return links.select(
        *edge(
            F.col("pathway"),
            F.col("disease"),
            "ASSOCIATED_WITH",
            ("Pathway", "Disease"),
            via_target=F.col("via_target"),
            data_source="OpenTargets_Inferred",
        )
    )
