"""Node projections, duplicate merge, counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vinculum.functions import columns as C
from vinculum.functions.ranking import first_per_key
from vinculum.operators.harmonise import harmonise

def _empty() -> Column:
    return F.lit("")



def _text(df: DataFrame, *names: str) -> Column:
    """First non-null of the columns that exist, else the empty text."""
    return F.coalesce(*[F.col(n).cast("string") for n in names if n in df.columns], _empty())


def disease_nodes(
    diseases: DataFrame, disease_map: DataFrame | None = None, descriptors: DataFrame | None = None
) -> DataFrame:
    """Disease nodes with synonyms, note and tree numbers of the matching descriptor."""
    rows = harmonise(diseases, "id", disease_map)
    rows = rows.select("id", F.lit("Disease").alias("type"), _text(rows, "approvedName", "name").alias("name"))
    if descriptors is None:
        empty = F.array().cast("array<string>")
        info = {"mesh_terms": empty, "mesh_description": _empty(), "tree_numbers": empty}
        return rows.withColumns(info)
    side = descriptors.select(
        F.col("id").alias("_id"),
        F.col("synonyms").alias("_terms"),
        F.col("description").alias("_description"),
        F.col("tree_numbers").alias("_numbers"),
    )
    joined = rows.join(side, rows["id"] == side["_id"], "left")
    return joined.select(
        *rows.columns,
        F.coalesce("_terms", F.array().cast("array<string>")).alias("mesh_terms"),
        F.coalesce("_description", _empty()).alias("mesh_description"),
        F.coalesce("_numbers", F.array().cast("array<string>")).alias("tree_numbers"),
    )


def target_nodes(targets: DataFrame, *target_maps: DataFrame | None) -> DataFrame:
    rows = harmonise(targets, "id", *target_maps)
    return rows.select(
        "id", F.lit("Target").alias("type"), _text(rows, "approvedSymbol").alias("symbol"), F.col("proteinIds")
    )


def pathway_nodes(pathways: DataFrame) -> DataFrame:
    """Pathway nodes; the name column of the public table is ``label``."""
    return pathways.select(
        "id",
        F.lit("Pathway").alias("type"),
        _text(pathways, "name", "label").alias("name"),
        _text(pathways, "description").alias("description"),
        F.lit("Reactome").alias("source"),
    )


def drug_record_nodes(drugs: DataFrame) -> DataFrame:
    """Drug nodes of integrated drug records. Structure columns are used where present."""
    text = ["name", "description", "state", "indication", "mechanism_of_action", "pharmacodynamics", "toxicity"]
    has = lambda c: c in drugs.columns
    typed = {
        "molecular_formula": "string",
        "inchi": "string",
        "logp": "double",
        "tpsa": "double",
        "rotatable_bonds": "int",
        "h_bond_donors": "int",
        "h_bond_acceptors": "int",
        "aromatic_rings": "int",
        "heavy_atoms": "int",
        "lipinski_compliant": "boolean",
        "lipinski_violations": "int",
    }
    pick = lambda names, t: F.coalesce(
        *[F.col(n).try_cast(t) for n in names if has(n)], F.lit(None).cast(t)
    )
    return drugs.where(~C.is_blank(F.col("drugbank_id"))).select(
        F.col("drugbank_id").alias("id"),
        F.lit("Drug").alias("type"),
        *[F.coalesce(F.col(c), _empty()).alias(c) for c in text],
        C.join_list(F.col("groups")).alias("groups"),
        C.join_list(F.col("synonyms")).alias("synonyms"),
        (F.coalesce("has_structure_data", F.lit(False)) if has("has_structure_data") else F.lit(False)).alias(
            "has_structure_data"
        ),
        pick(["molecular_weight_rdkit", "molecular_weight"], "double").alias("molecular_weight"),
        F.coalesce(pick(["canonical_smiles", "smiles"], "string"), _empty()).alias("canonical_smiles"),
        F.coalesce(pick(["inchikey_rdkit", "inchikey"], "string"), _empty()).alias("inchikey"),
        *[pick([c], t).alias(c) for c, t in typed.items()],
        C.list_size(F.col("targets")).alias("target_count"),
        C.list_size(F.col("enzymes")).alias("enzyme_count"),
        C.list_size(F.col("transporters")).alias("transporter_count"),
        C.list_size(F.col("carriers")).alias("carrier_count"),
        C.join_list(F.col("atc_codes")).alias("atc_codes"),
        C.join_list(F.col("categories")).alias("categories"),
        C.list_size(F.col("pathways")).alias("pathway_count"),
        F.lit("DrugBank_Enhanced").alias("data_source"),
    )


def molecule_nodes(molecules: DataFrame) -> DataFrame:
    """Drug nodes of the molecule table."""
    return molecules.select(
        "id",
        F.lit("Drug").alias("type"),
        F.coalesce("name", _empty()).alias("name"),
        F.coalesce("drugType", _empty()).alias("drugType"),
        F.coalesce(F.col("maximumClinicalTrialPhase").cast("double"), F.lit(0.0)).alias("maxPhase"),
        *[F.coalesce(c, F.lit(False)).alias(c) for c in ("isApproved", "hasBeenWithdrawn", "blackBoxWarning")],
        F.col("yearOfFirstApproval").cast("long").alias("yearOfFirstApproval"),
        F.coalesce("canonicalSmiles", _empty()).alias("canonicalSmiles"),
        F.coalesce("inchiKey", _empty()).alias("inchiKey"),
        C.join_list(F.col("synonyms")).alias("synonyms"),
        C.join_list(F.col("tradeNames")).alias("tradeNames"),
        F.coalesce("linkedDiseases.count", F.lit(0)).alias("linkedDiseases"),
        F.coalesce("linkedTargets.count", F.lit(0)).alias("linkedTargets"),
        F.lit("ChEMBL_OpenTargets").alias("data_source"),
    )


def union_nodes(*parts: DataFrame | None) -> DataFrame:
    """All node frames under one wide schema; ``ord`` numbers them in build order."""
    present = [p.withColumn("ord", F.lit(i)) for i, p in enumerate(parts) if p is not None]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), present)


def _counts(c: Column, data_type: T.DataType) -> Column:
    """Whether a value can win a merge: present, and not blank, zero, false or empty."""
    if isinstance(data_type, T.StringType):
        return ~C.is_blank(c) & (c != "None")
    if isinstance(data_type, T.BooleanType):
        return c
    if isinstance(data_type, T.NumericType):
        return c != 0
    if isinstance(data_type, (T.ArrayType, T.MapType)):
        return F.size(c) > 0
    return c.isNotNull()


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One node per id out of all entries, in ``ord`` order.

    Texts: the longest trimmed usable value, the earliest of equal length.
    Others: the earliest usable value. Without a usable value the first
    entry's stays. The label is the first entry's. One aggregation with
    map-side combine; entries with equal ``ord`` are ordered by a content hash.
    """
    values = [f for f in nodes.schema.fields if f.name not in ("id", "type", "ord")]
    content = [F.to_json(f.name) if isinstance(f.dataType, T.MapType) else F.col(f.name) for f in values]
    first = F.struct("ord", "_content")
    aggregates = [F.min_by("type", first).alias("type")]
    for f in values:
        c, ok = F.col(f.name), F.coalesce(_counts(F.col(f.name), f.dataType), F.lit(False))
        if isinstance(f.dataType, T.StringType):
            rank = F.struct(-F.length(C.strip(c)), "ord", "_content")
        else:
            rank = first
        aggregates.append(F.coalesce(F.min_by(c, F.when(ok, rank)), F.min_by(c, first)).alias(f.name))
    return nodes.withColumn("_content", F.xxhash64("type", *content)).groupBy("id").agg(*aggregates)


def merge_counts(nodes: DataFrame) -> DataFrame:
    """One row: ids with duplicates, entries merged into them, ids in all."""
    per_id = nodes.groupBy("id").agg(F.count("*").alias("n"))
    return per_id.agg(
        F.count_if(F.col("n") > 1).alias("duplicated_ids"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("entries_merged"),
        F.count("*").alias("ids"),
    )


def drop_identical(nodes: DataFrame) -> DataFrame:
    """Drop rows equal in all columns compared as text; a row with a value stays before one with null."""
    text = {f"_t_{f.name}": C.as_text(F.col(f.name), f.dataType.simpleString()) for f in nodes.schema.fields}
    values = F.transform(F.array(*(F.col(c).isNull() for c in nodes.columns)), lambda empty: empty.cast("int"))
    ranked = nodes.withColumns(text).withColumn("_nulls", values)
    return first_per_key(ranked, list(text), ["_nulls"]).select(*nodes.columns)
