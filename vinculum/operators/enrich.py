"""Enrichment of drug records from the vocabulary and from structure data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vinculum.functions import columns as C
from vinculum.functions.ranking import first_per_key

# Structure columns that also replace empty values.
ESSENTIAL = (
    "molecular_formula", "exact_mass", "molecular_weight_rdkit", "logp", "tpsa", "canonical_smiles",
    "inchikey_rdkit", "lipinski_violations", "lipinski_compliant",
)


def enrich_vocabulary(
    drugs: DataFrame, vocabulary: DataFrame | None, fields: tuple[str, ...] = ("inchikey", "unii", "cas_number")
) -> DataFrame:
    """Fill empty ``fields`` and merge pipe-separated synonyms.

    Synonyms become the sorted union when the vocabulary has some, else they
    stay as they were. The basic variant passes two fields only.
    """
    if vocabulary is None:
        return drugs
    side = vocabulary.select(
        F.col("drugbank_id").alias("_id"),
        *[F.col(f).alias(f"_{f}") for f in fields],
        F.split("synonyms", r"\|").alias("_synonyms"),
    ).where(F.col("_id").isNotNull())
    side = first_per_key(side, ["_id"], side.columns[1:])
    merged = F.array_sort(F.array_union(F.coalesce("synonyms", F.array().cast("array<string>")), "_synonyms"))
    updates = {f: C.fill_blank(F.col(f), F.col(f"_{f}")) for f in fields}
    updates["synonyms"] = F.when(F.col("_synonyms").isNotNull(), merged).otherwise(F.col("synonyms"))
    joined = drugs.join(side, drugs["drugbank_id"] == side["_id"], "left")
    return joined.withColumns(updates).drop("_id", "_synonyms", *[f"_{f}" for f in fields])


def structure_columns(descriptors: DataFrame) -> DataFrame:
    """Add the rule-of-five columns to a descriptor table."""
    rules = C.rule_of_five(
        F.col("molecular_weight_rdkit"), F.col("logp"), F.col("h_bond_donors"), F.col("h_bond_acceptors")
    )
    return descriptors.withColumns(rules)


def _falsy(name: str, data_type: T.DataType):
    c = F.col(name)
    if isinstance(data_type, T.StringType):
        return c.isNull() | (c == "")
    if isinstance(data_type, T.BooleanType):
        return c.isNull() | ~c
    if isinstance(data_type, T.NumericType):
        return c.isNull() | (c == 0)
    return c.isNull()


def enrich_structure(drugs: DataFrame, structures: DataFrame | None) -> DataFrame:
    """Add structure columns by drug id and the flag ``has_structure_data``.

    Essential columns also fill missing or empty values of columns the
    drugs already have; any other column is only added where it is new.
    """
    if structures is None:
        return drugs.withColumn("has_structure_data", F.lit(False))
    names = [c for c in structures.columns if c != "drug_id"]
    side = structures.select("drug_id", *[F.col(c).alias(f"_s_{c}") for c in names])
    columns = {}
    for name in names:
        if name not in drugs.columns:
            columns[name] = F.col(f"_s_{name}")
        elif name in ESSENTIAL:
            empty = _falsy(name, drugs.schema[name].dataType) & F.col("drug_id").isNotNull()
            columns[name] = F.when(empty, F.coalesce(f"_s_{name}", name)).otherwise(F.col(name))
    columns["has_structure_data"] = F.col("drug_id").isNotNull()
    joined = drugs.join(side, drugs["drugbank_id"] == side["drug_id"], "left")
    return joined.withColumns(columns).drop("drug_id", *[f"_s_{c}" for c in names])
