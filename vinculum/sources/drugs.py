"""Drug sources: XML records, vocabulary CSV, SDF property blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vinculum import schemas
from vinculum.functions import columns as C
from vinculum.functions.ranking import first_per_key
from vinculum.sources import readers

# Development groups that the approved-only switch removes.
UNAPPROVED_GROUPS = ("experimental", "investigational")

# SDF properties that may hold the drug id, in order of preference.
SDF_ID_PROPERTIES = ("DATABASE_ID", "DRUGBANK_ID", "ID")

# Output name -> XML child, for plain text children.
TEXT_FIELDS = {
    "name": "name",
    "description": "description",
    "cas_number": "cas-number",
    "unii": "unii",
    "state": "state",
    "indication": "indication",
    "pharmacodynamics": "pharmacodynamics",
    "mechanism_of_action": "mechanism-of-action",
    "toxicity": "toxicity",
    "metabolism": "metabolism",
    "absorption": "absorption",
    "half_life": "half-life",
    "protein_binding": "protein-binding",
    "route_of_elimination": "route-of-elimination",
}

# The narrower record of the basic scan.
BASIC_FIELDS = (
    "drugbank_id", "name", "description", "cas_number", "unii", "inchikey", "state", "groups",
    "indication", "pharmacodynamics", "mechanism_of_action", "synonyms",
    "targets", "enzymes", "transporters", "carriers",
)


def relations(entries: Column) -> Column:
    """Protein relations with the first UniProt id among the external ids."""

    def one(e: Column) -> Column:
        external = e["polypeptide"]["external-identifiers"]["external-identifier"]
        uniprot = F.try_element_at(F.filter(external, lambda x: C.strip(x["resource"]) == "UniProtKB"), F.lit(1))
        return F.struct(
            C.clean_text(e["id"]).alias("id"),
            C.clean_text(e["name"]).alias("name"),
            C.clean_text(e["organism"]).alias("organism"),
            C.clean_list(e["actions"]["action"]).alias("actions"),
            C.clean_text(uniprot["identifier"]).alias("uniprot_id"),
        )

    return F.coalesce(F.transform(entries, one), F.array().cast(f"array<{schemas.RELATION}>"))


def _pathways(entries: Column) -> Column:
    projected = F.transform(
        entries,
        lambda p: F.struct(
            C.clean_text(p["smpdb-id"]).alias("smpdb_id"),
            C.clean_text(p["name"]).alias("name"),
            C.clean_text(p["category"]).alias("category"),
        ),
    )
    return F.coalesce(projected, F.array().cast("array<struct<smpdb_id: string, name: string, category: string>>"))


def _codes(entries: Column, field: str) -> Column:
    return F.coalesce(F.transform(entries, lambda e: C.clean_text(e[field])), F.array().cast("array<string>"))


def project_records(raw: DataFrame, include_experimental: bool = True, last_property: bool = True) -> DataFrame:
    """Drug records from raw XML rows; rows without an id are dropped.

    With ``include_experimental=False`` a drug goes as soon as one of its
    groups is unapproved, even when it is approved as well.
    """
    props = F.col("calculated-properties.property")
    records = raw.select(
        C.primary_id(F.col("drugbank-id")).alias("drugbank_id"),
        *[C.clean_text(F.col(f"`{child}`")).alias(name) for name, child in TEXT_FIELDS.items()],
        C.pick_property(props, "InChIKey", last_property).alias("inchikey"),
        C.pick_property(props, "Molecular Weight").alias("molecular_weight"),
        C.pick_property(props, "SMILES").alias("smiles"),
        C.clean_list(F.col("groups.group")).alias("groups"),
        _codes(F.col("atc-codes.atc-code"), "code").alias("atc_codes"),
        _codes(F.col("categories.category"), "category").alias("categories"),
        C.clean_list(F.col("synonyms.synonym")).alias("synonyms"),
        _pathways(F.col("pathways.pathway")).alias("pathways"),
        *[relations(F.col(f"{many}.{one}")).alias(many) for many, one in schemas.RELATION_ELEMENTS.items()],
    ).where(F.col("drugbank_id").isNotNull())
    if include_experimental:
        return records
    return records.where(~F.arrays_overlap("groups", F.array(*map(F.lit, UNAPPROVED_GROUPS))))


def scan_xml(spark: SparkSession, path: str) -> DataFrame:
    """Parsed ``drug`` elements, whatever their attributes; those listed in a pathway are not records."""
    return readers.read_xml(spark, path, "drug", schemas.DRUG_XML, nested_in="pathways")


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    return readers.reject_rows(scan_xml(spark, path))


def read_drugs(
    spark: SparkSession, path: str, include_experimental: bool = True, limit: int | None = None
) -> DataFrame:
    """Drug records of an XML dump. Nested ``drug`` elements are not records of their own."""
    raw = readers.good_rows(scan_xml(spark, path))
    records = project_records(raw, include_experimental)
    return records.orderBy("drugbank_id").limit(limit) if limit else records


def read_drugs_basic(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """The 16-field record; here the first InChIKey entry counts, not the last."""
    raw = readers.good_rows(scan_xml(spark, path))
    records = project_records(raw, last_property=False)
    if limit:
        records = records.orderBy("drugbank_id").limit(limit)
    return records.select(*BASIC_FIELDS)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame | None:
    """Vocabulary CSV with library column names; ``None`` when the file is absent."""
    raw = readers.optional(
        lambda: spark.read.option("header", True).option("escape", '"').schema(schemas.VOCABULARY_CSV).csv(path)
    )
    return None if raw is None else raw.withColumnsRenamed(schemas.VOCABULARY_NAMES)


def parse_sdf_records(raw: DataFrame) -> DataFrame:
    """(drug_id, title, props) from SDF record texts in column ``value``.

    A property block is ``> <NAME>`` and the lines up to the next blank
    one. The last of equal names wins.
    """
    header_and_value = r"(?m)^>[^<\n]*+<([^>\n]++)>[^\n]*+\n((?:[ \t]*+\S[^\n]*+(?:\n|\z))*+)"
    text = F.regexp_replace(F.replace("value", F.lit("\r\n"), F.lit("\n")), r"\A\n", "")
    clean = raw.withColumn("_text", text)
    block = F.struct(
        C.clean_text(F.split_part("_text", F.lit("\n"), F.lit(1))).alias("title"),
        F.transform(F.regexp_extract_all("_text", F.lit(header_and_value), F.lit(1)), F.upper).alias("keys"),
        F.transform(F.regexp_extract_all("_text", F.lit(header_and_value), F.lit(2)), C.strip).alias("values"),
    )
    # The explode of one item keeps the filters below from repeating the parsing.
    blocks = clean.select(*raw.columns, F.explode(F.array(block)).alias("b")).select(*raw.columns, "b.*")
    from_end = F.reverse("keys")
    is_last = lambda e, i: (F.size("keys") - F.array_position(from_end, e["keys"])) == i
    entries = F.filter(F.arrays_zip("keys", "values"), is_last)
    mapped = blocks.withColumn("props", F.map_from_entries(entries)).drop("keys", "values")
    by_property = [F.nullif(F.try_element_at("props", F.lit(name)), F.lit("")) for name in SDF_ID_PROPERTIES]
    return mapped.withColumn("drug_id", F.coalesce(*by_property, "title")).where(F.col("drug_id").isNotNull())


def read_sdf(spark: SparkSession, path: str) -> DataFrame | None:
    """SDF properties, one row per drug id; the last record of an id wins."""
    raw = readers.optional(lambda: spark.read.option("lineSep", "$$$$").text(path))
    if raw is None:
        return None
    records = parse_sdf_records(raw.select("value", readers.file_order().alias("ord")))
    latest = first_per_key(records.select("drug_id", "title", "props", "ord"), ["drug_id"], ["ord"], last=True)
    return latest.drop("ord")
