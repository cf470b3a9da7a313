"""Disease-taxonomy XML: descriptors, qualifiers, supplementary records by year."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vinculum import schemas
from vinculum.functions import columns as C
from vinculum.functions.ranking import top_k
from vinculum.sources import readers

# Fixed value: tree numbers of the disease branch start with this letter.
DISEASE_PREFIXES = ("C",)


def _in_branch(tree_number: Column, prefixes=DISEASE_PREFIXES) -> Column:
    hit = F.lit(False)
    for prefix in prefixes:
        hit = hit | tree_number.startswith(prefix)
    return hit


def project_descriptors(raw: DataFrame, keep=(), prefixes=DISEASE_PREFIXES) -> DataFrame:
    """Descriptors with id and name and at least one tree number in the branch.

    The note comes from the record, else from its preferred concept.
    """
    concepts = F.col("ConceptList.Concept")
    preferred = F.try_element_at(F.filter(concepts, lambda c: c["_PreferredConceptYN"] == "Y"), F.lit(1))
    terms = F.flatten(F.transform(concepts, lambda c: F.coalesce(c["TermList"]["Term"]["String"], F.array())))
    qualifiers = F.transform(
        F.col("AllowableQualifierList.AllowableQualifier"), lambda q: q["QualifierReferredTo"]["QualifierUI"]
    )
    rows = raw.select(
        *keep,
        F.col("DescriptorUI").alias("id"),
        F.col("DescriptorName.String").alias("name"),
        C.clean_list(F.col("TreeNumberList.TreeNumber")).alias("tree_numbers"),
        F.coalesce(C.clean_text(F.col("ScopeNote")), C.clean_text(preferred["ScopeNote"])).alias("description"),
        F.array_sort(F.array_distinct(C.clean_list(terms))).alias("synonyms"),
        C.clean_list(qualifiers).alias("allowed_qualifiers"),
    )
    in_branch = F.exists("tree_numbers", lambda t: _in_branch(t, prefixes))
    return _valid(rows).where(in_branch).withColumn("is_disease", F.lit(True))


def project_qualifiers(raw: DataFrame, keep=()) -> DataFrame:
    return _valid(
        raw.select(
            *keep,
            F.col("QualifierUI").alias("id"),
            F.col("QualifierName.String").alias("name"),
            C.clean_list(F.col("TreeNumberList.TreeNumber")).alias("tree_numbers"),
            C.clean_text(F.col("ScopeNote")).alias("description"),
        )
    )


def project_supplementary(raw: DataFrame, keep=()) -> DataFrame:
    def referred(column: str) -> Column:
        return C.clean_list(F.transform(F.col(column), lambda r: r["DescriptorReferredTo"]["DescriptorUI"]))

    return _valid(
        raw.select(
            *keep,
            F.col("SupplementalRecordUI").alias("id"),
            F.col("SupplementalRecordName.String").alias("name"),
            referred("HeadingMappedToList.HeadingMappedTo").alias("mapped_descriptors"),
            referred("PharmacologicalActionList.PharmacologicalAction").alias("pharmacological_actions"),
        )
    )


def _valid(rows: DataFrame) -> DataFrame:
    return rows.where(~C.is_blank(F.col("id")) & ~C.is_blank(F.col("name")))


# File-name stem -> (row tag, schema, projection).
KINDS = {
    "desc": ("DescriptorRecord", schemas.DESCRIPTOR_XML, project_descriptors),
    "qual": ("QualifierRecord", schemas.QUALIFIER_XML, project_qualifiers),
    "supp": ("SupplementalRecord", schemas.SUPPLEMENTARY_XML, project_supplementary),
}


def available_years(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct years found in the names of the folder's XML files, ascending."""
    files = spark.read.format("binaryFile").load(f"{folder}/*.xml").select("path")
    years = files.select(C.year_of_file(F.col("path")).alias("year"))
    return years.where(F.col("year").isNotNull()).distinct().orderBy("year")


def _paths(spark: SparkSession, folder: str, kind: str, years: Sequence[int] | int | None) -> list[str]:
    """The files of one kind: of all years, or of those named; a year that has none is left out."""
    if years is None:
        return [f"{folder}/{kind}*.xml"]
    wanted = [years] if isinstance(years, int) else sorted(set(years))
    return [f"{folder}/{kind}{year}.xml" for year in wanted]


def read_kind(spark: SparkSession, folder: str, kind: str, year: Sequence[int] | int | None = None, limit: int | None = None) -> DataFrame | None:
    """One record kind of one year, some years, or every year, with a ``year`` column; other files are not opened.

    ``limit`` keeps the first records of each year by id.
    """
    row_tag, schema, project = KINDS[kind]
    scans = [readers.optional(lambda p=path: readers.read_xml(spark, p, row_tag, schema)) for path in _paths(spark, folder, kind, year)]
    scans = [x for x in scans if x is not None]
    if not scans:
        return None
    raw = reduce(DataFrame.unionByName, scans)
    rows = project(readers.good_rows(raw, C.year_of_file(F.col("file")).alias("year")), ["year"])
    return top_k(rows, ["year"], [F.col("id")], limit).drop("rank") if limit else rows


def read_years(
    spark: SparkSession,
    folder: str,
    year: Sequence[int] | int | None = None,
    include_supplementary: bool = True,
    limit: int | None = None,
) -> dict[str, DataFrame]:
    """Descriptors (mandatory), qualifiers and supplementary records (left out when absent)."""
    kinds = {"descriptors": "desc", "qualifiers": "qual"}
    if include_supplementary:
        kinds["supplementary"] = "supp"
    found = {name: read_kind(spark, folder, kind, year, limit) for name, kind in kinds.items()}
    if found["descriptors"] is None:
        raise FileNotFoundError(f"no descriptor file in {folder}" + (f" for {year}" if year else ""))
    return {name: df for name, df in found.items() if df is not None}
