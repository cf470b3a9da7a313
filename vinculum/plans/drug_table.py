"""Drug dump -> integrated drug table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vinculum.operators.enrich import enrich_structure, enrich_vocabulary
from vinculum.operators.quality import distribution, drug_statistics, missing_report
from vinculum.sources import drugs as source
from vinculum.sources.sinks import write_records
from pyspark.sql import functions as F


def integrated_drugs(
    spark: SparkSession,
    xml: str,
    vocabulary: str | None = None,
    structures: DataFrame | None = None,
    include_experimental: bool = True,
    limit: int | None = None,
) -> DataFrame:
    """Records enriched with the vocabulary and with structure data (keyed by ``drug_id``)."""
    records = source.read_drugs(spark, xml, include_experimental, limit)
    terms = source.read_vocabulary(spark, vocabulary) if vocabulary else None
    return enrich_structure(enrich_vocabulary(records, terms), structures)


def sdf_structures(spark: SparkSession, path: str) -> DataFrame | None:
    """SDF properties as structure columns."""
    sdf = source.read_sdf(spark, path)
    if sdf is None:
        return None
    pick = lambda name: F.try_element_at("props", F.lit(name))
    return sdf.select(
        "drug_id",
        F.col("title").alias("molecule_name"),
        F.coalesce(pick("FORMULA"), pick("JCHEM_FORMULA")).alias("molecular_formula"),
        pick("EXACT_MASS").try_cast("double").alias("exact_mass"),
        F.col("props").alias("sdf_properties"),
    )


def quality_reports(drugs: DataFrame) -> dict[str, DataFrame]:
    return {
        "statistics": drug_statistics(drugs),
        "missing": missing_report(drugs),
        "groups": distribution(drugs, F.col("groups"), "group"),
        "states": distribution(drugs, F.col("state"), "state", "unknown"),
    }


def build(spark: SparkSession, xml: str, vocabulary: str, sdf: str, output: str, format: str = "parquet", **options) -> str | None:
    """Parse, enrich and store; the path written, or ``None`` when there is nothing."""
    table = integrated_drugs(spark, xml, vocabulary, sdf_structures(spark, sdf), **options)
    return write_records(table, f"{output}/drugbank_parsed.{format}", format)
