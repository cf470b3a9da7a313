"""Format-level scans shared by the source modules."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vinculum import schemas
from vinculum.sources.xml_records import xml_records

CORRUPT = "_corrupt_record"


def file_order() -> Column:
    """Sort key that follows the order of rows in the files, however they are split."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def optional(load):
    """Run a loader; ``None`` when its path does not exist."""
    try:
        return load()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str, nested_in: str | None = None) -> DataFrame:
    """(file, text, record, malformed): one parsed struct per ``row_tag`` element of large XML files.

    Spark's XML source reads a file in one task and gives up on the rest of
    it at the first malformed element. Here the text is cut at record
    boundaries, which splits a file over many tasks, and each record is
    parsed on its own: a malformed one is marked and costs nothing else.

    Where elements of the same name are nested inside ``nested_in``, records are found by
    ``xml_records``, which knows nesting, comments and CDATA.
    """
    if nested_in:
        records = xml_records(spark, path, row_tag, nested_in)
    else:
        opening, close = rf"<{row_tag}[\s>]", f"</{row_tag}>"
        chunks = spark.read.option("lineSep", close).text(path).select("value", F.col("_metadata.file_path").alias("file"))
        text = F.concat(F.regexp_extract("value", rf"(?s){opening}.*", 0), F.lit(close))
        records = chunks.where(F.col("value").rlike(opening)).select("file", text.alias("text"), F.lit(False).alias("lost"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    # The explode of one item keeps later filters from repeating the parsing.
    parsed = F.array(F.from_xml("text", f"{schema}, {CORRUPT} string", options))
    records = records.select("file", "text", "lost", F.explode_outer(parsed).alias("record"))
    malformed = F.col("lost") | F.col(f"record.{CORRUPT}").isNotNull()
    return records.select("file", "text", "record", malformed.alias("malformed"))


def good_rows(parsed: DataFrame, *keep: Column) -> DataFrame:
    """Fields of the well-formed records, after the columns of ``keep``."""
    return parsed.where(~F.col("malformed")).select(*keep, "record.*").drop(CORRUPT)


def reject_rows(parsed: DataFrame) -> DataFrame:
    """(file, text) of the malformed records."""
    return parsed.where("malformed").select("file", "text")


def read_table(spark: SparkSession, path: str, schema: str | None = None, skip_corrupt: bool = False) -> DataFrame | None:
    """A parquet table or directory; ``None`` when absent.

    A file that cannot be read fails the job, unless ``skip_corrupt`` asks for the rest without it.
    """
    reader = spark.read.option("ignoreCorruptFiles", str(skip_corrupt).lower())
    if schema:
        reader = reader.schema(schema)
    return optional(lambda: reader.parquet(path))


def valid_associations(rows: DataFrame) -> DataFrame:
    """Four columns; both ids non-empty and a score present."""
    keep = (F.col("targetId") != "") & (F.col("diseaseId") != "") & F.col("score").isNotNull()
    return rows.select("targetId", "diseaseId", "score", "datasourceId").where(keep & ~F.isnan("score"))


def read_associations(spark: SparkSession, path: str, skip_corrupt: bool = False) -> DataFrame | None:
    """Target-disease associations of a parquet directory."""
    rows = read_table(spark, path, schemas.ASSOCIATION, skip_corrupt)
    return None if rows is None else valid_associations(rows)


def read_id_map(spark: SparkSession, path: str) -> DataFrame | None:
    """Id map CSV with columns ``index`` and ``0`` as (key, value); the last duplicate wins."""
    raw = optional(lambda: spark.read.option("header", True).schema("`index` string, `0` string").csv(path))
    if raw is None:
        return None
    rows = raw.select(F.col("index").alias("key"), F.col("0").alias("value"), file_order().alias("ord"))
    return last_value_per_key(rows.where(F.col("key").isNotNull()))


def last_value_per_key(rows: DataFrame) -> DataFrame:
    """(key, value) with the value of the largest ``ord`` for each key."""
    return rows.groupBy("key").agg(F.max_by("value", "ord").alias("value"))


def read_list_map(spark: SparkSession, path: str) -> DataFrame | None:
    """JSON object of arrays as (key, value) with the first item of each list; the last of equal keys wins.

    The object is cut behind each list, so its entries are parsed in many
    tasks; ids hold no closing bracket.
    """
    raw = optional(lambda: spark.read.option("lineSep", "]").text(path))
    if raw is None:
        return None
    raw = raw.select("value", file_order().alias("ord"))
    entry = F.concat(F.lit("{"), F.regexp_replace("value", r"^[\s,{]+", ""), F.lit("]}"))
    entries = raw.select("ord", F.explode(F.from_json(entry, "map<string,array<string>>")).alias("key", "items"))
    # A struct, since max_by leaves out values that are null.
    first = F.struct(F.try_element_at("items", F.lit(1)).alias("value"))
    return entries.groupBy("key").agg(F.max_by(first, "ord").alias("v")).select("key", "v.value")


def read_graph_csv(spark: SparkSession, path: str) -> DataFrame:
    """Reload node or edge CSV files written by ``sinks``."""
    return spark.read.option("header", True).option("escape", '"').csv(path)
