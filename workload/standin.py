"""Graph roles played by the driver's tables.

Drug = part, Target = supplier, Pathway = p_type or nation, Disease =
customer; associations, indications and mechanisms come from lineitem and
orders. Nested source columns are built inside one row, never by
collecting the rows of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vinculum.session import write_through


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt to all tasks: a small table that becomes much text is often one file and so one task."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def key(prefix: str, c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.lit(prefix), c.cast("string"))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem")


def lines_orders(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    return lines(spark, sf).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def lines_parts(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))


def associations(spark: SparkSession, sf: str) -> DataFrame:
    return lines_orders(spark, sf).select(
        key("S", "l_suppkey").alias("targetId"),
        key("C", "o_custkey").alias("diseaseId"),
        F.when(F.col("l_tax") > 0, F.col("l_discount")).alias("score"),
        F.col("l_linestatus").alias("datasourceId"),
    )


def target_pathways(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct (target, pathway)."""
    rows = lines_parts(spark, sf).select(key("S", "l_suppkey").alias("target"), F.col("p_type").alias("pathway"))
    return rows.distinct()


def nested_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Target rows with nested pathways: one row per line, its part's type as the pathway."""
    pathway = F.struct(F.col("p_type").alias("pathwayId"), F.col("p_brand").alias("pathway"))
    no_id = F.struct(F.lit(None).cast("string").alias("pathwayId"), F.lit("none").alias("pathway"))
    return lines_parts(spark, sf).select(key("S", "l_suppkey").alias("id"), F.array(pathway, no_id).alias("pathways"))


def known_drugs(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).select(
        key("P", "l_partkey").alias("drugId"),
        key("S", "l_suppkey").alias("targetId"),
        F.col("l_returnflag").alias("evidence"),
    )


def indications(spark: SparkSession, sf: str) -> DataFrame:
    entry = F.struct(
        key("C", "o_custkey").alias("disease"),
        F.col("o_orderpriority").alias("efoName"),
        F.when(F.col("l_linenumber") > 1, F.col("l_linenumber").cast("double")).alias("maxPhaseForIndication"),
    )
    no_disease = F.struct(
        F.lit(None).cast("string").alias("disease"),
        F.lit("none").alias("efoName"),
        F.lit(1.0).alias("maxPhaseForIndication"),
    )
    return lines_orders(spark, sf).select(
        key("P", "l_partkey").alias("id"), F.array(entry, no_disease).alias("indications")
    )


def mechanisms(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).select(
        F.array(key("P", "l_partkey"), key("P", F.col("l_partkey") + 1)).alias("chemblIds"),
        F.array(key("S", "l_suppkey"), key("S", "l_linenumber")).alias("targets"),
        F.col("l_returnflag").alias("actionType"),
        F.col("l_linestatus").alias("mechanismOfAction"),
        F.lit(None).cast("string").alias("targetName"),
        F.lit("single protein").alias("targetType"),
    )


def disease_map_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Id map entries with duplicate keys; ``ord`` is their order."""
    urgent = table(spark, sf, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    return urgent.select(key("C", "o_custkey").alias("key"), key("H", "o_orderkey").alias("value"), F.col("o_orderkey").alias("ord"))


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """(id, type, name, description) of all four labels."""
    part, supplier, customer = (table(spark, sf, t) for t in ("part", "supplier", "customer"))
    row = lambda i, label, name, text: [
        i.alias("id"), F.lit(label).alias("type"), name.alias("name"), text.alias("description")
    ]
    drugs = part.select(*row(key("P", "p_partkey"), "Drug", F.col("p_name"), F.concat_ws(" ", "p_brand", "p_type")))
    targets = supplier.select(*row(key("S", "s_suppkey"), "Target", F.col("s_name"), key("nation ", "s_nationkey")))
    diseases = customer.select(*row(key("C", "c_custkey"), "Disease", F.col("c_name"), F.lower("c_mktsegment")))
    types = part.select("p_type").distinct()
    pathways = types.select(*row(F.col("p_type"), "Pathway", F.lower("p_type"), F.lit("part type")))
    return drugs.unionByName(targets).unionByName(diseases).unionByName(pathways)


NODES_SQL = """
nodes AS (
  SELECT 'P' || p_partkey AS id, 'Drug' AS type, p_name AS name, p_brand || ' ' || p_type AS description FROM part
  UNION ALL SELECT 'S' || s_suppkey, 'Target', s_name, 'nation ' || s_nationkey FROM supplier
  UNION ALL SELECT 'C' || c_custkey, 'Disease', c_name, lower(c_mktsegment) FROM customer
  UNION ALL SELECT DISTINCT p_type, 'Pathway', lower(p_type), 'part type' FROM part)"""


def path_edges(spark: SparkSession, sf: str, *kinds: str) -> DataFrame:
    """Distinct (source, target, type, source_type, target_type) of the kinds asked for."""
    part, target, disease = key("P", "l_partkey"), key("S", "l_suppkey"), key("C", "o_custkey")
    nation = lambda c: key("N", c)
    pairs = {  # rows, their two keys, the ends these become
        "drug_target": lambda: (lines(spark, sf), ("l_partkey", "l_suppkey"), (part, target, "TARGETS", "Drug", "Target")),
        "drug_disease": lambda: (lines_orders(spark, sf), ("l_partkey", "o_custkey"), (part, disease, "INDICATED_FOR", "Drug", "Disease")),
        "rare_indication": lambda: (lines_orders(spark, sf).where("l_linenumber = 7"), ("l_partkey", "o_custkey"), (part, disease, "INDICATED_FOR", "Drug", "Disease")),
        "target_pathway": lambda: (lines_parts(spark, sf), ("l_suppkey", "p_type"), (target, F.col("p_type"), "INVOLVED_IN", "Target", "Pathway")),
        "target_disease": lambda: (lines_orders(spark, sf), ("l_suppkey", "o_custkey"), (target, disease, "ASSOCIATED_WITH", "Target", "Disease")),
        "target_nation": lambda: (table(spark, sf, "supplier"), ("s_suppkey", "s_nationkey"), (key("S", "s_suppkey"), nation("s_nationkey"), "INVOLVED_IN", "Target", "Pathway")),
        "nation_disease": lambda: (table(spark, sf, "customer"), ("c_nationkey", "c_custkey"), (nation("c_nationkey"), key("C", "c_custkey"), "ASSOCIATED_WITH", "Pathway", "Disease")),
    }

    def build(kind: str) -> DataFrame:
        """Keys are made distinct as they are, before they become text; each text comes from one key."""
        rows, keys, (source, end, type_, *labels) = pairs[kind]()
        named = [F.lit(v).alias(c) for v, c in zip((type_, *labels), ("type", "source_type", "target_type"), strict=True)]
        return rows.select(*keys).distinct().select(source.alias("source"), end.alias("target"), *named)

    frames = [build(k) for k in kinds]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def stored_edges(spark: SparkSession, sf: str, *kinds: str) -> DataFrame:
    """``path_edges`` as a stored table, as the graph build leaves it."""
    return write_through(path_edges(spark, sf, *kinds), "edges")


PATH_EDGE_SQL = {
    "drug_target": "SELECT DISTINCT 'P' || l_partkey AS source, 'S' || l_suppkey AS target, 'TARGETS' AS type, 'Drug' AS source_type, 'Target' AS target_type FROM lineitem",
    "drug_disease": "SELECT DISTINCT 'P' || l_partkey AS source, 'C' || o_custkey AS target, 'INDICATED_FOR' AS type, 'Drug' AS source_type, 'Disease' AS target_type FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "rare_indication": "SELECT DISTINCT 'P' || l_partkey AS source, 'C' || o_custkey AS target, 'INDICATED_FOR' AS type, 'Drug' AS source_type, 'Disease' AS target_type FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 7",
    "target_pathway": "SELECT DISTINCT 'S' || l_suppkey AS source, p_type AS target, 'INVOLVED_IN' AS type, 'Target' AS source_type, 'Pathway' AS target_type FROM lineitem JOIN part ON l_partkey = p_partkey",
    "target_disease": "SELECT DISTINCT 'S' || l_suppkey AS source, 'C' || o_custkey AS target, 'ASSOCIATED_WITH' AS type, 'Target' AS source_type, 'Disease' AS target_type FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "target_nation": "SELECT DISTINCT 'S' || s_suppkey AS source, 'N' || s_nationkey AS target, 'INVOLVED_IN' AS type, 'Target' AS source_type, 'Pathway' AS target_type FROM supplier",
    "nation_disease": "SELECT DISTINCT 'N' || c_nationkey AS source, 'C' || c_custkey AS target, 'ASSOCIATED_WITH' AS type, 'Pathway' AS source_type, 'Disease' AS target_type FROM customer",
}


def path_edges_sql(*kinds: str) -> str:
    return "edges AS (" + " UNION ALL ".join(PATH_EDGE_SQL[k] for k in kinds) + ")"


def disease_queries(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, query): the name of the richest customer of each segment."""
    customer = table(spark, sf, "customer")
    best = customer.groupBy("c_mktsegment").agg(F.max_by("c_name", F.struct("c_acctbal", "c_custkey")).alias("query"))
    return best.select(F.concat(F.lit("segment "), "c_mktsegment").alias("query_id"), "query")


def drug_queries(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, query): the name of the first part of each type."""
    part = table(spark, sf, "part")
    first = part.groupBy("p_type").agg(F.min_by("p_name", "p_partkey").alias("query"))
    return first.select(F.concat(F.lit("type "), "p_type").alias("query_id"), "query")


def name_parts(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, query): the last three characters of every customer name, and short words of part names."""
    ends = table(spark, sf, "customer").select(F.right("c_name", F.lit(3)).alias("query"))
    words = table(spark, sf, "part").select(F.left("p_name", F.lit(2)).alias("query"))
    return ends.unionByName(words).distinct().select(F.col("query").alias("query_id"), "query")


NAME_PARTS_SQL = """SELECT query AS query_id, query FROM (
  SELECT right(c_name, 3) AS query FROM customer UNION SELECT left(p_name, 2) FROM part)"""

DISEASE_QUERIES_SQL = """SELECT 'segment ' || c_mktsegment AS query_id,
  arg_max(c_name, (c_acctbal, c_custkey)) AS query FROM customer GROUP BY c_mktsegment"""
DRUG_QUERIES_SQL = "SELECT 'type ' || p_type AS query_id, arg_min(p_name, p_partkey) AS query FROM part GROUP BY p_type"
