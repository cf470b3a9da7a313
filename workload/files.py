"""Tables written by the sinks and read back, optional and malformed inputs, loads by year."""

from __future__ import annotations

from pyspark.sql import functions as F

from vinculum.operators import quality
from vinculum.operators import taxonomy as ops
from vinculum.plans import taxonomy_tables
from vinculum.session import scratch_dir
from vinculum.sources import drugs, readers, sinks, taxonomy
from workload import standin as T
from workload.dumps import YEARS_SQL, _odd_dump, descriptor_dump, yearly_dump
from workload.registry import query
from workload.tables import DRUGS_SQL, drug_records
from workload.trees import TREES_SQL


@query("drug_xml_rejects", "SELECT 'DB' || p_partkey AS drugbank_id FROM part WHERE p_size < 10")
def drug_xml_rejects(spark, sf):
    """Records of small parts hold a tag that is never closed; these and no others are rejects."""
    broken = F.when(F.col("p_size") < 10, F.lit("<description>")).otherwise(F.lit(""))
    rejects = drugs.read_rejects(spark, _odd_dump(spark, sf, "drug-xml-broken", broken))
    return rejects.select(F.regexp_extract("text", "<drugbank-id>(.*?)</", 1).alias("drugbank_id"))


@query(
    "drug_xml_lists",
    """SELECT 'DB' || p_partkey AS drugbank_id, 'A' || p_size || ',B01' AS atc_codes, p_brand || ',' || p_type AS categories,
  'SMP' || p_size || '/' || p_brand || '/' AS pathways FROM part""",
)
def drug_xml_lists(spark, sf):
    codes = F.concat(F.lit("<atc-codes><atc-code><code>A"), F.col("p_size"), F.lit("</code></atc-code><atc-code><code> B01 </code></atc-code></atc-codes>"))
    item = lambda c: F.concat(F.lit("<category><category>"), c, F.lit("</category></category>"))
    groups = F.concat(F.lit("<categories>"), item(F.col("p_brand")), item(F.col("p_type")), F.lit("</categories>"))
    pathway = F.concat(F.lit("<pathways><pathway><smpdb-id>SMP"), F.col("p_size"), F.lit("</smpdb-id><name>"), F.col("p_brand"), F.lit("</name><category> </category></pathway></pathways>"))
    rows = drugs.read_drugs(spark, _odd_dump(spark, sf, "drug-xml-lists", F.concat(codes, groups, pathway)))
    way = F.transform("pathways", lambda p: F.concat_ws("/", p["smpdb_id"], p["name"], F.coalesce(p["category"], F.lit(""))))
    join = lambda c: F.array_join(c, ",")
    return rows.select("drugbank_id", join("atc_codes").alias("atc_codes"), join("categories").alias("categories"), join(way).alias("pathways"))


@query("optional_table", "SELECT o_orderkey, o_orderpriority FROM orders")
def optional_table(spark, sf):
    """A table that is there is read whole, one that is not is None."""
    if readers.read_table(spark, f"{sf}/no such table.parquet") is not None:
        raise AssertionError("an absent table was found")
    return readers.read_table(spark, f"{sf}/orders.parquet").select("o_orderkey", "o_orderpriority")


@query(
    "list_map_scan",
    "SELECT 'S' || s_suppkey AS key, CASE WHEN s_nationkey <> 3 THEN 'U' || s_nationkey END AS value FROM supplier",
)
def list_map_scan(spark, sf):
    """One JSON object over many lines, a supplier's list each; some lists are empty."""
    items = F.when(F.col("s_nationkey") != 3, F.concat(F.lit('"U'), F.col("s_nationkey"), F.lit('", "V"'))).otherwise(F.lit(""))
    line = F.concat(F.lit('"S'), F.col("s_suppkey"), F.lit('": ['), items, F.lit("],"))
    path = scratch_dir(spark, "list-map")
    T.table(spark, sf, "supplier").select(line.alias("value")).write.text(path)
    return readers.read_list_map(spark, path)


@query(
    "drug_table_sink",
    f"""WITH {DRUGS_SQL} SELECT drugbank_id, name, array_to_string("groups", ',') AS "groups", n_targets::INTEGER AS targets, f AS format
FROM drugs, (VALUES ('parquet'), ('json')) AS t(f)""",
)
def drug_table_sink(spark, sf):
    """Drug records in both formats; an empty table writes nothing."""
    records, folder = drug_records(spark, sf), scratch_dir(spark, "drug-table")
    if sinks.write_records(records.where("false"), f"{folder}/none") is not None:
        raise AssertionError("an empty table was written")
    out = []
    for kind in sinks.FORMATS:
        path = sinks.write_records(records, f"{folder}/{kind}", kind)
        rows = spark.read.schema(records.schema).format(kind).load(path)
        out.append(rows.select("drugbank_id", "name", F.array_join("groups", ",").alias("groups"), F.coalesce(F.size("targets"), F.lit(0)).alias("targets"), F.lit(kind).alias("format")))
    return out[0].unionByName(out[1])


@query(
    "taxonomy_bundle_sink",
    f"WITH {YEARS_SQL} SELECT year, id, name FROM valid",
)
def taxonomy_bundle_sink(spark, sf):
    """The bundle of all years, partitioned by year; a part without rows is left out."""
    found = taxonomy.read_kind(spark, yearly_dump(spark, sf), "desc")
    folder = scratch_dir(spark, "bundle")
    written = sinks.write_taxonomy_bundle({"descriptors": found, "terms": found.where("false")}, folder, "all")
    if written["terms"] is not None:
        raise AssertionError("an empty table was written")
    rows = spark.read.schema(found.schema).parquet(written["descriptors"])
    return rows.select("year", "id", "name")


@query(
    "taxonomy_sink",
    f"""WITH {TREES_SQL} SELECT id, name, array_to_string(list_filter(tree_numbers, lambda t: starts_with(t, 'C')), ',') AS numbers
FROM descriptors WHERE len(list_filter(tree_numbers, lambda t: starts_with(t, 'C'))) > 0""",
)
def taxonomy_sink(spark, sf):
    folder = scratch_dir(spark, "mesh")
    descriptor_dump(spark, sf, folder)
    found = taxonomy.read_kind(spark, folder, "desc", 2025)
    pairs = ops.hierarchy_pairs(found)
    table = ops.extract_taxonomy(found, ops.hierarchy_nodes(pairs, found))
    path = sinks.write_records(table, f"{folder}/taxonomy", "json")
    rows = spark.read.schema(table.schema).json(path)
    own = F.filter("tree_numbers", lambda t: t.startswith("C"))
    return rows.select("id", "name", F.array_join(own, ",").alias("numbers"))


@query(
    "association_sink",
    """SELECT 'S' || l_suppkey AS "targetId", 'C' || o_custkey AS "diseaseId", l_discount AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_tax > 0""",
)
def association_sink(spark, sf):
    rows = readers.valid_associations(T.associations(spark, sf))
    path = sinks.write_records(rows, scratch_dir(spark, "associations"))
    return readers.read_associations(spark, path).select("targetId", "diseaseId", "score")


@query(
    "optimised_csv",
    f"""WITH {T.NODES_SQL} SELECT 'node' AS record, id AS a, coalesce(name, id) AS b, type AS c FROM nodes
UNION ALL SELECT DISTINCT 'edge', 'P' || l_partkey, 'S' || l_suppkey, 'TARGETS' FROM lineitem""",
)
def optimised_csv(spark, sf):
    edges = T.path_edges(spark, sf, "drug_target").select("source", "target", "type")
    written = sinks.write_optimised_csv(T.nodes(spark, sf), edges, scratch_dir(spark, "optimised"))
    read = lambda name: readers.read_graph_csv(spark, written[name])
    nodes = read("nodes").select(F.lit("node").alias("record"), F.col("id").alias("a"), F.col("name").alias("b"), F.col("type").alias("c"))
    return nodes.unionByName(read("edges").select(F.lit("edge").alias("record"), F.col("source").alias("a"), F.col("target").alias("b"), F.col("type").alias("c")))


@query("report_sink", f"WITH {T.NODES_SQL} SELECT coalesce('nodes ' || type, 'nodes') AS item, count(*) AS n FROM nodes GROUP BY ROLLUP (type) UNION ALL SELECT 'edges', 0")
def report_sink(spark, sf):
    nodes = T.nodes(spark, sf)
    report = quality.build_summary(nodes, nodes.where("false"))
    path = sinks.write_report(report, scratch_dir(spark, "report"))
    return spark.read.schema(report.schema).json(path)


@query(
    "mesh_limited",
    f"""WITH {TREES_SQL} SELECT id, name FROM descriptors WHERE len(list_filter(tree_numbers, lambda t: starts_with(t, 'C'))) > 0
ORDER BY id LIMIT 50""",
)
def mesh_limited(spark, sf):
    """The record limit is what this query checks."""
    folder = scratch_dir(spark, "mesh")
    descriptor_dump(spark, sf, folder)
    return taxonomy_tables.year_tables(spark, folder, 2025, limit=50)["descriptors"].select("id", "name")


@query(
    "mesh_some_years",
    f"WITH {YEARS_SQL} SELECT id, year, name, year = 1998 AS is_latest FROM valid WHERE year IN (1996, 1998)",
)
def mesh_some_years(spark, sf):
    tables = taxonomy_tables.all_year_tables(spark, yearly_dump(spark, sf), years=[1996, 1998, 1850])
    latest = tables["latest_descriptors"].select("id", "year", F.lit(True).alias("_latest"))
    rows = tables["descriptors"].join(latest, ["id", "year"], "left")
    return rows.select("id", "year", "name", F.col("_latest").isNotNull().alias("is_latest"))


@query("mesh_incremental", f"WITH {YEARS_SQL} SELECT id, year, name FROM valid WHERE year IN (1996, 1997, 1998)")
def mesh_incremental(spark, sf):
    """Two years stored, then one more and one of them again: every year is there once."""
    folder, store = yearly_dump(spark, sf), scratch_dir(spark, "reference")
    taxonomy_tables.load_years(spark, folder, store, [1996, 1997])
    return taxonomy_tables.load_years(spark, folder, store, [1997, 1998]).select("id", "year", "name")
