"""Hierarchy, taxonomy, term dictionary, yearly snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from vinculum.operators import taxonomy as ops
from workload import standin as T
from workload.registry import query


def pad(c, n: int):
    return F.lpad(F.col(c).cast("string"), n, "0")


def descriptors(spark, sf):
    """Descriptors of regions (one has none), nations and customers with dotted tree numbers.

    Rich customers carry a second disease number in another region, poor
    ones a number outside the disease branch as well.
    """
    nation, region = T.table(spark, sf, "nation"), T.table(spark, sf, "region")
    customer = T.table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    top = F.concat(F.lit("C"), pad("n_regionkey", 2))
    own = F.concat_ws(".", top, pad("n_nationkey", 3), pad("c_custkey", 7))
    second = F.concat(F.lit("C00.900."), pad("c_custkey", 7))
    outside = F.concat(F.lit("F01."), pad("c_custkey", 7))
    no_text = F.lit(None).cast("string")
    customers = customer.select(
        F.concat(F.lit("D"), pad("c_custkey", 7)).alias("id"),
        F.col("c_name").alias("name"),
        F.array_compact(
            F.array(own, F.when(F.col("c_acctbal") > 5000, second), F.when(F.col("c_acctbal") < 0, outside))
        ).alias("tree_numbers"),
        F.lower("c_mktsegment").alias("description"),
        F.array("c_mktsegment", F.upper("c_name"), "n_name").alias("synonyms"),
    )
    nations = nation.select(
        F.concat(F.lit("N"), pad("n_nationkey", 3)).alias("id"),
        F.col("n_name").alias("name"),
        F.array(F.concat_ws(".", top, pad("n_nationkey", 3))).alias("tree_numbers"),
        no_text.alias("description"),
        F.array(F.lower("n_name")).alias("synonyms"),
    )
    regions = region.where("r_regionkey <> 2").select(
        F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("id"),
        F.col("r_name").alias("name"),
        F.array(F.concat(F.lit("C"), pad("r_regionkey", 2))).alias("tree_numbers"),
        no_text.alias("description"),
        F.array().cast("array<string>").alias("synonyms"),
    )
    return customers.unionByName(nations).unionByName(regions)


TREES_SQL = """descriptors AS (
  SELECT 'D' || lpad(c_custkey::VARCHAR, 7, '0') AS id, c_name AS name,
    list_filter(['C' || lpad(n_regionkey::VARCHAR, 2, '0') || '.' || lpad(n_nationkey::VARCHAR, 3, '0') || '.' || lpad(c_custkey::VARCHAR, 7, '0'),
      CASE WHEN c_acctbal > 5000 THEN 'C00.900.' || lpad(c_custkey::VARCHAR, 7, '0') END,
      CASE WHEN c_acctbal < 0 THEN 'F01.' || lpad(c_custkey::VARCHAR, 7, '0') END], lambda x: x IS NOT NULL) AS tree_numbers,
    lower(c_mktsegment) AS description, [c_mktsegment, upper(c_name), n_name] AS synonyms
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'N' || lpad(n_nationkey::VARCHAR, 3, '0'), n_name,
    ['C' || lpad(n_regionkey::VARCHAR, 2, '0') || '.' || lpad(n_nationkey::VARCHAR, 3, '0')], NULL, [lower(n_name)] FROM nation
  UNION ALL SELECT 'R' || r_regionkey, r_name, ['C' || lpad(r_regionkey::VARCHAR, 2, '0')], NULL, []::VARCHAR[]
  FROM region WHERE r_regionkey <> 2),
numbers AS (SELECT id, name, unnest(tree_numbers) AS tn, unnest(generate_series(0, len(tree_numbers) - 1)) AS pos FROM descriptors),
branch AS (SELECT * FROM numbers WHERE starts_with(tn, 'C')),
pairs AS (SELECT DISTINCT array_to_string(list_slice(p, 1, i), '.') AS parent, array_to_string(list_slice(p, 1, i + 1), '.') AS child
  FROM (SELECT string_split(tn, '.') AS p, unnest(generate_series(1, len(string_split(tn, '.')) - 1)) AS i FROM branch WHERE contains(tn, '.'))),
owners AS (SELECT tn, min(id) AS descriptor_id, arg_min(name, id) AS name FROM numbers GROUP BY tn),
tree AS (SELECT n.tn AS tree_number,
    coalesce(o.name, CASE WHEN regexp_full_match(n.tn, '[A-Za-z]') THEN 'Category ' || n.tn ELSE 'Unknown Node (' || n.tn || ')' END) AS name,
    o.descriptor_id, (SELECT count(*) FROM pairs WHERE parent = n.tn) AS children
  FROM (SELECT parent AS tn FROM pairs UNION SELECT child FROM pairs) n LEFT JOIN owners o ON o.tn = n.tn),
parents AS (SELECT b.id, min(b.pos) AS pos, t.descriptor_id AS parent_id, arg_min(t.name, b.pos) AS parent_name,
    arg_min(t.tree_number, b.pos) AS parent_number
  FROM branch b JOIN tree t ON t.tree_number = regexp_replace(b.tn, '\\.[^.]*$', '') WHERE contains(b.tn, '.')
  GROUP BY b.id, t.descriptor_id, coalesce(t.descriptor_id, t.tree_number))"""


@query("tree_hierarchy", f"WITH {TREES_SQL} SELECT parent, child FROM pairs")
def tree_hierarchy(spark, sf):
    return ops.hierarchy_pairs(descriptors(spark, sf))


@query("hierarchy_labels", f"WITH {TREES_SQL} SELECT tree_number, name, descriptor_id, children FROM tree")
def hierarchy_labels(spark, sf):
    rows = descriptors(spark, sf)
    return ops.hierarchy_nodes(ops.hierarchy_pairs(rows), rows)


@query(
    "child_only_numbers",
    f"WITH {TREES_SQL} SELECT DISTINCT child AS tree_number FROM pairs WHERE child NOT IN (SELECT parent FROM pairs)",
)
def child_only_numbers(spark, sf):
    return ops.child_only_numbers(ops.hierarchy_pairs(descriptors(spark, sf)))


@query("tree_number_owners", f"WITH {TREES_SQL} SELECT tn AS tree_number, descriptor_id, name FROM owners")
def tree_number_owners(spark, sf):
    return ops.number_owners(descriptors(spark, sf))


@query(
    "taxonomy_parents", f"WITH {TREES_SQL} SELECT id, pos::INTEGER AS pos, parent_id, parent_name, parent_number FROM parents"
)
def taxonomy_parents(spark, sf):
    rows = descriptors(spark, sf)
    return ops.parent_rows(rows, ops.hierarchy_nodes(ops.hierarchy_pairs(rows), rows))


@query(
    "taxonomy",
    f"""WITH {TREES_SQL}, p AS (SELECT id, string_agg(coalesce(parent_id, '-') || '=' || parent_name, ';' ORDER BY pos) AS parents FROM parents GROUP BY id)
SELECT d.id, d.name, d.description, array_to_string(list_filter(tree_numbers, lambda t: starts_with(t, 'C')), ',') AS tree_numbers,
  array_to_string(synonyms, ',') AS synonyms, coalesce(p.parents, '') AS parents,
  len(list_filter(tree_numbers, lambda t: starts_with(t, 'C') AND contains(t, '.'))) = 0 AS is_top_level
FROM descriptors d LEFT JOIN p ON p.id = d.id WHERE len(list_filter(tree_numbers, lambda t: starts_with(t, 'C'))) > 0""",
)
def taxonomy(spark, sf):
    rows = descriptors(spark, sf)
    out = ops.extract_taxonomy(rows, ops.hierarchy_nodes(ops.hierarchy_pairs(rows), rows))
    text = F.transform("parents", lambda p: F.concat_ws("=", F.coalesce(p["id"], F.lit("-")), p["name"]))
    return out.select(
        "id", "name", "description", F.array_join("tree_numbers", ",").alias("tree_numbers"),
        F.array_join("synonyms", ",").alias("synonyms"), F.array_join(text, ";").alias("parents"), "is_top_level",
    )


@query(
    "term_dictionary",
    f"""WITH {TREES_SQL}, terms AS (
  SELECT lower(name) AS term, id, true AS is_name FROM descriptors
  UNION ALL SELECT lower(unnest(synonyms)), id, false FROM descriptors)
SELECT term, coalesce(max(id) FILTER (WHERE is_name), min(id) FILTER (WHERE NOT is_name)) AS id FROM terms GROUP BY term""",
)
def term_dictionary(spark, sf):
    return ops.term_dictionary(descriptors(spark, sf))


def yearly(spark, sf):
    """One snapshot row per customer and year: the priority of the year's last order, blank when open."""
    orders = T.table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    last = F.max_by(F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")).otherwise(F.lit("")), "o_orderkey")
    rows = orders.groupBy(T.key("C", "o_custkey").alias("id"), "year").agg(last.alias("name"))
    return rows.select("id", "year", "name")


YEARLY_SQL = """yearly AS (SELECT 'C' || o_custkey AS id, year(o_orderdate)::INTEGER AS year,
  arg_max(CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority ELSE '' END, o_orderkey) AS name FROM orders GROUP BY 1, 2)"""


@query("latest_year_wins", f"WITH {YEARLY_SQL} SELECT id, max(year) AS year, arg_max(name, year) AS name FROM yearly GROUP BY id")
def latest_year_wins(spark, sf):
    return ops.latest_per_key(yearly(spark, sf))


@query(
    "disease_lookup",
    f"""WITH {YEARLY_SQL}, l AS (SELECT id, max(year) AS year, arg_max(name, year) AS name FROM yearly GROUP BY id)
SELECT * FROM l WHERE name <> ''""",
)
def disease_lookup(spark, sf):
    return ops.disease_lookup(yearly(spark, sf))
