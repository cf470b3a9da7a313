"""Edge building, inference, orphan removal, path search."""

from __future__ import annotations

from pyspark.sql import functions as F

from vinculum.functions.ranking import first_per_key
from vinculum.operators import edges as E
from vinculum.operators import infer
from vinculum.operators import paths as P
from vinculum.operators.harmonise import harmonise
from vinculum.sources.readers import last_value_per_key
from workload import standin as T
from workload.registry import query

ASSOCIATION_PAIRS = "SELECT DISTINCT 'S' || l_suppkey AS target, 'C' || o_custkey AS disease FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
PATHWAY_PAIRS = "SELECT DISTINCT 'S' || l_suppkey AS target, p_type AS pathway FROM lineitem JOIN part ON l_partkey = p_partkey"


def _inference_sql(guard: int | None) -> str:
    having = f"WHERE d.n * p.n <= {guard}" if guard is not None else ""
    return f"""
WITH td AS ({ASSOCIATION_PAIRS}), tp AS ({PATHWAY_PAIRS}),
kept AS (
  SELECT d.target FROM (SELECT target, count(*) AS n FROM td GROUP BY target) d
  JOIN (SELECT target, count(*) AS n FROM tp GROUP BY target) p ON d.target = p.target {having})
SELECT pathway, disease, count(*) AS support, min(td.target) AS via_target
FROM td JOIN tp ON td.target = tp.target JOIN kept ON kept.target = td.target
GROUP BY pathway, disease"""


def _inference(spark, sf, guard):
    return infer.link_pathways(
        infer.target_disease_pairs(T.associations(spark, sf)), T.target_pathways(spark, sf), guard
    )


@query("pathway_disease_inference", _inference_sql(None))
def pathway_disease_inference(spark, sf):
    return _inference(spark, sf, None)


@query("pathway_disease_guarded", _inference_sql(2_900))
def pathway_disease_guarded(spark, sf):
    """A guard that keeps some of the targets and drops the others, on the whole tables."""
    return _inference(spark, sf, 2_900)


@query("pathway_disease_unguarded", _inference_sql(None))
def pathway_disease_unguarded(spark, sf):
    return _inference(spark, sf, None)


@query(
    "guarded_targets",
    f"""WITH td AS ({ASSOCIATION_PAIRS}), tp AS ({PATHWAY_PAIRS})
SELECT d.target, d.n AS diseases, p.n AS pathways
FROM (SELECT target, count(*) AS n FROM td GROUP BY target) d
JOIN (SELECT target, count(*) AS n FROM tp GROUP BY target) p ON d.target = p.target WHERE d.n * p.n > 2900""",
)
def guarded_targets(spark, sf):
    """What the guard of pathway_disease_guarded leaves out."""
    return infer.guarded_targets(infer.target_disease_pairs(T.associations(spark, sf)), T.target_pathways(spark, sf), 2_900)


@query(
    "shared_target_counts",
    f"""
WITH td AS ({ASSOCIATION_PAIRS}), tp AS ({PATHWAY_PAIRS})
SELECT d.target, d.n AS diseases, p.n AS pathways
FROM (SELECT target, count(*) AS n FROM td GROUP BY target) d
JOIN (SELECT target, count(*) AS n FROM tp GROUP BY target) p ON d.target = p.target""",
)
def shared_target_counts(spark, sf):
    return infer.shared_targets(infer.target_disease_pairs(T.associations(spark, sf)), T.target_pathways(spark, sf))


@query(
    "inferred_edges",
    f"""
WITH l AS ({_inference_sql(None)})
SELECT pathway AS source, disease AS target, 'ASSOCIATED_WITH' AS type, via_target FROM l""",
)
def inferred_edges(spark, sf):
    """All inferred edges: no guard, no cap."""
    return infer.inferred_edges(_inference(spark, sf, None)).select("source", "target", "type", "via_target")


@query(
    "inferred_edges_capped",
    f"""
WITH l AS ({_inference_sql(None)})
SELECT pathway AS source, disease AS target, 'ASSOCIATED_WITH' AS type, via_target
FROM l ORDER BY support DESC, pathway, disease LIMIT 1000""",
)
def inferred_edges_capped(spark, sf):
    """The optional edge cap is what this query checks: the best supported links of all of them."""
    links = _inference(spark, sf, None)
    return infer.inferred_edges(links, cap=1000).select("source", "target", "type", "via_target")


MAP_SQL = """idmap AS (
  SELECT 'C' || o_custkey AS key, 'H' || max(o_orderkey) AS value
  FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey)"""


@query(
    "harmonise_ids",
    f"""WITH {MAP_SQL}
SELECT 'C' || c_custkey AS id, coalesce(value, 'C' || c_custkey) AS harmonised
FROM customer LEFT JOIN idmap ON key = 'C' || c_custkey""",
)
def harmonise_ids(spark, sf):
    ids = T.table(spark, sf, "customer").select(T.key("C", "c_custkey").alias("id"))
    return harmonise(ids, "id", last_value_per_key(T.disease_map_rows(spark, sf)), out="harmonised")


EDGE_OUT = ["source", "target", "type", "data_source", "evidence", "efo_name", "max_phase", "action_type"]

EDGES_SQL = f"""
WITH {MAP_SQL},
e1 AS (SELECT 'P' || l_partkey AS source, 'S' || l_suppkey AS target, 'TARGETS' AS type,
  NULL::VARCHAR AS data_source, l_returnflag AS evidence, NULL::VARCHAR AS efo_name, NULL::DOUBLE AS max_phase,
  NULL::VARCHAR AS action_type, NULL::VARCHAR AS mechanism FROM lineitem),
e3 AS (SELECT 'P' || l_partkey, coalesce(value, 'C' || o_custkey), 'INDICATED_FOR', 'OpenTargets_Indications', NULL::VARCHAR,
  o_orderpriority, CASE WHEN l_linenumber > 1 THEN l_linenumber ELSE 0 END::DOUBLE, NULL::VARCHAR, NULL::VARCHAR
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN idmap ON key = 'C' || o_custkey),
e4 AS (SELECT d.drug, t.target, 'HAS_MECHANISM', 'OpenTargets_Mechanism', NULL::VARCHAR, NULL::VARCHAR, NULL::DOUBLE,
  l_returnflag, l_linestatus
  FROM lineitem, LATERAL (SELECT unnest(['P' || l_partkey, 'P' || (l_partkey + 1)]) AS drug) d,
  LATERAL (SELECT unnest(['S' || l_suppkey, 'S' || l_linenumber]) AS target) t),
edges AS (SELECT * FROM e1 UNION ALL SELECT * FROM e3 UNION ALL SELECT * FROM e4),
deduped AS (SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY source, target, type
  ORDER BY evidence NULLS FIRST, max_phase NULLS FIRST, efo_name NULLS FIRST, action_type NULLS FIRST, mechanism NULLS FIRST) = 1)
"""


def _edges(spark, sf):
    disease_map = last_value_per_key(T.disease_map_rows(spark, sf))
    return E.dedupe_edges(
        E.union_edges(
            E.known_drug_edges(T.known_drugs(spark, sf)),
            E.indication_edges(T.indications(spark, sf), disease_map),
            E.mechanism_edges(T.mechanisms(spark, sf)),
        )
    )


@query("edge_build_union_dedupe", EDGES_SQL + "SELECT " + ", ".join(EDGE_OUT) + " FROM deduped")
def edge_build_union_dedupe(spark, sf):
    return _edges(spark, sf).select(*EDGE_OUT)


# Nodes some edges miss: suppliers in debt and small parts are no nodes.
SOME_NODES_SQL = """known AS (
  SELECT 'P' || p_partkey AS id, 'Drug' AS type FROM part WHERE p_size > 10
  UNION ALL SELECT 'S' || s_suppkey, 'Target' FROM supplier WHERE s_acctbal > 0)"""
TARGETS_SQL = "t AS (SELECT DISTINCT 'P' || l_partkey AS source, 'S' || l_suppkey AS target, 'TARGETS' AS type FROM lineitem)"


def _some_nodes(spark, sf):
    part = T.table(spark, sf, "part").where("p_size > 10")
    supplier = T.table(spark, sf, "supplier").where("s_acctbal > 0")
    return part.select(T.key("P", "p_partkey").alias("id"), F.lit("Drug").alias("type")).unionByName(
        supplier.select(T.key("S", "s_suppkey").alias("id"), F.lit("Target").alias("type"))
    )


def _targets(spark, sf):
    return T.path_edges(spark, sf, "drug_target").select("source", "target", "type")


@query(
    "orphan_edge_removal",
    f"WITH {SOME_NODES_SQL}, {TARGETS_SQL} SELECT * FROM t WHERE source IN (SELECT id FROM known) AND target IN (SELECT id FROM known)",
)
def orphan_edge_removal(spark, sf):
    return E.remove_orphans(_targets(spark, sf), _some_nodes(spark, sf))


@query(
    "orphan_edges",
    f"WITH {SOME_NODES_SQL}, {TARGETS_SQL} SELECT * FROM t WHERE source NOT IN (SELECT id FROM known) OR target NOT IN (SELECT id FROM known)",
)
def orphan_edges(spark, sf):
    return E.orphan_edges(_targets(spark, sf), _some_nodes(spark, sf))


@query(
    "edge_label_suffix",
    f"""WITH {SOME_NODES_SQL}, {TARGETS_SQL}
SELECT source || '(' || a.type || ')' AS source, target || '(' || b.type || ')' AS target, t.type
FROM t JOIN known a ON a.id = source JOIN known b ON b.id = target""",
)
def edge_label_suffix(spark, sf):
    return E.suffix_edges(_targets(spark, sf), _some_nodes(spark, sf))


@query(
    "edge_post_pass_counts",
    f"""WITH {SOME_NODES_SQL}, u AS (
  SELECT 'P' || l_partkey AS source, 'S' || l_suppkey AS target, count(*) AS copies FROM lineitem GROUP BY 1, 2),
f AS (SELECT copies, source IN (SELECT id FROM known) AND target IN (SELECT id FROM known) AS ok FROM u)
SELECT sum(copies)::BIGINT AS built, sum(copies - 1)::BIGINT AS duplicates,
  count(*) FILTER (WHERE NOT ok) AS orphans, count(*) FILTER (WHERE ok) AS kept FROM f""",
)
def edge_post_pass_counts(spark, sf):
    rows = E.known_drug_edges(T.known_drugs(spark, sf))
    return E.edge_post_pass_counts(rows, _some_nodes(spark, sf))


@query(
    "nested_pathway_edges",
    """SELECT 'S' || l_suppkey AS source, p_type AS target, 'INVOLVED_IN' AS type, min(p_brand) AS "pathwayName"
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
)
def nested_pathway_edges(spark, sf):
    edges = E.dedupe_edges(E.union_edges(E.pathway_edges(T.nested_targets(spark, sf))))
    return edges.select("source", "target", "type", "pathwayName")


@query(
    "mechanism_cross_explode",
    """SELECT d.drug AS source, t.target AS target, 'HAS_MECHANISM' AS type, l_returnflag AS action_type, count(*) AS n
FROM lineitem, LATERAL (SELECT unnest(['P' || l_partkey, 'P' || (l_partkey + 1)]) AS drug) d,
  LATERAL (SELECT unnest(['S' || l_suppkey, 'S' || l_linenumber]) AS target) t
GROUP BY 1, 2, 4""",
)
def mechanism_cross_explode(spark, sf):
    edges = E.mechanism_edges(T.mechanisms(spark, sf))
    return edges.groupBy("source", "target", "type", "action_type").agg(F.count("*").alias("n"))


@query(
    "relation_edges",
    """WITH r AS (
  SELECT 'P' || l_partkey AS source, 'S' || l_suppkey AS target, 'TARGETS' AS type, l_returnflag || ',' || l_linestatus AS actions FROM lineitem
  UNION ALL SELECT 'P' || l_partkey, 'E' || l_linenumber, 'METABOLIZED_BY', l_returnflag FROM lineitem WHERE l_tax > 0
  UNION ALL SELECT 'P' || l_partkey, 'T' || l_linenumber, 'TRANSPORTED_BY', '' FROM lineitem
  UNION ALL SELECT 'P' || l_partkey, 'K' || l_linenumber, 'CARRIED_BY', l_linestatus FROM lineitem WHERE l_discount > 0)
SELECT source, target, type, actions, 'DrugBank' AS data_source, count(*) AS n FROM r GROUP BY 1, 2, 3, 4""",
)
def relation_edges(spark, sf):
    def relation(uniprot, *actions):
        return F.array(
            F.struct(
                uniprot.alias("id"),
                F.lit("name").alias("name"),
                F.lit(None).cast("string").alias("organism"),
                F.array(*actions).cast("array<string>").alias("actions"),
                uniprot.alias("uniprot_id"),
            )
        )

    when = lambda condition, c: F.when(condition, c)
    drugs = T.lines(spark, sf).select(
        T.key("P", "l_partkey").alias("drugbank_id"),
        relation(T.key("S", "l_suppkey"), F.col("l_returnflag"), F.col("l_linestatus")).alias("targets"),
        relation(when(F.col("l_tax") > 0, T.key("E", "l_linenumber")), F.col("l_returnflag")).alias("enzymes"),
        relation(T.key("T", "l_linenumber")).alias("transporters"),
        relation(when(F.col("l_discount") > 0, T.key("K", "l_linenumber")), F.col("l_linestatus")).alias("carriers"),
    )
    keys = ["source", "target", "type", "actions", "data_source"]
    return E.relation_edges(drugs).groupBy(*keys).agg(F.count("*").alias("n"))


@query(
    "first_edge_per_type",
    f"""WITH {T.path_edges_sql("drug_target", "drug_disease", "target_pathway")}
SELECT type, source, target FROM edges QUALIFY row_number() OVER (PARTITION BY type ORDER BY source, target) = 1""",
)
def first_edge_per_type(spark, sf):
    edges = T.path_edges(spark, sf, "drug_target", "drug_disease", "target_pathway").select("type", "source", "target")
    return first_per_key(edges, ["type"], ["source", "target"])


# --- path search ---


def path_sql(edges: str, queries: str, limit: int, max_hops: int = 3, stop: bool = False) -> str:
    """Union of explicit joins over all paths; with ``stop`` a query with enough shorter ones is not followed deeper."""
    ctes = [
        T.NODES_SQL,
        edges,
        f"q AS ({queries})",
        """adj AS (
  SELECT source AS f, target AS t, target_type AS tt, type AS rel, source || '|' || type || '|' || target AS k FROM edges
  UNION ALL SELECT target, source, source_type, type, source || '|' || type || '|' || target FROM edges WHERE source <> target)""",
        """m AS (SELECT q.query_id, n.id, n.type FROM q JOIN nodes n
  ON n.type IN ('Drug', 'Disease') AND contains(n.name, q.query))""",
        """h0 AS (SELECT query_id, id AS node, type AS tt, type AS st, [id] AS nodes,
  []::VARCHAR[] AS rels, []::VARCHAR[] AS keys FROM m)""",
    ]
    for h in range(1, max_hops + 1):
        served = f"AND h.query_id NOT IN (SELECT query_id FROM served{h - 1})" if stop and h > 1 else ""
        ctes.append(f"""h{h} AS (SELECT h.query_id, a.t AS node, a.tt, h.st, list_append(h.nodes, a.t) AS nodes,
  list_append(h.rels, a.rel) AS rels, list_append(h.keys, a.k) AS keys
  FROM h{h - 1} h JOIN adj a ON a.f = h.node WHERE NOT list_contains(h.keys, a.k) {served})""")
        ctes.append(f"""f{h} AS (
  SELECT query_id, {h} AS hops, nodes, rels, keys FROM h{h} WHERE st = 'Drug' AND tt = 'Disease'
  UNION ALL SELECT query_id, {h}, list_reverse(nodes), list_reverse(rels), list_reverse(keys) FROM h{h} h
  WHERE st = 'Disease' AND tt = 'Drug' AND NOT EXISTS (SELECT 1 FROM m WHERE m.query_id = h.query_id AND m.id = h.node))""")
        found = " UNION ALL ".join(f"SELECT query_id FROM f{i}" for i in range(1, h + 1))
        ctes.append(f"served{h} AS (SELECT query_id FROM ({found}) GROUP BY query_id HAVING count(*) >= {limit})")
    found = " UNION ALL ".join(f"SELECT * FROM f{i}" for i in range(1, max_hops + 1))
    return f"""WITH {", ".join(ctes)},
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hops, nodes, rels, keys) AS rank FROM ({found}))
SELECT query_id, rank::INTEGER AS rank, hops::INTEGER AS hops, array_to_string(nodes, '>') AS nodes,
  array_to_string(rels, '>') AS rels FROM ranked WHERE rank <= {limit}"""


def _flat(paths):
    return paths.select(
        "query_id", "rank", "hops", F.array_join("nodes", ">").alias("nodes"), F.array_join("rel_types", ">").alias("rels")
    )


BOTH_QUERIES_SQL = f"{T.DISEASE_QUERIES_SQL} UNION ALL {T.DRUG_QUERIES_SQL}"
FULL = ("drug_target", "drug_disease", "target_pathway")
TWO = ("drug_target", "target_disease")
THREE = ("drug_target", "target_nation", "nation_disease")
MIXED = ("rare_indication", *THREE)


def both_queries(spark, sf):
    return T.disease_queries(spark, sf).unionByName(T.drug_queries(spark, sf))


@query("path_search_1", path_sql(T.path_edges_sql(*FULL), BOTH_QUERIES_SQL, 20, stop=True))
def path_search_1(spark, sf):
    return _flat(P.search_paths(both_queries(spark, sf), T.nodes(spark, sf), T.stored_edges(spark, sf, *FULL)))


@query("path_search_2", path_sql(T.path_edges_sql(*TWO), T.DISEASE_QUERIES_SQL, 20))
def path_search_2(spark, sf):
    return _flat(P.search_paths(T.disease_queries(spark, sf), T.nodes(spark, sf), T.stored_edges(spark, sf, *TWO)))


@query("path_search_3", path_sql(T.path_edges_sql(*THREE), T.DISEASE_QUERIES_SQL, 20))
def path_search_3(spark, sf):
    return _flat(P.search_paths(T.disease_queries(spark, sf), T.nodes(spark, sf), T.stored_edges(spark, sf, *THREE)))


@query("path_search_mixed", path_sql(T.path_edges_sql(*MIXED), BOTH_QUERIES_SQL, 20))
def path_search_mixed(spark, sf):
    """A few direct paths, filled up with paths of three hops."""
    return _flat(P.search_paths(both_queries(spark, sf), T.nodes(spark, sf), T.stored_edges(spark, sf, *MIXED)))


@query(
    "name_matches",
    f"""WITH {T.NODES_SQL}, q AS ({T.NAME_PARTS_SQL})
SELECT query_id, id, type FROM q JOIN nodes ON type IN ('Drug', 'Disease') AND contains(name, query)""",
)
def name_matches(spark, sf):
    return P.match_names(T.name_parts(spark, sf), T.nodes(spark, sf), ("Drug", "Disease"))


@query("suggestions", path_sql(T.path_edges_sql(*FULL), BOTH_QUERIES_SQL, 10, stop=True))
def suggestions(spark, sf):
    return _flat(P.suggest(both_queries(spark, sf), T.nodes(spark, sf), T.stored_edges(spark, sf, *FULL)))


INCIDENT_SQL = f"""{T.NODES_SQL}, {T.path_edges_sql(*FULL)},
adj AS (SELECT source AS f, target AS t, type AS rel FROM edges
  UNION ALL SELECT target, source, type FROM edges WHERE source <> target)"""


@query(
    "entity_connections",
    f"""WITH {INCIDENT_SQL}
SELECT n.id AS entity_id, n.name, n.type, a.rel AS relation, a.t AS connected_id, c.name AS connected
FROM nodes n LEFT JOIN adj a ON a.f = n.id LEFT JOIN nodes c ON c.id = a.t WHERE n.type IN ('Target', 'Pathway')""",
)
def entity_connections(spark, sf):
    nodes = T.nodes(spark, sf)
    ids = nodes.where(F.col("type").isin("Target", "Pathway")).select(F.col("id").alias("entity_id"))
    return P.entity_connections(ids, nodes, T.stored_edges(spark, sf, *FULL))


@query(
    "entity_details",
    f"""WITH {INCIDENT_SQL}, listed AS (
  SELECT n.id AS entity_id, n.name, n.type, a.rel, coalesce(a.rel, '') || ':' || coalesce(c.name, '') AS item
  FROM nodes n LEFT JOIN adj a ON a.f = n.id LEFT JOIN nodes c ON c.id = a.t)
SELECT entity_id, name, type, count(rel) AS degree, count(*) AS connections, count(DISTINCT item) AS kinds,
  min(item) AS first, max(item) AS last, sum(length(item))::BIGINT AS characters FROM listed GROUP BY entity_id, name, type""",
)
def entity_details(spark, sf):
    """All nodes, their lists in rows of about 100, taken apart again to compare."""
    nodes = T.nodes(spark, sf)
    rows = P.entity_details(nodes.select(F.col("id").alias("entity_id")), nodes, T.stored_edges(spark, sf, *FULL), chunk=100)
    named = lambda relation, connected: F.concat_ws(":", F.coalesce(relation, F.lit("")), F.coalesce(connected, F.lit("")))
    keys = ["entity_id", "name", "type", "degree"]
    # An entity with one list is summed up in its row; the rows of the others' lists are shuffled.
    items = rows.where("degree <= 100").select(*keys, F.transform("connections", lambda c: named(c["relation"], c["connected"])).alias("items"))
    own = items.select(
        *keys, F.size("items").cast("bigint").alias("connections"), F.size(F.array_distinct("items")).cast("bigint").alias("kinds"),
        F.array_min("items").alias("first"), F.array_max("items").alias("last"),
        F.aggregate("items", F.lit(0).cast("bigint"), lambda n, item: n + F.length(item)).alias("characters"),
    )
    rows = rows.where("degree > 100").select(*keys, F.inline("connections"))
    # Equal items are counted first: with a distinct count beside the least of texts Spark would sort every row.
    counted = rows.groupBy(*keys, named(F.col("relation"), F.col("connected")).alias("item")).agg(F.count("*").alias("n"))
    summed = counted.groupBy(*keys).agg(
        F.sum("n").alias("connections"), F.count("*").alias("kinds"), F.min("item").alias("first"),
        F.max("item").alias("last"), F.sum(F.col("n") * F.length("item")).alias("characters"),
    )
    return own.unionByName(summed)
