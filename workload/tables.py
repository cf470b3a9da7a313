"""Nodes, counts, quality reports, profiles, enrichment, clean-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from vinculum.functions import columns as C
from vinculum.functions.ranking import first_per_key
from vinculum.operators import cleanup, enrich, quality, search
from vinculum.operators import nodes as N
from vinculum.sources.readers import last_value_per_key
from workload import standin as T
from workload.graph import MAP_SQL
from workload.registry import query

# --- node projections ---


def drug_records(spark, sf):
    """Drug records out of parts: gaps, lists and relations derived from the row's own columns."""
    size = F.col("p_size")
    relation = lambda i: F.struct(
        F.lit("t").alias("id"), F.lit("n").alias("name"), F.lit("Humans").alias("organism"),
        F.array(F.lit("a")).alias("actions"), T.key("U", i).alias("uniprot_id"),
    )
    targets = F.when(size > 5, F.transform(F.sequence(F.lit(1), F.least(size, F.lit(9)) - 4), relation))
    return T.spread(T.table(spark, sf, "part")).select(
        T.key("P", "p_partkey").alias("drugbank_id"),
        F.when(size != 7, F.col("p_name")).alias("name"),
        F.when(size < 40, F.concat_ws(" ", "p_brand", "p_type")).alias("description"),
        F.when(size != 3, F.lower("p_type")).alias("state"),
        F.when(size > 20, F.array(F.lit("approved"))).when(
            size > 10, F.array(F.lit("approved"), F.lit("experimental"))
        ).when(size > 5, F.array(F.lit("investigational"))).otherwise(F.array().cast("array<string>")).alias("groups"),
        F.when(size > 15, T.key("treats ", "p_brand")).alias("indication"),
        F.when(size > 30, F.lit("binds")).otherwise(F.lit("")).alias("mechanism_of_action"),
        F.lit(None).cast("string").alias("pharmacodynamics"),
        F.lit(None).cast("string").alias("toxicity"),
        F.when(size > 25, T.key("IK", "p_partkey")).when(size > 12, F.lit("")).alias("inchikey"),
        F.when(size > 35, T.key("UN", "p_partkey")).alias("unii"),
        F.lit(None).cast("string").alias("cas_number"),
        F.array("p_type", "p_brand", "p_type").alias("synonyms"),
        F.when(size > 8, F.array("p_brand", F.lit(None).cast("string"), "p_type")).alias("categories"),
        F.array().cast("array<string>").alias("atc_codes"),
        F.col("p_retailprice").cast("string").alias("molecular_weight"),
        targets.alias("targets"),
        F.array(relation(size)).alias("enzymes"),
        F.filter(F.array(relation(size)), lambda r: F.lit(False)).alias("transporters"),
        F.filter(F.array(relation(size)), lambda r: F.lit(False)).alias("carriers"),
        F.array(F.struct(F.col("p_type").alias("smpdb_id"), F.lit("p").alias("name"), F.lit("c").alias("category"))).alias("pathways"),
    )


DRUGS_SQL = """drugs AS (SELECT 'P' || p_partkey AS drugbank_id,
  CASE WHEN p_size <> 7 THEN p_name END AS name,
  CASE WHEN p_size < 40 THEN p_brand || ' ' || p_type END AS description,
  CASE WHEN p_size <> 3 THEN lower(p_type) END AS state,
  CASE WHEN p_size > 20 THEN ['approved'] WHEN p_size > 10 THEN ['approved', 'experimental']
    WHEN p_size > 5 THEN ['investigational'] ELSE []::VARCHAR[] END AS "groups",
  CASE WHEN p_size > 15 THEN 'treats ' || p_brand END AS indication,
  CASE WHEN p_size > 30 THEN 'binds' ELSE '' END AS mechanism_of_action,
  CASE WHEN p_size > 25 THEN 'IK' || p_partkey WHEN p_size > 12 THEN '' END AS inchikey,
  CASE WHEN p_size > 35 THEN 'UN' || p_partkey END AS unii,
  [p_type, p_brand, p_type] AS synonyms,
  CASE WHEN p_size > 5 THEN least(p_size, 9) - 4 ELSE 0 END AS n_targets, p_size, p_retailprice, p_type, p_brand, p_partkey
FROM part)"""


def molecules(spark, sf):
    """Molecule rows out of parts; large parts share their id with a drug record."""
    size = F.col("p_size")
    return T.table(spark, sf, "part").select(
        F.when(size > 25, T.key("P", "p_partkey")).otherwise(T.key("M", "p_partkey")).alias("id"),
        F.upper("p_name").alias("name"),
        F.when(size > 10, F.lit("Small molecule")).alias("drugType"),
        F.when(size > 20, (size / 10)).alias("maximumClinicalTrialPhase"),
        F.when(size > 15, size > 30).alias("isApproved"),
        (size == 1).alias("hasBeenWithdrawn"),
        (size == 2).alias("blackBoxWarning"),
        F.when(size > 30, F.lit(1950) + size).cast("long").alias("yearOfFirstApproval"),
        F.lit("CCO").alias("canonicalSmiles"),
        T.key("IK", "p_partkey").alias("inchiKey"),
        F.array("p_brand", "p_type").alias("synonyms"),
        F.array("p_name").alias("tradeNames"),
        F.when(size > 5, F.struct(F.array("p_type").alias("rows"), size.alias("count"))).alias("linkedDiseases"),
        F.lit(None).cast("struct<rows: array<string>, count: int>").alias("linkedTargets"),
    )


@query(
    "disease_nodes",
    f"""WITH {MAP_SQL}, d AS (
  SELECT coalesce(value, 'C' || c_custkey) AS id, c_name AS name FROM customer LEFT JOIN idmap ON key = 'C' || c_custkey)
SELECT d.id, 'Disease' AS type, d.name, coalesce(o.o_orderpriority || ',' || o.o_orderstatus, '') AS mesh_terms,
  coalesce(o.o_orderpriority, '') AS mesh_description, coalesce('C' || o.o_custkey, '') AS tree_numbers
FROM d LEFT JOIN orders o ON 'H' || o.o_orderkey = d.id""",
)
def disease_nodes(spark, sf):
    diseases = T.table(spark, sf, "customer").select(T.key("C", "c_custkey").alias("id"), F.col("c_name").alias("name"))
    descriptors = T.table(spark, sf, "orders").select(
        T.key("H", "o_orderkey").alias("id"),
        F.array("o_orderpriority", "o_orderstatus").alias("synonyms"),
        F.col("o_orderpriority").alias("description"),
        F.array(T.key("C", "o_custkey")).alias("tree_numbers"),
    )
    rows = N.disease_nodes(diseases, last_value_per_key(T.disease_map_rows(spark, sf)), descriptors)
    return rows.withColumns({c: C.join_list(F.col(c)) for c in ("mesh_terms", "tree_numbers")})


@query(
    "target_pathway_nodes",
    """SELECT 'S' || s_suppkey AS id, 'Target' AS type, s_name AS symbol, 'N' || s_nationkey AS protein_ids,
  NULL AS name, NULL AS source FROM supplier
UNION ALL SELECT DISTINCT p_type, 'Pathway', NULL, NULL, p_type || ' path', 'Reactome' FROM part""",
)
def target_pathway_nodes(spark, sf):
    protein = F.struct(T.key("N", "s_nationkey").alias("id"), F.lit("uniprot").alias("source"))
    targets = T.table(spark, sf, "supplier").select(
        T.key("S", "s_suppkey").alias("id"), F.col("s_name").alias("approvedSymbol"), F.array(protein).alias("proteinIds")
    )
    types = T.table(spark, sf, "part").select("p_type").distinct()
    reactome = types.select(F.col("p_type").alias("id"), F.concat("p_type", F.lit(" path")).alias("label"))
    rows = N.union_nodes(N.target_nodes(targets), N.pathway_nodes(reactome))
    return rows.select(
        "id", "type", "symbol", F.array_join("proteinIds.id", ",").alias("protein_ids"), "name", "source"
    )


@query(
    "drug_record_nodes",
    f"""WITH {DRUGS_SQL}
SELECT drugbank_id AS id, 'Drug' AS type, coalesce(name, '') AS name, coalesce(description, '') AS description,
  coalesce(state, '') AS state, array_to_string("groups", ',') AS "groups", array_to_string(synonyms, ',') AS synonyms,
  CASE WHEN p_size > 8 THEN p_brand || ',' || p_type ELSE '' END AS categories,
  coalesce(indication, '') AS indication, coalesce(inchikey, '') AS inchikey,
  p_retailprice AS molecular_weight, n_targets::INTEGER AS target_count, 1 AS enzyme_count, 0 AS carrier_count,
  1 AS pathway_count, false AS has_structure_data, 'DrugBank_Enhanced' AS data_source FROM drugs""",
)
def drug_record_nodes(spark, sf):
    return N.drug_record_nodes(drug_records(spark, sf)).select(
        "id", "type", "name", "description", "state", "groups", "synonyms", "categories", "indication", "inchikey",
        "molecular_weight", "target_count", "enzyme_count", "carrier_count", "pathway_count", "has_structure_data",
        "data_source",
    )


MOLECULES_SQL = """molecules AS (SELECT CASE WHEN p_size > 25 THEN 'P' ELSE 'M' END || p_partkey AS id, upper(p_name) AS name,
  CASE WHEN p_size > 10 THEN 'Small molecule' ELSE '' END AS "drugType",
  CASE WHEN p_size > 20 THEN p_size / 10.0 ELSE 0 END::DOUBLE AS "maxPhase",
  coalesce(CASE WHEN p_size > 15 THEN p_size > 30 END, false) AS "isApproved", p_size = 1 AS "hasBeenWithdrawn",
  CASE WHEN p_size > 30 THEN 1950 + p_size END::BIGINT AS "yearOfFirstApproval",
  p_brand || ',' || p_type AS synonyms, CASE WHEN p_size > 5 THEN p_size ELSE 0 END AS "linkedDiseases",
  'IK' || p_partkey AS "inchiKey" FROM part)"""


@query(
    "molecule_nodes",
    f"""WITH {MOLECULES_SQL} SELECT id, 'Drug' AS type, name, "drugType", "maxPhase", "isApproved", "hasBeenWithdrawn",
  "yearOfFirstApproval", synonyms, "linkedDiseases", 0 AS "linkedTargets", 'ChEMBL_OpenTargets' AS data_source FROM molecules""",
)
def molecule_nodes(spark, sf):
    return N.molecule_nodes(molecules(spark, sf)).select(
        "id", "type", "name", "drugType", "maxPhase", "isApproved", "hasBeenWithdrawn", "yearOfFirstApproval",
        "synonyms", "linkedDiseases", "linkedTargets", "data_source",
    )


def all_nodes(spark, sf):
    """Diseases and targets whose ids clash (both keyed by number), drug records, molecules."""
    customer, supplier = T.table(spark, sf, "customer"), T.table(spark, sf, "supplier")
    diseases = customer.select(
        T.key("X", "c_custkey").alias("id"), F.lit("Disease").alias("type"), F.col("c_mktsegment").alias("name"),
        F.when(F.col("c_acctbal") > 0, F.lit("None")).otherwise(F.lit("   ")).alias("description"),
        F.round("c_acctbal").alias("weight"),
    )
    targets = supplier.select(
        T.key("X", "s_suppkey").alias("id"), F.lit("Target").alias("type"), F.col("s_name").alias("name"),
        T.key("nation ", "s_nationkey").alias("description"), F.round("s_acctbal").alias("weight"),
    )
    return N.union_nodes(
        diseases, targets, N.drug_record_nodes(drug_records(spark, sf)), N.molecule_nodes(molecules(spark, sf))
    )


NODES_IN_SQL = f"""{DRUGS_SQL}, {MOLECULES_SQL}, entries AS (
  SELECT 'X' || c_custkey AS id, 'Disease' AS type, 0 AS ord, c_mktsegment AS name,
    CASE WHEN c_acctbal > 0 THEN 'None' ELSE '   ' END AS description, round(c_acctbal) AS weight, NULL::VARCHAR AS synonyms,
    NULL::BOOLEAN AS approved, NULL::VARCHAR AS data_source FROM customer
  UNION ALL SELECT 'X' || s_suppkey, 'Target', 1, s_name, 'nation ' || s_nationkey, round(s_acctbal), NULL, NULL, NULL FROM supplier
  UNION ALL SELECT drugbank_id, 'Drug', 2, coalesce(name, ''), coalesce(description, ''), NULL, array_to_string(synonyms, ','), NULL, 'DrugBank_Enhanced' FROM drugs
  UNION ALL SELECT id, 'Drug', 3, name, NULL, NULL, synonyms, "isApproved", 'ChEMBL_OpenTargets' FROM molecules)"""


def _text_merge(c: str) -> str:
    ok = f"{c} IS NOT NULL AND trim({c}) <> '' AND {c} <> 'None'"
    return f"coalesce(arg_max({c}, (length(trim({c})), -ord)) FILTER (WHERE {ok}), arg_min_null({c}, ord)) AS {c}"


@query(
    "node_merge",
    f"""WITH {NODES_IN_SQL}
SELECT id, arg_min(type, ord) AS type, {_text_merge("name")}, {_text_merge("description")}, {_text_merge("synonyms")},
  {_text_merge("data_source")},
  coalesce(arg_min(weight, ord) FILTER (WHERE weight <> 0), arg_min_null(weight, ord)) AS weight,
  coalesce(arg_min(approved, ord) FILTER (WHERE approved), arg_min_null(approved, ord)) AS approved
FROM entries GROUP BY id""",
)
def node_merge(spark, sf):
    merged = N.merge_nodes(all_nodes(spark, sf))
    return merged.select(
        "id", "type", "name", "description", "synonyms", "data_source", "weight", F.col("isApproved").alias("approved")
    )


@query(
    "node_merge_stats",
    f"""WITH {NODES_IN_SQL}, n AS (SELECT id, count(*) AS n FROM entries GROUP BY id)
SELECT count(*) FILTER (WHERE n > 1) AS duplicated_ids, coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS entries_merged,
  count(*) AS ids FROM n""",
)
def node_merge_stats(spark, sf):
    return N.merge_counts(all_nodes(spark, sf))


@query(
    "identical_rows_dropped",
    "SELECT DISTINCT user_id, event_type, props FROM events",
)
def identical_rows_dropped(spark, sf):
    return N.drop_identical(T.table(spark, sf, "events").select("user_id", "event_type", "props"))


# --- counts and reports ---


@query(
    "node_counts",
    f"""WITH {T.NODES_SQL}, {T.path_edges_sql("drug_target", "target_pathway")}
SELECT 'nodes ' || type AS item, count(*) AS n FROM nodes GROUP BY type
UNION ALL SELECT 'nodes', count(*) FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges""",
)
def node_counts(spark, sf):
    return quality.build_summary(T.nodes(spark, sf), T.path_edges(spark, sf, "drug_target", "target_pathway"))


@query(
    "graph_stats",
    f"""WITH {T.NODES_SQL}, e AS (SELECT user_id::VARCHAR AS source, (CASE WHEN event_type = 'view' THEN user_id ELSE user_id + 1 END)::VARCHAR AS target FROM events)
SELECT 'node_count' AS metric, count(*) AS value FROM nodes
UNION ALL SELECT 'edge_count', count(*) FROM e
UNION ALL SELECT 'undirected_matches', 2 * count(*) - count(*) FILTER (WHERE source = target) FROM e""",
)
def graph_stats(spark, sf):
    """Edges between neighbouring users; views are loops."""
    user = F.col("user_id")
    other = F.when(F.col("event_type") == "view", user).otherwise(user + 1)
    edges = T.table(spark, sf, "events").select(
        user.cast("string").alias("source"), other.cast("string").alias("target")
    )
    return quality.graph_statistics(T.nodes(spark, sf), edges)


@query(
    "drug_statistics",
    f"""WITH {DRUGS_SQL}
SELECT count(*) AS total_drugs, count(*) FILTER (WHERE list_contains("groups", 'approved')) AS approved_drugs,
  count(*) FILTER (WHERE list_has_any("groups", ['experimental', 'investigational'])) AS experimental_drugs,
  count(*) FILTER (WHERE n_targets > 0) AS drugs_with_targets, count(*) FILTER (WHERE indication <> '') AS drugs_with_indications,
  count(*) FILTER (WHERE p_size > 20) AS drugs_with_structures FROM drugs""",
)
def drug_statistics(spark, sf):
    return quality.drug_statistics(_with_structures(spark, sf))


def _missing_sql(field: str, condition: str) -> str:
    return f"SELECT '{field}' AS field, count(*) FILTER (WHERE {condition}) AS missing, round(100.0::DOUBLE * count(*) FILTER (WHERE {condition}) / count(*), 2) AS percentage FROM drugs"


@query(
    "quality_report",
    f"WITH {DRUGS_SQL} "
    + " UNION ALL ".join(
        _missing_sql(f, c)
        for f, c in {
            "drugbank_id": "drugbank_id IS NULL",
            "name": "coalesce(name, '') = ''",
            "inchikey": "coalesce(inchikey, '') = ''",
            "indication": "coalesce(indication, '') = ''",
            "targets": "n_targets = 0",
            "synonyms": "len(synonyms) = 0",
            "mechanism_of_action": "coalesce(mechanism_of_action, '') = ''",
        }.items()
    ),
)
def quality_report(spark, sf):
    return quality.missing_report(drug_records(spark, sf))


@query(
    "group_distribution",
    f"""WITH {DRUGS_SQL}, g AS (SELECT unnest("groups") AS "group" FROM drugs)
SELECT "group", count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM drugs), 2) AS percentage FROM g GROUP BY 1""",
)
def group_distribution(spark, sf):
    return quality.distribution(drug_records(spark, sf), F.col("groups"), "group")


@query(
    "state_distribution",
    f"""WITH {DRUGS_SQL}
SELECT coalesce(state, 'unknown') AS state, count(*) AS n,
  round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM drugs), 2) AS percentage FROM drugs GROUP BY 1""",
)
def state_distribution(spark, sf):
    return quality.distribution(drug_records(spark, sf), F.col("state"), "state", "unknown")


@query(
    "label_quality",
    """WITH j AS (SELECT lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))
SELECT lang, count(*) AS documents, count(quality) AS labelled,
  round(100.0::DOUBLE * count(quality) / count(*), 2) AS labelled_percent,
  count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic FROM j GROUP BY lang""",
)
def label_quality(spark, sf):
    rows = T.table(spark, sf, "documents").select("doc_id", "lang").join(T.table(spark, sf, "labels"), "doc_id", "left")
    return rows.groupBy("lang").agg(
        F.count("*").alias("documents"),
        F.count("quality").alias("labelled"),
        C.percent(F.count("quality"), F.count("*")).alias("labelled_percent"),
        F.count_if(F.col("quality") == 1).alias("good"),
        F.count_if(F.col("toxic") == 1).alias("toxic"),
    )


def _profile_sql(column: str, type_: str, text: str | None = None) -> str:
    text = text or f"{column}::VARCHAR"
    cut = lambda x: f"CASE WHEN length({x}) > 100 THEN substring({x}, 1, 100) || '...' ELSE {x} END"
    return f"""SELECT '{column}' AS "column", '{type_}' AS type, count({column}) AS non_null, count(*) - count({column}) AS nulls,
  {cut(f"min({text})")} AS example_low, {cut(f"max({text})")} AS example_high FROM j"""


@query(
    "table_profile",
    "WITH j AS (SELECT doc_id, text, lang, source, n_chars, quality FROM documents LEFT JOIN labels USING (doc_id)) "
    + " UNION ALL ".join(
        _profile_sql(c, t)
        for c, t in {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint", "quality": "int"}.items()
    ),
)
def table_profile(spark, sf):
    labels = T.table(spark, sf, "labels").select("doc_id", "quality")
    return quality.table_profile(T.table(spark, sf, "documents").join(labels, "doc_id", "left"))


@query(
    "nested_profile",
    "WITH j AS (SELECT vec_id, embedding, label FROM embeddings) "
    + _profile_sql("vec_id", "bigint")
    + " UNION ALL "
    + _profile_sql("embedding", "array<float>", "'list[' || len(embedding) || ']'")
    + " UNION ALL "
    + _profile_sql("label", "int"),
)
def nested_profile(spark, sf):
    return quality.table_profile(T.table(spark, sf, "embeddings"))


@query(
    "key_profile",
    """WITH k AS (SELECT unnest(json_keys(props)) AS key, props FROM events)
SELECT key, count(*) AS n, min(json_extract_string(props, key)) AS example_low, max(json_extract_string(props, key)) AS example_high
FROM k GROUP BY key""",
)
def key_profile(spark, sf):
    return quality.key_profile(T.table(spark, sf, "events"), "props")


@query(
    "sample_rows",
    "SELECT event_id, event_type, value FROM events ORDER BY md5('42:' || event_id), event_id LIMIT 200",
)
def sample_rows(spark, sf):
    return quality.sample_rows(T.table(spark, sf, "events").select("event_id", "event_type", "value"), 200, "event_id")


@query(
    "first_per_type",
    """SELECT event_type, event_id, user_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) = 1""",
)
def first_per_type(spark, sf):
    rows = T.table(spark, sf, "events").select("event_type", "event_id", "user_id", "value")
    return quality.first_per_type(rows, "event_type", ("event_id",))


# --- enrichment ---


def vocabulary(spark, sf):
    part = T.table(spark, sf, "part").where("p_size > 10")
    return part.select(
        T.key("P", "p_partkey").alias("drugbank_id"),
        T.key("VK", "p_partkey").alias("inchikey"),
        T.key("VU", "p_partkey").alias("unii"),
        T.key("VC", "p_size").alias("cas_number"),
        F.when(F.col("p_size") > 14, F.concat_ws("|", "p_brand", "p_name", F.lit(" spaced "))).alias("synonyms"),
    )


@query(
    "vocab_enrichment",
    f"""WITH {DRUGS_SQL}
SELECT drugbank_id,
  CASE WHEN coalesce(inchikey, '') <> '' THEN inchikey WHEN p_size > 10 THEN 'VK' || p_partkey END AS inchikey,
  CASE WHEN coalesce(unii, '') <> '' THEN unii WHEN p_size > 10 THEN 'VU' || p_partkey END AS unii,
  CASE WHEN p_size > 10 THEN 'VC' || p_size END AS cas_number,
  array_to_string(CASE WHEN p_size > 14 THEN list_sort(list_distinct([p_type, p_brand, p_type, p_name_raw, ' spaced ']))
    ELSE synonyms END, ',') AS synonyms
FROM (SELECT d.*, p.p_name AS p_name_raw FROM drugs d JOIN part p ON p.p_partkey = d.p_partkey)""",
)
def vocab_enrichment(spark, sf):
    rows = enrich.enrich_vocabulary(drug_records(spark, sf), vocabulary(spark, sf))
    return rows.select("drugbank_id", "inchikey", "unii", "cas_number", F.array_join("synonyms", ",").alias("synonyms"))


@query(
    "basic_vocab_enrichment",
    f"""WITH {DRUGS_SQL}
SELECT drugbank_id,
  CASE WHEN coalesce(inchikey, '') <> '' THEN inchikey WHEN p_size > 10 THEN 'VK' || p_partkey END AS inchikey,
  NULL::VARCHAR AS cas_number FROM drugs""",
)
def basic_vocab_enrichment(spark, sf):
    rows = enrich.enrich_vocabulary(drug_records(spark, sf), vocabulary(spark, sf), ("inchikey", "unii"))
    return rows.select("drugbank_id", "inchikey", "cas_number")


def structures(spark, sf):
    part = T.table(spark, sf, "part").where("p_size > 20")
    return enrich.structure_columns(
        part.select(
            T.key("P", "p_partkey").alias("drug_id"),
            (F.col("p_retailprice") / 2).alias("molecular_weight_rdkit"),
            (F.col("p_size") / 8.0).alias("logp"),
            (F.col("p_size") - 40).alias("h_bond_donors"),
            (F.col("p_size") - 30).alias("h_bond_acceptors"),
            F.upper("p_type").alias("state"),
        )
    )


def _with_structures(spark, sf):
    return enrich.enrich_structure(drug_records(spark, sf), structures(spark, sf))


STRUCTURES_SQL = """s AS (SELECT 'P' || p_partkey AS drug_id, p_retailprice / 2 AS mw, p_size / 8.0::DOUBLE AS logp,
  p_size - 40 AS hbd, p_size - 30 AS hba FROM part WHERE p_size > 20),
r AS (SELECT *, (mw > 500)::INT + (logp > 5)::INT + (hbd > 5)::INT + (hba > 10)::INT AS violations FROM s)"""


@query(
    "rule_of_five",
    f"""WITH {STRUCTURES_SQL} SELECT drug_id, mw <= 500 AS lipinski_mw, logp <= 5 AS lipinski_logp, hbd <= 5 AS lipinski_hbd,
  hba <= 10 AS lipinski_hba, violations AS lipinski_violations, violations <= 1 AS lipinski_compliant FROM r""",
)
def rule_of_five(spark, sf):
    rows = structures(spark, sf)
    return rows.select("drug_id", *[c for c in rows.columns if c.startswith("lipinski")])


@query(
    "structure_enrichment",
    f"""WITH {DRUGS_SQL}, {STRUCTURES_SQL}
SELECT drugbank_id, state, mw AS molecular_weight_rdkit, violations AS lipinski_violations,
  violations <= 1 AS lipinski_compliant, drug_id IS NOT NULL AS has_structure_data
FROM drugs LEFT JOIN r ON drug_id = drugbank_id""",
)
def structure_enrichment(spark, sf):
    return _with_structures(spark, sf).select(
        "drugbank_id", "state", "molecular_weight_rdkit", "lipinski_violations", "lipinski_compliant", "has_structure_data"
    )


# --- clean-up and corpus ---


@query(
    "optimized_nodes",
    """SELECT 'P' || p_partkey AS id, CASE WHEN p_size = 7 THEN 'P' || p_partkey ELSE p_name END AS name,
  CASE WHEN p_size < 10 THEN true WHEN p_size < 20 THEN false END AS "isApproved",
  CASE WHEN p_size < 10 THEN '[]' WHEN p_size < 20 THEN '["' || p_brand || '", ""]' ELSE '[]' END AS "proteinIds",
  CASE WHEN p_size > 30 THEN '["a"]' ELSE '[]' END AS mesh_terms,
  CASE WHEN p_size > 40 THEN p_type ELSE '' END AS state,
  CASE WHEN p_size > 40 THEN p_retailprice ELSE 0 END AS weight FROM part""",
)
def optimized_nodes(spark, sf):
    size = F.col("p_size")
    rows = T.table(spark, sf, "part").select(
        T.key("P", "p_partkey").alias("id"),
        F.when(size != 7, F.col("p_name")).alias("name"),
        F.when(size < 10, F.lit("True")).when(size < 20, F.lit("FALSE")).otherwise(F.lit("nan")).alias("isApproved"),
        F.when(size < 10, F.lit(None).cast("string"))
        .when(size < 20, F.concat(F.lit('[{"id": "'), "p_brand", F.lit('", "source": "x"}, {"source": "y"}]')))
        .otherwise(F.lit("not json"))
        .alias("proteinIds"),
        F.when(size > 30, F.lit('["a"]')).alias("mesh_terms"),
        F.when(size > 40, F.col("p_type")).alias("state"),
        F.when(size > 40, F.col("p_retailprice")).alias("weight"),
    )
    return cleanup.clean_nodes(rows)


@query(
    "optimized_edges",
    """SELECT user_id::VARCHAR AS source, event_type AS target, CASE WHEN value > 5 THEN value ELSE 0 END AS max_phase,
  CASE event_type WHEN 'view' THEN '[]' WHEN 'click' THEN '["a"]' ELSE '["' || event_type || '"]' END AS actions,
  CASE WHEN value > 5 THEN props ELSE '' END AS evidence FROM events""",
)
def optimized_edges(spark, sf):
    kind, value = F.col("event_type"), F.col("value")
    rows = T.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("source"),
        kind.alias("target"),
        F.when(value > 5, value.cast("string")).otherwise(F.lit("n/a")).alias("max_phase"),
        F.when(kind == "view", F.lit(None)).when(kind == "click", F.lit('["a"]')).otherwise(kind).alias("actions"),
        F.when(value > 5, F.col("props")).alias("evidence"),
    )
    return cleanup.clean_edges(rows)


@query(
    "corpus_build",
    f"""WITH {T.NODES_SQL} SELECT type AS collection, id, name, description FROM nodes WHERE type IN ('Drug', 'Disease', 'Target')""",
)
def corpus_build(spark, sf):
    return search.build_corpus(T.nodes(spark, sf))


@query(
    "corpus_counts",
    "SELECT coalesce(lang, 'total') AS collection, count(*) AS n FROM documents GROUP BY ROLLUP (lang)",
)
def corpus_counts(spark, sf):
    return quality.counts_with_total(T.table(spark, sf, "documents").select(F.col("lang").alias("collection")), "collection")


@query(
    "last_event_per_user",
    "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1",
)
def last_event_per_user(spark, sf):
    rows = T.table(spark, sf, "events").select("user_id", "event_type", "event_id")
    return first_per_key(rows, ["user_id", "event_type"], ["event_id"], last=True)
