"""Source formats: dumps written by Spark from the driver's tables, then scanned back."""

from __future__ import annotations

from pyspark.sql import functions as F


from vinculum.operators import edges as E
from vinculum.operators import nodes as N

from vinculum.plans import drug_table, graph_build, taxonomy_tables
from vinculum.session import scratch_dir, write_through
from vinculum.sources import drugs, readers, sinks, taxonomy
from workload import standin as T
from workload.registry import query
from workload.tables import DRUGS_SQL, drug_records
from workload.trees import TREES_SQL, descriptors, yearly

DRUG_ROOT = 'drugbank xmlns="http://www.drugbank.ca"'


def write_xml(df, path, row_tag, root):
    df.write.mode("overwrite").format("xml").option("rowTag", row_tag).option("rootTag", root).save(path)
    return path


def _nest(c, *names):
    """An item list as nested XML elements, absent when the list is."""
    for name in reversed(names):
        c = F.struct(c.alias(name))
    return c


def drug_dump(spark, sf):
    """Path of a drug XML dump of all parts."""
    rows = drug_records(spark, sf)
    number = F.regexp_extract("drugbank_id", r"\d+", 0)
    second = F.struct(F.concat(F.lit("OLD"), number).alias("_VALUE"), F.lit(None).cast("string").alias("_primary"))
    primary = F.struct(F.col("drugbank_id").alias("_VALUE"), F.lit("true").alias("_primary"))
    external = lambda r: F.array(
        F.struct(F.lit("GenBank").alias("resource"), F.lit("G1").alias("identifier")),
        F.struct(F.lit("UniProtKB").alias("resource"), r["uniprot_id"].alias("identifier")),
    )
    relation = lambda r: F.struct(
        r["id"].alias("id"),
        F.concat(F.lit(" "), r["name"], F.lit("\n")).alias("name"),
        r["organism"].alias("organism"),
        _nest(r["actions"], "action").alias("actions"),
        _nest(external(r), "external-identifiers", "external-identifier").alias("polypeptide"),
    )
    props = F.array(
        F.struct(F.lit("InChIKey").alias("kind"), F.lit("first").alias("value")),
        F.struct(F.lit("Molecular Weight").alias("kind"), F.col("molecular_weight").alias("value")),
        F.struct(F.lit("InChIKey").alias("kind"), F.col("inchikey").alias("value")),
    )
    nested = F.array(F.struct(F.lit("nested").alias("name")))
    dump = rows.select(
        F.lit("small molecule").alias("_type"),
        F.array(second, primary).alias("drugbank-id"),
        "name", "description", "state", "indication",
        F.col("mechanism_of_action").alias("mechanism-of-action"),
        F.when(F.size("groups") > 0, _nest(F.col("groups"), "group")).alias("groups"),
        _nest(F.col("synonyms"), "synonym").alias("synonyms"),
        _nest(props, "property").alias("calculated-properties"),
        _nest(F.transform("categories", lambda c: F.struct(c.alias("category"))), "category").alias("categories"),
        _nest(F.transform("pathways", lambda p: F.struct(p["smpdb_id"].alias("smpdb-id"), p["name"].alias("name"), _nest(nested, "drug").alias("drugs"))), "pathway").alias("pathways"),
        F.when(F.size("targets") > 0, _nest(F.transform("targets", relation), "target")).alias("targets"),
        _nest(F.transform("enzymes", relation), "enzyme").alias("enzymes"),
    )
    return write_xml(dump, scratch_dir(spark, "drug-xml"), "drug", DRUG_ROOT)


RECORD_SQL = """SELECT drugbank_id, name, description, state, {key} AS inchikey, array_to_string("groups", ',') AS "groups",
  array_to_string(synonyms, ',') AS synonyms, n_targets::INTEGER AS targets, 1 AS enzymes FROM drugs"""
KEY_SQL = "nullif(inchikey, '')"


def _record(df):
    return df.select(
        "drugbank_id", "name", "description", "state", "inchikey",
        F.array_join("groups", ",").alias("groups"), F.array_join("synonyms", ",").alias("synonyms"),
        F.size("targets").alias("targets"), F.size("enzymes").alias("enzymes"),
    )


@query("drug_xml_roundtrip", f"WITH {DRUGS_SQL} " + RECORD_SQL.format(key=KEY_SQL))
def drug_xml_roundtrip(spark, sf):
    return _record(drugs.read_drugs(spark, drug_dump(spark, sf)))


ATTRIBUTE_ORDER = """SELECT 'DB' || p_partkey AS drugbank_id, p_name AS name FROM part"""


@query("drug_xml_any_attributes", ATTRIBUTE_ORDER)
def drug_xml_any_attributes(spark, sf):
    """Records whose type is not the first attribute, or that have none; a nested element is no record."""
    part = T.table(spark, sf, "part")
    head = F.element_at(F.array(F.lit("<drug>"), F.lit('<drug created="2005" type="x">'), F.lit("<drug type='x'>")), (F.col("p_partkey") % 3 + 1).cast("int"))
    nested = F.lit("<pathways><pathway><drugs><drug><drugbank-id>N</drugbank-id><name>n</name></drug><drug><name>m</name></drug></drugs></pathway></pathways>")
    record = F.concat(head, F.lit('<drugbank-id primary="true">DB'), "p_partkey", F.lit("</drugbank-id><name>"), "p_name", F.lit("</name>"), nested, F.lit("</drug>"))
    path = scratch_dir(spark, "drug-xml-attributes")
    T.spread(part).select(record.alias("value")).write.text(path)
    return drugs.read_drugs(spark, path).select("drugbank_id", "name")


def _odd_dump(spark, sf, name, inside):
    """Attribute-free records out of parts, ``inside`` between id and name."""
    part = T.table(spark, sf, "part")
    record = F.concat(F.lit("<drug><drugbank-id>DB"), "p_partkey", F.lit("</drugbank-id>"), inside, F.lit("<name>"), "p_name", F.lit("</name></drug>"))
    path = scratch_dir(spark, name)
    T.spread(part).select(record.alias("value")).write.text(path)
    return path


def _with_rejects(spark, path):
    rejects = drugs.read_rejects(spark, path).select(F.lit("reject").alias("drugbank_id"), F.col("text").alias("name"))
    return drugs.read_drugs(spark, path).select("drugbank_id", "name").unionByName(rejects)


@query("drug_xml_nested_attributes", ATTRIBUTE_ORDER)
def drug_xml_nested_attributes(spark, sf):
    """Nested elements that have attributes are no records, and no record is a reject."""
    kind = F.concat(F.lit('<drug kind="'), "p_brand", F.lit('" a="1>0"><drugbank-id>N</drugbank-id></drug><drug kind="y"/>'))
    nested = F.concat(F.lit("<pathways><pathway><drugs>"), kind, F.lit("</drugs></pathway></pathways>"))
    return _with_rejects(spark, _odd_dump(spark, sf, "drug-xml-nested", nested))


@query("drug_xml_cdata", ATTRIBUTE_ORDER)
def drug_xml_cdata(spark, sf):
    """Text in CDATA, comments and instructions that looks like tags is none."""
    odd = F.element_at(
        F.array(
            F.lit('<description><![CDATA[ <drug type="x"> </drug> </pathways> ]]></description>'),
            F.lit("<!-- <drug> a </drug> <drug> --><?note </drug> <pathways> ?>"),
            F.lit("<toxicity><![CDATA[</drug>]]></toxicity><pathways><!-- ]]> </pathways> --><pathway><drugs><drug/></drugs></pathway></pathways>"),
        ),
        (F.col("p_partkey") % 3 + 1).cast("int"),
    )
    return _with_rejects(spark, _odd_dump(spark, sf, "drug-xml-cdata", odd))


@query("drug_xml_basic", f"WITH {DRUGS_SQL} " + RECORD_SQL.format(key="'first'"))
def drug_xml_basic(spark, sf):
    return _record(drugs.read_drugs_basic(spark, drug_dump(spark, sf)))


@query(
    "drug_xml_approved_only",
    f"""WITH {DRUGS_SQL} SELECT drugbank_id, array_to_string("groups", ',') AS "groups" FROM drugs
WHERE NOT list_has_any("groups", ['experimental', 'investigational'])""",
)
def drug_xml_approved_only(spark, sf):
    rows = drugs.read_drugs(spark, drug_dump(spark, sf), include_experimental=False)
    return rows.select("drugbank_id", F.array_join("groups", ",").alias("groups"))


@query(
    "drug_xml_limited",
    f"WITH {DRUGS_SQL} SELECT drugbank_id, name FROM drugs ORDER BY drugbank_id LIMIT 100",
)
def drug_xml_limited(spark, sf):
    """The scan's row limit is what this query checks; the dump holds all parts."""
    return drugs.read_drugs(spark, drug_dump(spark, sf), limit=100).select("drugbank_id", "name")


@query(
    "drug_xml_relations",
    f"""WITH {DRUGS_SQL} SELECT drugbank_id, 'TARGETS' AS type, unnest(generate_series(1, n_targets)) AS n,
  'n' AS target_name, 'Humans' AS organism, 'a' AS actions FROM drugs WHERE n_targets > 0
UNION ALL SELECT drugbank_id, 'METABOLIZED_BY', p_size, 'n', 'Humans', 'a' FROM drugs""",
)
def drug_xml_relations(spark, sf):
    edges = E.relation_edges(drugs.read_drugs(spark, drug_dump(spark, sf)))
    number = F.regexp_extract("target", r"\d+", 0).cast("long")
    return edges.select(
        F.col("source").alias("drugbank_id"), "type", number.alias("n"), "target_name", "organism", "actions"
    )


def vocabulary_dump(spark, sf):
    """Path of a vocabulary CSV of the larger parts."""
    part = T.spread(T.table(spark, sf, "part")).where("p_size > 10")
    rows = part.select(
        T.key("P", "p_partkey").alias("DrugBank ID"),
        F.lit("A1 | A2").alias("Accession Numbers"),
        F.concat("p_name", F.lit(', "quoted"')).alias("Common name"),
        T.key("VC", "p_size").alias("CAS"),
        T.key("VU", "p_partkey").alias("UNII"),
        F.when(F.col("p_size") > 14, F.concat_ws("|", "p_brand", "p_name")).alias("Synonyms"),
        T.key("VK", "p_partkey").alias("Standard InChI Key"),
    )
    path = scratch_dir(spark, "vocabulary")
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


@query(
    "vocabulary_scan",
    """SELECT 'P' || p_partkey AS drugbank_id, p_name || ', "quoted"' AS name, 'VC' || p_size AS cas_number,
  'VU' || p_partkey AS unii, CASE WHEN p_size > 14 THEN p_brand || '|' || p_name END AS synonyms, 'VK' || p_partkey AS inchikey,
  'A1 | A2' AS accession_numbers FROM part WHERE p_size > 10""",
)
def vocabulary_scan(spark, sf):
    return drugs.read_vocabulary(spark, vocabulary_dump(spark, sf))


def sdf_dump(spark, sf):
    """Path of SDF text of all parts; half name their id in a property, half in the title."""
    size = F.col("p_size")
    block = lambda name, value: F.concat(F.lit(f"> <{name}>\n"), value, F.lit("\n\n"))
    title = F.when(size > 25, F.lit("molecule")).otherwise(T.key("P", "p_partkey"))
    record = F.concat(
        title,
        F.lit("\n  generated\n\n  0  0\nM  END\n"),
        F.when(size > 25, block("DATABASE_ID", T.key("P", "p_partkey"))).otherwise(F.lit("")),
        block("FORMULA", F.lit("old")),
        block("FORMULA", F.concat(F.lit("C"), size.cast("string"))),
        block("EXACT_MASS", F.col("p_retailprice").cast("string")),
        block("NOTE", F.concat(F.col("p_brand"), F.lit("\n"), F.col("p_type"))),
        F.lit("$$$$"),
    )
    path = scratch_dir(spark, "sdf")
    T.spread(T.table(spark, sf, "part")).select(record).write.mode("overwrite").text(path)
    return path


@query(
    "sdf_properties",
    """SELECT 'P' || p_partkey AS drug_id, 'C' || p_size AS formula, p_retailprice AS mass, p_brand || '/' || p_type AS note FROM part""",
)
def sdf_properties(spark, sf):
    rows = drugs.read_sdf(spark, sdf_dump(spark, sf))
    prop = lambda name: F.try_element_at("props", F.lit(name))
    return rows.select(
        "drug_id",
        prop("FORMULA").alias("formula"),
        prop("EXACT_MASS").cast("double").alias("mass"),
        F.translate(prop("NOTE"), "\n", "/").alias("note"),
    )


@query(
    "integrated_drug_table",
    f"""WITH {DRUGS_SQL}
SELECT drugbank_id, CASE WHEN coalesce(inchikey, '') <> '' THEN inchikey WHEN p_size > 10 THEN 'VK' || p_partkey END AS inchikey,
  CASE WHEN p_size > 10 THEN 'VU' || p_partkey END AS unii, 'C' || p_size AS molecular_formula, true AS has_structure_data FROM drugs""",
)
def integrated_drug_table(spark, sf):
    structures = drug_table.sdf_structures(spark, sdf_dump(spark, sf))
    rows = drug_table.integrated_drugs(spark, drug_dump(spark, sf), vocabulary_dump(spark, sf), structures)
    return rows.select("drugbank_id", "inchikey", "unii", "molecular_formula", "has_structure_data")


# --- taxonomy ---


def descriptor_elements(rows):
    """Descriptor rows in the element structure of the dump; notes sit in the preferred concept."""
    term = lambda s: F.struct(s.alias("String"))
    concepts = F.array(
        F.struct(
            F.lit("N").alias("_PreferredConceptYN"),
            F.lit("other note").alias("ScopeNote"),
            _nest(F.transform(F.slice("synonyms", 1, 1), term), "Term").alias("TermList"),
        ),
        F.struct(
            F.lit("Y").alias("_PreferredConceptYN"),
            F.col("description").alias("ScopeNote"),
            _nest(F.transform(F.concat("synonyms", "synonyms"), term), "Term").alias("TermList"),
        ),
    )
    qualifier = F.array(_nest(F.lit("Q000001"), "QualifierReferredTo", "QualifierUI"))
    return rows.select(
        F.col("id").alias("DescriptorUI"),
        _nest(F.col("name"), "String").alias("DescriptorName"),
        _nest(F.col("tree_numbers"), "TreeNumber").alias("TreeNumberList"),
        _nest(concepts, "Concept").alias("ConceptList"),
        _nest(qualifier, "AllowableQualifier").alias("AllowableQualifierList"),
    )


def descriptor_dump(spark, sf, folder, year=2025):
    path = f"{folder}/desc{year}.xml"
    return write_xml(descriptor_elements(descriptors(spark, sf)), path, "DescriptorRecord", "DescriptorRecordSet")


@query(
    "mesh_xml_roundtrip",
    f"""WITH {TREES_SQL}
SELECT id, name, array_to_string(tree_numbers, ',') AS tree_numbers, description,
  array_to_string(list_sort(list_distinct(synonyms)), ',') AS synonyms, 'Q000001' AS allowed_qualifiers, true AS is_disease
FROM descriptors WHERE len(list_filter(tree_numbers, lambda t: starts_with(t, 'C'))) > 0""",
)
def mesh_xml_roundtrip(spark, sf):
    folder = scratch_dir(spark, "mesh")
    descriptor_dump(spark, sf, folder)
    rows = taxonomy.read_kind(spark, folder, "desc", 2025)
    join = lambda c: F.array_join(c, ",").alias(c)
    return rows.select(
        "id", "name", join("tree_numbers"), "description", join("synonyms"), join("allowed_qualifiers"), "is_disease"
    )


@query(
    "mesh_qualifiers",
    """SELECT 'Q' || n_nationkey AS id, n_name AS name, 'Q' || n_regionkey || ',Q99' AS tree_numbers,
  CASE WHEN n_regionkey > 2 THEN 'note' END AS description FROM nation WHERE n_nationkey <> 3""",
)
def mesh_qualifiers(spark, sf):
    rows = T.table(spark, sf, "nation").select(
        T.key("Q", "n_nationkey").alias("QualifierUI"),
        _nest(F.when(F.col("n_nationkey") != 3, F.col("n_name")), "String").alias("QualifierName"),
        F.when(F.col("n_regionkey") > 2, F.lit(" note ")).alias("ScopeNote"),
        _nest(F.array(T.key("Q", "n_regionkey"), F.lit(" Q99 ")), "TreeNumber").alias("TreeNumberList"),
    )
    folder = scratch_dir(spark, "mesh")
    write_xml(rows, f"{folder}/qual2025.xml", "QualifierRecord", "QualifierRecordSet")
    found = taxonomy.read_kind(spark, folder, "qual", 2025)
    return found.select("id", "name", F.array_join("tree_numbers", ",").alias("tree_numbers"), "description")


@query(
    "mesh_supplementary",
    """SELECT 'S' || s_suppkey AS id, s_name AS name, 'D' || s_nationkey AS mapped_descriptors,
  CASE WHEN s_acctbal > 0 THEN 'A1,A' || s_nationkey ELSE '' END AS pharmacological_actions FROM supplier""",
)
def mesh_supplementary(spark, sf):
    referred = lambda c: _nest(c, "DescriptorReferredTo", "DescriptorUI")
    actions = F.array(referred(F.lit("A1")), referred(T.key("A", "s_nationkey")))
    rows = T.table(spark, sf, "supplier").select(
        T.key("S", "s_suppkey").alias("SupplementalRecordUI"),
        _nest(F.col("s_name"), "String").alias("SupplementalRecordName"),
        _nest(F.array(referred(T.key("D", "s_nationkey"))), "HeadingMappedTo").alias("HeadingMappedToList"),
        F.when(F.col("s_acctbal") > 0, _nest(actions, "PharmacologicalAction")).alias("PharmacologicalActionList"),
    )
    folder = scratch_dir(spark, "mesh")
    write_xml(rows, f"{folder}/supp2025.xml", "SupplementalRecord", "SupplementalRecordSet")
    found = taxonomy.read_kind(spark, folder, "supp", 2025)
    join = lambda c: F.array_join(c, ",").alias(c)
    return found.select("id", "name", join("mapped_descriptors"), join("pharmacological_actions"))


def yearly_dump(spark, sf):
    """Folder of one descriptor file per order year; nameless customers are absent from a year."""
    folder = scratch_dir(spark, "mesh")
    rows = write_through(
        yearly(spark, sf).select(
            "id", "year", "name",
            F.array(F.concat(F.lit("C01."), "id")).alias("tree_numbers"),
            F.lit(None).cast("string").alias("description"),
            F.array("id").alias("synonyms"),
        ),
        "yearly",
    )
    for year in [r["year"] for r in rows.select("year").distinct().collect()]:
        one = descriptor_elements(rows.where(F.col("year") == year))
        write_xml(one, f"{folder}/desc{year}.xml", "DescriptorRecord", "DescriptorRecordSet")
    return folder


YEARS_SQL = """yearly AS (SELECT 'C' || o_custkey AS id, year(o_orderdate)::INTEGER AS year,
  arg_max(CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority ELSE '' END, o_orderkey) AS name FROM orders GROUP BY 1, 2),
valid AS (SELECT * FROM yearly WHERE name <> '')"""


@query(
    "mesh_years",
    f"WITH {YEARS_SQL} SELECT year, count(*) AS descriptors, year = max(year) OVER () AS is_latest FROM valid GROUP BY year",
)
def mesh_years(spark, sf):
    folder = yearly_dump(spark, sf)
    tables = taxonomy_tables.all_year_tables(spark, folder)
    counts = tables["descriptors"].groupBy("year").agg(F.count("*").alias("descriptors"))
    latest = tables["latest_descriptors"].select(F.col("year").alias("_latest")).distinct()
    rows = counts.join(latest, F.col("year") == F.col("_latest"), "left")
    known = taxonomy.available_years(spark, folder)
    return rows.join(known, "year").select("year", "descriptors", F.col("_latest").isNotNull().alias("is_latest"))


@query(
    "mesh_years_combined",
    f"WITH {YEARS_SQL} SELECT id, max(year) AS year, arg_max(name, year) AS name FROM valid GROUP BY id",
)
def mesh_years_combined(spark, sf):
    tables = taxonomy_tables.all_year_tables(spark, yearly_dump(spark, sf))
    return taxonomy_tables.combined_lookup(tables)["descriptors"].select("id", "year", "name")


@query(
    "mesh_one_year_terms",
    f"""WITH {TREES_SQL}, kept AS (SELECT * FROM descriptors WHERE len(list_filter(tree_numbers, lambda t: starts_with(t, 'C'))) > 0),
terms AS (SELECT lower(name) AS term, id, true AS is_name FROM kept UNION ALL SELECT lower(unnest(synonyms)), id, false FROM kept)
SELECT term, coalesce(max(id) FILTER (WHERE is_name), min(id) FILTER (WHERE NOT is_name)) AS id FROM terms GROUP BY term""",
)
def mesh_one_year_terms(spark, sf):
    folder = scratch_dir(spark, "mesh")
    descriptor_dump(spark, sf, folder)
    return taxonomy_tables.year_tables(spark, folder, 2025)["terms"]


# --- other scans and sinks ---


@query(
    "association_scan",
    """SELECT 'S' || l_suppkey AS "targetId", 'C' || o_custkey AS "diseaseId", l_discount AS score, l_linestatus AS "datasourceId"
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_tax > 0""",
)
def association_scan(spark, sf):
    path = scratch_dir(spark, "associations")
    T.associations(spark, sf).write.parquet(path)
    return readers.read_associations(spark, path)


@query(
    "id_map_scan",
    "SELECT 'C' || o_custkey AS key, 'H' || max(o_orderkey) AS value FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1",
)
def id_map_scan(spark, sf):
    """The map written as CSV in order, so that the last duplicate is the largest order key."""
    path = scratch_dir(spark, "id-map")
    rows = T.disease_map_rows(spark, sf).orderBy("ord")
    rows.select(F.col("key").alias("index"), F.col("value").alias("0")).write.option("header", True).csv(path)
    return readers.read_id_map(spark, path)


@query(
    "node_csv_roundtrip",
    """SELECT 'P' || p_partkey || '(Drug)' AS "id:ID", 'Drug' AS ":LABEL", p_name AS "name:string",
  CASE WHEN p_size > 15 THEN 'treats ' || p_brand END AS "indication:string",
  p_type || ',' || p_brand || ',' || p_type AS "synonyms:string" FROM part WHERE p_size <> 7
UNION ALL SELECT 'P' || p_partkey || '(Drug)', 'Drug', NULL, CASE WHEN p_size > 15 THEN 'treats ' || p_brand END,
  p_type || ',' || p_brand || ',' || p_type FROM part WHERE p_size = 7""",
)
def node_csv_roundtrip(spark, sf):
    path = scratch_dir(spark, "node-csv")
    written = sinks.write_node_csv(N.drug_record_nodes(drug_records(spark, sf)), path, ("Drug",))
    rows = readers.read_graph_csv(spark, written["Drug"])
    return rows.select("id:ID", ":LABEL", "name:string", "indication:string", "synonyms:string")


@query(
    "edge_csv_roundtrip",
    """SELECT 'P' || l_partkey || '(Drug)' AS ":START_ID", 'S' || l_suppkey || '(Target)' AS ":END_ID", 'TARGETS' AS ":TYPE",
  min(l_returnflag) AS "evidence:string", NULL::VARCHAR AS "via_target:string" FROM lineitem GROUP BY 1, 2""",
)
def edge_csv_roundtrip(spark, sf):
    edges = E.dedupe_edges(E.union_edges(E.known_drug_edges(T.known_drugs(spark, sf))))
    path = sinks.write_edge_csv(E.suffix_edges(edges, T.nodes(spark, sf)), scratch_dir(spark, "edge-csv"))
    rows = readers.read_graph_csv(spark, path)
    return rows.select(":START_ID", ":END_ID", ":TYPE", "evidence:string", "via_target:string")


@query(
    "corpus_sink",
    "SELECT lang AS collection, doc_id::VARCHAR AS id, length(text) AS n FROM documents",
)
def corpus_sink(spark, sf):
    docs = T.table(spark, sf, "documents").select(
        F.col("lang").alias("collection"), F.col("doc_id").cast("string").alias("id"), F.col("text").alias("description")
    )
    path = sinks.write_corpus(docs, scratch_dir(spark, "corpus"))
    rows = spark.read.schema("id string, description string, collection string").parquet(path)
    return rows.select("collection", "id", F.length("description").cast("long").alias("n"))


@query(
    "graph_build_counts",
    """WITH e AS (
  SELECT DISTINCT 'TARGETS' AS type, l_partkey AS a, l_suppkey AS b FROM lineitem
  UNION ALL SELECT DISTINCT 'INDICATED_FOR', l_partkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT DISTINCT 'INVOLVED_IN', l_suppkey, dense_rank() OVER (ORDER BY p_type) FROM lineitem JOIN part ON l_partkey = p_partkey),
a AS (SELECT count(*) AS n FROM (SELECT DISTINCT p_type, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN (SELECT DISTINCT l_suppkey AS s, p_type FROM lineitem JOIN part ON l_partkey = p_partkey) ON s = l_suppkey))
SELECT type, count(*) AS n FROM e GROUP BY type UNION ALL SELECT 'ASSOCIATED_WITH', n FROM a""",
)
def graph_build_counts(spark, sf):
    """The whole build, nodes to stored edges, counted per edge type."""
    customer, supplier = T.table(spark, sf, "customer"), T.table(spark, sf, "supplier")
    protein = F.array(F.struct(F.lit("x").alias("id"), F.lit("y").alias("source")))
    pathways = T.nested_targets(spark, sf).groupBy("id").agg(F.collect_set(F.col("pathways")[0]).alias("pathways"))
    targets = supplier.select(T.key("S", "s_suppkey").alias("id"), F.col("s_name").alias("approvedSymbol"), protein.alias("proteinIds"))
    sources = graph_build.Sources(
        target=targets.join(pathways, "id", "left"),
        disease=customer.select(T.key("C", "c_custkey").alias("id"), F.col("c_name").alias("name")),
        known_drug=T.known_drugs(spark, sf),
        reactome=T.table(spark, sf, "part").select(F.col("p_type").alias("id"), F.col("p_type").alias("label")).distinct(),
        association_overall_direct=T.associations(spark, sf),
        drug_indication=T.indications(spark, sf),
        drugs=drug_records(spark, sf).withColumns(
            {c: F.filter(c, lambda r: F.lit(False)) for c in ("targets", "enzymes")}
        ),
    )
    _, edges = graph_build.build_graph(sources)
    return edges.groupBy("type").agg(F.count("*").alias("n"))



