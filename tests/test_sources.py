from __future__ import annotations

import os
import pytest
from pyspark.sql import functions as F

from vinculum.operators.edges import relation_edges
from vinculum.plans import drug_table, taxonomy_tables
from vinculum.sources import drugs, readers, sinks, taxonomy
from vinculum.sources.xml_records import xml_records

DRUGS = """<?xml version="1.0" encoding="UTF-8"?>
<drugbank xmlns="http://www.drugbank.ca" version="5.1">
<drug type="small molecule">
  <drugbank-id>OLD1</drugbank-id><drugbank-id primary="true"> DB1 </drugbank-id>
  <name> One
  </name><description>   </description>
  <groups><group>approved</group><group>experimental</group></groups>
  <synonyms><synonym language="en" coder="x">B</synonym><synonym> A </synonym></synonyms>
  <calculated-properties>
    <property><kind>InChIKey</kind><value>K1</value></property>
    <property><kind>InChIKey</kind><value>K2</value></property>
    <property><kind>SMILES</kind><value>CC&amp;O</value></property>
  </calculated-properties>
  <pathways><pathway><smpdb-id>SMP1</smpdb-id><name>p</name><category>c</category>
    <drugs><drug><drugbank-id>DB9</drugbank-id><name>nested</name></drug></drugs></pathway></pathways>
  <targets>
    <target><id>T1</id><name>t</name><organism>Humans</organism><actions><action>inhibitor</action><action>agonist</action></actions>
      <polypeptide id="P1"><external-identifiers>
        <external-identifier><resource>GenBank</resource><identifier>G</identifier></external-identifier>
        <external-identifier><resource>UniProtKB</resource><identifier>U1</identifier></external-identifier>
        <external-identifier><resource>UniProtKB</resource><identifier>U2</identifier></external-identifier>
      </external-identifiers></polypeptide></target>
    <target><id>T2</id></target>
  </targets>
</drug>
<drug type="biotech"><drugbank-id>DB2</drugbank-id><drugbank-id>DB2b</drugbank-id><name>Two</name><groups><group>approved</group></groups></drug>
<drug type="biotech"><name>no id</name></drug>
<drug type="biotech"><drugbank-id primary="true">DB3</drugbank-id><name>broken<name></drug>
<drug type="biotech"><drugbank-id primary="true">DB4</drugbank-id><name>Four</name></drug>
</drugbank>
"""


@pytest.fixture()
def drug_xml(tmp_path):
    path = tmp_path / "drugs.xml"
    path.write_text(DRUGS, encoding="utf-8")
    return str(path)


def by_id(df, key="drugbank_id"):
    return {r[key]: r for r in df.collect()}


def test_drug_records(spark, drug_xml):
    rows = by_id(drugs.read_drugs(spark, drug_xml))
    assert sorted(rows) == ["DB1", "DB2", "DB4"]
    one = rows["DB1"]
    assert (one["name"], one["description"], one["inchikey"], one["smiles"]) == ("One", None, "K2", "CC&O")
    assert one["groups"] == ["approved", "experimental"] and one["synonyms"] == ["B", "A"]
    assert [p["smpdb_id"] for p in one["pathways"]] == ["SMP1"]
    assert [(t["id"], t["uniprot_id"], t["actions"]) for t in one["targets"]] == [
        ("T1", "U1", ["inhibitor", "agonist"]),
        ("T2", None, []),
    ]
    assert rows["DB4"]["targets"] == [] and rows["DB4"]["groups"] == []


def test_only_the_malformed_record_is_rejected(spark, drug_xml):
    rejects = drugs.read_rejects(spark, drug_xml).collect()
    assert len(rejects) == 1 and "DB3" in rejects[0]["text"] and "DB4" not in rejects[0]["text"]


def test_records_are_found_by_element_not_by_attributes(spark, tmp_path):
    path = tmp_path / "plain.xml"
    nested = "<pathways><pathway><drugs><drug><drugbank-id>N</drugbank-id></drug></drugs></pathway></pathways>"
    path.write_text(
        f"<drugbank><drug><drugbank-id>X</drugbank-id>{nested}</drug><drug><drugbank-id>Y</drugbank-id></drug>"
        f'<drug created="1" type="b"><drugbank-id>Z</drugbank-id>{nested}</drug><drug\ntype="b"><drugbank-id>V</drugbank-id></drug>'
        f"<drug updated='2'><drugbank-id>W</drugbank-id></drugbank>"
    )
    assert sorted(by_id(drugs.read_drugs(spark, str(path)))) == ["V", "X", "Y", "Z"]
    rejects = drugs.read_rejects(spark, str(path)).collect()
    assert len(rejects) == 1 and "W" in rejects[0]["text"]


NESTED = "<pathways><pathway><drugs><drug{}><drugbank-id>N{}</drugbank-id></drug><drug/></drugs></pathway></pathways>"


def odd_records(n):
    """Records with nested elements that have attributes, comments, CDATA and instructions that look like tags, on one line."""
    out = []
    for i in range(n):
        inside = [
            NESTED.format(' kind="x"', i),
            "<description><![CDATA[ a <drug type='x'> b </drug> ]]></description>",
            "<!-- <drug> </drug> <pathways> --><indication>i</indication>",
            "<?note <drug> ?>" + NESTED.format("", i),
            "<toxicity><![CDATA[</drug>]]></toxicity><!-- ]]> </pathways> -->" + NESTED.format("", i),
            "",
        ][i % 6]
        out.append(f"<drug><drugbank-id>DB{i}</drugbank-id>{inside}<name>{'n' * (i % 50)}x</name></drug>")
    return out


@pytest.mark.parametrize("size", ["300", "1000", "100000"])
def test_nesting_comments_and_cdata_over_split_files(spark, tmp_path, size):
    path = tmp_path / "odd.xml"
    path.write_text("<drugbank><!-- </drug><drug> -->" + "".join(odd_records(60)) + "</drugbank>")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        found = drugs.read_drugs(spark, str(path)).collect()
        assert sorted(r["drugbank_id"] for r in found) == sorted(f"DB{i}" for i in range(60))
        assert {r["drugbank_id"]: r["name"] for r in found} == {f"DB{i}": "n" * (i % 50) + "x" for i in range(60)}
        assert drugs.read_rejects(spark, str(path)).count() == 0
        if size == "1000":
            assert xml_records(spark, str(path), "drug", "pathways").rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_a_record_without_end_costs_only_itself(spark, tmp_path):
    path = tmp_path / "broken.xml"
    good = "<drug><drugbank-id>DB{}</drugbank-id>" + NESTED.format("", 0) + "</drug>"
    path.write_text("<r>" + good.format(1) + "<drug><drugbank-id>BAD1</drugbank-id>" + good.format(2) + "<drug><drugbank-id>BAD2</drugbank-id><pathways></drug>" + good.format(3) + "<drug><drugbank-id>BAD4</drugbank-id>")
    assert sorted(by_id(drugs.read_drugs(spark, str(path)))) == ["BAD4", "DB1", "DB2", "DB3"]
    rejects = drugs.read_rejects(spark, str(path)).collect()
    assert sorted(r["text"][19:23] for r in rejects) == ["BAD1", "BAD2"]


def test_large_file_is_split(spark, tmp_path):
    path = tmp_path / "big.xml"
    record = '<drug type="biotech">\n<drugbank-id primary="true">DB{}</drugbank-id>\n<name>n</name>\n</drug>\n'
    path.write_text("<drugbank>\n" + "".join(record.format(i) for i in range(3000)) + "</drugbank>")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = drugs.read_drugs(spark, str(path))
        assert rows.rdd.getNumPartitions() > 5
        assert rows.select("drugbank_id").distinct().count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_approved_only_drops_mixed_groups(spark, drug_xml):
    assert sorted(by_id(drugs.read_drugs(spark, drug_xml, include_experimental=False))) == ["DB2", "DB4"]


def test_limit_and_basic_scan(spark, drug_xml):
    assert sorted(by_id(drugs.read_drugs(spark, drug_xml, limit=2))) == ["DB1", "DB2"]
    basic = drugs.read_drugs_basic(spark, drug_xml)
    assert basic.columns == list(drugs.BASIC_FIELDS)
    assert by_id(basic)["DB1"]["inchikey"] == "K1"


def test_relation_edges_need_a_uniprot_id(spark, drug_xml):
    edges = relation_edges(drugs.read_drugs(spark, drug_xml)).collect()
    assert [(e["source"], e["target"], e["type"], e["actions"]) for e in edges] == [("DB1", "U1", "TARGETS", "inhibitor,agonist")]


SDF = (
    "DB1\n  prog\n\n  0  0\nM  END\n> <FORMULA>\nC1\n\n> <NOTE>\nline one\nline two\n\n> <FORMULA>\nC2\n\n$$$$\n"
    "molecule\n\n\nM  END\n> <DATABASE_ID>\nDB2\n\n> <drugbank_id>\nother\n\n$$$$\n"
    "DB1\r\n\r\n\r\nM  END\r\n> <FORMULA>\r\nC9\r\n\r\n$$$$\n\n"
)


def test_sdf(spark, tmp_path):
    path = tmp_path / "a.sdf"
    path.write_bytes(SDF.encode())
    raw = spark.createDataFrame([(r,) for r in SDF.split("$$$$")], "value string")
    parsed = [(r["drug_id"], r["props"]) for r in drugs.parse_sdf_records(raw).collect()]
    assert ("DB1", {"FORMULA": "C2", "NOTE": "line one\nline two"}) in parsed
    rows = by_id(drugs.read_sdf(spark, str(path)), "drug_id")
    assert sorted(rows) == ["DB1", "DB2"]
    assert rows["DB1"]["props"] == {"FORMULA": "C9"}
    assert drugs.read_sdf(spark, str(tmp_path / "absent.sdf")) is None


def test_integrated_table(spark, drug_xml, tmp_path):
    vocabulary = tmp_path / "v.csv"
    vocabulary.write_text(
        "DrugBank ID,Accession Numbers,Common name,CAS,UNII,Synonyms,Standard InChI Key\n"
        "DB1,A,One,C1,U1,B | C|Z,V1\nDB2,A,Two,C2,U2,,V2\nDB7,A,Seven,,,x,V7\n"
    )
    sdf = tmp_path / "a.sdf"
    sdf.write_bytes(SDF.encode())
    table = drug_table.integrated_drugs(spark, drug_xml, str(vocabulary), drug_table.sdf_structures(spark, str(sdf)))
    rows = by_id(table)
    assert sorted(rows) == ["DB1", "DB2", "DB4"]
    assert rows["DB1"]["synonyms"] == [" C", "A", "B", "B ", "Z"]
    assert (rows["DB1"]["inchikey"], rows["DB2"]["inchikey"], rows["DB4"]["inchikey"]) == ("K2", "V2", None)
    assert rows["DB2"]["synonyms"] == [] and rows["DB2"]["cas_number"] == "C2"
    assert (rows["DB1"]["molecular_formula"], rows["DB1"]["has_structure_data"]) == ("C9", True)
    assert rows["DB4"]["has_structure_data"] is False
    assert by_id(drug_table.integrated_drugs(spark, drug_xml, str(tmp_path / "none.csv")))["DB2"]["inchikey"] is None
    reports = {k: v.collect() for k, v in drug_table.quality_reports(table).items()}
    assert reports["statistics"][0].asDict() == {
        "total_drugs": 3, "approved_drugs": 2, "experimental_drugs": 1, "drugs_with_targets": 1,
        "drugs_with_indications": 0, "drugs_with_structures": 2,
    }
    assert {(r["group"], r["n"], r["percentage"]) for r in reports["groups"]} == {("approved", 2, 66.67), ("experimental", 1, 33.33)}
    assert [(r["state"], r["n"]) for r in reports["states"]] == [("unknown", 3)]


DESCRIPTOR = """<DescriptorRecord DescriptorClass="1"><DescriptorUI>{ui}</DescriptorUI><DescriptorName><String>{name}</String></DescriptorName>
{extra}<TreeNumberList>{numbers}</TreeNumberList><ConceptList>
<Concept PreferredConceptYN="N"><ScopeNote>other</ScopeNote><TermList><Term><String>{name}</String></Term></TermList></Concept>
<Concept PreferredConceptYN="Y"><ScopeNote> note {ui} </ScopeNote><TermList><Term><String>zeta</String></Term><Term><String>alpha</String></Term></TermList></Concept>
</ConceptList></DescriptorRecord>
"""


def descriptor(ui, name, *numbers, extra=""):
    listed = "".join(f"<TreeNumber>{n}</TreeNumber>" for n in numbers)
    return DESCRIPTOR.format(ui=ui, name=name, numbers=listed, extra=extra)


@pytest.fixture()
def mesh(tmp_path):
    head, tail = '<?xml version="1.0"?>\n<DescriptorRecordSet LanguageCode="eng">\n', "</DescriptorRecordSet>\n"
    (tmp_path / "desc2020.xml").write_text(
        head + descriptor("D1", "Old name", "C01") + descriptor("D2", "Dropped", "C01.100") + tail
    )
    (tmp_path / "desc2025.xml").write_text(
        head
        + descriptor("D1", "New name", "C01", extra="<ScopeNote>own note</ScopeNote>")
        + descriptor("D3", "Child", "C01.100.200", "F03.1", "C02.5.6")
        + descriptor("D4", "Outside", "F03.1")
        + descriptor("D5", "Single", "C09")
        + descriptor("", "No id", "C01.9")
        + "<DescriptorRecord><DescriptorUI>D6<DescriptorUI></DescriptorRecord>\n"
        + tail
    )
    (tmp_path / "qual2025.xml").write_text(
        "<QualifierRecordSet><QualifierRecord><QualifierUI>Q1</QualifierUI><QualifierName><String>q</String></QualifierName></QualifierRecord></QualifierRecordSet>"
    )
    (tmp_path / "notes.xml").write_text("<x/>")
    return str(tmp_path)


def test_taxonomy_years(spark, mesh):
    assert [r["year"] for r in taxonomy.available_years(spark, mesh).collect()] == [2020, 2025]
    tables = taxonomy_tables.year_tables(spark, mesh, 2025)
    assert "supplementary" not in tables
    rows = by_id(tables["descriptors"], "id")
    assert sorted(rows) == ["D1", "D3", "D5"]
    assert rows["D1"]["description"] == "own note" and rows["D3"]["description"] == "note D3"
    assert rows["D3"]["synonyms"] == ["Child", "alpha", "zeta"]
    with pytest.raises(FileNotFoundError):
        taxonomy_tables.year_tables(spark, mesh, 2021)
    everything = taxonomy_tables.all_year_tables(spark, mesh)
    assert {r["id"] for r in everything["latest_descriptors"].collect()} == {"D1", "D3", "D5"}
    combined = taxonomy_tables.combined_lookup(everything)
    assert {(r["id"], r["name"]) for r in combined["descriptors"].collect()} == {
        ("D1", "New name"), ("D2", "Dropped"), ("D3", "Child"), ("D5", "Single"),
    }
    terms = {r["term"]: r["id"] for r in combined["terms"].collect()}
    assert terms["old name"] == "D1" and terms["dropped"] == "D2" and terms["alpha"] == "D1"


def test_taxonomy_tree(spark, mesh):
    tables = taxonomy_tables.year_tables(spark, mesh, 2025)
    assert {(r["parent"], r["child"]) for r in tables["hierarchy"].collect()} == {
        ("C01", "C01.100"), ("C01.100", "C01.100.200"), ("C02", "C02.5"), ("C02.5", "C02.5.6"),
    }
    names = {r["tree_number"]: (r["name"], r["children"]) for r in tables["hierarchy_nodes"].collect()}
    assert names["C01"] == ("New name", 1) and names["C01.100"] == ("Unknown Node (C01.100)", 1)
    assert "C09" not in names
    rows = by_id(tables["taxonomy"], "id")
    assert rows["D3"]["tree_numbers"] == ["C01.100.200", "C02.5.6"] and not rows["D3"]["is_top_level"]
    assert [(p["id"], p["tree_number"]) for p in rows["D3"]["parents"]] == [(None, "C01.100"), (None, "C02.5")]
    assert rows["D5"]["is_top_level"] and rows["D5"]["parents"] == []


def test_associations_and_maps(spark, tmp_path):
    good = str(tmp_path / "assoc")
    rows = [("T1", "D1", 0.5, "x"), ("", "D1", 0.5, "x"), ("T1", None, 0.5, "x"), ("T1", "D2", None, "x"), ("T1", "D3", float("nan"), "x")]
    spark.createDataFrame(rows, "targetId string, diseaseId string, score double, datasourceId string").write.parquet(good)
    (tmp_path / "assoc" / "broken.parquet").write_text("not parquet")
    assert [tuple(r) for r in readers.read_associations(spark, good, skip_corrupt=True).collect()] == [("T1", "D1", 0.5, "x")]
    with pytest.raises(Exception, match="not a Parquet file|PARQUET|CANNOT_READ|FAILED_READ"):
        readers.read_associations(spark, good).collect()
    assert readers.read_associations(spark, str(tmp_path / "absent")) is None
    (tmp_path / "m.csv").write_text("index,0\nA,1\nB,2\nA,3\n")
    assert {tuple(r) for r in readers.read_id_map(spark, str(tmp_path / "m.csv")).collect()} == {("A", "3"), ("B", "2")}
    (tmp_path / "u.json").write_text('{\n"E1": ["U1", "U2"],\n"E2": [],\n"E1": ["U9"]}')
    assert {tuple(r) for r in readers.read_list_map(spark, str(tmp_path / "u.json")).collect()} == {("E1", "U9"), ("E2", None)}  # the last of equal keys


def test_sinks(spark, tmp_path):
    empty = spark.createDataFrame([], "id string")
    assert sinks.write_records(empty, str(tmp_path / "none")) is None
    with pytest.raises(ValueError):
        sinks.write_records(empty, str(tmp_path / "none"), "pickle")
    nodes = spark.createDataFrame(
        [("a", "Drug", 'x "q",\ny', None, 1.5), ("b", "Pathway", None, "d", None)],
        "id string, type string, name string, description string, molecular_weight double",
    )
    written = sinks.write_node_csv(nodes, str(tmp_path / "csv"))
    assert sorted(written) == ["Disease", "Drug", "Pathway", "Target"]
    drug = readers.read_graph_csv(spark, written["Drug"])
    assert drug.columns[:4] == ["id:ID", ":LABEL", "name:string", "data_source:string"]
    row = drug.collect()[0]
    assert (row["id:ID"], row["name:string"], row["molecular_weight:string"]) == ("a(Drug)", 'x "q", y', "1.5")
    pathway = readers.read_graph_csv(spark, written["Pathway"]).collect()[0]
    assert pathway["description:string"] == "d"
    edges = spark.createDataFrame(
        [("a(Drug)", "b(Pathway)", "T", 2.0, "line\nbreak")], "source string, target string, type string, max_phase double, evidence string"
    )
    row = readers.read_graph_csv(spark, sinks.write_edge_csv(edges, str(tmp_path / "csv"))).collect()[0]
    assert (row["max_phase:string"], row["evidence:string"], row["via_target:string"]) == ("2.0", "line break", None)
    paths = sinks.write_optimised_csv(nodes, edges, str(tmp_path / "opt"))
    names = {r["id"]: r["name"] for r in readers.read_graph_csv(spark, paths["nodes"]).collect()}
    assert names["b"] == "b"
    bundle = sinks.write_taxonomy_bundle({"terms": nodes.withColumn("year", F.lit(2025))}, str(tmp_path / "mesh"), "2025")
    assert spark.read.parquet(bundle["terms"]).where("year = 2025").count() == 2
    sinks.write_report(nodes, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2


def test_dump_of_one_file_is_written_by_many_tasks(spark):
    from workload import dumps

    path = dumps.drug_dump(spark, "/root/testdata/sf0.001")
    assert len([f for f in os.listdir(path.removeprefix("file:")) if f.startswith("part-")]) > 1
