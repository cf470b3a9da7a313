"""Explicit schemas of every source and of the graph tables.

XML types are never inferred: a single ``<group>`` and many of them would
infer to different types. Field names are fixed by the public formats.
"""

from __future__ import annotations

_RELATION = """array<struct<
    id: string, name: string, organism: string,
    actions: struct<action: array<string>>,
    polypeptide: struct<`external-identifiers`: struct<`external-identifier`:
        array<struct<resource: string, identifier: string>>>>>>"""

DRUG_XML = f"""
    `drugbank-id` array<struct<_VALUE: string, _primary: string>>,
    name string, description string, `cas-number` string, unii string, state string,
    groups struct<`group`: array<string>>,
    indication string, pharmacodynamics string, `mechanism-of-action` string,
    toxicity string, metabolism string, absorption string, `half-life` string,
    `protein-binding` string, `route-of-elimination` string,
    synonyms struct<synonym: array<string>>,
    `calculated-properties` struct<property: array<struct<kind: string, value: string>>>,
    `atc-codes` struct<`atc-code`: array<struct<code: string>>>,
    categories struct<category: array<struct<category: string>>>,
    pathways struct<pathway: array<struct<`smpdb-id`: string, name: string, category: string>>>,
    targets struct<target: {_RELATION}>,
    enzymes struct<enzyme: {_RELATION}>,
    transporters struct<transporter: {_RELATION}>,
    carriers struct<carrier: {_RELATION}>
"""

RELATION = "struct<id: string, name: string, organism: string, actions: array<string>, uniprot_id: string>"

# XML list element -> element of one entry, in edge-builder order.
RELATION_ELEMENTS = {"targets": "target", "enzymes": "enzyme", "transporters": "transporter", "carriers": "carrier"}

VOCABULARY_CSV = """
    `DrugBank ID` string, `Accession Numbers` string, `Common name` string, CAS string,
    UNII string, Synonyms string, `Standard InChI Key` string
"""
VOCABULARY_NAMES = {
    "DrugBank ID": "drugbank_id",
    "Accession Numbers": "accession_numbers",
    "Common name": "name",
    "CAS": "cas_number",
    "UNII": "unii",
    "Synonyms": "synonyms",
    "Standard InChI Key": "inchikey",
}

_TREE_NUMBERS = "TreeNumberList struct<TreeNumber: array<string>>"
_REFERRED = "DescriptorReferredTo: struct<DescriptorUI: string>"

DESCRIPTOR_XML = f"""
    DescriptorUI string, DescriptorName struct<String: string>, ScopeNote string,
    {_TREE_NUMBERS},
    ConceptList struct<Concept: array<struct<_PreferredConceptYN: string, ScopeNote: string,
        TermList: struct<Term: array<struct<String: string>>>>>>,
    AllowableQualifierList struct<AllowableQualifier:
        array<struct<QualifierReferredTo: struct<QualifierUI: string>>>>
"""
QUALIFIER_XML = f"""
    QualifierUI string, QualifierName struct<String: string>, ScopeNote string, {_TREE_NUMBERS}
"""
SUPPLEMENTARY_XML = f"""
    SupplementalRecordUI string, SupplementalRecordName struct<String: string>,
    HeadingMappedToList struct<HeadingMappedTo: array<struct<{_REFERRED}>>>,
    PharmacologicalActionList struct<PharmacologicalAction: array<struct<{_REFERRED}>>>
"""

ASSOCIATION = "targetId string, diseaseId string, score double, datasourceId string"

# Columns of the wide edge table, with their types.
EDGE_PAYLOAD = {
    "source_type": "string",
    "target_type": "string",
    "data_source": "string",
    "evidence": "string",
    "target_name": "string",
    "actions": "string",
    "organism": "string",
    "max_phase": "double",
    "efo_name": "string",
    "action_type": "string",
    "mechanism": "string",
    "target_type_detailed": "string",
    "pathwayName": "string",
    "via_target": "string",
}
EDGE_COLUMNS = {"source": "string", "target": "string", "type": "string", **EDGE_PAYLOAD}
