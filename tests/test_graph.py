from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vinculum.functions import ranking
from vinculum.functions.ranking import first_rows
from vinculum.operators.adjacency import store_adjacency
from vinculum.operators import cleanup, edges as E, infer, nodes as N, paths as P, taxonomy as tree
from vinculum.operators.enrich import enrich_structure
from vinculum.operators.harmonise import harmonise
from vinculum.plans import graph_build
from vinculum.session import scratch_dir, scratch_run
from vinculum.sources import readers


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# --- harmonise, edges ---


def test_harmonise_uses_maps_in_order(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    first = spark.createDataFrame([("a", "A")], "key string, value string")
    second = spark.createDataFrame([("a", "X"), ("b", "B")], "key string, value string")
    assert rows(harmonise(df, "id", first, None, second)) == [("A",), ("B",), ("c",)]


def test_dedupe_keeps_the_first_builder(spark):
    first = spark.createDataFrame([("a", "b", "T", "z"), ("a", "b", "T", "y")], "source string, target string, type string, evidence string")
    second = spark.createDataFrame([("a", "b", "T", "a"), ("a", "c", "T", "q"), ("a", "a", "T", "loop")], first.schema)
    unioned = E.union_edges(first, None, second)
    for width in (1, 7):
        kept = E.dedupe_edges(unioned.repartition(width)).select("source", "target", "evidence")
        assert rows(kept) == [("a", "a", "loop"), ("a", "b", "y"), ("a", "c", "q")]


def test_orphans(spark):
    edges = spark.createDataFrame([("a", "b", "T"), ("a", "x", "T"), ("x", "b", "T"), ("a", "a", "T")], "source string, target string, type string")
    nodes = spark.createDataFrame([("a", "Drug"), ("b", "Target")], "id string, type string")
    assert rows(E.remove_orphans(edges, nodes)) == [("a", "a", "T"), ("a", "b", "T")]
    assert rows(E.orphan_edges(edges, nodes)) == [("a", "x", "T"), ("x", "b", "T")]
    assert rows(E.suffix_edges(edges, nodes)) == [("a(Drug)", "a(Drug)", "T"), ("a(Drug)", "b(Target)", "T")]
    assert rows(E.edge_post_pass_counts(edges.unionAll(edges), nodes)) == [(8, 4, 2, 2)]


def test_indications_skip_missing_diseases(spark):
    schema = "id string, indications array<struct<disease: string, efoName: string, maxPhaseForIndication: double>>"
    df = spark.createDataFrame([("d", [("x", "n", None), (None, "n", 1.0), ("", "n", 1.0)]), ("e", []), ("f", None)], schema)
    out = E.indication_edges(df).select("source", "target", "max_phase")
    assert rows(out) == [("d", "x", 0.0)]


# --- inference ---


def _links(assoc, paths, guard):
    out = {}
    for t in {t for t, _ in assoc} & {t for t, _ in paths}:
        ds, ps = {d for x, d in assoc if x == t}, {p for x, p in paths if x == t}
        if guard is not None and len(ds) * len(ps) > guard:
            continue
        for p in ps:
            for d in ds:
                out.setdefault((p, d), set()).add(t)
    return sorted((p, d, len(ts), min(ts)) for (p, d), ts in out.items())


@pytest.mark.parametrize("guard", [None, 6, 5, 100])
def test_inference_matches_brute_force(spark, guard):
    rng = random.Random(3)
    assoc = [(f"t{rng.randrange(6)}", f"d{rng.randrange(9)}") for _ in range(60)] + [("hot", f"d{i}") for i in range(40)]
    paths = [(f"t{rng.randrange(7)}", f"p{rng.randrange(3)}") for _ in range(20)] + [("hot", "p0"), ("hot", "p9")]
    assoc += [("exact", "dx"), ("exact", "dy"), ("exact", "dz")]
    paths += [("exact", "px"), ("exact", "py")]
    a = spark.createDataFrame(assoc, "target string, disease string").distinct()
    p = spark.createDataFrame(paths, "target string, pathway string").distinct()
    assert rows(infer.link_pathways(a, p, guard)) == _links(assoc, paths, guard)


# --- node merge ---


def _merge(entries):
    """The fold of the entries of one id in order."""
    base = dict(entries[0])
    blank = lambda v: not v or str(v).strip() == "" or str(v) == "None"
    for entry in entries[1:]:
        for k, v in entry.items():
            if k in ("id", "type", "ord") or blank(v):
                continue
            if blank(base[k]):
                base[k] = v
            elif isinstance(v, str) and isinstance(base[k], str) and len(v.strip()) > len(base[k].strip()):
                base[k] = v
    return base


def test_merge_matches_the_fold_on_any_partitioning(spark):
    rng = random.Random(5)
    texts = ["", "  ", "None", None, "a", "bb", " b ", "ccc", "dd\n"]
    entries = [
        {
            "id": f"i{rng.randrange(60)}", "type": rng.choice(["Drug", "Target"]), "ord": i, "name": rng.choice(texts),
            "n": rng.choice([None, 0, 1, 2]), "flag": rng.choice([None, True, False]), "items": rng.choice([None, [], ["x"], ["y"]]),
        }
        for i in range(300)
    ]
    expected = {}
    for e in entries:
        expected.setdefault(e["id"], []).append(e)
    want = sorted((i, es[0]["type"], *[_merge(es)[k] for k in ("name", "n", "flag", "items")]) for i, es in expected.items())
    df = spark.createDataFrame(entries, "id string, type string, ord int, name string, n int, flag boolean, items array<string>")
    key = lambda r: r[0]
    for width in (1, 9):
        got = N.merge_nodes(df.repartition(width, F.rand(width))).select("id", "type", "name", "n", "flag", "items")
        assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    counts = N.merge_counts(df).collect()[0]
    assert counts["ids"] == len(expected) and counts["duplicated_ids"] == sum(len(v) > 1 for v in expected.values())


def test_identical_rows_are_dropped(spark):
    df = spark.createDataFrame([("a", ["x"], None), ("a", ["x"], ""), ("a", ["y"], None)], "id string, l array<string>, s string")
    assert N.drop_identical(df).count() == 2
    same_text = spark.createDataFrame([("a", None), ("a", ""), ("b", None)], "id string, name string")
    assert {tuple(r) for r in N.drop_identical(same_text).collect()} == {("a", ""), ("b", None)}


# --- ranking ---


def test_top_k_is_exact_above_the_limit_of_windows(spark, monkeypatch):
    df = spark.range(20_000).select((F.col("id") % 2).alias("g"), F.xxhash64("id").alias("v"), "id")
    order = [F.col("v"), F.col("id")]
    by_ranges = ranking.top_k(df, ["g"], order, 1500)
    monkeypatch.setattr(ranking, "GROUP_LIMIT", 5000)
    plain = ranking.top_k(df, ["g"], order, 1500)
    assert rows(by_ranges) == rows(plain) and by_ranges.count() == 3000


def test_first_per_key_with_a_map_column(spark):
    df = spark.createDataFrame([("a", 1, {"x": "1"}), ("a", 2, {"x": "2"})], "k string, o int, m map<string,string>")
    assert ranking.first_per_key(df, ["k"], ["o"], last=True).collect()[0]["m"] == {"x": "2"}


# --- taxonomy ---


def test_hierarchy_and_terms_match_simple_models(spark):
    rng = random.Random(11)
    records = []
    for i in range(120):
        numbers = [".".join([rng.choice("CF") + str(rng.randrange(3))] + [str(rng.randrange(4)) for _ in range(rng.randrange(4))]) for _ in range(rng.randrange(1, 4))]
        records.append((f"D{i:03}", rng.choice("ABCDE") + str(rng.randrange(30)), numbers, None, [rng.choice("abcde") + str(rng.randrange(30)) for _ in range(rng.randrange(3))]))
    records.append(("D900", "Letter", ["C.1"], None, []))
    df = spark.createDataFrame(records, "id string, name string, tree_numbers array<string>, description string, synonyms array<string>").repartition(5)
    pairs, terms = set(), {}
    for _, _, numbers, _, _ in records:
        for n in numbers:
            parts = n.split(".")
            if n.startswith("C"):
                pairs |= {(".".join(parts[:i]), ".".join(parts[: i + 1])) for i in range(1, len(parts))}
    for i, name, _, _, synonyms in records:
        terms[name.lower()] = i
        for s in synonyms:
            terms.setdefault(s.lower(), i)
    by_name = {r[1].lower() for r in records}
    got_pairs = tree.hierarchy_pairs(df)
    assert set(rows(got_pairs)) == pairs
    got = dict(rows(tree.term_dictionary(df)))
    assert {t for t in got if t in by_name} == by_name and all(got[t] == terms[t] for t in by_name)
    first = {}
    for i, _, _, _, synonyms in records:
        for s in synonyms:
            first.setdefault(s, i)
    assert all(got[s] == i for s, i in first.items() if s not in by_name)
    nodes = {r["tree_number"]: r for r in tree.hierarchy_nodes(got_pairs, df).collect()}
    assert nodes["C"]["name"] == "Category C" and nodes["C"]["children"] == 1
    assert sum(n["children"] for n in nodes.values()) == len(pairs)


# --- paths ---


def _graph(seed, n_nodes=9, n_edges=16):
    rng = random.Random(seed)
    labels = ["Drug", "Target", "Disease"]
    nodes = [(f"n{i}", labels[i % 3], rng.choice([None, "asp", "aspirin", "flu", "x"])) for i in range(n_nodes)]
    edges = {(f"n{rng.randrange(n_nodes)}", f"n{rng.randrange(n_nodes)}", rng.choice("RS")) for _ in range(n_edges)}
    label = {i: t for i, t, _ in nodes}
    return nodes, sorted((a, b, r, label[a], label[b]) for a, b, r in edges)


def _all_paths(nodes, edges, text, hops):
    name = {i: n for i, _, n in nodes}
    label = {i: t for i, t, _ in nodes}
    hit = lambda i: name[i] is not None and text in name[i]
    found = set()

    def walk(trail, used, rels):
        here = trail[-1]
        if used and label[here] == "Disease" and (hit(trail[0]) or hit(here)):
            found.add((len(used), trail, rels, used))
        if len(used) < hops:
            for e in edges:
                if e not in used:
                    if e[0] == here:
                        walk((*trail, e[1]), (*used, e), (*rels, e[2]))
                    elif e[1] == here:
                        walk((*trail, e[0]), (*used, e), (*rels, e[2]))

    for i, t, _ in nodes:
        if t == "Drug":
            walk((i,), (), ())
    return sorted((h, t, r) for h, t, r, _ in found)


EDGE = "source string, target string, type string, source_type string, target_type string"


@pytest.mark.parametrize(("seed", "n_nodes", "n_edges", "hub_edges"), [(1, 9, 16, 100), (2, 9, 16, 5), (3, 5, 22, 100), (4, 6, 9, 2), (5, 12, 18, 100)])
def test_paths_match_brute_force(spark, seed, n_nodes, n_edges, hub_edges):
    nodes, edges = _graph(seed, n_nodes, n_edges)
    n = spark.createDataFrame(nodes, "id string, type string, name string")
    e = spark.createDataFrame(edges, EDGE).repartition(3)
    texts = {1: "asp", 2: "flu", 3: "none such"}
    q = spark.createDataFrame(list(texts.items()), "query_id int, query string")
    adj = store_adjacency(e, hub_edges)
    everything = P.search_paths(q, n, adj, limit=None).collect()
    limited = P.search_paths(q, n, adj, limit=4).collect()
    for i, text in texts.items():
        want = _all_paths(nodes, edges, text, 3)
        got = sorted((r["hops"], tuple(r["nodes"]), tuple(r["rel_types"])) for r in everything if r["query_id"] == i)
        assert got == want
        top = sorted((r["rank"], r["hops"], tuple(r["nodes"]), tuple(r["rel_types"])) for r in limited if r["query_id"] == i)
        assert [t[1:] for t in top] == want[:4]


def test_names_match_for_any_number_of_queries(spark):
    rng = random.Random(4)
    names = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 7))) for _ in range(60)]
    n = spark.createDataFrame([(f"n{i}", "Drug", s) for i, s in enumerate(names)] + [("z", "Drug", None)], "id string, type string, name string")
    texts = [("a" * (i % 3)) + "".join(rng.choice("abcd") for _ in range(1 + i % 4)) for i in range(400)] + [""]
    q = spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")
    for asked in (q, q.where("query_id < 3"), q.where("query_id = 400")):
        kept = {r["query_id"] for r in asked.collect()}
        want = sorted((i, f"n{j}", "Drug") for i, t in enumerate(texts) for j, s in enumerate(names) if t and t in s and i in kept)
        assert rows(P.match_names(asked, n, ("Drug",))) == want


def test_entity_details_spread_a_hub_and_keep_the_lonely(spark):
    nodes = [("hub", "Drug", "Hub"), ("alone", "Drug", "Alone")] + [(f"n{i}", "Target", f"N{i}") for i in range(50)]
    edges = [("hub", f"n{i}", "T", "Drug", "Target") for i in range(50)] + [("hub", "hub", "T", "Drug", "Drug")]
    n = spark.createDataFrame(nodes, "id string, type string, name string")
    e = spark.createDataFrame(edges, EDGE)
    ids = spark.createDataFrame([("hub",), ("alone",), ("absent",)], "entity_id string")
    out = P.entity_details(ids, n, e, chunk=10).collect()
    hub = [c for r in out if r["entity_id"] == "hub" for c in r["connections"]]
    assert len(hub) == 51 and {c["connected"] for c in hub} == {f"N{i}" for i in range(50)} | {"Hub"}
    assert sum(r["entity_id"] == "hub" for r in out) > 1
    lonely = [r for r in out if r["entity_id"] == "alone"]
    assert [tuple(c) for c in lonely[0]["connections"]] == [(None, None)]
    assert {r["entity_id"] for r in out} == {"hub", "alone"}


# --- enrichment, clean-up ---


def test_structure_fills_only_empty_essentials(spark):
    drugs = spark.createDataFrame([("a", 0.0, "kept"), ("b", 2.0, None), ("c", None, None)], "drugbank_id string, logp double, note string")
    side = spark.createDataFrame([("a", 1.0, "new", 7), ("b", 9.0, "new", 8)], "drug_id string, logp double, note string, extra int")
    out = enrich_structure(drugs, side)
    assert rows(out.select("drugbank_id", "logp", "extra", "has_structure_data").na.fill(-1)) == [
        ("a", 1.0, 7, True), ("b", 2.0, 8, True), ("c", -1.0, -1, False),
    ]
    assert {r["note"] for r in out.collect()} == {"kept", None}


def test_cleanup(spark):
    proteins = "array<struct<id: string, source: string>>"
    df = spark.createDataFrame(
        [("a", None, 'x"y', None), ("b", "n", None, [("P1", "s"), (None, "s")])],
        f"id string, name string, state string, proteinIds {proteins}",
    )
    assert rows(cleanup.clean_nodes(df)) == [("a", "a", 'x"y', "[]"), ("b", "n", "", '["P1", ""]')]
    edges = spark.createDataFrame([("a", 'say "x"', "2.5"), ("b", "[]", "x"), ("c", None, None)], "source string, actions string, max_phase string")
    assert rows(cleanup.clean_edges(edges)) == [("a", '["say \\"x\\""]', 2.5), ("b", "[]", 0.0), ("c", "[]", 0.0)]


# --- whole build from files ---


def test_graph_build_keeps_one_edge_of_each_and_no_step(spark):
    """Builders of one type are deduped together, and what a group stored on the way is gone; so are its shuffles."""
    sources = graph_build.Sources(
        target=spark.createDataFrame([("T1", "S", None, [("R1", "one"), ("R1", "two")])], "id string, approvedSymbol string, proteinIds array<struct<id: string, source: string>>, pathways array<struct<pathwayId: string, pathway: string>>"),
        disease=spark.createDataFrame([("D1", "Flu")], "id string, name string"),
        reactome=spark.createDataFrame([("R1", "Path")], "id string, label string"),
        known_drug=spark.createDataFrame([("T1", "T1"), ("T1", "T1"), ("T1", "absent")], "drugId string, targetId string"),
        association_overall_direct=spark.createDataFrame([("D1", "T1", 0.5), ("D1", "T1", 0.2)], "diseaseId string, targetId string, score double"),
    )
    with scratch_run(spark):
        edges = graph_build.build_graph(sources)[1]
        assert rows(edges.select("source", "target", "type", "pathwayName", "target_label")) == [
            ("R1", "D1", "ASSOCIATED_WITH", None, "Disease"), ("T1", "R1", "INVOLVED_IN", "one", "Pathway"), ("T1", "T1", "TARGETS", None, "Target"),
        ]
        left = [p.name.split("-")[0] for p in Path(scratch_dir(spark).removeprefix("file:")).parent.iterdir()]
    assert left.count("edges") == 3 and "deduped" not in left


def test_graph_build_from_files(spark, tmp_path):
    folder, maps = tmp_path / "tables", tmp_path / "maps"
    maps.mkdir()
    write = lambda name, data, schema: spark.createDataFrame(data, schema).write.parquet(str(folder / f"{name}.parquet"))
    write(
        "target",
        [("E1", "SYM1", [("p1", "s")], [("R1", "path one"), (None, "x")]), ("E2", "SYM2", None, None)],
        "id string, approvedSymbol string, proteinIds array<struct<id: string, source: string>>, pathways array<struct<pathwayId: string, pathway: string>>",
    )
    write("disease", [("EFO1", "Flu"), ("EFO2", "Cold")], "id string, name string")
    write("known_drug", [("CH1", "E1"), ("CH1", "E1"), ("CH9", "E1")], "drugId string, targetId string")
    write("reactome", [("R1", "Path one")], "id string, label string")
    write("association_overall_direct", [("EFO1", "E1", 0.5), ("EFO2", "E1", 0.1)], "diseaseId string, targetId string, score double")
    write(
        "drug_molecule",
        [("CH1", "Aspirin", "Small", "C", "K", 4.0, True, False, None, 1950, ["s1", None], None, None, None)],
        "id string, name string, drugType string, canonicalSmiles string, inchiKey string, maximumClinicalTrialPhase double, isApproved boolean, "
        "hasBeenWithdrawn boolean, blackBoxWarning boolean, yearOfFirstApproval long, synonyms array<string>, tradeNames array<string>, "
        "linkedDiseases struct<rows: array<string>, count: int>, linkedTargets struct<rows: array<string>, count: int>",
    )
    (maps / "disease_mapping.csv").write_text("index,0\nEFO1,D001\n")
    (maps / "ensembl_to_uniprot_full.json").write_text('{"E1": ["U1", "U2"]}')
    sources = graph_build.Sources.read(spark, str(folder), str(maps))
    assert sources.target_map is None and sources.drug_indication is None
    nodes, edges = graph_build.build_graph(sources)
    assert {(r["id"], r["type"]) for r in nodes.collect()} == {
        ("D001", "Disease"), ("EFO2", "Disease"), ("U1", "Target"), ("E2", "Target"), ("R1", "Pathway"), ("CH1", "Drug"),
    }
    assert rows(edges.select("source", "target", "type")) == [
        ("CH1", "U1", "TARGETS"), ("R1", "D001", "ASSOCIATED_WITH"), ("R1", "EFO2", "ASSOCIATED_WITH"), ("U1", "R1", "INVOLVED_IN"),
    ]
    old = graph_build.build_graph(sources, same_target_ids=False)[1]
    assert "TARGETS" not in {r["type"] for r in old.collect()}
    summary = {r["item"]: r["n"] for r in graph_build.write_graph(nodes, edges, str(tmp_path / "out")).collect()}
    assert summary["nodes"] == 6 and summary["edges"] == 4
    csv = readers.read_graph_csv(spark, str(tmp_path / "out" / "edges"))
    assert ("CH1(Drug)", "U1(Target)") in {(r[":START_ID"], r[":END_ID"]) for r in csv.collect()}


def test_hot_targets_are_dealt_by_their_size(spark):
    rng = random.Random(12)
    assoc = {("hot", f"d{i}") for i in range(60)} | {(f"t{i % 9}", f"d{rng.randrange(20)}") for i in range(60)}
    paths = {("hot", f"p{i}") for i in range(25)} | {(f"t{i % 9}", f"p{rng.randrange(6)}") for i in range(30)}
    a = spark.createDataFrame(sorted(assoc), "target string, disease string")
    p = spark.createDataFrame(sorted(paths), "target string, pathway string")
    assert rows(infer.link_pathways(a, p, part_combinations=40)) == _links(assoc, paths, None)
    assert rows(infer.guarded_targets(a, p, 1000).select("target")) == [("hot",)]


@pytest.mark.parametrize("n", [0, 1, 7, 399, 400, 1000])
def test_first_rows_of_any_number(spark, n):
    data = [(i * 37 % 401, i % 3) for i in range(400)]
    df = spark.createDataFrame(data, "a int, b int").repartition(6)
    assert rows(first_rows(df, [F.desc("b"), F.col("a")], n)) == sorted(sorted(data, key=lambda r: (-r[1], r[0]))[:n])


def test_a_hub_in_parts_keeps_its_paths(spark):
    """A target with most of the edges; every query fills its limit behind it."""
    nodes = [("hub", "Target", "Hub")] + [(f"d{i:03}", "Drug", f"drug {i:03}") for i in range(200)] + [(f"x{i:03}", "Disease", f"ill {i:03}") for i in range(200)]
    edges = [(f"d{i:03}", "hub", "T", "Drug", "Target") for i in range(200)] + [("hub", f"x{i:03}", "A", "Target", "Disease") for i in range(200)]
    n = spark.createDataFrame(nodes, "id string, type string, name string")
    adj = store_adjacency(spark.createDataFrame(edges, EDGE), hub_edges=50)
    assert [tuple(r) for r in adj.hubs.collect()] == [("hub", 8)]
    q = spark.createDataFrame([(1, "ill 007"), (2, "drug 019"), (3, "drug"), (4, "ill")], "query_id int, query string")
    found = {}
    for r in P.search_paths(q, n, adj, limit=5).collect():
        found.setdefault(r["query_id"], []).append(tuple(r["nodes"]))
    assert sorted(found[1]) == [(f"d{i:03}", "hub", "x007") for i in range(5)]
    assert sorted(found[2]) == [("d019", "hub", f"x{i:03}") for i in range(5)]
    assert sorted(found[3]) == sorted(found[4]) == [("d000", "hub", f"x{i:03}") for i in range(5)]


def test_a_run_leaves_nothing_behind(spark):
    with scratch_run(spark) as own:
        n = spark.createDataFrame([("a", "Drug", "A"), ("b", "Disease", "B")], "id string, type string, name string")
        e = spark.createDataFrame([("a", "b", "T", "Drug", "Disease")], EDGE)
        q = spark.createDataFrame([(1, "A")], "query_id int, query string")
        assert P.search_paths(q, n, e).count() == 1
        folder = Path(scratch_dir(spark).removeprefix("file:").rpartition(own)[0] + own)
        assert any(folder.rglob("*.parquet"))
    assert not folder.exists()


def test_large_k_is_cut_by_ranges(spark):
    data = [(None if i % 5 == 0 else "AB"[i % 2], i * 37 % 2503) for i in range(2500)]
    df = spark.createDataFrame(data, "g string, v int").repartition(6)
    got = sorted((r["g"] or "", r["v"], r["rank"]) for r in ranking.top_k(df, ["g"], [F.col("v").desc()], 1001).collect())
    want = []
    for g in (None, "A", "B"):
        own = sorted((v for x, v in data if x == g), reverse=True)[:1001]
        want += [(g or "", v, i) for i, v in enumerate(own, 1)]
    assert got == sorted(want)


def test_links_are_hashed_not_sorted(spark):
    """The least target is found by its number: texts would have all combinations sorted."""
    diseases = spark.createDataFrame([("S10", "d"), ("S9", "d"), ("S9", "e")], "target string, disease string")
    pathways = spark.createDataFrame([("S10", "p"), ("S9", "p"), ("S8", "p")], "target string, pathway string")
    links = infer.link_pathways(diseases, pathways)
    assert sorted(tuple(r) for r in links.collect()) == [("p", "d", 2, "S10"), ("p", "e", 1, "S9")]
    assert "SortAggregate" not in links._jdf.queryExecution().toString()


def test_connections_are_not_stored_on_the_way(spark):
    """Degrees come from the adjacency: neither lookup stores a row for each edge."""
    n = spark.createDataFrame([("a", "Drug", "A"), ("b", "Target", "B"), ("c", "Target", None)], "id string, type string, name string")
    e = spark.createDataFrame([("a", "b", "T", "Drug", "Target"), ("a", "x", "T", "Drug", "Target")], "source string, target string, type string, source_type string, target_type string")
    with scratch_run(spark) as own:
        out = P.entity_details(n.select(F.col("id").alias("entity_id")), n, store_adjacency(e)).collect()
        folder = Path(scratch_dir(spark).removeprefix("file:")).parent
        assert str(folder).endswith(own.rstrip("/"))
        assert not [p for p in folder.iterdir() if p.name.startswith(("incident-", "connections-"))]
    got = sorted((r["entity_id"], r["degree"], [tuple(c) for c in r["connections"]]) for r in out)
    assert got == [("a", 2, [("T", None), ("T", "B")]), ("b", 1, [("T", "A")]), ("c", 0, [(None, None)])]


@pytest.mark.parametrize("most", [1_000_000, 7])
def test_details_of_all_entities_move_an_edge_twice(spark, monkeypatch, most):
    """By its other end and by the entity, in steps of their own and for some entities after the others; no step stays on disk."""
    monkeypatch.setattr(P, "LIST_EDGES", most)
    monkeypatch.setattr(P, "stored", lambda edges: pytest.fail("an adjacency is stored"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    nodes = [("hub", "Drug", "Hub"), ("alone", "Drug", "Alone")] + [(f"n{i}", "Target", f"N{i % 9}") for i in range(40)]
    edges = [("hub", f"n{i}", t, "Drug", "Target") for i in range(40) for t in "TU"] + [("hub", "hub", "T", "Drug", "Drug"), ("n1", None, "T", "Target", "Target"), ("n2", "absent", "T", "Target", "Target")]
    n, e = spark.createDataFrame(nodes, "id string, type string, name string"), spark.createDataFrame(edges, EDGE)
    name = {i: text for i, _, text in nodes}
    expected = {i: [] for i in name}
    for a, b, t, *_ in edges:
        for own, other in {(a, b), (b, a)}:
            if own in expected:
                expected[own].append((t, name.get(other)))
    for few in (0, 100):
        monkeypatch.setattr(P, "FEW", few)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
        monkeypatch.setattr(P, "ROUND_EDGES", 1000 if few else 60)
        try:
            frame = P.entity_details(n.select(F.col("id").alias("entity_id")), n, e, chunk=3)
            out = frame.collect()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        assert len({(r["entity_id"], r["chunk"]) for r in out}) == len(out)
        assert {r["entity_id"]: r["degree"] for r in out} == {i: len(x) for i, x in expected.items()}
        for i, x in expected.items():
            got = [tuple(c) for r in out if r["entity_id"] == i for c in r["connections"]]
            assert sorted(got, key=str) == sorted(x or [(None, None)], key=str)
        assert sum(r["entity_id"] == "hub" for r in out) > 9
    with scratch_run(spark):
        monkeypatch.setattr(P, "ROUND_EDGES", 60)
        P.entity_details(n.select(F.col("id").alias("entity_id")), n, e, chunk=3)
        left = [p.name.split("-")[0] for p in Path(scratch_dir(spark).removeprefix("file:")).parent.iterdir()]
    assert sorted(left) == ["asked", "entities", "hubs", "lists", "lists", "lists"]


def test_few_lookups_store_no_adjacency(spark, monkeypatch):
    """Paths of one edge, and paths back from an end, are looked up in the edges themselves; the result is that of the adjacency."""
    names = [("d1", "Drug", "one drug"), ("d2", "Drug", "two drug"), ("d3", "Drug", "other"), ("t", "Target", "t"), ("x", "Disease", "ache"), ("y", "Disease", "pain")]
    nodes = spark.createDataFrame(names, "id string, type string, name string")
    pairs = [("d1", "t", "TARGETS", "Target"), ("d2", "t", "TARGETS", "Target"), ("d1", "x", "TREATS", "Disease"), ("d2", "y", "TREATS", "Disease"), ("d3", "y", "TREATS", "Disease")]
    edges = spark.createDataFrame([(a, b, t, "Drug", k) for a, b, t, k in pairs], "source string, target string, type string, source_type string, target_type string")
    queries = spark.createDataFrame([("s", "drug", ), ("e", "ache")], "query_id string, query string")
    ends = queries.where("query_id = 'e'")
    every = [rows(P.search_paths(ends, nodes, store_adjacency(edges))), rows(P.search_paths(queries, nodes, store_adjacency(edges), 1))]

    def fail(edges):
        raise AssertionError("an adjacency is stored")

    monkeypatch.setattr(P, "stored", fail)
    assert [rows(P.search_paths(ends, nodes, edges)), rows(P.search_paths(queries, nodes, edges, 1))] == every
    assert [r[2] for r in every[0]] == [1, 3] and [r[1:4] for r in every[1]] == [(1, 1, ["d1", "x"])] * 2


def test_keep_one_sorts_by_a_number_first(spark):
    """Rows are grouped by the hash of their keys and then the keys: the same rows, null keys and equal prefixes included."""
    rows = [(k, t, v) for v in (3, 1, 2) for k in ("same prefix a", "same prefix b", None, "") for t in ("x", None)]
    df = spark.createDataFrame(rows, "k string, t string, v int").withColumn("text", F.concat(F.lit("v"), "v"))
    found = ranking.first_per_key(df.repartition(4), ["k", "t"], ["v"])
    assert sorted(map(tuple, found.collect()), key=str) == sorted(((k, t, 1, "v1") for k, t, v in rows if v == 1), key=str)
    sorts = [line for line in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Sort [" in line]
    assert sorts and all(not line.split("Sort [")[1].startswith(("k#", "t#")) for line in sorts)
