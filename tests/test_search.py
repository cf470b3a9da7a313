from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from vinculum.operators import keyword_index as K, quality, search as S, vector_index as V
from vinculum.plans import retrieval


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def cut(x):
    return math.floor(x * 1e6 + 0.5) / 1e6


def tokens(text):
    return [t for t in re.split(r"[^\w]+|_", text.lower()) if t]


WORDS = ["aspirin", "flu", "cold", "heart", "der", "été", "x1", "y"]


def corpus(seed, n=60):
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        text = " ".join(rng.choices(WORDS, weights=[1, 1, 2, 3, 9, 1, 1, 1], k=rng.randrange(0, 12)))
        if i % 3 == 0:
            text = "der flu. Der FLU!"
        vector = None if i % 4 == 0 else [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(3)]
        docs.append((i, "AB"[i % 5 == 0], text, vector))
    queries = [(1, "flu", [1.0, 0.0, 0.0]), (2, "heart aspirin DER", None), (3, "unknown", [0.0, 1.0, 1.0]), (4, "", [0.0, 0.0, 0.0])]
    return docs, queries


def frames(spark, docs, queries):
    d = spark.createDataFrame(docs, "doc_id long, collection string, text string, vector array<float>")
    q = spark.createDataFrame(queries, "query_id int, query string, vector array<float>")
    return d.repartition(3), q


def keyword(docs, queries):
    out = {}
    for c in {d[1] for d in docs}:
        part = [(d[0], tokens(d[2])) for d in docs if d[1] == c]
        avg = sum(len(t) for _, t in part) / len(part)
        for qid, text, _ in queries:
            for i, words in part:
                score, hit = 0.0, False
                for term in sorted(set(tokens(text))):
                    tf = words.count(term)
                    df = sum(term in w for _, w in part)
                    if tf:
                        hit = True
                        idf = math.log(1 + (len(part) - df + 0.5) / (df + 0.5))
                        score += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / avg))
                if hit:
                    out[qid, c, i] = cut(score)
    return out


def cosine(docs, queries):
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    out = {}
    for qid, _, qv in queries:
        for i, c, _, v in docs:
            if v and qv and norm(v) and norm(qv):
                out[qid, c, i] = cut(sum(a / norm(v) * (b / norm(qv)) for a, b in zip(v, qv)))
    return out


def best(scores, k):
    groups = {}
    for (q, c, i), s in scores.items():
        groups.setdefault((q, c), []).append((-s, i))
    return sorted((q, c, i) for (q, c), items in groups.items() for _, i in sorted(items)[:k])


@pytest.mark.parametrize("whole", [True, False])
def test_keyword_scores(spark, whole):
    docs, queries = corpus(1)
    d, q = frames(spark, docs, queries)
    given = K.keyword_index(d) if whole else d
    got = {(r["query_id"], r["collection"], r["doc_id"]): r["kw"] for r in K.keyword_scores(q, given).collect()}
    assert got == pytest.approx(keyword(docs, queries), abs=2e-6)


def test_vector_top_k_in_one_block_and_in_many(spark, monkeypatch):
    docs, queries = corpus(2)
    d, q = frames(spark, docs, queries)
    want = best(cosine(docs, queries), 4)
    pick = lambda df: rows(df.select("query_id", "collection", "doc_id"))
    assert pick(V.vector_top_k(q, d, 4)) == want
    monkeypatch.setattr(V, "QUERY_BLOCK", 1)
    assert pick(V.vector_top_k(q, d, 4)) == want
    monkeypatch.setattr(V, "PART_ROWS", 3)
    for cells, probes in ((1, 1), (4, 1), (9, 2)):
        assert pick(V.vector_index_top_k(q, V.vector_index(d, cells), 4, probes)) == want
    assert V.vector_index_top_k(q, V.vector_index(d.limit(0)), 4).count() == 0


def test_a_task_passes_on_its_best_only(spark):
    """However many batches a task reads."""
    docs = [(i, "AB"[i % 2], "", [math.cos(i), math.sin(i)]) for i in range(400)]
    d, q = frames(spark, docs, [(1, "", [1.0, 0.0]), (2, "", [0.0, 1.0])])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    rows_ = V.vector_extremes(q, d.coalesce(1), 3).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows_) == 2 * 2 * (3 + 1)


def test_recall_of_few_cells(spark):
    rng = random.Random(9)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    docs = [(i, "A", "", [x + rng.gauss(0, 0.35) for x in centres[i % 12]]) for i in range(1200)]
    queries = [(i, "", docs[i * 7][3]) for i in range(60)]
    d, q = frames(spark, docs, queries)
    index = V.vector_index(d, 24)
    want = best(cosine(docs, queries), 10)
    got = rows(V.vector_index_top_k(q, index, 10, probes=4, exact=False).select("query_id", "collection", "doc_id"))
    assert len(set(got) & set(want)) >= 0.9 * len(want)
    assert rows(V.vector_index_top_k(q, index, 10, probes=1).select("query_id", "collection", "doc_id")) == want


def test_ids_of_two_collections_keep_their_vectors(spark):
    d = spark.createDataFrame(
        [(1, "A", "flu", [1.0, 0.0]), (1, "B", "flu cold cold cold", None), (2, "B", "flu", [0.0, 1.0])],
        "doc_id long, collection string, text string, vector array<float>",
    )
    q = spark.createDataFrame([(7, "flu", [1.0, 0.0])], "query_id int, query string, vector array<float>")
    got = {(r["collection"], r["doc_id"]): r["score"] for r in S.hybrid_top_k(q, d, 3).collect()}
    assert got["B", 1] == 0.0 and got["A", 1] == 1.0


@pytest.mark.parametrize("alpha", [0.5, 0.9, 0.0])
def test_hybrid_is_exact(spark, alpha):
    docs, queries = corpus(3)
    d, q = frames(spark, docs, queries)
    kw, vec = keyword(docs, queries), cosine(docs, queries)

    def scaled(scores):
        out = {}
        for key, s in scores.items():
            group = [x for k, x in scores.items() if k[:2] == key[:2]]
            out[key] = 1.0 if max(group) == min(group) else (s - min(group)) / (max(group) - min(group))
        return out

    kn, vn = scaled(kw), scaled(vec)
    fused = {k: alpha * vn.get(k, 0.0) + (1 - alpha) * kn.get(k, 0.0) for k in {*kn, *vn}}
    got = S.hybrid_top_k(q, d, 3, alpha).collect()
    for r in got:
        assert r["score"] == pytest.approx(fused[r["query_id"], r["collection"], r["doc_id"]], abs=1e-5)
    worst = {}
    for r in got:
        key = (r["query_id"], r["collection"])
        worst[key] = min(worst.get(key, 9.0), r["score"])
    assert len(got) == len(best(fused, 3))
    taken = {(r["query_id"], r["collection"], r["doc_id"]) for r in got}
    assert all(s <= worst[k[:2]] + 1e-5 for k, s in fused.items() if k not in taken)


def test_no_score_of_a_pair_leaves_a_task(spark, monkeypatch):
    """One row of postings for each document, and k rows of a task for each query and collection, in any blocks."""
    docs = [(i, "AB"[i % 2], "flu cold " * (1 + i % 5), [float(i), 1.0]) for i in range(300)]
    d, q = frames(spark, docs, [(1, "flu", [1.0, 0.0]), (2, "cold flu", None), (3, "none", [0.0, 1.0])])
    index = K.keyword_index(d, K.query_terms(q))
    assert index.postings.count() == len(docs)
    assert K._keyword(q, index, 2).count() <= 3 * 2 * 2 * 2
    want = rows(S.hybrid_top_k(q, d, 4))
    monkeypatch.setattr(K, "QUERY_BLOCK", 1)
    monkeypatch.setattr(K, "CELLS", 16)
    assert rows(S.hybrid_top_k(q, d, 4, index=index)) == want and len(want) == 3 * 2 * 4


def hits_and_paths(spark):
    q = spark.createDataFrame([(1, "asp heart", 2), (2, "none", 10)], "query_id int, query string, max_results int")
    hits = spark.createDataFrame(
        [(1, 1, "d1", "Aspirin", None, 0.9, "Drug", "vector"), (1, 2, "d2", "heart", "asp", 0.2, "Drug", "vector")],
        "query_id int, rank int, id string, name string, description string, score double, collection string, source string",
    )
    paths = spark.createDataFrame(
        [(1, 1, [("a", "asp"), ("b", "heart")]), (1, 2, None), (2, 1, [("c", None), ("d", "x")])],
        "query_id int, rank int, node_details array<struct<id: string, name: string>>",
    )
    return q, hits, paths


def test_rerank_orders_by_score_then_candidate_order(spark):
    q, hits, paths = hits_and_paths(spark)
    idf = spark.createDataFrame([("asp", 2.0), ("heart", 1.0)], "term string, idf double")
    out = S.merge_and_rerank(q, paths, hits, S.overlap_scorer(idf)).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["text"], r["rerank_score"]) for r in out] == [
        (1, "heart: asp", 1.0), (1, "Graph Path: asp -> heart", 1.0), (1, "Aspirin: ", 0.0), (2, "Graph Path:  -> x", 0.0),
    ]


def test_fallback_keeps_paths_without_details(spark):
    q, hits, paths = hits_and_paths(spark)
    out = S.merge_and_rerank(q, paths, hits.withColumn("score", F.when(F.col("rank") == 1, F.col("score")))).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["leg"], r["pos"], r["rerank_score"]) for r in out] == [
        (1, 0, 1, 0.9), (1, 1, 1, 0.8), (1, 1, 2, 0.8), (1, 0, 2, 0.5), (2, 1, 1, 0.8),
    ]


def test_missing_and_empty_legs(spark):
    q, hits, paths = hits_and_paths(spark)
    assert S.merge_and_rerank(q, None, hits).count() == 2
    assert S.merge_and_rerank(q, paths, None).count() == 3
    assert S.merge_and_rerank(q, None, None).count() == 0
    assert S.merge_and_rerank(q, paths.limit(0), hits.limit(0)).count() == 0
    assert retrieval.retrieve(q).count() == 0


def test_answer_tables(spark):
    q, hits, paths = hits_and_paths(spark)
    tables = retrieval.answer_tables(S.merge_and_rerank(q, paths, hits), q)
    context = {r["query_id"]: r["context"] for r in tables["context"].collect()}
    assert context[1] == "Aspirin: \n: \n: \nheart: asp"
    entities = tables["entities"].orderBy("query_id", "rank").collect()
    assert [(r["id"], r["type"], r["source"], r["total_found"]) for r in entities] == [
        ("d1", "Drug", "vector", 2), ("unknown", "Entity", "unknown", 2), ("unknown", "Entity", "unknown", 1),
    ]
    cards = tables["cards"].orderBy("query_id", "rank").collect()
    assert (cards[0]["badge"], cards[0]["score"], cards[0]["quote"]) == ("DRUG", "0.900", None)


def test_request_validation(spark):
    requests = [(" a ", None), ("", 5), ("   ", 5), ("x" * 501, 5), ("x" * 500, 50), ("a", 51), ("a", 0), (None, 5)]
    checked = S.validate_requests(spark.createDataFrame(requests, "query string, max_results int"))
    assert rows(S.accepted(checked).select(F.length("query"), "max_results")) == [(1, 10), (500, 50)]
    errors = {r["error"] for r in S.rejected(checked).collect()}
    assert errors == {"query is too short", "query is blank", "query is too long", "max_results is out of range", "query is missing"}


def test_corpus_cap(spark):
    nodes = spark.createDataFrame([(f"n{i:02}", "Drug", "x", None) for i in range(30)] + [("p", "Pathway", "x", None)], "id string, type string, name string, description string")
    assert S.build_corpus(nodes, 7).count() == 7
    assert S.build_corpus(nodes, None, ("Drug", "Pathway")).count() == 31


def test_profiles_and_sample(spark):
    df = spark.createDataFrame([("a" * 150, [1], {"k": 1}, None), ("b", None, None, None)], "s string, l array<int>, m map<string,int>, n int")
    profile = {r["column"]: r for r in quality.table_profile(df).collect()}
    assert profile["s"]["example_low"] == "a" * 100 + "..." and profile["l"]["example_low"] == "list[1]"
    assert profile["m"]["example_high"] == "dict[1 keys]" and (profile["n"]["non_null"], profile["n"]["nulls"]) == (0, 2)
    numbers = spark.range(500)
    assert rows(quality.sample_rows(numbers, 20, "id")) == rows(quality.sample_rows(numbers.repartition(7), 20, "id"))
    assert rows(quality.sample_rows(numbers, 20, "id")) != rows(quality.sample_rows(numbers, 20, "id", seed=7))
    empty = quality.missing_report(df.limit(0), ("s", "l")).collect()
    assert {(r["field"], r["missing"], r["percentage"]) for r in empty} == {("s", 0, None), ("l", 0, None)}


def test_fewer_results_than_collections(spark):
    docs = spark.createDataFrame(
        [(c, f"{c}{i}", "n", "d", f"word{i} shared", [float(i), 1.0]) for c in ("A", "B", "C", "D") for i in range(3)],
        "collection string, doc_id string, name string, description string, text string, vector array<float>",
    )
    queries = spark.createDataFrame([("q", "shared word1", [1.0, 1.0])], "query_id string, query string, vector array<float>")
    assert S.hybrid_search(queries, docs, ("A", "B", "C", "D"), limit=3).count() == 3
