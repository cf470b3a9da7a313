"""Keyword, vector and hybrid search, merge and rerank, response tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vinculum.functions.ranking import top_k
from vinculum.operators import keyword_index as K
from vinculum.operators import search as S
from vinculum.operators import vector_index as V
from vinculum.plans import retrieval as plan
from vinculum.session import write_through
from workload import standin as T
from workload.graph import BOTH_QUERIES_SQL, FULL, both_queries, path_sql
from workload.registry import query

TOP = 5
COLLECTIONS = ("Drug", "Disease", "Target", "Pathway")


def text_queries(spark, sf):
    """Every benchmark item as a query; its vector is the stored one of the same number."""
    items = T.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    vectors = T.table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return items.join(vectors, "query_id", "left")


def text_docs(spark, sf):
    """Every document with its language as collection, and a vector where one is stored."""
    docs = T.table(spark, sf, "documents").select("doc_id", F.col("lang").alias("collection"), "text")
    vectors = T.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return docs.join(vectors, "doc_id", "left")


CUT = "floor(({}) * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE"
SPLIT = r"list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
UNIT = "CASE WHEN sqrt(list_sum(list_transform(v, lambda x: x * x))) > 0 THEN list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) END"

# q(query_id, query, v), d(doc_id, collection, text, v): v is a DOUBLE list or null.
TEXT_SQL = """q AS (SELECT item_id AS query_id, text AS query, embedding::DOUBLE[] AS v FROM benchmark LEFT JOIN embeddings ON vec_id = item_id),
d AS (SELECT doc_id, lang AS collection, text, embedding::DOUBLE[] AS v FROM documents LEFT JOIN embeddings ON vec_id = doc_id)"""

KEYWORD_SQL = f"""qt AS (SELECT DISTINCT query_id, unnest({SPLIT.format("query")}) AS term FROM q),
words AS (SELECT doc_id, collection, {SPLIT.format("text")} AS w FROM d),
sizes AS (SELECT collection, count(*) AS n_docs, avg(len(w)) AS avg_len FROM words GROUP BY collection),
posted AS (SELECT doc_id, collection, dl, term, count(*) AS tf FROM (
  SELECT doc_id, collection, len(w) AS dl, unnest(w) AS term FROM words) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT collection, term, count(*) AS df FROM posted GROUP BY ALL),
kw AS (SELECT query_id, p.collection, doc_id,
    {CUT.format("sum(ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avg_len)))")} AS kw
  FROM posted p JOIN df ON df.collection = p.collection AND df.term = p.term JOIN sizes s ON s.collection = p.collection
  JOIN qt ON qt.term = p.term GROUP BY query_id, p.collection, doc_id)"""

VECTOR_SQL = f"""qu AS (SELECT query_id, {UNIT} AS u FROM q WHERE v IS NOT NULL),
du AS (SELECT doc_id, collection, {UNIT} AS u FROM d WHERE v IS NOT NULL),
vec AS (SELECT query_id, collection, doc_id, {CUT.format("list_dot_product(du.u, qu.u)")} AS vec FROM qu, du)"""

FUSED_SQL = """kr AS (SELECT query_id, collection, min(kw) AS lo, max(kw) AS hi FROM kw GROUP BY ALL),
vr AS (SELECT query_id, collection, min(vec) AS lo, max(vec) AS hi FROM vec GROUP BY ALL),
fused AS (SELECT query_id, collection, doc_id,
    0.5::DOUBLE * coalesce(CASE WHEN vec IS NULL THEN NULL WHEN vr.hi = vr.lo THEN 1.0 ELSE (vec - vr.lo) / (vr.hi - vr.lo) END, 0)
    + 0.5::DOUBLE * coalesce(CASE WHEN kw IS NULL THEN NULL WHEN kr.hi = kr.lo THEN 1.0 ELSE (kw - kr.lo) / (kr.hi - kr.lo) END, 0) AS score
  FROM kw FULL JOIN vec USING (query_id, collection, doc_id)
  LEFT JOIN kr USING (query_id, collection) LEFT JOIN vr USING (query_id, collection))"""


def _ranked(source: str, score: str, k: int = TOP) -> str:
    return f"""SELECT query_id, collection, doc_id, {score} AS score,
  row_number() OVER (PARTITION BY query_id, collection ORDER BY {score} DESC, doc_id)::INTEGER AS rank
FROM {source} QUALIFY rank <= {k}"""


@query("bm25_topk", f"WITH {TEXT_SQL}, {KEYWORD_SQL} {_ranked('kw', 'kw')}")
def bm25_topk(spark, sf):
    rows = K.keyword_top_k(text_queries(spark, sf), text_docs(spark, sf), TOP)
    return rows.select("query_id", "collection", "doc_id", F.col("kw").alias("score"), "rank")


@query("vector_topk", f"WITH {TEXT_SQL}, {VECTOR_SQL} {_ranked('vec', 'vec')}")
def vector_topk(spark, sf):
    docs = text_docs(spark, sf).where(F.col("vector").isNotNull())
    rows = V.vector_top_k(text_queries(spark, sf), docs, TOP)
    return rows.select("query_id", "collection", "doc_id", F.col("vec").alias("score"), "rank")


@query("vector_cells_topk", f"WITH {TEXT_SQL}, {VECTOR_SQL} {_ranked('vec', 'vec')}")
def vector_cells_topk(spark, sf):
    """The exact search through the cell index."""
    index = V.vector_index(text_docs(spark, sf).where(F.col("vector").isNotNull()))
    rows = V.vector_index_top_k(text_queries(spark, sf), index, TOP)
    return rows.select("query_id", "collection", "doc_id", F.col("vec").alias("score"), "rank")


def repeated_docs(spark, sf):
    """Documents of two collections whose ids repeat in both; one of each pair has the vector."""
    docs = text_docs(spark, sf)
    even = F.col("doc_id") % 2 == 0
    first = docs.select(F.lit("first").alias("collection"), "doc_id", "text", F.when(even, F.col("vector")).alias("vector"))
    return first.unionByName(docs.select(F.lit("second").alias("collection"), "doc_id", "text", F.when(~even, F.col("vector")).alias("vector")))


REPEATED_SQL = f"""{TEXT_SQL.replace("d AS (", "d0 AS (")},
d AS (SELECT doc_id, 'first' AS collection, text, CASE WHEN doc_id % 2 = 0 THEN v END AS v FROM d0
  UNION ALL SELECT doc_id, 'second', text, CASE WHEN doc_id % 2 <> 0 THEN v END FROM d0)"""


@query(
    "hybrid_repeated_ids",
    f"WITH {REPEATED_SQL}, {KEYWORD_SQL}, {VECTOR_SQL}, {FUSED_SQL}, r AS ({_ranked('fused', 'score')}) SELECT query_id, collection, doc_id, {CUT.format('score')} AS score, rank FROM r",
)
def hybrid_repeated_ids(spark, sf):
    rows = S.hybrid_top_k(text_queries(spark, sf), repeated_docs(spark, sf), TOP)
    return rows.select("query_id", "collection", "doc_id", K.quantised(F.col("score")).alias("score"), "rank")


@query(
    "hybrid_topk",
    f"WITH {TEXT_SQL}, {KEYWORD_SQL}, {VECTOR_SQL}, {FUSED_SQL}, r AS ({_ranked('fused', 'score')}) SELECT query_id, collection, doc_id, {CUT.format('score')} AS score, rank FROM r",
)
def hybrid_topk(spark, sf):
    rows = S.hybrid_top_k(text_queries(spark, sf), text_docs(spark, sf), TOP)
    return rows.select("query_id", "collection", "doc_id", K.quantised(F.col("score")).alias("score"), "rank")


@query(
    "hits_per_label_limited",
    f"""WITH {T.NODES_SQL} SELECT type, id, row_number() OVER (PARTITION BY type ORDER BY id)::INTEGER AS rank FROM nodes QUALIFY rank <= 1200""",
)
def hits_per_label_limited(spark, sf):
    rows = T.nodes(spark, sf).select("type", "id")
    return top_k(rows, ["type"], [F.col("id")], 1200)


# --- retrieval over the graph ---


def requests(spark, sf):
    """Stored requests: customer and part names; part queries have the vector of their part."""
    part = T.table(spark, sf, "part")
    vectors = T.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    first = part.groupBy("p_type").agg(F.min("p_partkey").alias("vec_id"))
    with_vector = first.join(vectors, "vec_id", "left").select(F.concat(F.lit("type "), "p_type").alias("query_id"), "vector")
    rows = both_queries(spark, sf).join(with_vector, "query_id", "left")
    limit = F.when(F.col("query_id").startswith("type"), 50).otherwise(8)
    return write_through(rows.withColumn("max_results", limit), "requests")


def graph_corpus(spark, sf):
    """All nodes as search documents; drugs have the stored vector of their number."""
    vectors = T.table(spark, sf, "embeddings").select(T.key("P", "vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    nodes = T.nodes(spark, sf).select(F.col("type").alias("collection"), F.col("id").alias("doc_id"), "name", "description")
    text = F.concat_ws(" ", "name", "description")
    return nodes.withColumn("text", text).join(vectors, "doc_id", "left")


RESULTS = 50  # as many results as a request may ask for

GRAPH_SQL = f"""{T.NODES_SQL},
raw AS ({BOTH_QUERIES_SQL}),
q AS (SELECT raw.query_id, raw.query, e.embedding::DOUBLE[] AS v,
    CASE WHEN starts_with(raw.query_id, 'type') THEN 50 ELSE 8 END AS max_results
  FROM raw LEFT JOIN (SELECT 'type ' || p_type AS query_id, min(p_partkey) AS vec_id FROM part GROUP BY p_type) f ON f.query_id = raw.query_id
  LEFT JOIN embeddings e ON e.vec_id = f.vec_id),
d AS (SELECT id AS doc_id, type AS collection, name, description, name || ' ' || description AS text, embedding::DOUBLE[] AS v
  FROM nodes LEFT JOIN embeddings ON 'P' || vec_id = id)"""

HITS_SQL = f"""{GRAPH_SQL}, {KEYWORD_SQL}, {VECTOR_SQL}, {FUSED_SQL},
top AS ({_ranked("fused", "score", -(-RESULTS // len(COLLECTIONS)))}),
hits AS (SELECT t.query_id, row_number() OVER (PARTITION BY t.query_id ORDER BY score DESC, t.collection, t.doc_id)::INTEGER AS rank,
    t.doc_id AS id, d.name, d.description, score, t.collection, 'vector' AS source
  FROM top t JOIN d ON d.doc_id = t.doc_id AND d.collection = t.collection QUALIFY rank <= {RESULTS})"""


def _hits(spark, sf):
    return S.hybrid_search(requests(spark, sf), graph_corpus(spark, sf), COLLECTIONS, RESULTS)


@query(
    "hybrid_search",
    f"WITH {HITS_SQL} SELECT query_id, rank, id, name, description, {CUT.format('score')} AS score, collection, source FROM hits",
)
def hybrid_search(spark, sf):
    return _hits(spark, sf).withColumn("score", K.quantised(F.col("score")))


PATHS_SQL = f"""p0 AS ({path_sql(T.path_edges_sql(*FULL), BOTH_QUERIES_SQL, RESULTS, stop=True)}),
paths AS (SELECT query_id, rank, (SELECT string_agg(n.name, ' -> ' ORDER BY i) FROM (
    SELECT unnest(string_split(nodes, '>')) AS nid, unnest(generate_series(1, len(string_split(nodes, '>')))) AS i) s
    JOIN nodes n ON n.id = s.nid) AS names FROM p0)"""


@query(
    "path_details",
    f"""WITH {T.NODES_SQL}, {PATHS_SQL} SELECT query_id, rank, names FROM paths""",
)
def path_details(spark, sf):
    rows = plan.graph_leg(both_queries(spark, sf), T.nodes(spark, sf), T.stored_edges(spark, sf, *FULL), RESULTS)
    names = F.array_join(F.transform("node_details", lambda n: n["name"]), " -> ")
    return rows.select("query_id", "rank", names.alias("names"))


CANDIDATES_SQL = f"""{HITS_SQL}, {PATHS_SQL},
cand AS (SELECT query_id, 0 AS leg, rank AS pos, id, name, description, score, collection, source,
    name || ': ' || description AS text FROM hits
  UNION ALL SELECT query_id, 1, rank, NULL, NULL, NULL, NULL, NULL, NULL, 'Graph Path: ' || names FROM paths)"""

RERANKED_SQL = f"""{CANDIDATES_SQL},
idf AS (SELECT term, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM (
  SELECT term, count(*) AS df, (SELECT count(*) FROM d) AS n FROM (
    SELECT DISTINCT doc_id, unnest({SPLIT.format("text")}) AS term FROM d) GROUP BY term)),
ct AS (SELECT c.query_id, leg, pos, t.term, list_contains({SPLIT.format("c.text")}, t.term) AS hit
  FROM cand c JOIN (SELECT DISTINCT query_id, unnest({SPLIT.format("query")}) AS term FROM q) t ON t.query_id = c.query_id),
scored AS (SELECT ct.query_id, leg, pos, {CUT.format("sum(CASE WHEN hit THEN coalesce(idf, 1) ELSE 0 END) / sum(coalesce(idf, 1))")} AS rerank_score
  FROM ct LEFT JOIN idf ON idf.term = ct.term GROUP BY ct.query_id, leg, pos),
results AS (SELECT c.*, rerank_score, row_number() OVER (PARTITION BY c.query_id ORDER BY rerank_score DESC, c.leg, c.pos)::INTEGER AS rank
  FROM cand c JOIN scored s ON s.query_id = c.query_id AND s.leg = c.leg AND s.pos = c.pos QUALIFY rank <= {RESULTS})"""

FALLBACK_SQL = f"""{CANDIDATES_SQL},
results AS (SELECT *, CASE WHEN leg = 0 THEN coalesce(score, 0.5) ELSE 0.8 END::DOUBLE AS rerank_score,
    row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN leg = 0 THEN coalesce(score, 0.5) ELSE 0.8 END DESC, leg, pos)::INTEGER AS rank
  FROM cand QUALIFY rank <= {RESULTS})"""


def _results(spark, sf, scored: bool = True):
    corpus, asked = graph_corpus(spark, sf), requests(spark, sf)
    index = K.keyword_index(corpus, K.query_terms(asked))
    scorer = S.overlap_scorer(K.document_frequencies(index)) if scored else None
    return plan.retrieve(
        asked, T.nodes(spark, sf), T.stored_edges(spark, sf, *FULL), corpus, COLLECTIONS, scorer, index=index
    )


OUT_SQL = f"SELECT query_id, rank, leg, id, text, {CUT.format('rerank_score')} AS rerank_score FROM results"


def _out(rows):
    return rows.select("query_id", "rank", "leg", "id", "text", K.quantised(F.col("rerank_score")).alias("rerank_score"))


@query("merge_rerank", f"WITH {RERANKED_SQL} {OUT_SQL}")
def merge_rerank(spark, sf):
    return _out(_results(spark, sf))


@query("rerank_fallback", f"WITH {FALLBACK_SQL} {OUT_SQL}")
def rerank_fallback(spark, sf):
    return _out(_results(spark, sf, scored=False))


@query("one_leg_only", f"WITH {HITS_SQL} SELECT query_id, rank, id, {CUT.format('score')} AS rerank_score FROM hits")
def one_leg_only(spark, sf):
    rows = plan.retrieve(requests(spark, sf), corpus=graph_corpus(spark, sf), collections=COLLECTIONS)
    return rows.select("query_id", "rank", "id", K.quantised(F.col("rerank_score")).alias("rerank_score"))


@query(
    "context_table",
    f"""WITH {RERANKED_SQL} SELECT query_id, string_agg(coalesce(name, '') || ': ' || coalesce(description, ''), chr(10) ORDER BY rank) AS context
FROM results WHERE rank <= 10 GROUP BY query_id""",
)
def context_table(spark, sf):
    return S.context_table(_results(spark, sf))


ENTITIES_SQL = f"""{RERANKED_SQL}, entities AS (
  SELECT r.query_id, r.rank, coalesce(id, 'unknown') AS id, coalesce(name, 'Unknown') AS name, coalesce(collection, source, 'Entity') AS type,
    coalesce(score, 0) AS score, coalesce(description, '') AS description, coalesce(source, 'unknown') AS source,
    count(*) OVER (PARTITION BY r.query_id) AS total_found
  FROM results r JOIN q ON q.query_id = r.query_id WHERE r.rank <= q.max_results)"""


@query(
    "response_table",
    f"WITH {ENTITIES_SQL} SELECT query_id, rank, id, name, type, {CUT.format('score')} AS score, description, source, total_found FROM entities",
)
def response_table(spark, sf):
    rows = S.response_table(_results(spark, sf), requests(spark, sf))
    return rows.withColumn("score", K.quantised(F.col("score")))


@query(
    "evidence_cards",
    f"""WITH {ENTITIES_SQL} SELECT query_id, rank, name AS title, upper(type) AS badge, source, printf('%.3f', {CUT.format("score")}) AS score,
  CASE WHEN description <> '' THEN substring(description, 1, 250) || '...' END AS quote FROM entities""",
)
def evidence_cards(spark, sf):
    rows = S.response_table(_results(spark, sf), requests(spark, sf))
    return S.evidence_cards(rows.withColumn("score", K.quantised(F.col("score"))))


@query(
    "request_validation",
    """WITH r AS (SELECT conv_id, turn, text AS query, CASE WHEN turn > 0 THEN turn * 20 END AS wanted FROM conversations),
v AS (SELECT conv_id, turn, query, coalesce(wanted, 10) AS max_results FROM r)
SELECT conv_id, turn, length(regexp_replace(query, '^[ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+$', '', 'g'))::INTEGER AS query_length, max_results,
  CASE WHEN query IS NULL THEN 'query is missing' WHEN length(query) < 1 THEN 'query is too short' WHEN length(query) > 500 THEN 'query is too long'
    WHEN regexp_full_match(query, '[ \t\n\r\x0b\x0c]*') THEN 'query is blank'
    WHEN max_results < 1 OR max_results > 50 THEN 'max_results is out of range' END AS error FROM v""",
)
def request_validation(spark, sf):
    rows = T.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.col("text").alias("query"), F.when(F.col("turn") > 0, F.col("turn") * 20).alias("max_results")
    )
    checked = S.validate_requests(rows)
    return checked.select("conv_id", "turn", F.length("query").alias("query_length"), "max_results", "error")


