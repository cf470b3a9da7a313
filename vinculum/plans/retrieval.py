"""Table of search requests -> ranked results, context and response tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from vinculum.operators import paths as P
from vinculum.operators import search as S
from vinculum.operators.adjacency import Adjacency
from vinculum.operators.keyword_index import KeywordIndex


def graph_leg(requests: DataFrame, nodes: DataFrame, edges: DataFrame | Adjacency, limit: int = P.PATH_LIMIT) -> DataFrame:
    return P.with_node_details(P.search_paths(requests, nodes, edges, limit), nodes)


def retrieve(
    requests: DataFrame,
    nodes: DataFrame | None = None,
    edges: DataFrame | Adjacency | None = None,
    corpus: DataFrame | None = None,
    collections: tuple[str, ...] = ("Drug", "Disease", "Target", "Pathway"),
    scorer=None,
    limit: int = S.MAX_RESULTS,
    index: KeywordIndex | None = None,
) -> DataFrame:
    """Ranked results of both legs. A leg without its tables contributes nothing.

    Each leg and the merge keep ``limit`` results, by default as many as a request may ask for.
    """
    paths = graph_leg(requests, nodes, edges, limit) if nodes is not None and edges is not None else None
    hits = S.hybrid_search(requests, corpus, collections, limit, index=index) if corpus is not None else None
    return S.merge_and_rerank(requests, paths, hits, scorer, limit)


def answer_tables(results: DataFrame, requests: DataFrame) -> dict[str, DataFrame]:
    """Context per query, response entities and evidence cards."""
    entities = S.response_table(results, requests)
    return {"context": S.context_table(results), "entities": entities, "cards": S.evidence_cards(entities)}
