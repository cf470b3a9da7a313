"""Cosine top-k: an exact scan, and an index of cells that is exact as well.

The scan multiplies every batch of document vectors with a matrix of queries and keeps a
running top-k over all batches of a task. The index cuts the vectors into cells around
centres; a search reads each query's nearest cells first and then only those cells that, by
the angle of their furthest vector, can still hold a better one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vinculum.functions.ranking import top_k
from vinculum.operators.running import SCALE, Best
from vinculum.session import write_through

# Queries that are sent to the tasks as one matrix.
QUERY_BLOCK = 1024
# Vectors that the centres are fitted on, at most about.
SAMPLE = 100_000
# Vectors of a cell that one task reads.
PART_ROWS = 50_000
GROUP = ["query_id", "collection"]


def unit(vector: Column) -> Column:
    """The vector scaled to length one, in double; null for a zero vector."""
    doubles = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(doubles, lambda x: x / norm))


def _micro(matrix: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Queries x documents, cosines in millionths."""
    return np.floor(vectors @ matrix.T * SCALE + 0.5).T


def _running(ids: np.ndarray, matrix: np.ndarray, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[str, Best] = {}
        for batch in batches:
            for collection, part in batch.groupby("collection", sort=False):
                own = best.setdefault(collection, Best(len(ids), k))
                own.add(_micro(matrix, np.stack(part["vector"].to_numpy())), part["doc_id"].to_numpy())
        for collection, own in best.items():
            yield pd.DataFrame({"query_id": ids[own.row], "collection": collection, "doc_id": own.ids, "micro": own.score.astype("int64"), "is_best": True}, dtype=object)
            yield pd.DataFrame({"query_id": ids, "collection": collection, "doc_id": own.low_id, "micro": own.low.astype("int64"), "is_best": False}, dtype=object)

    return run


def _schema(queries: DataFrame, docs: DataFrame) -> str:
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return f"query_id {kind(queries, 'query_id')}, collection string, doc_id {kind(docs, 'doc_id')}, micro long, is_best boolean"


def _units(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, unit(F.col("vector")).alias("vector")).where(F.col("vector").isNotNull())


def vector_extremes(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query_id, collection, doc_id, vec, is_best): each task's best ``k`` and worst one by cosine.

    Documents are not moved: a task passes on ``k`` + 1 rows per query and collection, however
    many batches it reads. Queries come in blocks of bounded size, each one scan.
    """
    wanted = write_through(_units(queries, "query_id"), "asked")
    stored, schema = _units(docs, "doc_id", "collection"), _schema(queries, docs)
    n = -(-wanted.count() // QUERY_BLOCK)
    rows = queries.sparkSession.createDataFrame([], schema)
    for block in range(n):
        own = wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == block).collect()
        if own:
            ids, matrix = np.array([r["query_id"] for r in own]), np.array([r["vector"] for r in own])
            found = stored.mapInPandas(_running(ids, matrix, k), schema)
            rows = found if n == 1 else rows.unionByName(found)
    return rows.select(*GROUP, "doc_id", (F.col("micro") / SCALE).alias("vec"), "is_best")


def _top(rows: DataFrame, k: int) -> DataFrame:
    return top_k(rows, GROUP, [F.desc("vec"), F.col("doc_id")], k)


def vector_top_k(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest documents per query and collection by cosine."""
    return _top(vector_extremes(queries, docs, k).where("is_best").drop("is_best"), k)


# --- cells -----------------------------------------------------------------


@dataclass(frozen=True)
class VectorIndex:
    """``rows``: (cell, part, collection, doc_id, vector); ``cells``: (cell, parts, low), low being the least
    cosine between the cell's centre and one of its vectors; ``centres`` by cell number."""

    rows: DataFrame
    cells: DataFrame
    centres: np.ndarray


def vector_index(docs: DataFrame, cells: int | None = None, sample: int = SAMPLE, seed: int = 7) -> VectorIndex:
    """Cut ``docs`` (collection, doc_id, vector) into ``cells``, by default the square root of their number.

    Centres are fitted on about ``sample`` vectors drawn at random, every vector is indexed. A cell
    of many vectors is read in parts.
    """
    stored = write_through(_units(docs, "collection", "doc_id"), "units")
    total = stored.count()
    cells = max(2, cells or round(total**0.5))
    drawn = stored if total <= sample else stored.sample(sample / total, seed=seed)
    fitted = KMeans(k=cells, distanceMeasure="cosine", seed=seed, maxIter=10, featuresCol="v").fit(drawn.select(array_to_vector("vector").alias("v"))) if total else None
    centres = np.array(fitted.clusterCenters()) if fitted else np.zeros((0, 0))
    if len(centres):
        centres = centres / np.linalg.norm(centres, axis=1, keepdims=True)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cosine = np.stack(batch["vector"].to_numpy()) @ centres.T
                cell = cosine.argmax(axis=1)
                yield batch.assign(cell=cell.astype("int32"), cosine=cosine[np.arange(len(cell)), cell])

    kinds = ", ".join(f"{c} {stored.schema[c].dataType.simpleString()}" for c in ("collection", "doc_id", "vector"))
    placed = write_through(stored.mapInPandas(place, f"{kinds}, cell int, cosine double") if len(centres) else stored.selectExpr("*", "0 AS cell", "0D AS cosine"), "placed")
    parts = F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts")
    found = write_through(placed.groupBy("cell").agg(parts, F.min("cosine").alias("low")), "cells")
    rows = placed.join(found.select("cell", "parts"), "cell").withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts").cast("int"))
    return VectorIndex(rows.select("cell", "part", "collection", "doc_id", "vector"), found, centres)


def _search(asked: DataFrame, index: VectorIndex, k: int, schema: str) -> DataFrame:
    """Best ``k`` per query, collection and part of the (query_id, vector, cell) asked for."""

    def run(queries: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(docs):
            return pd.DataFrame({c: [] for c in ("query_id", "collection", "doc_id", "micro", "is_best")}, dtype=object)
        ids, matrix = queries["query_id"].to_numpy(), np.stack(queries["vector"].to_numpy())
        found = pd.concat(list(_running(ids, matrix, k)(iter([docs]))))
        return found[found["is_best"].astype(bool)]

    parts = index.cells.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    left = asked.select("query_id", "vector", "cell").join(parts, "cell")
    met = left.groupBy("cell", "part").cogroup(index.rows.groupBy("cell", "part")).applyInPandas(run, schema)
    return met.select(*GROUP, "doc_id", (F.col("micro") / SCALE).alias("vec"))


def vector_index_top_k(queries: DataFrame, index: VectorIndex, k: int, probes: int = 8, exact: bool = True) -> DataFrame:
    """The ``k`` nearest documents per query and collection, from the ``probes`` nearest cells.

    With ``exact`` further cells are read wherever they can hold a nearer one: a vector of a cell
    is no nearer to the query than the angle to the centre less the cell's widest angle.
    """
    centres = index.centres
    wide = np.zeros(len(centres))
    for r in index.cells.collect():  # as many as there are centres
        if len(centres):
            wide[r["cell"]] = np.arccos(np.clip(r["low"], -1, 1))

    def aim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch) and len(centres):
                angle = np.arccos(np.clip(np.stack(batch["vector"].to_numpy()) @ centres.T, -1, 1))
                bound = np.cos(np.maximum(angle - wide, 0)) + 2 / SCALE
                nearest = np.argsort(np.argsort(angle, axis=1), axis=1)
                n = len(centres)
                yield pd.DataFrame(
                    {
                        "query_id": np.repeat(batch["query_id"].to_numpy(), n),
                        "vector": [v for v in batch["vector"] for _ in range(n)],
                        "cell": np.tile(np.arange(n, dtype="int32"), len(batch)),
                        "place": nearest.ravel().astype("int32"),
                        "bound": bound.ravel(),
                    }
                )

    wanted, schema = _units(queries, "query_id"), _schema(queries, index.rows)
    kind = queries.schema["query_id"].dataType.simpleString()
    aimed = write_through(wanted.mapInPandas(aim, f"query_id {kind}, vector array<double>, cell int, place int, bound double"), "aimed")
    first = write_through(_search(aimed.where(F.col("place") < probes), index, k, schema), "near")
    if not exact:
        return _top(first, k)
    bars = _top(first, k).groupBy(*GROUP).agg(F.count("*").alias("n"), F.min("vec").alias("bar"))
    # A query goes on where one of the collections is short of k, or was not met yet.
    names = index.rows.select("collection").distinct()
    met = bars.where(F.col("n") >= k).groupBy("query_id").agg(F.count("*").alias("full"), F.min("bar").alias("bar"))
    open_ = aimed.where(F.col("place") >= probes).join(met, "query_id", "left")
    open_ = open_.where(F.col("bar").isNull() | (F.col("full") < names.agg(F.count("*")).scalar()) | (F.col("bound") >= F.col("bar")))
    return _top(first.unionByName(_search(open_, index, k, schema)), k)
