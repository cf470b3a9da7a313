"""Hard-negative mining by a vertical scan (BOND) of blocks of columnar dimensions.

For every anchor, its best rows of the same label are positives; for every positive, the best
rows of other labels whose score lies in a window below the positive's are hard negatives.

- Rows become blocks of one label: ids, and one array per dimension with its least and
  largest component. Anchors become blocks as well; both are stored, and blocks of rows and of
  anchors meet in cells of a grid of bounded size (each side is dealt to as many groups as its
  number of blocks asks for), so no task holds more than a cell, whatever a label's share is.
- In a cell an anchor reads the dimensions in the order of its own descending magnitudes.
  What the dimensions not yet read can still add lies between sums of their least and largest
  products; candidates that this bounds below the k-th best known (or outside every window that
  is still open) leave the bitmap, and later dimensions are read for those left only. A block
  whose bounds over all dimensions decide is not read.
- A cell passes on the best few per anchor; these are merged by anchor. Positives come first,
  as their scores are the windows of the second pass.

Scores are exact: components are integers, summed as doubles where every sum stays below 2^53
and as 64-bit integers (wrapping beyond, without pruning) otherwise.

Defined cases: rows with a null id, label or vector, or a component that is null or not finite,
take no part; components a vector lacks are 0; rows that repeat an id, label and vector are one
anchor, and rows with an equal id and score are one partner; no row is a partner of one with its
own id; ties go to the smaller id; an anchor without positives and a positive without negatives
give no rows; an empty table gives none; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vinculum.llm.common import table
from vinculum.llm.registry import query
from vinculum.session import write_through

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95  # a negative's score in percent of the positive's
BLOCK_ROWS = 4096
ANCHOR_ROWS = 256
CELL_BLOCKS = 4  # blocks of rows, and blocks of anchors, that meet in a cell
STEP = 8  # dimensions read between two looks at the bounds

BLOCK = "block bigint, label bigint, ids binary, columns array<binary>, least binary, largest binary"
ASKED = "block bigint, label bigint, anchor binary, ids binary, vectors array<binary>, wanted array<array<bigint>>"
_INTS = "<i8"


def usable(rows: DataFrame, id_column: str, label_column: str, vector_column: str) -> DataFrame:
    """``id``, ``label``, ``vector`` (whole numbers) of the rows that take part."""
    named = rows.select(F.col(id_column).cast("bigint").alias("id"), F.col(label_column).cast("bigint").alias("label"), F.col(vector_column).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    kept = named.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").where(finite)
    return kept.withColumn("vector", F.transform("vector", lambda x: F.floor(SCALE * x)))


def _whole(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Components, row after row, and the rows' bounds."""
    size = np.asarray(pc.list_value_length(vectors), dtype=np.int64)
    return np.asarray(vectors.flatten(), dtype=np.int64), np.r_[0, np.cumsum(size)]


def _matrix(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows x dimensions; what a row lacks is 0."""
    size = np.diff(bounds)
    width = int(size.max(initial=0))
    if (size == width).all():
        return flat[bounds[0] : bounds[-1]].reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        out[i, : b - a] = flat[a:b]
    return out


def _runs_of(batch: pa.RecordBatch, rows: int) -> Iterator[tuple[int, int]]:
    """Slices of one label and at most so many rows."""
    label = np.asarray(batch.column("label"))
    cuts = np.flatnonzero(np.r_[True, label[1:] != label[:-1], True]) if len(label) else np.zeros(1, int)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        for at in range(a, b, rows):
            yield at, min(at + rows, b)


def _to_blocks(block_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 32
        for batch in batches:
            flat, bounds = _whole(batch.column("vector"))
            for a, b in _runs_of(batch, block_rows):
                m = _matrix(flat, bounds[a : b + 1])
                kind = np.int32 if m.size == 0 or -(1 << 31) <= m.min() <= m.max() < 1 << 31 else np.int64
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": pa.array([n], pa.int64()),
                        "label": [batch.column("label")[int(a)].as_py()],
                        "ids": [np.asarray(batch.column("id"))[a:b].astype(_INTS).tobytes()],
                        "columns": pa.array([[np.ascontiguousarray(c, dtype=kind).tobytes() for c in m.T]], pa.list_(pa.binary())),
                        "least": [m.min(axis=0).astype(_INTS).tobytes()],
                        "largest": [m.max(axis=0).astype(_INTS).tobytes()],
                    }
                )
                n += 1

    return run


def columnar(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Stored blocks of one label each. Rows are dealt by ranges of (label, hash), so a hot label is spread."""
    order = [F.col("label"), F.xxhash64("id")]
    return write_through(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_to_blocks(block_rows), BLOCK), "columns")


def _ask(anchor_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 32
        for batch in batches:
            flat, bounds = _whole(batch.column("vector"))
            for a, b in _runs_of(batch, anchor_rows):
                own = batch.slice(int(a), int(b - a))
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": pa.array([n], pa.int64()),
                        "label": [own.column("label")[0].as_py()],
                        "anchor": [np.asarray(own.column("anchor")).astype(_INTS).tobytes()],
                        "ids": [np.asarray(own.column("id")).astype(_INTS).tobytes()],
                        "vectors": pa.array([[flat[bounds[i] : bounds[i + 1]].astype(_INTS).tobytes() for i in range(a, b)]], pa.list_(pa.binary())),
                        "wanted": pa.array([own.column("wanted").to_pylist()], pa.list_(pa.list_(pa.int64()))),
                    }
                )
                n += 1

    return run


def _in_blocks(anchors: DataFrame, anchor_rows: int) -> DataFrame:
    order = [F.col("label"), F.col("anchor")]
    return write_through(anchors.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_ask(anchor_rows), ASKED), "asked")


@dataclass
class Block:
    label: int
    ids: np.ndarray
    columns: list[bytes]
    least: np.ndarray
    largest: np.ndarray
    kind: np.dtype
    read: int = 0  # components read, for tests

    def column(self, d: int, alive: np.ndarray | None) -> np.ndarray:
        c = np.frombuffer(self.columns[d], self.kind)
        c = c if alive is None else c[alive]
        self.read += len(c)
        return c


def block_of(row: dict) -> Block:
    ids = np.frombuffer(row["ids"], _INTS)
    columns = row["columns"]
    wide = bool(columns) and len(columns[0]) == 8 * len(ids)
    return Block(row["label"], ids, columns, np.frombuffer(row["least"], _INTS), np.frombuffer(row["largest"], _INTS), np.dtype("<i8" if wide else "<i4"))


def _exact(q: np.ndarray, block: Block) -> np.ndarray:
    """64-bit sums without pruning, for components whose products leave the range of doubles."""
    score = np.zeros(len(block.ids), np.int64)
    with np.errstate(over="ignore"):
        for d in range(min(len(q), len(block.columns))):
            score += q[d] * block.column(d, None).astype(np.int64)
    return score


def scan(q: np.ndarray, block: Block, keep) -> tuple[np.ndarray, np.ndarray]:
    """Candidates (positions) that ``keep`` never ruled out, and their exact scores.

    ``keep(low, high)`` gets bounds of the scores of those left and says which may still count.
    """
    width = min(len(q), len(block.columns))
    low, high = block.least[:width].astype(np.float64), block.largest[:width].astype(np.float64)
    part = q[:width].astype(np.float64)
    reach = np.abs(part) @ np.maximum(np.abs(low), np.abs(high))
    if not reach < 2.0**53:
        score = _exact(q, block)
        alive = np.flatnonzero(keep(score, score))
        return alive, score[alive]
    order = np.argsort(-np.abs(part), kind="stable")
    most, least = np.maximum(part * low, part * high), np.minimum(part * low, part * high)
    rest_most = np.r_[np.cumsum(most[order][::-1])[::-1], 0.0]
    rest_least = np.r_[np.cumsum(least[order][::-1])[::-1], 0.0]
    if not keep(rest_least[:1], rest_most[:1])[0]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    score, alive = np.zeros(len(block.ids)), None
    for at in range(0, width, STEP):
        own = order[at : at + STEP]
        score += part[own] @ np.stack([block.column(d, alive) for d in own])
        done = min(at + STEP, width)
        left = keep(score + rest_least[done], score + rest_most[done])
        if not left.all():
            score = score[left]
            alive = np.flatnonzero(left) if alive is None else alive[left]
            if not len(alive):
                break
    return np.arange(len(score)) if alive is None else alive, score.astype(np.int64)


def _merge(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k of distinct (score, id) by descending score, then id."""
    order = np.lexsort((ids, -score))
    score, ids = score[order], ids[order]
    head = np.r_[True, (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])][: len(ids)]
    return score[head][:k], ids[head][:k]


def best(q: np.ndarray, own_id: int, blocks: list[Block], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the best k rows with other ids."""
    score, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for block in blocks:
        # a block may hold the anchor and repeated rows; so many more than k that k others are among them
        extra = int((block.ids == own_id).sum()) + len(block.ids) - len(np.unique(block.ids))

        def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            bar = score[k - 1] if len(score) == k else -np.inf  # noqa: B023
            if len(low) > k + extra:  # noqa: B023
                bar = max(bar, np.partition(low, -(k + extra))[-(k + extra)])  # noqa: B023
            return high >= bar

        at, found = scan(q, block, keep)
        other = block.ids[at] != own_id
        score, ids = _merge(np.r_[score, found[other]], np.r_[ids, block.ids[at][other]], k)
    return score, ids


def windows(wanted: list[int], low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score of a negative for each positive's score: low * p <= 100 * n <= high * p."""
    return np.array([-((-low * p) // 100) for p in wanted], np.int64), np.array([high * p // 100 for p in wanted], np.int64)


def best_in_windows(q: np.ndarray, own_id: int, blocks: list[Block], first: np.ndarray, last: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window the scores and ids of the best k rows with other ids inside it."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in first]
    for block in blocks:
        # a full window is open above its k-th best only
        bars = [max(a, s[k - 1]) if len(s) == k else a for a, (s, _) in zip(first, found, strict=True)]

        def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            out = np.zeros(len(low), bool)
            for a, b in zip(bars, last, strict=True):  # noqa: B023
                if a <= b:
                    out |= (high >= a) & (low <= b)
            return out

        at, score = scan(q, block, keep)
        other = block.ids[at] != own_id
        ids, score = block.ids[at][other], score[other]
        for i, (a, b) in enumerate(zip(first, last, strict=True)):
            inside = (score >= a) & (score <= b)
            if inside.any():
                found[i] = _merge(np.r_[found[i][0], score[inside]], np.r_[found[i][1], ids[inside]], k)
    return found


def _cell(k: int, low: int, high: int, positives: bool):
    """All anchors of a cell against all its rows. -> anchor, wanted (null in the first pass), id, score."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        blocks = [block_of(r) for r in rows.to_pylist()]
        out: list[list[np.ndarray]] = [[], [], [], []]

        def put(anchor: int, wanted: int, score: np.ndarray, ids: np.ndarray) -> None:
            for column, values in zip(out, (np.full(len(ids), anchor), np.full(len(ids), wanted), ids, score), strict=True):
                column.append(values)

        for a in asked.to_pylist():
            mine = [b for b in blocks if (b.label == a["label"]) == positives]
            names, ids = np.frombuffer(a["anchor"], _INTS), np.frombuffer(a["ids"], _INTS)
            for anchor, own_id, vector, wanted in zip(names, ids, a["vectors"], a["wanted"], strict=True):
                q = np.frombuffer(vector, _INTS)
                if positives:
                    put(anchor, 0, *best(q, own_id, mine, k))
                else:
                    for p, found in zip(wanted, best_in_windows(q, own_id, mine, *windows(wanted, low, high), k), strict=True):
                        put(anchor, p, *found)
        columns = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in out]
        return pa.table(columns, names=["anchor", "wanted", "id", "score"])

    return run


def _meet(blocks: DataFrame, asked: DataFrame, cell_blocks: int, by_label: bool, run) -> DataFrame:
    """Every block of rows with every block of anchors (of its label, or of all), in cells of the grid.

    Each side's number of groups follows from its number of blocks; a block goes to one group of its
    own side, picked by hash, and is copied to the cells of that group.
    """
    keys = ["label"] if by_label else []

    def groups(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy(*keys).agg(F.greatest(F.ceil(F.count("*") / cell_blocks), F.lit(1)).cast("int").alias(name))

    if by_label:
        sizes = groups(blocks, "across").join(groups(asked, "down"), "label")
        join = lambda side: side.join(sizes, "label")
    else:
        across, down = (groups(side, "n").first()["n"] for side in (blocks, asked))
        join = lambda side: side.withColumns({"across": F.lit(across), "down": F.lit(down)})
    hashed = lambda n: F.pmod(F.xxhash64("block"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = join(blocks).withColumn("x", hashed("across")).select("*", every("down").alias("y")).drop("across", "down")
    right = join(asked).withColumn("y", hashed("down")).select("*", every("across").alias("x")).drop("across", "down")
    return left.groupBy(*keys, "x", "y").cogroup(right.groupBy(*keys, "x", "y")).applyInArrow(run, "anchor bigint, wanted bigint, id bigint, score bigint")


def hard_negatives(
    rows: DataFrame,
    anchors: DataFrame,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    block_rows: int = BLOCK_ROWS,
    anchor_rows: int = ANCHOR_ROWS,
    cell_blocks: int = CELL_BLOCKS,
) -> DataFrame:
    """``rows`` and ``anchors``: (id, label, vector) as of ``usable``. -> anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score."""
    blocks = columnar(rows, block_rows)
    named = write_through(anchors.distinct().withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    first = _in_blocks(named.withColumn("wanted", F.lit(None).cast("array<bigint>")), anchor_rows)
    order = [F.col("score").desc(), F.col("id")]

    partners = _meet(blocks, first, cell_blocks, True, _cell(positives, low, high, True)).drop("wanted").distinct()
    partners = partners.withColumn("rank", F.row_number().over(Window.partitionBy("anchor").orderBy(*order))).where(F.col("rank") <= positives)
    partners = write_through(partners.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    wanted = partners.groupBy("anchor").agg(F.collect_set("positive_score").alias("wanted"))
    second = _in_blocks(named.join(wanted, "anchor"), anchor_rows)
    found = _meet(blocks, second, cell_blocks, False, _cell(negatives, low, high, False)).distinct()
    place = Window.partitionBy("anchor", "wanted").orderBy(*order)
    found = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= negatives).withColumnRenamed("wanted", "positive_score")
    ids = named.select("anchor", F.col("id").alias("anchor_id"))
    return (
        found.join(partners, ["anchor", "positive_score"])
        .join(ids, "anchor")
        .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )


@query(
    "op11_hard_negatives",
    """
    WITH v AS (
        SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), pairs AS (
        SELECT DISTINCT a.vec_id AS anchor_id, a.label, b.vec_id AS id, b.label = a.label AS same,
            CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
        FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
    ), positives AS (
        SELECT anchor_id, label, id AS positive_id, score AS positive_score
        FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id, label ORDER BY score DESC, id) <= 5
    ), ranked AS (
        SELECT p.anchor_id, p.positive_id, n.id AS negative_id, p.positive_score, n.score AS negative_score,
            row_number() OVER (PARTITION BY p.anchor_id, p.label, p.positive_id, p.positive_score ORDER BY n.score DESC, n.id) AS rank
        FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND n.label = p.label AND NOT n.same
            AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
    )
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
    """,
)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")
    rows = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, rows.where("id % 50 = 0"))
