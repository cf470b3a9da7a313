"""Filter interaction audit over a sparse document-term matrix.

Five filters are asked of every whole text; every order of them says what each removes
first, what it would remove anyway and what it alone removes. Filters A (too few words) and
B (too few distinct words) are decided from the matrix: row sums and nonzero counts.

- Words of a shard of consecutive documents are encoded by the shard's own dictionary and
  counted into compressed sparse rows (``indptr``, ``indices``, ``counts``). Shards are stored.
- The shards' dictionaries are dealt by ranges of the words' hashes, as many as their words ask
  for: a word gets one number in the whole corpus (its range and its rank there), however many
  shards and documents hold it. Words are compared by their bytes, never by hash.
- Ranks go back to the shards, whose indices are replaced; a word is in a shard's dictionary
  once, so a frequent word makes no hot key. Indices and ranks ascend, so their steps are moved.
- The smallest id of every text is found by map-side aggregation and joined on (text digest,
  id), so a group of copies with a third of all rows is spread by id.
- Rows are counted by part and failure pattern (32 at most) before the orders unfold.

Defined cases: a null text is empty; words are maximal runs of other characters than blanks
and 09 to 0D, compared by their bytes; a null id has no smaller id and is none, and has no
labels; rows that repeat an id do not fail E by each other; labels that contradict each other
count as both; very long texts are a shard of their own; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vinculum.llm.common import RangeHash, Texts, _runs, slices, table
from vinculum.llm.registry import query
from vinculum.session import write_through

FILTERS = "ABCDE"
MIN_WORDS = 50  # A: fewer words
DISTINCT_PERCENT = 65  # B: fewer distinct words of 100
UPPER_PERCENT = 5  # C: more capitals of 100 code points
MARKS = b"#$%&*|"  # D: any of them
SHARD_BYTES = 4 << 20
PART_TERMS = 1 << 19  # words of shards' dictionaries that are numbered together, about
NUMBER_BITS = 40  # a term's number is its part's and its rank there

DOCS = "doc_id array<bigint>, part array<string>, digest array<binary>, marks binary"
SHARD = f"shard bigint, {DOCS}, indptr binary, indices binary, counts binary, n_terms bigint, words binary, sizes binary"
MATRIX = f"shard bigint, {DOCS}, indptr binary, indices binary, counts binary"


def packed(values: np.ndarray, steps: bool = False) -> bytes:
    """32-bit numbers (or the steps between them) by byte planes, which compress well."""
    values = values.astype("<u4")
    if steps:
        values = np.diff(values, prepend=values.dtype.type(0))
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 4).T).tobytes()


def unpacked(blob: bytes, steps: bool = False) -> np.ndarray:
    values = np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return np.cumsum(values, dtype="<u4") if steps else values


def _hashes(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return RangeHash(data)(bounds[:-1], bounds[1:])


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of all words of an array without offset."""
    _, at, raw = words.buffers()
    bounds = np.frombuffer(at, np.int64)[: len(words) + 1]
    return np.frombuffer(raw, np.uint8)[: bounds[-1]] if raw is not None else np.zeros(0, np.uint8), bounds


def _in_order(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct words by their hash, and the place of each in that order."""
    order = np.argsort(_hashes(*_bytes_of(words)), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return words.take(pa.array(order)), place


def _terms(t: Texts) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words by hash, and the rows (documents) over them: indptr, indices, counts."""
    inside = (t.data != 32) & ((t.data < 9) | (t.data > 13))
    start, end = _runs(inside, t.offsets)
    doc = np.searchsorted(t.offsets, start, "right") - 1
    coded = _binary(t.data[inside], np.r_[0, np.cumsum(end - start)]).dictionary_encode()
    words, place = _in_order(coded.dictionary)
    width = max(len(words), 1)
    cell = np.sort(doc * width + place[np.asarray(coded.indices)])
    head = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]][: len(cell)])
    row, column = np.divmod(cell[head], width)
    return words, np.searchsorted(row, np.arange(len(t) + 1)), column, np.diff(np.r_[head, len(cell)])


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Marked bytes of every text; few are marked."""
    return np.diff(np.searchsorted(np.flatnonzero(mask), offsets))


_MARK = np.zeros(256, bool)
_MARK[list(MARKS)] = True


def _one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _cut(shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 32
        for batch in batches:
            for t in slices(batch.column("text"), shard_bytes):
                words, indptr, indices, counts = _terms(t)
                upper, points = _sums((t.data >= 65) & (t.data <= 90), t.offsets), np.diff(t.offsets) - _sums(t.data & 0xC0 == 0x80, t.offsets)
                marks = (100 * upper > UPPER_PERCENT * points) * 4 | (_sums(_MARK[t.data], t.offsets) > 0) * 8
                own = batch.slice(t.row, len(t))
                data, bounds = _bytes_of(words)
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": pa.array([n], pa.int64()),
                        **{c: _one_list(own.column(c)) for c in ("doc_id", "part", "digest")},
                        "marks": [marks.astype(np.uint8).tobytes()],
                        "indptr": [packed(indptr, steps=True)],
                        "indices": [packed(indices, steps=True)],
                        "counts": [packed(counts)],
                        "n_terms": pa.array([len(words)], pa.int64()),
                        "words": [data.tobytes()],
                        "sizes": [packed(np.diff(bounds))],
                    }
                )
                n += 1

    return run


def shards_of(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Stored shards in their own dictionaries' numbers, with the ``words``. ``docs``: doc_id, part, text."""
    text = F.coalesce("text", F.lit(""))
    given = docs.select("doc_id", "part", F.unhex(F.sha2(text, 256)).alias("digest"), text.cast("binary").alias("text"))
    return write_through(given.mapInArrow(_cut(shard_bytes), SHARD), "shards")


def _deal(parts: int):
    """A shard's dictionary by parts of the hash range."""
    edges = (np.arange(1, parts, dtype=np.float64) / parts * 2.0**64).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, words, sizes in zip(*(batch.column(c) for c in ("shard", "words", "sizes")), strict=True):
                data, size = np.frombuffer(words.as_py(), np.uint8), unpacked(sizes.as_py())
                bounds = np.r_[0, np.cumsum(size, dtype=np.int64)]
                cut = np.r_[0, np.searchsorted(_hashes(data, bounds), edges), len(size)]
                own = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_pydict(
                    {
                        "range": pa.array(own, pa.int32()),
                        "shard": pa.array([shard.as_py()] * len(own), pa.int64()),
                        "at": pa.array(cut[own], pa.int64()),
                        "words": pa.array([data[bounds[cut[p]] : bounds[cut[p + 1]]].tobytes() for p in own], pa.binary()),
                        "sizes": pa.array([packed(size[cut[p] : cut[p + 1]]) for p in own], pa.binary()),
                    }
                )

    return run


NUMBERED = "range int, shard bigint, at bigint, ranks binary, words array<binary>"


def _number(part: pa.Table) -> pa.Table:
    """Ranks of a part's words. The first row brings the words that have them, in order."""
    blobs, sizes = part.column("words").to_pylist(), [unpacked(x) for x in part.column("sizes").to_pylist()]
    bounds = np.r_[0, np.cumsum(np.concatenate(sizes), dtype=np.int64)]
    coded = _binary(np.frombuffer(b"".join(blobs), np.uint8), bounds).dictionary_encode()
    words, place = _in_order(coded.dictionary)
    rank = place[np.asarray(coded.indices)]
    cut = np.r_[0, np.cumsum([len(x) for x in sizes])]
    return pa.table(
        {
            "range": part.column("range"),
            "shard": part.column("shard"),
            "at": part.column("at"),
            "ranks": pa.array([packed(rank[a:b], steps=True) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
            "words": pa.array([words.to_pylist(), *[None] * (len(part) - 1)], pa.list_(pa.binary())),
        }
    )


def term_numbers(shards: DataFrame, part_terms: int = PART_TERMS) -> DataFrame:
    """Numbers for all words of all shards. A row gives the ``ranks`` that one shard's words from ``at``
    on have in a ``range`` of hashes; one row of each range also has its ``words``, in order of rank."""
    total = shards.agg(F.sum("n_terms").alias("n")).first()["n"] or 0
    dealt = shards.select("shard", "words", "sizes").mapInArrow(_deal(-(-total // part_terms) or 1), "range int, shard bigint, at bigint, words binary, sizes binary")
    return dealt.groupBy("range").applyInArrow(_number, NUMBERED)


def dictionary(numbers: DataFrame) -> DataFrame:
    """The corpus dictionary: ``term`` (number) and ``word``."""
    listed = numbers.where("words IS NOT NULL").select("range", F.posexplode("words").alias("rank", "word"))
    return listed.select((F.shiftleft(F.col("range").cast("bigint"), NUMBER_BITS) + F.col("rank")).alias("term"), F.col("word").cast("string").alias("word"))


def _encode(shard: pa.Table, numbers: pa.Table) -> pa.Table:
    numbers = numbers.sort_by("at")
    term = [np.int64(r) << NUMBER_BITS | unpacked(x, steps=True).astype(np.int64) for r, x in zip(numbers.column("range").to_pylist(), numbers.column("ranks").to_pylist(), strict=True)]
    term = np.concatenate(term) if term else np.zeros(0, np.int64)
    given = {c: unpacked(shard.column(c)[0].as_py(), steps=c != "counts") for c in ("indptr", "indices", "counts")}
    out = {c: shard.column(c) for c in ("shard", "doc_id", "part", "digest", "marks")}
    made = (("indptr", given["indptr"]), ("indices", term[given["indices"]].astype("<i8")), ("counts", given["counts"]))
    return pa.table(out | {c: pa.array([v.tobytes()], pa.binary()) for c, v in made})


def _per_shard(shards: DataFrame, numbers: DataFrame, run, schema: str) -> DataFrame:
    used = numbers.select("shard", "at", "range", "ranks")
    return shards.drop("words", "sizes", "n_terms").groupBy("shard").cogroup(used.groupBy("shard")).applyInArrow(run, schema)


def term_matrix(shards: DataFrame, numbers: DataFrame) -> DataFrame:
    """Shards of compressed sparse rows over the corpus dictionary: ``indices`` are term numbers
    (64 bits), ``indptr`` and ``counts`` 32 bits, little-endian; row i is document ``doc_id[i]``."""
    return _per_shard(shards, numbers, _encode, MATRIX)


FACTS = "doc_id bigint, part string, digest binary, n_words bigint, n_distinct bigint, marks int"


def _facts(shard: pa.Table) -> pa.Table:
    """Row sums and nonzero counts of a shard's rows, and the marks of C and D."""
    read = lambda c, kind: np.frombuffer(shard.column(c)[0].as_py(), kind)
    indptr = read("indptr", "<u4").astype(np.int64)
    sums = np.diff(np.r_[0, np.cumsum(read("counts", "<u4"), dtype=np.int64)][indptr])
    made = {"n_words": sums, "n_distinct": np.diff(indptr), "marks": read("marks", np.uint8).astype(np.int32)}
    return pa.table({c: shard.column(c)[0].values for c in ("doc_id", "part", "digest")} | {c: pa.array(v) for c, v in made.items()})


def row_facts(shards: DataFrame, numbers: DataFrame) -> DataFrame:
    """Per document, read from its row of ``term_matrix``; a shard's matrix never leaves its task."""
    return _per_shard(shards, numbers, lambda shard, used: _facts(_encode(shard, used)), FACTS)


def failures(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``doc_id``, ``part`` and ``fails``: bit i is set where filter i of ``FILTERS`` fails."""
    shards = shards_of(docs, shard_bytes)
    facts = write_through(row_facts(shards, term_numbers(shards)), "facts")
    first = facts.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    a = F.col("n_words") < MIN_WORDS
    b = 100 * F.col("n_distinct") < DISTINCT_PERCENT * F.col("n_words")
    e = F.col("doc_id").isNotNull() & F.col("first").isNull()
    fails = a.cast("int") + b.cast("int") * 2 + F.col("marks") + e.cast("int") * 16
    return facts.join(first, ["digest", "doc_id"], "left").select("doc_id", "part", fails.alias("fails"))


def _orders() -> str:
    """Every step of every order, as JSON: its filter's bit and the bits of those before it."""
    steps = []
    for order in itertools.permutations(range(len(FILTERS))):
        for k, own in enumerate(order):
            steps.append({"filter_order": "".join(FILTERS[i] for i in order), "step": k + 1, "own": 1 << own, "before": sum(1 << i for i in order[:k])})
    return json.dumps(steps)


def audit(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order and step: what the step's filter does. ``failed``: doc_id, part, fails."""
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.expr("int(quality = 1)")).alias("good"), F.max(F.expr("int(toxic = 1)")).alias("toxic"))
    patterns = (
        failed.join(known, "doc_id", "left")
        .groupBy("part", "fails")
        .agg(F.count("*").alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("good", "toxic")))
    )
    kind = "array<struct<filter_order:string,step:int,own:int,before:int>>"
    steps = patterns.select("*", F.inline(F.from_json(F.lit(_orders()), kind)))
    fails, own, before = F.col("fails"), F.col("own"), F.col("before")
    failing, gone = fails.bitwiseAND(own) != 0, fails.bitwiseAND(before) != 0
    count = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0)).cast("bigint")
    out = steps.groupBy("part", "filter_order", "step", "own").agg(
        count(~failing & ~gone).alias("kept"),
        count(failing & ~gone).alias("removed"),
        count(failing & gone).alias("redundant"),
        count(fails == own).alias("unique_fails"),
        count(failing & ~gone, "good").alias("good_lost"),
        count(failing & ~gone, "toxic").alias("toxic_lost"),
    )
    share = out.groupBy("part", "own").agg(F.sum("removed").alias("shapley"))
    return out.join(share, ["part", "own"]).drop("own")


@query(
    "op12_filter_audit",
    r"""
    WITH docs AS (
        SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
            regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
        FROM documents
    ), seen AS (
        SELECT text, min(doc_id) AS first FROM docs GROUP BY text
    ), known AS (
        SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
    ), failed AS (
        SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
            CASE WHEN len(words) < 50 THEN 1 ELSE 0 END
            + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
            + CASE WHEN 100 * length(regexp_replace(docs.text, '[^A-Z]', '', 'g')) > 5 * length(docs.text) THEN 4 ELSE 0 END
            + CASE WHEN regexp_matches(docs.text, '[#$%&*|]') THEN 8 ELSE 0 END
            + CASE WHEN docs.doc_id > first THEN 16 ELSE 0 END AS fails
        FROM docs JOIN seen ON docs.text = seen.text LEFT JOIN known ON docs.doc_id = known.doc_id
    ), patterns AS (
        SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, fails
    ), f AS (
        SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(letter, bit)
    ), orders AS (
        SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
        FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
            AND a.bit <> b.bit AND a.bit <> c.bit AND a.bit <> d.bit AND a.bit <> e.bit AND b.bit <> c.bit
            AND b.bit <> d.bit AND b.bit <> e.bit AND c.bit <> d.bit AND c.bit <> e.bit AND d.bit <> e.bit
    ), steps AS (
        SELECT filter_order, step, bits[step] AS own,
            (CASE WHEN step > 1 THEN bits[1] ELSE 0 END) + (CASE WHEN step > 2 THEN bits[2] ELSE 0 END)
            + (CASE WHEN step > 3 THEN bits[3] ELSE 0 END) + (CASE WHEN step > 4 THEN bits[4] ELSE 0 END) AS before
        FROM orders, (VALUES (1), (2), (3), (4), (5)) AS s(step)
    ), counted AS (
        SELECT part, filter_order, step, own,
            sum(CASE WHEN fails & (own | before) = 0 THEN n ELSE 0 END) AS kept,
            sum(CASE WHEN fails & own <> 0 AND fails & before = 0 THEN n ELSE 0 END) AS removed,
            sum(CASE WHEN fails & own <> 0 AND fails & before <> 0 THEN n ELSE 0 END) AS redundant,
            sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
            sum(CASE WHEN fails & own <> 0 AND fails & before = 0 THEN good ELSE 0 END) AS good_lost,
            sum(CASE WHEN fails & own <> 0 AND fails & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
        FROM patterns, steps GROUP BY part, filter_order, step, own
    )
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
        CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
        CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
    FROM counted
    """,
)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("part"), "text")
    return audit(failures(docs), table(spark, sf_dir, "labels"))
