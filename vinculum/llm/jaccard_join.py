"""N-gram Jaccard join: T-occurrence search by DivideSkip, within groups that cannot be apart.

1. Every text becomes its set of shingles (64-bit hashes). Texts with the same set are
   one class; one member stands for it.
2. Grouping, exact: two sets of at most n shingles that link differ in at most d =
   2n/19 shingles (for a similarity of 0.9), so of d + 1 segments of the hash range one
   holds the same shingles in both. Each set emits a signature per segment, and sets
   that share one are put in one group. Passages that many texts share hardly group
   them, as a segment must agree whole. Sets too many of whose shingles are in no other
   set can have no partner and take no part. Shingles and signatures that several sets
   have are counted first and kept as bitmaps of fixed size, so the others (nearly all)
   do not travel; a signature that a task has several times leaves it once, tied to the
   smallest set there, so a hot one costs a row per task.
3. T-occurrence: in a group, shingles have inverted lists of the sets that hold them. A
   set needs T occurrences of a partner on its lists. DivideSkip puts its L longest
   lists aside, merges the short ones, keeps partners found T - L times, and looks
   those up in the long lists by binary probes (or by one scan of the lists where that
   is cheaper). Groups beyond ``UNIT_SHINGLES`` are dealt into blocks, and every pair of
   blocks is a unit of its own: no cap, no group in one task. A text has a row for each block
   of its group, so large groups' units are dealt out in rounds and disk stays bounded.
4. Links give components; copies follow the member that stands for them.

Defined cases: ids are integers; rows without an id or without a word link with
nothing and are returned with themselves as component; rows that repeat an id are
documents of their own, each joined by its own text; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vinculum.llm.common import COUNT_BITS, FLUSH, RangeHash, Texts, hash_parts, in_bitmap, joined, lower_ascii, may_contain, mix, name_of, repeated, slices, table, word_spans
from vinculum.llm.components import components
from vinculum.llm.registry import query
from vinculum.session import drop_stored, write_through

WORDS = 3
PERCENT = 90
UNIT_SHINGLES = 1_000_000
UNIT_ROWS = 256  # rows looked at before a task decides whether it holds enough
SKIP_RATE = 0.0085  # DivideSkip's weight of a probe against a merge step
ROUND_COPIES = 2  # times the texts of all groups that are dealt out at once
MOST_BITS = 1 << 28
U64 = np.uint64


def shingle_sets(t: Texts, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of every distinct shingle, sorted by both. Fewer words are one shorter shingle."""
    start, end, doc = word_spans(t)
    word = RangeHash(lower_ascii(t.data))(start, end)
    n = np.bincount(doc, minlength=len(t))
    first = np.cumsum(n) - n
    docs, hashes = [], []
    for size in range(1, words + 1):
        own = joined(word, size) ^ mix(np.full(1, size, np.uint64))
        if size < words:
            rows = np.flatnonzero(n == size)
            docs.append(rows)
            hashes.append(own[first[rows]])
        elif len(own):
            at = np.flatnonzero(doc[: len(own)] == doc[size - 1 :])
            docs.append(doc[at])
            hashes.append(own[at])
    doc, value = np.concatenate(docs), np.concatenate(hashes)
    order = np.argsort(value)
    order = order[np.argsort(doc[order].astype(np.int32), kind="stable")]
    doc, value = doc[order], value[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[keep], value[keep]


def set_hashes(doc: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """Two 64-bit hashes of each text's set (two rows, signed)."""
    h = np.zeros((2, rows), np.uint64)
    if len(doc):
        heads = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        h[0, doc[heads]] = np.add.reduceat(mix(value), heads)
        h[1, doc[heads]] = np.add.reduceat(mix(value ^ U64(0x5851F42D4C957F2D)), heads)
    return h.view(np.int64)


def size_classes(limit: int, percent: int) -> np.ndarray:
    """Lower ends of size classes, from the smallest size that can link to another set to two ends above
    ``limit``: a longer list begins with a shorter one, and every class that a set may sign has its upper end."""
    ends = [percent // (100 - percent)]
    above = lambda end: max(end + 3, end * 5 // 4)
    while ends[-1] <= limit:
        ends.append(above(ends[-1]))
    return np.array([*ends, above(ends[-1])])


def signatures(doc: np.ndarray, value: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and signature of every segment of every set, in its own size class and, where it may
    have partners there, in the next one."""
    ends = size_classes(int(n.max(initial=0)), percent)
    own = np.searchsorted(ends, n, "right") - 1
    docs, signs = [], []
    for step in (0, 1):
        rows = np.flatnonzero((own >= 0) & (n > 0)) if step == 0 else np.flatnonzero((100 * n >= percent * ends[own + 1]) & (n > 0))
        kind = own[rows] + step
        most = ends[kind + 1] - 1
        # |x ^ y| <= (|x| + |y|) (100 - percent) / (100 + percent)
        apart = 2 * most * (100 - percent) // (100 + percent)
        segments = apart + 1 + (apart + 3) // 3  # some to spare, as some stay empty
        first = np.cumsum(segments) - segments
        place = np.full(len(n), -1)
        place[rows] = np.arange(len(rows))
        mine = np.flatnonzero(place[doc] >= 0)
        at = place[doc[mine]]
        segment = ((value[mine] >> U64(32)) * segments[at].astype(np.uint64)) >> U64(32)
        cell = first[at] + segment.astype(np.int64)
        heads = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
        sums = np.zeros(int(segments.sum()), np.uint64)
        if len(cell):
            sums[cell[heads]] = np.add.reduceat(mix(value[mine]), heads)
        owner = np.repeat(np.arange(len(rows)), segments)
        # Of two sets that link, one segment agrees that is not empty, if either has more such segments
        # than the sets can differ in. A set with fewer signs its empty segments too.
        filled = np.zeros(len(sums), bool)
        filled[cell[heads]] = True
        signed = filled | (np.bincount(owner[filled], minlength=len(rows)) <= apart)[owner]
        tag = kind[owner].astype(np.uint64) << U64(40) | (np.arange(len(sums)) - first[owner]).astype(np.uint64)
        docs.append(rows[owner[signed]])
        signs.append(mix(sums + mix(tag + U64(1)))[signed])
    return np.concatenate(docs), np.concatenate(signs)


def _least_per_signature(sign: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each distinct signature with its smallest key, and the edges from the other keys to it."""
    order = np.lexsort((key, sign))
    sign, key = sign[order], key[order]
    head = np.r_[True, sign[1:] != sign[:-1]] if len(sign) else np.zeros(0, bool)
    least = key[head][np.cumsum(head) - 1] if len(sign) else key
    other = key != least
    edges = np.unique(np.stack([key[other], least[other]], axis=1), axis=0)
    return sign[head], key[head], edges[:, 0], edges[:, 1]


SIGNED = pa.schema([("part", pa.int32()), ("signs", pa.binary()), ("keys", pa.binary()), ("a", pa.int64()), ("b", pa.int64())])


def set_table(docs: DataFrame, words: int) -> DataFrame:
    """(key, n, h1, h2) of every row of ``docs`` (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in slices(batch.column(1)):
                doc, value = shingle_sets(t, words)
                h1, h2 = set_hashes(doc, value, len(t))
                n = np.bincount(doc, minlength=len(t))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.row, len(t)), pa.array(n), pa.array(h1), pa.array(h2)], names=["key", "n", "h1", "h2"])

    return docs.mapInArrow(run, "key bigint, n bigint, h1 bigint, h2 bigint")


def set_shingles(batch: pa.RecordBatch, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(shingle, h1 of its set) of the rows of a batch (key, text) that have a key."""
    known = ~np.asarray(batch.column(0).is_null())
    for t in slices(batch.column(1)):
        doc, value = shingle_sets(t, words)
        own = known[t.row + doc]
        yield value[own], set_hashes(doc, value, len(t))[0][doc[own]]


def signed_sets(batch: pa.RecordBatch, words: int, percent: int, common: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(signature, h1 of its set) of the rows of a batch (key, text) that have a key and can have a
    partner: at least ``percent`` of a set's shingles must be ``common``, in other sets too."""
    known = ~np.asarray(batch.column(0).is_null())
    for t in slices(batch.column(1)):
        doc, value = shingle_sets(t, words)
        h1, _ = set_hashes(doc, value, len(t))
        n = np.bincount(doc, minlength=len(t))
        shared = np.bincount(doc[in_bitmap(common, name_of(value), ordered=True)], minlength=len(t))
        able = known[t.row : t.row + len(t)] & (100 * shared >= percent * n)
        kept = able[doc]
        at, sign = signatures(doc[kept], value[kept], np.where(able, n, 0), percent)
        yield sign, h1[at]


def bitmap_bits(total: int) -> int:
    """Bits for the repeated ones among ``total`` shingles, about a seventh of them: a full bitmap would let all
    sets through. From 8 MB to 32 MB."""
    return min(max(COUNT_BITS, 1 << (max(total // 4, 1) - 1).bit_length()), MOST_BITS)


def signature_table(docs: DataFrame, words: int, percent: int, parts: int, bits: int = COUNT_BITS) -> DataFrame:
    """Signatures that several sets have, by part of the hash range (part, signs, keys), and edges
    found inside a task (a, b). Keys are the sets' h1."""
    common = repeated(docs, lambda batch: set_shingles(batch, words), parts, bits, ordered=True)
    shared = repeated(docs, lambda batch: signed_sets(batch, words, percent, common), parts, bits, ordered=True)

    def leave(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        sign, own, a, b = _least_per_signature(np.concatenate([s for s, _ in held]), np.concatenate([k for _, k in held]))
        bounds = hash_parts(sign, parts)
        rows = [p for p in range(parts) if bounds[p + 1] > bounds[p]]
        blobs = [pa.array([x[bounds[p] : bounds[p + 1]].tobytes() for p in rows], pa.binary()) for x in (sign, own)]
        none = pa.nulls(len(rows), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), *blobs, none, none], schema=SIGNED)
        no_part = [pa.nulls(len(a), f.type) for f in SIGNED][:3]
        yield pa.RecordBatch.from_arrays([*no_part, pa.array(a), pa.array(b)], schema=SIGNED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for sign, own in signed_sets(batch, words, percent, common):
                keep = in_bitmap(shared, name_of(sign), ordered=True)
                held.append((sign[keep], own[keep]))
                if sum(len(s) for s, _ in held) >= FLUSH:
                    yield from leave(held)
                    held = []
        if held:
            yield from leave(held)

    return docs.mapInArrow(run, "part int, signs binary, keys binary, a bigint, b bigint")


def signature_edges(signed: DataFrame, parts: int) -> DataFrame:
    """(a, b): sets that share a signature, as stars around the smallest h1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.frombuffer(s, np.uint64), np.frombuffer(k, np.int64)) for batch in batches for s, k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        if held:
            _, _, a, b = _least_per_signature(np.concatenate([s for s, _ in held]), np.concatenate([k for _, k in held]))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    dealt = signed.where("part is not null").select("part", "signs", "keys").repartition(parts, "part")
    inside = signed.where("part is null").select("a", "b")
    return dealt.mapInArrow(run, "a bigint, b bigint").unionByName(inside)


class Lists:
    """Inverted lists of some sets; sets are numbered by ascending size."""

    def __init__(self, sets: np.ndarray, value: np.ndarray, size: np.ndarray, percent: int):
        _, token = np.unique(value, return_inverse=True)
        order = np.lexsort((sets, token))
        self.size, self.percent, self.count = size, percent, len(size)
        self.members = sets[order]
        self.length = np.bincount(token)
        self.first = np.cumsum(self.length) - self.length
        self.keys = token[order].astype(np.int64) * len(size) + self.members
        by_set = np.argsort(sets, kind="stable")
        self.tokens = token[by_set]
        self.set_first = np.searchsorted(sets[by_set], np.arange(len(size) + 1))

    def needed(self, n: int, m):
        """Least overlap at which sets of n and m shingles link."""
        return -(-self.percent * (n + m) // (100 + self.percent))

    def partners(self, x: int) -> np.ndarray:
        """Sets before ``x`` that link with it."""
        n = int(self.size[x])
        own = self.tokens[self.set_first[x] : self.set_first[x + 1]]
        own = own[self.length[own] > 1]
        low = int(np.searchsorted(self.size, -(-n * self.percent // 100)))  # sets that are large enough
        least = int(self.needed(n, -(-n * self.percent // 100)))
        if len(own) < least or low >= x:
            return np.zeros(0, np.int64)
        own = own[np.argsort(self.length[own], kind="stable")]
        aside = min(int(least / (SKIP_RATE * np.log2(self.length[own[-1]]) + 1)), least - 1)
        short, long = own[: len(own) - aside], own[len(own) - aside :]
        found, counts = np.unique(self._merged(short, low, x), return_counts=True)
        keep = counts >= least - aside
        found, counts = found[keep], counts[keep]
        if len(found) and len(long):
            if len(found) * 24 < self.length[long].mean():
                probes = long[:, None].astype(np.int64) * self.count + found
                at = np.minimum(np.searchsorted(self.keys, probes), len(self.keys) - 1)
                counts = counts + (self.keys[at] == probes).sum(axis=0)
            else:
                counts = counts + np.bincount(self._merged(long, low, x), minlength=x)[found]
        return found[counts >= self.needed(n, self.size[found])]

    def _merged(self, tokens: np.ndarray, low: int, high: int) -> np.ndarray:
        """Members of the lists from set ``low`` to before ``high``, list after list."""
        a = np.searchsorted(self.keys, tokens.astype(np.int64) * self.count + low)
        size = np.searchsorted(self.keys, tokens.astype(np.int64) * self.count + high) - a
        return self.members[np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def link_units(units: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b, links): each set with a link, the smallest set of its component in the unit, and how
    many documents it links with there. ``units``: unit, side, h1, copies, text, sorted by unit."""

    def solve(unit: np.ndarray, side: np.ndarray, h1: np.ndarray, copies: np.ndarray, column: pa.Array) -> pa.RecordBatch:
        docs, values = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        own = np.zeros(len(h1), bool)  # rows that hold the set asked for; an id may have other texts too
        for t in slices(column):
            doc, value = shingle_sets(t, words)
            rows = slice(t.row, t.row + len(t))
            own[rows] = set_hashes(doc, value, len(t))[0] == h1[rows]
            docs.append(doc + t.row)
            values.append(mix(value ^ mix(unit[rows][doc].view(np.uint64))))  # units have lists of their own
        doc, value = np.concatenate(docs), np.concatenate(values)
        order = np.flatnonzero(own)
        order = order[np.r_[True, (unit[order][1:] != unit[order][:-1]) | (h1[order][1:] != h1[order][:-1])][: len(order)]]  # rows that repeat
        n = np.bincount(doc, minlength=len(h1))
        order = order[np.lexsort((h1[order], n[order]))]
        rank = np.full(len(h1), -1)
        rank[order] = np.arange(len(order))
        kept = rank[doc] >= 0
        lists = Lists(rank[doc[kept]], value[kept], n[order], percent)
        h1, side, copies = h1[order], side[order], copies[order]
        links, root = np.zeros(len(h1), np.int64), np.arange(len(h1))
        members = {i: [i] for i in range(len(h1))}
        for x in range(len(h1)):
            found = lists.partners(x)
            found = found[(side[found] != side[x]) | (side[x] < 0)]
            if len(found):
                links[x] += copies[found].sum()
                links[found] += copies[x]
                for r in np.unique(root[found]):
                    a, b = int(root[x]), int(r)
                    if a != b:
                        a, b = (a, b) if len(members[a]) >= len(members[b]) else (b, a)
                        root[members[b]] = a
                        members[a] += members.pop(b)
        linked = np.flatnonzero(links)
        least = {r: int(h1[m].min()) for r, m in members.items() if len(m) > 1}
        return pa.RecordBatch.from_arrays([pa.array(h1[linked]), pa.array([least[int(r)] for r in root[linked]], pa.int64()), pa.array(links[linked])], names=["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in (b.slice(k, UNIT_ROWS) for b in batches for k in range(0, len(b), UNIT_ROWS)):
            held.append(batch)
            size += batch.column(4).nbytes
            if size < 6 * UNIT_SHINGLES:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            last = np.searchsorted(np.asarray(whole.column(0)), np.asarray(whole.column(0))[-1])  # its last unit may go on
            if last:
                yield solve(*_columns(whole.slice(0, last)))
            held = whole.slice(last).combine_chunks().to_batches()
            size = sum(b.column(4).nbytes for b in held)
        if held:
            yield solve(*_columns(pa.Table.from_batches(held)))

    return units.mapInArrow(run, "a bigint, b bigint, links bigint")


def unit_rows(placed: DataFrame, rounds: int, turn: int) -> DataFrame:
    """(unit, side, h1, copies, text): a row of ``placed`` for each unit of its own that has its turn."""
    unit = lambda other: F.xxhash64("group", F.least("block", other), F.greatest("block", other))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.pmod(F.shiftright(unit(other), 20), F.lit(rounds)) == turn)
    return placed.withColumn("other", F.explode(others)).select(
        unit(F.col("other")).alias("unit"),
        # In a unit of two blocks only pairs across them count; in a unit of one block (side -1) all do.
        F.when(F.col("block") == F.col("other"), F.lit(-1)).otherwise(F.col("block")).cast("bigint").alias("side"),
        "h1",
        "copies",
        "text",
    )


def _columns(rows: pa.Table):
    rows = rows.combine_chunks()
    return *(np.asarray(rows.column(k)) for k in range(4)), rows.column(4).combine_chunks()


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, unit_shingles: int = UNIT_SHINGLES) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id, n_links (documents it links with)."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(key, text)
    keyed = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    sets = write_through(set_table(keyed, words), "sets")
    bits = bitmap_bits(sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    signed = write_through(signature_table(keyed, words, percent, parts, bits), "signed")
    # A class is named by h1; its smallest id stands for it.
    filled = sets.where("n > 0 and key is not null")
    classes = write_through(filled.groupBy("h1", "h2", "n").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    candidates = write_through(signature_edges(signed, parts), "candidates")
    drop_stored(signed)
    groups = components(candidates)
    drop_stored(candidates)
    members = classes.join(groups, classes["h1"] == groups["node"]).select("h1", "rep", "copies", "n", F.col("component").alias("group"))
    sizes = members.groupBy("group").agg(F.sum("n").alias("total"))
    members = members.join(sizes, "group").withColumn("blocks", F.ceil(F.col("total") / unit_shingles).cast("int"))
    members = write_through(members.select("group", "h1", "rep", "copies", "n", "blocks"), "members")
    drop_stored(groups)
    # Their texts, then one row for each unit a set belongs to. A text of a group of k blocks has k such rows, so the
    # units of large groups come in rounds, each of which shuffles a bounded share of them.
    texts = may_contain(docs.select(F.col(key).cast("bigint").alias("rep"), F.col(text).alias("text")).where("rep is not null"), members, "rep")
    placed = texts.join(members.drop("n"), "rep").withColumn("block", F.pmod(F.xxhash64("h1"), F.col("blocks")).cast("int"))
    own, dealt = members.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("blocks")), F.lit(0))).first()
    rounds = max(1, -(-dealt // max(ROUND_COPIES * own, 1)))
    if rounds > 1:
        placed = write_through(placed, "placed")
    solved = []
    for turn in range(rounds):
        units = unit_rows(placed, rounds, turn).repartition(parts, "unit").sortWithinPartitions("unit", "h1")
        solved.append(write_through(link_units(units, words, percent), "links"))
    links = reduce(DataFrame.unionByName, solved)
    drop_stored(members, *([placed] if rounds > 1 else []))
    counted = links.groupBy(F.col("a").alias("h1")).agg(F.sum("links").alias("links"))
    named = classes.join(components(links.select("a", "b")).withColumnRenamed("node", "h1"), "h1", "left").join(counted, "h1", "left")
    named = named.withColumn("component", F.coalesce("component", "h1"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "component").select("h1", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    alone = ~F.col("filled")
    found = sets.withColumn("filled", (F.col("n") > 0) & F.col("key").isNotNull()).join(named, "h1", "left")
    return found.select(
        F.col("key").cast(docs.schema[key].dataType).alias(key),
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("key")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("links")).alias("n_links"),
    )


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, coalesce(list_distinct(CASE
      WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END), []) AS s
  FROM words
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM items a JOIN items b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS other FROM sets
  UNION
  SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id, coalesce(l.n, 0) AS n_links
FROM sets s
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, count(*) AS n FROM links GROUP BY a) l USING (doc_id)
"""


@query("op4_ngram_jaccard_join", SQL)
def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
