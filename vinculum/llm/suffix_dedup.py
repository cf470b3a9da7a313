"""Suffix-array dedup: bytes covered by a 50-byte string that also starts in a document with a smaller id.

A string of ``MATCH`` bytes is placed by its anchor, the ``GRAM``-byte piece of it with
the smallest hash (the last one of equals). Equal strings have equal anchors, so all
occurrences of a string meet where its anchor goes. Strings with the same anchor in a
row form a context, the few dozen bytes that hold them all.

1. Copies of a whole text need no search: the smallest id stands for them.
2. Anchors found in two documents or more are counted exactly and kept as a bitmap of
   fixed size. It lets all of them through, and a few others, which cost work only.
3. Contexts of such anchors go to the anchor's part of the hash range, each distinct one
   once a batch, and a task takes one part after the other. Where an anchor has several contexts, their suffixes are ordered: every
   shard (contexts from some tasks) has its own suffix order and Burrows-Wheeler
   transform, and the shards are merged by refining their interleave. Each round sorts the
   merged rows by ``STEP`` more leading characters (the first by what is over), which are one
   letter of the transforms, and reads the transforms only; rows part where these characters
   differ, so when ``MATCH`` are done the runs left whole are the repeated intervals of that common prefix. No suffix is sorted again. The
   smallest id of an interval holds for every context in it. At most ``UNIT_CONTEXTS``
   are ordered at once: where one anchor has more, their windows are placed anew by longer
   pieces, whose contexts are ordered group by group.
4. The texts are read once more for the occurrences of contexts with a result, which is all
   of them that leave a task. They meet the results in a join, which splits hot keys, and
   give each text the intervals to remove. Only texts with some are shuffled.

Defined cases: a null text is empty; matches never cross documents; rows without an id
remove nothing and lose nothing; rows that repeat an id are not smaller than each
other; texts under ``MATCH`` bytes lose nothing; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vinculum.llm.common import BASE, COUNT_BITS, RangeHash, Texts, bitmap_of, hash_parts, in_bitmap, may_contain, mix, name_of, repeated, slices, table
from vinculum.llm.registry import query
from vinculum.session import write_through

MATCH = 50
GRAM = 20
BLOCK = 1 << 18  # windows whose runs leave together
PIECE = 1 << 15  # windows looked at together; what is computed of them stays in the processor's cache
POSITION_BITS = 28
FLUSH_CONTEXTS = 1 << 14
UNIT_CONTEXTS = 4_000  # a quarter of a megabyte, and some 40 MB while they are ordered
LONGER_GRAMS = (35, 45)
PART_CUTS = 16  # parts of the hash range for each task
SHARDS = 4
STEP = 8  # characters of a transform's letter
U64 = np.uint64
NEVER = np.iinfo(np.int64).max


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of every ``gram`` bytes in a row, put together from those of 1, 2, 4 ... bytes."""
    part, size = data.astype(np.uint64) + U64(1), 1
    tail, tail_size = None, 0
    while True:
        if gram & size:
            if tail is None:
                tail = part
            else:
                n = min(len(part), len(tail) - size)
                tail = part[:n] * U64(pow(int(BASE), tail_size, 1 << 64)) + tail[size : size + n]
            tail_size += size
        if tail_size == gram:
            return mix(tail)
        part = part[:-size] * U64(pow(int(BASE), size, 1 << 64)) + part[size:]
        size *= 2


def _anchored(t: Texts, begin: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``anchors`` of the windows that start in the ``PIECE`` bytes from ``begin``."""
    w = MATCH - gram + 1
    low = U64((1 << POSITION_BITS) - 1)
    value = gram_hashes(t.data[begin : begin + PIECE + MATCH - 1], gram)
    key = value & ~low
    key |= np.arange(int(low), int(low) - len(value), -1, dtype=np.uint64)
    span = 1
    while span * 2 <= w:
        key, span = np.minimum(key[:-span], key[span:]), span * 2
    if span < w:
        key = np.minimum(key[: len(key) - (w - span)], key[w - span :])
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])  # the place is part of the key
    new[t.offsets[np.searchsorted(t.offsets, begin) : np.searchsorted(t.offsets, begin + len(key))] - begin] = True
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(key)] - 1 + begin
    at = (low - (key[first] & low)).astype(np.int64)
    first += begin
    text = np.searchsorted(t.offsets, first, "right") - 1
    end = t.offsets[text + 1] - MATCH
    k = np.flatnonzero(first <= end)
    return text[k], first[k], np.minimum(last, end)[k], value[at[k]]


def anchors(t: Texts, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, first, last, hash): runs of windows (by start byte in the slice) with the same anchor."""
    n = len(t.data) - MATCH + 1
    for block in range(0, max(n, 0), BLOCK):
        found = [_anchored(t, begin, gram) for begin in range(block, min(block + BLOCK, n), PIECE)]
        text, first, last, value = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(text):
            yield text, first, last, value


def leading(batches: Iterator[pa.RecordBatch], leaders: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (doc, row, text) that may stand for their text: whole copies need no search."""
    for batch in batches:
        yield batch.filter(pa.array(in_bitmap(leaders, np.asarray(batch.column(1)))))


WIDTH = 2 * MATCH - GRAM  # bytes of the longest context
ROW = np.dtype([("anchor", "<u8"), ("ctx", "<i8"), ("least", "<i8"), ("most", "<i8"), ("size", "u1"), ("bytes", "u1", WIDTH)])


def _shared_runs(batches: Iterator[pa.RecordBatch], leaders: np.ndarray, shared: np.ndarray):
    """(slice, rows' ids and numbers, text, first, last, anchor) of runs whose anchors are shared, some thousands at a time."""
    for batch in leading(batches, leaders):
        ids, rows = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        for t in slices(batch.column(2)):
            for text, first, last, value in anchors(t):
                own = np.flatnonzero(in_bitmap(shared, name_of(value)))
                for a in range(0, len(own), FLUSH_CONTEXTS):
                    k = own[a : a + FLUSH_CONTEXTS]
                    yield t, ids, rows, text[k], first[k], last[k], value[k]


def _context_names(t: Texts, first: np.ndarray, last: np.ndarray, value: np.ndarray) -> np.ndarray:
    begin = int(first[0])
    hashed = RangeHash(t.data[begin : int(last[-1]) + MATCH])
    return mix(hashed(first - begin, last - begin + MATCH) ^ mix(value)).view(np.int64)


def contexts(docs: DataFrame, leaders: np.ndarray, shared: np.ndarray, parts: int) -> DataFrame:
    """Distinct contexts of a batch by part of the hash range (part, rows). ``docs``: doc, row, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, ids, _, text, first, last, value in _shared_runs(batches, leaders, shared):
            yield leave(t, ids[t.row + text], first, last, value)

    def leave(t: Texts, doc, first, last, value) -> pa.RecordBatch:
        size = last - first + MATCH
        ctx = _context_names(t, first, last, value)
        order = np.lexsort((ctx, value))
        heads = np.flatnonzero(np.r_[True, (ctx[order][1:] != ctx[order][:-1]) | (value[order][1:] != value[order][:-1])])
        head = order[heads]
        out = np.zeros(len(head), ROW)
        out["anchor"], out["ctx"], out["size"] = value[head], ctx[head], size[head]
        out["least"], out["most"] = np.minimum.reduceat(doc[order], heads), np.maximum.reduceat(doc[order], heads)
        begin = int(first[0])
        padded = np.r_[t.data[begin : int(last[-1]) + MATCH], np.zeros(WIDTH, np.uint8)]
        taken = padded[(first - begin)[head][:, None] + np.arange(WIDTH)]
        taken[np.arange(WIDTH) >= size[head][:, None]] = 0
        out["bytes"] = taken
        bounds = hash_parts(out["anchor"], parts)
        own = [p for p in range(parts) if bounds[p + 1] > bounds[p]]
        blobs = [out[bounds[p] : bounds[p + 1]].tobytes() for p in own]
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "rows"])

    return docs.mapInArrow(run, "part int, rows binary")


def occurrences(docs: DataFrame, leaders: np.ndarray, shared: np.ndarray, placed: np.ndarray) -> DataFrame:
    """(ctx, row, doc, at) of every context whose name the bitmap ``placed`` holds. ``docs``: doc, row, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, ids, rows, text, first, last, value in _shared_runs(batches, leaders, shared):
            ctx = _context_names(t, first, last, value)
            k = np.flatnonzero(in_bitmap(placed, ctx))
            at, text = first[k] - t.offsets[text[k]], t.row + text[k]
            yield pa.RecordBatch.from_arrays([pa.array(ctx[k]), pa.array(rows[text]), pa.array(ids[text]), pa.array(at)], names=["ctx", "row", "doc", "at"])

    return docs.mapInArrow(run, "ctx bigint, row bigint, doc bigint, at bigint")


def word_ranks(shards: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different words of ``STEP`` characters in order, and the rank of the one at every place of the shards
    (laid end to end, each read in a circle)."""
    words = []
    for s in shards:
        around = np.resize(s, len(s) + STEP).astype(np.uint64)
        word = np.zeros(len(s), np.uint64)
        for k in range(STEP):
            word <<= U64(8)
            word |= around[k : k + len(s)]
        words.append(word)
    word = np.concatenate(words)
    order = np.argsort(word)
    word = word[order]
    new = np.ones(len(word), bool)
    new[1:] = word[1:] != word[:-1]
    rank = np.empty(len(word), np.uint32)
    rank[order] = np.cumsum(new) - 1
    return word[new], rank


def suffix_order(rank: np.ndarray, depth: int = MATCH) -> np.ndarray:
    """Starts of all suffixes of a shard in order of their first ``depth`` characters or more, read in a circle.

    ``rank``: of the ``STEP`` characters at each place; the ranks of twice as many follow from those of a place and
    of the one behind."""
    size = STEP
    while True:
        step = min(size, max(depth - size, 0))
        key = rank.astype(np.uint64) << U64(32) | np.roll(rank, -step)
        order = np.argsort(key)
        size += step
        if size >= depth:
            return order
        key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        rank = np.empty(len(key), np.uint32)
        rank[order] = np.cumsum(new) - 1


def merge_shards(shards: list[np.ndarray], depth: int = MATCH) -> tuple[np.ndarray, np.ndarray]:
    """Merge the shards' transforms: suffix starts (in the shards laid end to end) in merged order, and
    the interval of each: suffixes in the same interval have the first ``depth`` characters in common.

    A transform holds the ``STEP`` characters before each suffix, as one letter of a larger alphabet."""
    sizes = [len(s) for s in shards]
    shift = np.cumsum([0, *sizes])
    words, rank = word_ranks(shards)
    ranks = [rank[a:b] for a, b in zip(shift[:-1], shift[1:], strict=True)]
    orders = [suffix_order(r, depth) for r in ranks]
    starts = np.concatenate([o + b for o, b in zip(orders, shift[:-1], strict=True)])
    interleave = np.repeat(np.arange(len(shards), dtype=np.uint8), sizes)
    interval = np.zeros(len(starts), np.uint32)
    read = np.empty(len(starts), np.uint64)
    row = np.arange(len(starts), dtype=np.uint64)
    for width in [depth % STEP] * (depth % STEP > 0) + [STEP] * (depth // STEP):
        letters = words >> U64(8 * (STEP - width))
        letters = np.cumsum(np.r_[False, letters[1:] != letters[:-1]][: len(letters)]).astype(np.uint64) << U64(32)
        transform = np.concatenate([letters[r[o - width % len(o)]] for r, o in zip(ranks, orders, strict=True)])
        # Row i of the merge is the next unread row of shard interleave[i]; its suffix, with the
        # characters before it put in front, is ``width`` longer.
        read[np.argsort(interleave, kind="stable")] = transform
        read |= row
        by = np.sort(read)
        char = by >> U64(32)
        by = (by & U64(0xFFFFFFFF)).astype(np.int64)
        interleave, before = interleave[by], interval[by]
        parts = np.ones(len(by), bool)
        parts[1:] = (char[1:] != char[:-1]) | (before[1:] != before[:-1])
        interval = np.cumsum(parts, dtype=np.uint32) - np.uint32(1)
    merged = np.empty(len(starts), np.int64)
    merged[np.argsort(interleave, kind="stable")] = starts
    return merged, interval


def least_ids(rows: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """For each context (row) and window: the smallest id of any context that holds the window."""
    out = np.full((len(rows), WIDTH - MATCH + 1), NEVER)
    windows = rows["size"].astype(np.int64) - MATCH + 1
    order = np.argsort(shard, kind="stable")
    size = rows["size"][order].astype(np.int64) + 1  # each ends with a 0
    first = np.cumsum(size) - size
    text = np.zeros(int(size.sum()), np.uint8)
    owner = np.repeat(np.arange(len(order)), size)
    offset = np.arange(len(text)) - first[owner]
    inside = offset < size[owner] - 1
    # The end mark is 0, so bytes are shifted by one; UTF-8 has none above 244.
    text[inside] = rows["bytes"][order[owner[inside]], offset[inside]] + 1
    cuts = np.searchsorted(shard[order], np.arange(SHARDS + 1))
    ends = np.r_[first, len(text)][cuts]
    merged, interval = merge_shards([text[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True) if b > a])
    whole = offset[merged] < windows[order[owner[merged]]]
    least = np.where(whole, rows["least"][order[owner[merged]]], NEVER)
    heads = np.flatnonzero(np.r_[True, interval[1:] != interval[:-1]])
    found = np.minimum.reduceat(least, heads)[interval]
    out[order[owner[merged[whole]]], offset[merged[whole]]] = found[whole]
    return out


def _units(group: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of whole groups (sorted) that have ``UNIT_CONTEXTS`` rows together, or of one that has more."""
    ends = np.flatnonzero(np.r_[group[1:] != group[:-1], True][: len(group)]) + 1
    at = 0
    while at < len(group):
        k = int(np.searchsorted(ends, at + UNIT_CONTEXTS, "right")) - 1
        stop = int(ends[k]) if k >= 0 and ends[k] > at else int(ends[k + 1])
        yield at, stop
        at = stop


def least_ids_of_any(rows: np.ndarray, shard: np.ndarray, grams: tuple[int, ...] = LONGER_GRAMS) -> np.ndarray:
    """``least_ids`` for any number of contexts: equal windows have equal anchors of any length, so too many
    contexts are cut into those of a longer one, which are fewer and ordered apart."""
    if len(rows) <= UNIT_CONTEXTS or not grams:
        return least_ids(rows, shard)
    size = rows["size"].astype(np.int64)
    inside = np.arange(WIDTH) < size[:, None]
    t = Texts(0, rows["bytes"][inside], np.r_[0, np.cumsum(size)], np.zeros(len(rows), bool))
    owner, first, last, value = (np.concatenate(x) for x in zip(*anchors(t, grams[0]), strict=True))
    order = np.argsort(value, kind="stable")
    owner, first, last, value = owner[order], first[order] - t.offsets[owner[order]], last[order] - t.offsets[owner[order]], value[order]
    out = np.full((len(rows), WIDTH - MATCH + 1), NEVER)
    for a, b in _units(value):
        own, start, n = owner[a:b], first[a:b], last[a:b] - first[a:b] + 1
        pieces = np.zeros(b - a, ROW)
        pieces["least"], pieces["size"] = rows["least"][own], n + MATCH - 1
        taken = rows["bytes"][own[:, None], np.minimum(start[:, None] + np.arange(WIDTH), WIDTH - 1)]
        taken[np.arange(WIDTH) >= pieces["size"][:, None]] = 0
        pieces["bytes"] = taken
        found = least_ids_of_any(pieces, shard[own], grams[1:])
        k, window = np.nonzero(np.arange(WIDTH - MATCH + 1) < n[:, None])
        out[own[k], start[k] + window] = found[k, window]
    return out


def interval_ids(found: DataFrame, parts: int) -> DataFrame:
    """(ctx, a, b, least): windows a to b of a context all start, at the least, in document ``least``."""

    def solve(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        rows = np.frombuffer(b"".join(blobs), ROW)
        shard = np.repeat(np.arange(len(blobs)) % SHARDS, [len(b) // ROW.itemsize for b in blobs])
        order = np.lexsort((rows["ctx"], rows["anchor"]))
        anchor, ctx = rows["anchor"][order], rows["ctx"][order]
        head = np.flatnonzero(np.r_[True, (ctx[1:] != ctx[:-1]) | (anchor[1:] != anchor[:-1])])
        least, most = np.minimum.reduceat(rows["least"][order], head), np.maximum.reduceat(rows["most"][order], head)
        rows, shard, group = rows[order[head]], shard[order[head]], anchor[head]
        rows["least"], rows["most"] = least, most
        group = np.cumsum(np.r_[True, group[1:] != group[:-1]]) - 1
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        one_doc = (np.minimum.reduceat(least, first) == np.maximum.reduceat(most, first))[group]
        several = (np.bincount(group) > 1)[group] & ~one_doc
        single = np.flatnonzero(~several & ~one_doc)
        yield leave(rows["ctx"][single], np.zeros(len(single), np.int64), rows["size"][single].astype(np.int64) - MATCH, rows["least"][single])
        mixed = np.flatnonzero(several)
        for at, stop in _units(group[mixed]):
            own = mixed[at:stop]
            ids = least_ids_of_any(rows[own], shard[own])
            n, width = ids.shape
            new = np.ones((n, width), bool)
            new[:, 1:] = ids[:, 1:] != ids[:, :-1]
            k, a = np.nonzero(new)
            b = np.r_[a[1:], 0] - 1
            last = np.r_[k[1:] != k[:-1], True]
            b[last] = width - 1
            kept = ids[k, a] != NEVER
            yield leave(rows["ctx"][own[k[kept]]], a[kept], b[kept], ids[k[kept], a[kept]])

    def leave(*columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["ctx", "a", "b", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        open_part = None
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if held and part != open_part:
                    yield from solve(held)
                    held = []
                open_part = part
                held.append(blob.as_py())
        if held:
            yield from solve(held)

    dealt = found.repartition(parts, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(run, "ctx bigint, a bigint, b bigint, least bigint")


def cut(docs: DataFrame, key: str) -> DataFrame:
    """Remove the intervals of each text. ``docs``: key, text, copied, spans (array of from, to)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, copied, spans = (batch.column(k).to_pylist() for k in (1, 2, 3))
            out: list[tuple[int, int, int, str, bytes]] = []
            for text, copy, own in zip(texts, copied, spans, strict=True):
                raw = (text or "").encode()
                ends = sorted((s["from"], s["to"]) for s in own or ())
                if copy:
                    ends = [(0, len(raw))]
                kept, at, n_spans = [], 0, 0
                open_end = -1
                for a, b in ends:
                    if a > open_end:
                        n_spans += 1
                    if a > at:
                        kept.append(raw[at:a])
                    at, open_end = max(at, b), max(open_end, b)
                kept.append(raw[at:])
                left = b"".join(kept)
                out.append((len(raw), len(raw) - len(left), n_spans, hashlib.sha256(left).hexdigest(), left))
            n_bytes, removed, n_spans, sha, left = zip(*out, strict=True) if out else ((),) * 5
            arrays = [pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string()), pa.array(left, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.mapInArrow(run, f"`{key}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left)."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("row", F.xxhash64(F.col(key), "text"))
    known = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("doc"), "row", "text")
    # Whole copies: all but those with the smallest id of their text.
    names = write_through(known.where(F.octet_length("text") >= MATCH).select("doc", "row", F.sha2("text", 256).alias("sha")), "names")
    first = names.groupBy("sha").agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
    leaders = names.join(first, "sha")
    copies = leaders.where("doc > least").select("row").distinct()
    own = bitmap_of(leaders.where("doc = least"), "row")

    def named(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for part in leading(iter([batch]), own):
            ids = np.asarray(part.column(0))
            for t in slices(part.column(2)):
                for doc, _, _, value in anchors(t):
                    yield value, ids[t.row + doc]

    shared = repeated(known, named, parts)
    ids = write_through(interval_ids(contexts(known, own, shared, PART_CUTS * parts), parts), "interval-ids")
    seen = occurrences(known, own, shared, bitmap_of(ids, "ctx", COUNT_BITS))
    removed = seen.join(ids, "ctx").where("least < doc").select("row", (F.col("at") + F.col("a")).alias("from"), (F.col("at") + F.col("b") + MATCH).alias("to"))
    spans = removed.groupBy("row").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    touched = write_through(spans.withColumn("copied", F.lit(False)).unionByName(copies.select("row", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"), F.lit(True).alias("copied"))), "touched")
    touched_once = touched.groupBy("row").agg(F.max("copied").alias("copied"), F.first("spans", ignorenulls=True).alias("spans"))
    some = may_contain(docs, touched, "row").join(touched_once, "row", "left")
    some = some.select(key, F.when(F.col(key).isNotNull(), F.col("copied")).alias("copied"), F.when(F.col(key).isNotNull(), F.col("spans")).alias("spans"), "text")
    rest = may_contain(docs, touched, "row", others=True).select(
        key,
        F.octet_length("text").cast("bigint").alias("n_bytes"),
        F.lit(0).cast("bigint").alias("n_removed"),
        F.lit(0).cast("bigint").alias("n_spans"),
        F.sha2("text", 256).alias("kept_sha256"),
        F.col("text").cast("binary").alias("kept"),
    )
    return cut(some.select(key, "text", "copied", "spans"), key).unionByName(rest)


@query("op3_suffix_array_dedup")
def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("kept")
