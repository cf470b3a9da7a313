"""What the operators of this folder share: reading, text bytes as arrays, hashes.

Texts reach Python as Arrow batches; the helpers below see a batch as one byte
array with document offsets, so that work per byte or per word is one numpy pass
and never a Python loop. ``slices`` bounds what is held at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vinculum.session import shuffles_dropped

SLICE_BYTES = 2 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
U64 = np.uint64
FILTER_BITS = 1 << 23
COUNT_BITS = 1 << 26
FLUSH = 1 << 19  # hashes a task holds before they leave it


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(key: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; an id that is null falls in fold -1."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % n, F.lit(-1))


class Texts:
    """Some rows of a text column: ``data`` bytes, ``offsets`` (rows + 1), first row ``row``."""

    def __init__(self, row: int, data: np.ndarray, offsets: np.ndarray, null: np.ndarray):
        self.row, self.data, self.offsets, self.null = row, data, offsets, null

    def __len__(self) -> int:
        return len(self.offsets) - 1


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """Consecutive rows of at most ``limit`` bytes, one row at least. A null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, raw = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    null = np.asarray(column.is_null())
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        own = offsets[first : last + 1]
        yield Texts(first, data[own[0] : own[-1]], own - own[0], null[first:last])
        first = last


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data | 32, data)


def _runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of marked bytes; runs end where a text ends."""
    n = len(inside)
    padded = np.zeros(n + 2, bool)
    padded[1:-1] = inside
    first, last = inside & ~padded[:-2], inside & ~padded[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    first[edges] |= inside[edges]
    last[edges - 1] |= inside[edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_spans(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (bytes) and document of every word ``[^\\x20\\x09-\\x0D]+``."""
    start, end = _runs((t.data != 32) & ((t.data < 9) | (t.data > 13)), t.offsets)
    return start, end, np.searchsorted(t.offsets, start, "right") - 1


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, b in enumerate((BASE, BASE_INVERSE)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (in place where possible)."""
    h = h ^ (h >> U64(31))
    h *= U64(0x7FB5D329728EA185)
    h ^= h >> U64(27)
    h *= U64(0x81DADEF4BC2DD44D)
    h ^= h >> U64(33)
    return h


class RangeHash:
    """64-bit hashes of byte ranges of one array, each in constant time."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + U64(1)) * up[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * U64(0xD6E8FEB86659FD93))


def joined(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each ``n`` consecutive hashes: len - n + 1 values."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:m].copy()
    for k in range(1, n):
        out *= U64(0xC2B2AE3D27D4EB4F)
        out += hashes[k : k + m] ^ (out >> U64(29))
    return mix(out)


def letter_runs(t: Texts, digits: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, document and hash of every run of letters (ASCII ones and bytes above 127), and digits if asked."""
    data = lower_ascii(t.data)
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    if digits:
        letter |= (data >= 48) & (data <= 57)
    start, end = _runs(letter, t.offsets)
    return start, end, np.searchsorted(t.offsets, start, "right") - 1, RangeHash(data)(start, end)



def _bit(values: np.ndarray, bits: int, ordered: bool = False) -> np.ndarray:
    """The bit of each value: of its hash or, for names of hashes, ``ordered`` as they are, so that names
    of one part of the hash range share their words of the bitmap. ``bits`` is a power of two then."""
    if ordered:
        return values.astype(np.int64) >> (48 - bits.bit_length())
    return (mix(values.astype(np.int64).view(np.uint64)) % U64(bits)).astype(np.int64)


def marked(values: np.ndarray, bits: int = FILTER_BITS, ordered: bool = False) -> pa.RecordBatch:
    """The 64-bit words of a bitmap that the hashed values mark: (at, bits)."""
    bit = np.unique(_bit(values, bits, ordered))
    word = bit >> 6
    head = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(bit) else np.zeros(0, np.int64)
    ones = U64(1) << (bit & 63).astype(np.uint64)
    words = np.bitwise_or.reduceat(ones, head) if len(bit) else ones
    return pa.RecordBatch.from_arrays([pa.array(word[head]), pa.array(words.view(np.int64))], names=["at", "bits"])


MARKED = "at bigint, bits bigint"


def gathered(words: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """The bitmap of all tasks' words, as bytes: what reaches the driver has a fixed size."""
    with shuffles_dropped(words.sparkSession):
        found = words.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint8)


def bitmap_of(members: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield marked(np.asarray(batch.column(0)), bits)

    return gathered(members.where(F.col(column).isNotNull()).select(F.col(column).cast("bigint")).mapInArrow(run, MARKED), bits)


def in_bitmap(bitmap: np.ndarray, values: np.ndarray, ordered: bool = False) -> np.ndarray:
    at = _bit(values, len(bitmap) * 8, ordered)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def may_contain(docs: DataFrame, members: DataFrame, key: str, others: bool = False) -> DataFrame:
    """Rows of ``docs`` whose key may be among ``members`` (all that are, and a few more), or the other
    rows: for an exact join after it, so that rows which cannot match are not shuffled. A null key is
    among the others."""
    bitmap = bitmap_of(members, key)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(batch.num_columns - 1)
            found = in_bitmap(bitmap, np.asarray(own.fill_null(0))) & ~np.asarray(own.is_null())
            yield batch.filter(pa.array(~found if others else found)).select(columns)

    return docs.withColumn("_member", F.col(key).cast("bigint")).mapInArrow(run, docs.schema)


def without(docs: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Rows of ``docs`` whose key is not among ``members``. Only rows whose key may be are shuffled."""
    doubtful = may_contain(docs, members, key).join(members.select(key).distinct(), key, "left_anti").select(docs.columns)
    return may_contain(docs, members, key, others=True).unionByName(doubtful)


def name_of(value: np.ndarray) -> np.ndarray:
    return (value >> U64(17)).astype(np.int64)


def hash_parts(value: np.ndarray, parts: int) -> np.ndarray:
    """Bounds of each part of the hash range in sorted hashes."""
    cuts = np.searchsorted(value, (np.arange(1, parts, dtype=np.float64) / parts * 2.0**64).astype(np.uint64))
    return np.r_[0, cuts, len(value)]


def repeated(docs: DataFrame, named: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]], parts: int, bits: int = COUNT_BITS, ordered: bool = False) -> np.ndarray:
    """Bitmap of the names of hashes that two owners or more have, counted over all of ``docs``.

    ``named`` gives (hash, owner) of a batch. Each distinct hash leaves a task once, as six bytes: its
    first 47 bits and whether the task saw several owners. The hash range is cut finer than ``parts``,
    so that a part is small in memory when it is counted.
    """
    parts = 4 * parts

    def leave(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        value, owner = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(value)
        value, owner = value[order], owner[order]
        head = np.flatnonzero(np.r_[True, value[1:] != value[:-1]][: len(value)])
        several = np.minimum.reduceat(owner, head) != np.maximum.reduceat(owner, head) if len(head) else np.zeros(0, bool)
        value = value[head]
        bounds = hash_parts(value, parts)
        name = ((value >> U64(17)) << U64(1) | several.astype(np.uint64)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        own = [p for p in range(parts) if bounds[p + 1] > bounds[p]]
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([name[bounds[p] : bounds[p + 1]].tobytes() for p in own], pa.binary())], names=["part", "names"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for value, owner in named(batch):
                held.append((value, owner))
                size += len(value)
                if size >= FLUSH:
                    yield leave(held)
                    held, size = [], 0
        if held:
            yield leave(held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [b for batch in batches for b in batch.column(1).to_pylist()]
        if blobs:
            raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 6)
            name = np.zeros((len(raw), 8), np.uint8)
            name[:, :6] = raw
            name = np.sort(name.view("<u8").ravel())
            value, flag = name >> U64(1), name & U64(1)
            head = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
            size = np.diff(np.r_[head, len(value)])
            yield marked(value[head[(size > 1) | (np.maximum.reduceat(flag, head) > 0)]], bits, ordered)

    return gathered(docs.mapInArrow(run, "part int, names binary").repartition(parts, "part").mapInArrow(count, MARKED), bits)
