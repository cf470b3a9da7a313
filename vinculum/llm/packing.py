"""Best-fit packing: vector best-fit of tokenised documents into fixed-length sequences.

A document is its token ids and an end id. Documents longer than a sequence are cut
into full pieces and a rest. A sequence has three capacities: tokens, documents and
attention cost (the sum of squared piece lengths). Pieces are taken longest first;
among the open sequences with room in every capacity, the one that fits best is
chosen by the weighted dot product of the piece's needs and what remains (the rule
``dot``) or by the smallest norm of what would remain (the rule ``norm``, the
default, which wastes fewest tokens). A sequence is opened only when none has room.

Pieces are stored first. They are then dealt by hash into as many groups as their
number asks for, about ``GROUP_PIECES`` each, and every group is packed by one task
on its own; each group leaves at most a few sequences that are not full. Only piece
descriptions travel (about 50 bytes), never texts or ids.

Tokenisation works on the distinct words of a batch: the tokenizer drops white space
and never joins across it, so a text's ids are those of its words in a row. It lowers
case, and a run of punctuation after a letter or digit is a word to it as well, so
"Word," is asked for as "word" and ",". Words seen before are kept in a table of
bounded size for the tasks of one worker.

Defined cases: a null or empty text is the end id alone; repeated rows are pieces of
their own; an empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vinculum.llm.common import RangeHash, Texts, lower_ascii, slices, table, word_spans
from vinculum.llm.registry import query
from vinculum.session import write_through

SEQUENCE = 4096
END_ID = 1
MAX_DOCUMENTS = 4096  # documents of a sequence
MAX_ATTENTION = SEQUENCE * SEQUENCE
WEIGHTS = (1.0, 0.001, 0.001)  # of tokens, documents and attention cost in the fit
GROUP_PIECES = 30_000
WORDS_KEPT = 1_000_000  # words whose ids a worker keeps
TRAILING = np.isin(np.arange(256), np.frombuffer(b".,!?;:*#$%&|", np.uint8))
ALNUM = np.array([i < 128 and chr(i).isalnum() for i in range(256)])
ASKED = 4_096  # words given to the tokenizer at once
SLICE = 1 << 18  # bytes of text split into words at once: the arrays of a slice take some sixty times as much


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of words, by hash; asks the tokenizer only for words not seen before."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.hashes, self.first, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        parts, sizes = [], []
        for a in range(0, len(words), ASKED):  # an encoding is far larger than its ids
            found = [e.ids for e in self.tokenizer.encode_batch_fast(words[a : a + ASKED], add_special_tokens=False)]
            sizes += [len(ids) for ids in found]
            parts.append(np.fromiter((i for own in found for i in own), np.uint32))
        size, ids = np.array(sizes, np.int64), np.concatenate(parts)
        first = len(self.ids) + np.cumsum(size) - size
        order = np.argsort(np.r_[self.hashes, hashes], kind="stable")
        self.hashes, self.first, self.size = (np.r_[old, new][order] for old, new in ((self.hashes, hashes), (self.first, first), (self.size, size)))
        self.ids = np.r_[self.ids, ids]

    def __call__(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words of the texts in a row, and how many each text has."""
        data, start, end, doc = asked_words(t)
        every, example, inverse = np.unique(RangeHash(data)(start, end), return_index=True, return_inverse=True)
        if len(self.hashes) + len(every) > WORDS_KEPT:
            self.clear()
        at = np.minimum(np.searchsorted(self.hashes, every), max(len(self.hashes) - 1, 0))
        new = np.flatnonzero(self.hashes[at] != every) if len(self.hashes) else np.arange(len(every))
        if len(new):
            raw = data.tobytes()
            self.learn(every[new], [raw[start[i] : end[i]].decode() for i in example[new]])
        at = np.searchsorted(self.hashes, every)
        size = self.size[at][inverse]
        place = np.repeat(self.first[at][inverse] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return self.ids[place], np.bincount(doc, weights=size, minlength=len(t)).astype(np.int64)


def asked_words(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in lower case, and start, end and text of the strings the tokenizer is asked for.

    A word with a "<" may hold a special token, whose case counts: it stays as it is.
    """
    start, end, doc = word_spans(t)
    if not len(start):
        return t.data, start, end, doc
    data = lower_ascii(t.data)
    marked = np.r_[0, np.cumsum(t.data == ord("<"))]
    special = np.flatnonzero(marked[end] > marked[start])
    if len(special):
        data = data.copy()
        for a, b in zip(start[special], end[special], strict=True):
            data[a:b] = t.data[a:b]
    bare = np.maximum.accumulate(np.where(TRAILING[data], -1, np.arange(len(data))))[end - 1] + 1
    cut = (bare > start) & (bare < end)
    cut[cut] = ALNUM[data[bare[cut] - 1]]
    cut[special] = False
    tails = np.flatnonzero(cut)
    stem_end = np.where(cut, bare, end)
    order = np.argsort(np.r_[np.arange(len(start)) * 2, tails * 2 + 1], kind="stable")
    return data, np.r_[start, bare[tails]][order], np.r_[stem_end, end[tails]][order], np.r_[doc, doc[tails]][order]


_worker: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _worker:
        _worker[path] = WordIds(path)
    return _worker[path]


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", sequence: int = SEQUENCE) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of every document, whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for t in slices(batch.column(1), SLICE):
                ids, size = words(t)
                after = np.cumsum(size)
                for k in range(len(t)):
                    own = np.r_[ids[after[k] - size[k] : after[k]], np.uint32(END_ID)].astype("<u4")
                    for piece, start in enumerate(range(0, len(own), sequence)):
                        part = own[start : start + sequence]
                        rows.append((t.row + k, piece, start, len(part), zlib.crc32(part.tobytes())))
            row, piece, start, length, crc = np.array(rows, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)],
                names=[key, "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(lengths: np.ndarray, capacity: tuple[int, int, int], weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece; ``lengths`` descend.

    Sequences without room for the shortest piece are closed, so that only those that
    can still take something are compared.
    """
    capacity = np.array(capacity, np.float64)
    scale = np.array(weights) / capacity
    least = lengths[-1] if len(lengths) else 0
    room = np.empty((1024, 3))
    number = np.empty(1024, np.int64)
    n_open = n_all = 0
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, length in enumerate(lengths):
        need = np.array([length, 1, float(length) * length])
        fits = np.flatnonzero((room[:n_open] >= need).all(axis=1))
        if len(fits):
            rest = room[fits] * scale if rule == "dot" else (room[fits] - need) * scale
            k = fits[(rest @ (need * scale)).argmax() if rule == "dot" else (rest * rest).sum(axis=1).argmin()]
        else:
            if n_open == len(room):
                room, number = np.concatenate([room, np.empty_like(room)]), np.concatenate([number, np.empty_like(number)])
            k = n_open
            room[k], number[k] = capacity, n_all
            n_open, n_all = n_open + 1, n_all + 1
        sequence[i], offset[i] = number[k], capacity[0] - room[k, 0]
        room[k] -= need
        if room[k, 0] < least or room[k, 1] < 1:
            n_open -= 1
            room[k], number[k] = room[n_open], number[n_open]
    return sequence, offset


def pack(
    parts: DataFrame,
    key: str = "doc_id",
    sequence: int = SEQUENCE,
    max_documents: int = MAX_DOCUMENTS,
    max_attention: int = MAX_ATTENTION,
    weights: tuple[float, float, float] = WEIGHTS,
    rule: str = "norm",
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """``parts`` (stored pieces) with ``sequence_id`` and ``offset``."""
    groups = max(1, -(-parts.count() // group_pieces))
    capacity = (sequence, max_documents, max_attention)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = [b.to_pandas() for b in batches]
        frame = pd.concat(frames, ignore_index=True) if frames else None
        if frame is None or not len(frame):
            return
        frame = frame.sort_values(["length", key, "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        number, frame["offset"] = best_fit(frame["length"].to_numpy(), capacity, weights, rule)
        frame["sequence_id"] = (TaskContext.get().partitionId() << 33) + number
        yield pa.RecordBatch.from_pandas(frame[[key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]], schema=schema, preserve_index=False)

    key_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[parts.schema[key].dataType.simpleString()]
    schema = pa.schema([(key, key_type), ("piece", pa.int32()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "sequence_id", "offset"))])
    dealt = parts.repartition(groups, F.xxhash64(key, "piece"))
    return dealt.mapInArrow(
        run, f"`{key}` {parts.schema[key].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    )


def pack_documents(docs: DataFrame, path: str | None = None, **how) -> DataFrame:
    """Tokenise, cut and pack; ``how`` are options of ``pack``."""
    path = path or tokenizer_path()
    return pack(write_through(pieces(docs, path, sequence=how.get("sequence", SEQUENCE)), "pieces"), **how)


@query("op7_best_fit_packing")
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
