"""Benchmark decontamination: BM25 index of test items, queried with every passage by block-max WAND.

Terms are runs of letters and digits in lower case. A posting's impact is its BM25
weight divided by the score of its part of the item for that part's own text, so a score
is the share of the part found in a passage, and one threshold serves all. The parts of
an item are its first half (question) and its second half (answer), each found without
the other; an item of under ten terms, whose halves say little alone, is one part.
Passages are windows of a text's terms, each reaching past the next one's start by the
longest part's length, so that a part copied into a text lies whole in one of them. They
are verified with as many terms on both sides as the longest item has.

A passage is dropped at once if no part can reach the threshold in it, by a bound that
a few array passes over the batch give (see ``passages``). The others are searched by
block-max WAND: terms ordered by their next part, a pivot by list maxima, a second test by the
maxima of the blocks the pivot falls in, and scoring only of parts that can still
reach the threshold. What is retrieved is verified by the shares of the question's and
the answer's shingles that the passage holds. Shingles are of five words, in halves of
under fifteen of a third of their words (two at least), so that half of them or more
are left when a word is changed. Halves of under five words are one shingle.

Items are indexed in blocks of bounded size, one scan of the documents for each, so
the index shipped to tasks never outgrows a task; document frequencies are counted
over all items first. Documents are never shuffled; a text is queried whole.

Defined cases: items and texts that are null or without terms match nothing; equal
item texts are items of their own; repeated rows and ids each give their pairs (one
row for a document id and item); an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vinculum.llm.common import Texts, letter_runs, slices, table
from vinculum.llm.registry import query
from vinculum.session import write_through

K1, B = 1.2, 0.75
THRESHOLD = 0.5  # share of a part's own score that a passage must reach
OVERLAP = 0.5  # share of the shingles of an item's question or answer; a changed word leaves as many
SHINGLE = 5
STRIDE = 16
LIST_BLOCK = 64
CELLS = 1 << 21  # strides times items added up at once
COMMON_SHARE = 0.6  # a term of more of the items is common
BLOCK_TERMS = 100_000  # terms of one block of items


def terms_of(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of every term."""
    _, _, doc, term = letter_runs(t, digits=True)
    return doc, term


def item_terms(items: DataFrame, item_key: str, text: str) -> DataFrame:
    """(item, position, term) of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in slices(batch.column(1)):
                doc, term = terms_of(t)
                position = np.arange(len(doc)) - np.searchsorted(doc, doc)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(t.row + doc)), pa.array(position), pa.array(term.view(np.int64))], names=["item", "position", "term"])

    kind = items.schema[item_key].dataType.simpleString()
    return items.where(F.col(item_key).isNotNull()).select(item_key, text).mapInArrow(run, f"item {kind}, position bigint, term bigint")


def shingles(terms: np.ndarray) -> set[bytes]:
    """Shingles of an item's half."""
    n = len(terms) if len(terms) < SHINGLE else min(SHINGLE, max(len(terms) // 3, 2))
    return {terms[i : i + n].tobytes() for i in range(len(terms) - n + 1)} if n else set()


class Index:
    """Postings of the parts of one block of items; ``df`` is counted over all items."""

    def __init__(self, items: list, terms: list[np.ndarray], df: dict[int, int], n_items: int, mean_length: float):
        self.items = items
        self.longest = max(map(len, terms), default=0)
        halves = [(own[: -(-len(own) // 2)], own[-(-len(own) // 2) :]) for own in terms]
        parts = [(i, part) for i, own in enumerate(terms) for part in (halves[i] if len(own) >= 2 * SHINGLE else (own,))]
        self.item_of = [i for i, _ in parts]
        self.longest_part = max((len(part) for _, part in parts), default=0)
        postings: dict[int, list[tuple[int, float]]] = {}
        for i, (_, own) in enumerate(parts):
            found, tf = np.unique(own, return_counts=True)
            idf = np.log1p((n_items - np.array([df[int(x)] for x in found]) + 0.5) / (np.array([df[int(x)] for x in found]) + 0.5))
            weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(own) * len(parts) / max(len(items), 1) / mean_length))
            for term, w in zip(found, weight / weight.sum(), strict=True):
                postings.setdefault(int(term), []).append((i, float(w)))
        self.vocabulary = np.array(sorted(postings), np.uint64)
        lists = [postings[int(x)] for x in self.vocabulary]
        self.ids = [[i for i, _ in own] for own in lists]
        self.impacts = [[w for _, w in own] for own in lists]
        self.block_max = [[max(own[a : a + LIST_BLOCK]) for a in range(0, len(own), LIST_BLOCK)] for own in self.impacts]
        self.most = np.array([max(own) for own in self.impacts])
        self.list_size = np.array([len(own) for own in self.ids], np.int64)
        self.list_start = np.cumsum(self.list_size) - self.list_size
        self.all_ids = np.array([i for own in self.ids for i in own], np.int64)
        self.all_impacts = np.array([w for own in self.impacts for w in own])
        self.few = self.list_size <= max(COMMON_SHARE * len(parts), 1)
        in_common = np.repeat(~self.few, self.list_size)
        self.common = np.bincount(self.all_ids[in_common], weights=self.all_impacts[in_common], minlength=1).max() if len(self.all_ids) else 0.0
        self.question = [shingles(q) for q, _ in halves]
        self.answer = [shingles(a) for _, a in halves]

    def places(self, term: np.ndarray) -> np.ndarray:
        """Vocabulary number of each term, -1 for terms of no item."""
        if not len(self.vocabulary):
            return np.full(len(term), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, term), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == term, at, -1)

    def reached(self, places: np.ndarray, threshold: float) -> bool:
        """Whether any part's score reaches the threshold: one array pass, as most passages end here."""
        size = self.list_size[places]
        entry = np.repeat(self.list_start[places] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.bincount(self.all_ids[entry], weights=self.all_impacts[entry], minlength=1).max() >= threshold - 1e-9

    def search(self, places: list[int], threshold: float) -> list[tuple[int, float]]:
        """(part number, score) of every part whose score reaches the threshold: block-max WAND."""
        cursors = [[self.ids[p][0], 0, p] for p in places]  # next item, place in the list, term
        hits = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, p) in enumerate(cursors):
                bound += self.most[p]
                if bound >= threshold - 1e-9:
                    pivot = k
                    break
            if pivot < 0:
                return hits
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block_bound, last = 0.0, 1 << 62
            for _, at, p in cursors[: pivot + 1]:
                b = bisect_left(self.ids[p], item, at) // LIST_BLOCK
                if b < len(self.block_max[p]):
                    block_bound += self.block_max[p][b]
                    end = min((b + 1) * LIST_BLOCK, len(self.ids[p])) - 1
                    last = min(last, self.ids[p][end])
            if block_bound >= threshold - 1e-9:
                score = 0.0
                for _, at, p in cursors[: pivot + 1]:
                    at = bisect_left(self.ids[p], item, at)
                    if at < len(self.ids[p]) and self.ids[p][at] == item:
                        score += self.impacts[p][at]
                if score >= threshold - 1e-9:
                    hits.append((item, score))
                target = item + 1
            else:  # nothing before the end of these blocks, or before the next list begins, can reach it
                target = last + 1 if last < 1 << 62 else item + 1
                if pivot + 1 < len(cursors):
                    target = max(item + 1, min(target, cursors[pivot + 1][0]))
            left = []
            for own in cursors:
                if own[0] < target:
                    at = bisect_left(self.ids[own[2]], target, own[1])
                    if at == len(self.ids[own[2]]):
                        continue
                    own[0], own[1] = self.ids[own[2]][at], at
                left.append(own)
            cursors = left
        return hits


def passages(index: Index, doc: np.ndarray, place: np.ndarray, threshold: float) -> Iterator[tuple[int, int]]:
    """First and last term of the windows that can reach the threshold.

    Terms found in many parts can add ``index.common`` to a part at most, all together.
    The other terms' impacts are added up by stride and part, each term once a stride,
    and strides are added up to windows.
    """
    if not len(doc) or not index.item_of:
        return
    order = np.arange(len(doc)) - np.searchsorted(doc, doc)  # place in the document
    stride = np.cumsum(order % STRIDE == 0) - 1
    start = np.flatnonzero(order % STRIDE == 0)
    width = index.longest_part + STRIDE
    reach = -(-width // STRIDE)  # strides of a window
    own = np.flatnonzero(place >= 0)
    own = own[index.few[place[own]]]
    at, term = np.divmod(np.unique(stride[own] * len(index.vocabulary) + place[own]), len(index.vocabulary))
    group = max(CELLS // len(index.item_of), reach)
    for g in range(0, len(start), group):
        n = min(group, len(start) - g)
        a, b = np.searchsorted(at, [g, g + n + reach - 1])  # with the strides that the last windows reach into
        size = index.list_size[term[a:b]]
        entry = np.repeat(index.list_start[term[a:b]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        cells = np.repeat(at[a:b] - g, size) * len(index.item_of) + index.all_ids[entry]
        sums = np.bincount(cells, weights=index.all_impacts[entry], minlength=(n + reach - 1) * len(index.item_of)).reshape(-1, len(index.item_of))
        window = sums[:n].copy()
        for k in range(1, reach):  # strides of the next document only loosen the bound
            window += sums[k : k + n]
        for w in start[g : g + n][window.max(axis=1) + index.common >= threshold - 1e-9]:
            yield int(w), int(min(w + width, np.searchsorted(doc, doc[w], "right")))


def matches(index: Index, t: Texts, threshold: float, overlap: float) -> Iterator[tuple[int, int, float, float, float]]:
    """(row, item number, score, question share, answer share) of verified passages."""
    doc, term = terms_of(t)
    place = index.places(term)
    for a, b in passages(index, doc, place, threshold):
        own = np.unique(place[a:b])
        own = own[own >= 0]
        if not index.reached(own, threshold):
            continue
        hits = index.search(own.tolist(), threshold)
        if hits:
            first, last = np.searchsorted(doc, [doc[a], doc[a] + 1])
            around = term[max(a - index.longest, first) : min(b + index.longest, last)]
            for found, score in hits:
                item = index.item_of[found]
                shares = [share(part, around) for part in (index.question[item], index.answer[item])]
                if max(shares) >= overlap:
                    yield int(doc[a]), item, score, *shares


def share(part: set[bytes], terms: np.ndarray) -> float:
    """Share of the shingles of an item's half in the passage."""
    if not part:
        return 0.0
    size = len(next(iter(part))) // 8
    return len(part & {terms[i : i + size].tobytes() for i in range(len(terms) - size + 1)}) / len(part)


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    threshold: float = THRESHOLD,
    overlap: float = OVERLAP,
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """(key, item_key, score, question_overlap, answer_overlap): the best passage of each document and item."""
    terms = write_through(item_terms(items, item_key, item_text), "item-terms")
    totals = terms.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("item").alias("items")).first()
    df = write_through(terms.groupBy("term").agg(F.count_distinct("item").alias("df")), "item-df")
    blocks = max(1, -(-totals["n"] // block_terms))
    kinds = (docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString())
    found = None
    for b in range(blocks):
        own = terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        counted = {r["term"] % (1 << 64): r["df"] for r in df.join(own.select("term").distinct(), "term", "left_semi").toLocalIterator()}
        frame = own.toPandas().sort_values(["item", "position"], kind="stable")
        grouped = [(item, part["term"].to_numpy().view(np.uint64)) for item, part in frame.groupby("item", sort=True)]
        index = Index([i for i, _ in grouped], [x for _, x in grouped], counted, totals["items"], totals["n"] / max(totals["items"], 1))
        part = docs.select(key, text).mapInArrow(
            _task(index, threshold, overlap, key, item_key), f"`{key}` {kinds[0]}, `{item_key}` {kinds[1]}, score double, question_overlap double, answer_overlap double"
        )
        found = part if found is None else found.unionByName(part)
    best = F.max(F.struct(F.greatest("question_overlap", "answer_overlap"), "score", "question_overlap", "answer_overlap")).alias("best")
    return found.groupBy(key, item_key).agg(best).select(key, item_key, *(F.round(f"best.{c}", 6).alias(c) for c in ("score", "question_overlap", "answer_overlap")))


def _task(index: Index, threshold: float, overlap: float, key: str, item_key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in slices(batch.column(1)):
                rows = list(matches(index, t, threshold, overlap))
                if rows:
                    row, item, *shares = zip(*rows, strict=True)
                    keys = batch.column(0).take(pa.array(np.array(row) + t.row))
                    yield pa.RecordBatch.from_arrays(
                        [keys, pa.array([index.items[i] for i in item]), *(pa.array(s, pa.float64()) for s in shares)],
                        names=[key, item_key, "score", "question_overlap", "answer_overlap"],
                    )

    return run


@query("op10_benchmark_decontamination")
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
