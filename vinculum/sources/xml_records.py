"""Records of large XML files, found by element whatever lies inside or around them.

A file is read by many tasks, each a stream of pieces that end with a closing record tag.
Where a task begins it cannot know whether it is inside a comment, a CDATA section, or a
record and its nested list. So there are two passes. In the first each task follows all
states it may have begun in at once (those of one lexical state share the scan, and they soon
agree); its result is a function from its first to its last state. The functions, one per
file range, are composed in order. In the second pass each task knows its first state and
gives its records; a record that runs over the end of a range comes in fragments, which are
joined by the range it began in.

A record is an element that is not inside a ``nested_in`` element of another. A record whose
closing tag is missing ends, as lost, where the next one begins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Lexical states, and what ends each.
TEXT, COMMENT, CDATA, INSTRUCTION = range(4)
ENDS = {COMMENT: "-->", CDATA: "]]>", INSTRUCTION: "?>"}
BEGINS = {"<!--": COMMENT, "<![CDATA[": CDATA, "<?": INSTRUCTION}

# States of a record: outside, inside, and inside its nested list below 0, 1, .. open elements of its own name.
OUTSIDE, INSIDE, LIST = 0, 1, 2
DEEPEST = 7
STATES = LIST + DEEPEST + 1
OPEN, CLOSE, OPEN_LIST, CLOSE_LIST = range(4)


def step(state: int, event: int) -> int:
    if event == OPEN:
        return min(state + 1, STATES - 1) if state >= LIST else INSIDE
    if event == CLOSE:
        # More closing tags than the list has opening ones: the record's own, though its list is open.
        return state - 1 if state > LIST else OUTSIDE
    if event == OPEN_LIST:
        return LIST if state == INSIDE else state
    return INSIDE if state >= LIST else state


class Scanner:
    """Events of a stream of text: positions of record and list tags outside comments, CDATA and instructions."""

    def __init__(self, row_tag: str, nested_in: str):
        self.row_tag = row_tag
        self.token = re.compile(rf"""<(?:!--|!\[CDATA\[|\?|(/?)({re.escape(row_tag)}|{re.escape(nested_in)})(?=[\s/>])((?:[^>"']|"[^"]*"|'[^']*')*)>)""")

    def __call__(self, piece: str, lexical: int) -> tuple[list[tuple[int, int, int]], int]:
        """[(event, start, end)], lexical state behind the piece."""
        events, at = [], 0
        while True:
            if lexical != TEXT:
                at = piece.find(ENDS[lexical], at)
                if at < 0:
                    return events, lexical
                at, lexical = at + len(ENDS[lexical]), TEXT
            found = self.token.search(piece, at)
            if not found:
                return events, lexical
            at = found.end()
            if found[2] is None:
                lexical = BEGINS[found[0]]
                continue
            kinds = (OPEN, CLOSE) if found[2] == self.row_tag else (OPEN_LIST, CLOSE_LIST)
            events.append((kinds[bool(found[1])], found.start(), at))
            if not found[1] and found[3].endswith("/"):
                events.append((kinds[1], found.start(), at))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """The pieces of each file range in the order of the file."""
    rows = ((f, b, v) for batch in batches for f, b, v in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value")), strict=True))
    held = next(rows, None)
    while held is not None:
        own = held[:2]

        def pieces() -> Iterator[str]:
            nonlocal held
            while held is not None and held[:2] == own:  # noqa: B023
                value, held = held[2], next(rows, None)
                yield value

        yield own, pieces()


def _summaries(scanner: Scanner, close: str):
    """For each range and first lexical state: the last one, and the last record state for each first one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block), pieces in _ranges(batches):
            lexical = list(range(4))
            states = [list(range(STATES)) for _ in range(4)]
            for piece in pieces:
                for now in set(lexical):
                    events, then = scanner(piece + close, now)
                    for first in [i for i in range(4) if lexical[i] == now]:
                        lexical[first] = -1 - then  # not taken for a state before this piece is done
                        for event, _, _ in events:
                            moved = {s: step(s, event) for s in set(states[first])}
                            states[first] = [moved[s] for s in states[first]]
                lexical = [-1 - x for x in lexical]
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([lexical], pa.list_(pa.int32())), pa.array([states], pa.list_(pa.list_(pa.int32())))], names=["file", "block", "lexical", "states"])

    return run


def _first_states(summaries: list) -> tuple[dict[tuple[str, int], tuple[int, int]], bool]:
    """(lexical state, record state) at the start of every range, and whether a record is open at the end of any."""
    out, last_file, runs_over = {}, None, False
    lexical = state = 0
    for row in sorted(summaries, key=lambda r: (r["file"], r["block"])):
        if row["file"] != last_file:
            last_file, lexical, state = row["file"], TEXT, OUTSIDE
        out[row["file"], row["block"]] = (lexical, state)
        lexical, state = row["lexical"][lexical], row["states"][lexical][state]
        runs_over = runs_over or state != OUTSIDE
    return out, runs_over


RECORDS = "file string, block bigint, text string, lost boolean, begun boolean, open boolean"


def _records(scanner: Scanner, close: str, first: dict[tuple[str, int], tuple[int, int]], fragments: bool):
    """The whole records of a range, or its fragments. ``begun``: it began in an earlier range; ``open``: it goes on in the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block), pieces in _ranges(batches):
            lexical, state = first[file, block]
            begun, parts = state != OUTSIDE, []
            out: list[tuple[str, bool, bool, bool]] = []

            def give(lost: bool, open_: bool) -> None:
                nonlocal begun, parts
                if (begun or open_) == fragments:
                    out.append(("".join(parts), lost, begun, open_))  # noqa: B023
                begun, parts = False, []

            for piece in pieces:
                piece += close
                events, lexical = scanner(piece, lexical)
                at = 0
                for event, start, end in events:
                    was, state = state, step(state, event)
                    if event == OPEN and was in (OUTSIDE, INSIDE):
                        if was == INSIDE:
                            parts.append(piece[at:start])
                            give(True, False)
                        at = start
                    elif was != OUTSIDE and state == OUTSIDE:
                        parts.append(piece[at:end])
                        give(False, False)
                        at = end
                if state != OUTSIDE:
                    parts.append(piece[at:])
                if len(out) >= 256:
                    yield _batch(file, block, out)
                    out = []
            if state != OUTSIDE:
                give(False, True)
            if out:
                yield _batch(file, block, out)

    return run


def _batch(file: str, block: int, rows: list[tuple[str, bool, bool, bool]]) -> pa.RecordBatch:
    text, lost, begun, open_ = (list(c) for c in zip(*rows, strict=True))
    columns = [pa.array([file] * len(rows)), pa.array([block] * len(rows), pa.int64()), pa.array(text), pa.array(lost), pa.array(begun), pa.array(open_)]
    return pa.RecordBatch.from_arrays(columns, names=["file", "block", "text", "lost", "begun", "open"])


def xml_records(spark: SparkSession, path: str, row_tag: str, nested_in: str) -> DataFrame:
    """(file, text, lost): the text of every ``row_tag`` record; lost ones have no closing tag of their own.

    The closing tag that Spark cuts away is put back behind every piece, so text that ends a file
    without one is a record if it is well-formed with it.
    """
    close = f"</{row_tag}>"
    pieces = spark.read.option("lineSep", close).text(path)
    pieces = pieces.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    scanner = Scanner(row_tag, nested_in)
    found = pieces.mapInArrow(_summaries(scanner, close), "file string, block bigint, lexical array<int>, states array<array<int>>")
    first, runs_over = _first_states(found.collect())  # a few numbers for each range of the files
    whole = pieces.mapInArrow(_records(scanner, close, first, False), RECORDS).select("file", "text", "lost")
    if not runs_over:
        return whole
    parts = pieces.mapInArrow(_records(scanner, close, first, True), RECORDS)
    order = Window.partitionBy("file").orderBy("block", F.desc("begun"))  # two fragments for each range of a file at most
    chained = parts.withColumn("chain", F.sum(F.when(F.col("begun"), 0).otherwise(1)).over(order))
    joined = chained.groupBy("file", "chain").agg(F.array_sort(F.collect_list(F.struct("block", "text", "lost", "open"))).alias("p"))
    end = F.element_at("p", -1)
    text = F.array_join(F.transform("p", lambda x: x["text"]), "")
    return whole.unionByName(joined.select("file", text.alias("text"), (end["lost"] | end["open"]).alias("lost")))
