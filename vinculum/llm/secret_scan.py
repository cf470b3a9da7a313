"""Secret scans: fixed patterns, and sliding-window Shannon entropy of candidate strings.

A candidate is a maximal run of key characters of at least one window's length. A
window slides over it with counts that change by one character out and one in, so
its entropy costs constant time per step. The window's character class (hexadecimal,
or letters with digits) picks the threshold; windows of letters alone or of digits
alone are ordinary words and numbers and never count. Windows at or above their
threshold are merged into spans. Allow-listed runs (UUIDs, documented example keys,
alphabets) are suppressed; pattern spans always stay.

Each text is scanned whole, in its own row; nothing is shuffled. Defined cases: a
null text is empty and has no spans; repeated rows each keep their row; other
columns are ignored; a text of one very long run costs one pass.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vinculum.llm.common import slices, table, word_spans
from vinculum.llm.registry import query

Span = tuple[str, int, int]

KINDS = ("assign", "access", "hex", "entropy")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6

MASK = "<SECRET>"
WINDOW = 20
HEX_BITS = 3.0
MIXED_BITS = 3.6
CANDIDATE = re.compile(rf"[A-Za-z0-9+/=_-]{{{WINDOW},}}")
UUID = re.compile(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}")
ALLOWED = ("EXAMPLE", "abcdefghijklmnopqrst", "ABCDEFGHIJKLMNOPQRST", "0123456789abcdef", "0123456789ABCDEF")


def keyword_spans(text: str) -> list[Span]:
    lower = text.lower()
    if any(word in lower for word in KEYWORDS):
        return [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    return []


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each fixed pattern; code points, end exclusive."""
    access = [("access", *m.span()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    return keyword_spans(text) + access + [("hex", *m.span()) for m in HEX.finditer(text)]


def hot_windows(run: str, window: int = WINDOW, hex_bits: float = HEX_BITS, mixed_bits: float = MIXED_BITS) -> list[tuple[int, int]]:
    """Merged windows of ``run`` whose entropy reaches the threshold of their character class."""
    weight = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    total, digits, letters, outside = 0.0, 0, 0, 0  # outside: characters that are not hexadecimal
    spans: list[tuple[int, int]] = []
    for i, c in enumerate(run):
        for char, step in ((run[i - window] if i >= window else "", -1), (c, 1)):
            if char:
                had = counts.get(char, 0)
                counts[char] = had + step
                total += weight[had + step] - weight[had]
                digits += step * char.isdigit()
                letters += step * char.isalpha()
                outside += step * (char not in "0123456789abcdefABCDEF")
        if i >= window - 1 and digits and letters and math.log2(window) - total / window >= (mixed_bits if outside else hex_bits):
            if spans and i - window + 1 <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((i - window + 1, i + 1))
    return spans


def entropy_spans(text: str) -> list[Span]:
    spans = []
    for m in CANDIDATE.finditer(text):
        run = m.group()
        if run.isalpha() or run.isdigit() or UUID.fullmatch(run) or any(word in run for word in ALLOWED):
            continue
        spans += [("entropy", m.start() + a, m.start() + b) for a, b in hot_windows(run)]
    return spans


def in_order(spans: list[Span], kinds: tuple[str, ...] = KINDS) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(written(spans).encode()).hexdigest()


def scan(column: pa.Array) -> Iterator[tuple[list[Span], list[Span]]]:
    """Base and added spans of each text, in order.

    Only texts with a word of a window's length can hold a hexadecimal key or a
    candidate, as neither contains blanks; the others need the keyword patterns only.
    """
    for t in slices(column):
        start, end, doc = word_spans(t)
        long = np.zeros(len(t), bool)
        long[doc[end - start >= WINDOW]] = True
        values = column.slice(t.row, len(t)).to_pylist()
        for text, has_long in zip(values, long, strict=True):
            text = text or ""
            base = in_order(base_spans(text) if has_long else keyword_spans(text))
            yield base, entropy_spans(text) if has_long else []


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The row's key and its spans: array of (kind, start, end, base), ordered by start, then kind."""

    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b, "base": k != "entropy"} for k, a, b in in_order(base + added)] for base, added in scan(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, struct)], names=[key, "spans"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")


def redact(docs: DataFrame, text: str = "text", mask: str = MASK) -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mask``; spans that overlap are one."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, (base, added) in zip(batch.column(at).to_pylist(), scan(batch.column(at)), strict=True):
                parts, end = [], 0
                for _, a, b in in_order(base + added):
                    if a >= end:
                        parts += [value[end:a], mask]
                    end = max(end, b)
                out.append("".join([*parts, value[end:]]) if parts else value)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def span_text(spans: str, only: str | None = None):
    """kind:start:end of the spans, comma-joined; ``only`` names a boolean field to filter by."""
    kept = F.filter(spans, lambda s: s[only]) if only else F.col(spans)
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: str, kind: str):
    return F.size(F.filter(spans, lambda s: (s["kind"] == kind) & s["base"])).cast("bigint").alias(f"n_{kind}")


@query("op2_secret_scans")
def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *(counted("spans", kind) for kind in KINDS[:3]),
        F.sha2(span_text("spans", "base"), 256).alias("base_sha256"),
        span_text("spans").alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["base"])).cast("bigint").alias("n_entropy"),
    )
