"""PII: identifiers in the text as written, and in a deobfuscated copy whose offsets are kept.

The copy is a ``Tape``: characters, each with the span of source characters it came
from. Transducers rewrite a tape and keep the spans: look-alike letters and foreign
or full-width digits become ASCII, zero-width characters go, runs of spelled digits
become digits, and at/dot disguises become ``@`` and ``.``. The detectors then run on
the tape and what they find is mapped back to source characters. Spans found in the
text as written always stay; a span from the tape is added unless one found before
covers it.

A text is rewritten only if one of the transducers has something to rewrite in it,
which a pass over its bytes decides. Each text is read whole, in its own row.
Defined cases: a null text is empty; repeated rows each keep their row; other columns
are ignored; very long runs of digits or of address characters cost one pass.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vinculum.llm.common import RangeHash, Texts, letter_runs, lower_ascii, slices, table
from vinculum.llm.registry import query
from vinculum.llm.secret_scan import Span, counted, in_order, span_text

KINDS = ("email", "ip", "card", "phone")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
# A match can only begin where a run of digits begins, so the look-behind changes no match.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# Letters that look like Latin ones, each followed by its Latin letter.
LOOK_ALIKES = (
    "аa еe оo рp сc уy хx іi јj ѕs һh ԁd ԛq ԝw АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ІI ЈJ ЅS "
    "αa οo νv ρp ιi κk υu ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ıi ɡg ℓl"
)
HOMOGLYPHS = {ord(pair[0]): pair[1] for pair in LOOK_ALIKES.split()}
# Ten digit names per language, zero first; then other names of zero.
DIGIT_NAMES = (
    "zero one two three four five six seven eight nine",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
DIGITS = {name: str(i) for names in DIGIT_NAMES for i, name in enumerate(names.split())} | {"oh": "0", "zwo": "2", "ein": "1"}
PLUS_NAMES = ("plus", "más")
LEAST_SPELLED = 4  # so many digit names in a row are read as digits
PHONE_DIGITS = (7, 15)  # a run of spelled digits of this length is a phone number by itself
AT_NAMES = ("at", "arroba", "arobase", "ät")
DOT_NAMES = ("dot", "punkt", "point", "punto")
TOP_DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|io|co|ai|app|dev|example|test|invalid|eu|de|fr|es|uk|us|ch|at|it|nl|be|pt|mx|ar|ca|au|in|jp|cn|ru|br"

_NAME = "|".join(sorted(DIGITS, key=len, reverse=True))
SPELLED = re.compile(rf"(?<!\w)(?:(?:{'|'.join(PLUS_NAMES)})[\s-]+)?(?:{_NAME})(?:[\s,.-]{{1,3}}(?:{_NAME})){{{LEAST_SPELLED - 1},}}(?!\w)", re.IGNORECASE)
SPELLED_WORD = re.compile(r"[^\W\d_]+")
_AT = "|".join(AT_NAMES)
_DOT = "|".join(DOT_NAMES)
BRACKETED = re.compile(rf"\s{{0,3}}(?:[\[({{<]\s{{0,3}}(?:(?P<at>{_AT}|@|a)|(?P<dot>{_DOT}|\.))\s{{0,3}}[\])}}>])\s{{0,3}}", re.IGNORECASE)
_LABEL = r"[A-Za-z0-9][A-Za-z0-9_%+-]*"
SPELLED_ADDRESS = re.compile(
    rf"(?<![\w.%+-]){_LABEL}(?:(?:\.|\s{{1,3}}(?:{_DOT})\s{{1,3}}){_LABEL})*(?P<at>\s{{1,3}}(?:{_AT})\s{{1,3}}|\s{{0,3}}@\s{{0,3}})"
    rf"[A-Za-z0-9-]+(?:(?:\.|\s{{1,3}}(?:{_DOT})\s{{1,3}})[A-Za-z0-9-]+)*?(?:\.|\s{{1,3}}(?:{_DOT})\s{{1,3}})(?:{TOP_DOMAINS})(?![\w-])",
    re.IGNORECASE,
)
JOINTS = re.compile(rf"\s{{1,3}}(?:(?P<at>{_AT})|(?P<dot>{_DOT}))\s{{1,3}}|\s{{0,3}}(?P<sign>@)\s{{0,3}}", re.IGNORECASE)
AT_DOMAIN = re.compile(rf"(?<=\s)(?:{_AT})\s+[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", re.IGNORECASE)
ODD = re.compile("[" + "".join(map(chr, HOMOGLYPHS)) + "​-‍⁠﻿­٠-٩۰-۹०-९！-～]")
_ALNUM = np.array([chr(i).isalnum() and i < 128 for i in range(256)])
ZERO_WIDTH = frozenset("​‌‍⁠﻿­")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def octet(part: str) -> bool:
    value = part.lstrip("0")
    return len(value) <= 3 and int(value or 0) <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain, found from the ``@`` outwards."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and not NOT_LOCAL.match(text, start - 1):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
        free = max(free, at + 1)  # an earlier run never reaches over an @
        at = text.find("@", free)


def detect(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass their test; code points."""
    spans: list[Span] = []
    if "@" in text:
        spans += [("email", a, b) for a, b in emails(text)]
    if not DIGIT.search(text):
        return spans
    if "." in text:
        spans += [("ip", *m.span()) for m in IP.finditer(text) if all(octet(p) for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    if "+" in text:
        spans += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return spans


class Tape:
    """Characters with the source span of each: ``start[i]`` to ``end[i]``, end exclusive."""

    def __init__(self, text: str, start: list[int] | None = None, end: list[int] | None = None):
        self.text = text
        self.start = list(range(len(text))) if start is None else start
        self.end = list(range(1, len(text) + 1)) if end is None else end

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.start[a], self.end[b - 1]

    def rewrite(self, pattern: re.Pattern, put: Callable[[re.Match], list[tuple[int, int, str]]]) -> Tape:
        """Replace parts of each match: ``put`` lists (start, end, characters) on this tape."""
        text, start, end, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            for a, b, chars in put(m):
                text += [self.text[at:a], chars]
                start += self.start[at:a] + [self.start[a]] * len(chars)
                end += self.end[at:a] + [self.end[b - 1]] * len(chars)
                at = b
        if not at:
            return self
        text.append(self.text[at:])
        return Tape("".join(text), start + self.start[at:], end + self.end[at:])


def plain_char(m: re.Match) -> list[tuple[int, int, str]]:
    c = m.group()
    if c in ZERO_WIDTH:
        return [(*m.span(), "")]
    return [(*m.span(), HOMOGLYPHS.get(ord(c)) or unicodedata.normalize("NFKC", c) if not c.isdigit() else str(unicodedata.digit(c)))]


def spelled_digits(m: re.Match) -> list[tuple[int, int, str]]:
    parts, last = [], m.start()
    for w in SPELLED_WORD.finditer(m.string, m.start(), m.end()):
        if w.start() > last:
            parts.append((last, w.start(), ""))
        parts.append((*w.span(), DIGITS.get(w.group().lower(), "+")))
        last = w.end()
    return parts


def bracketed(m: re.Match) -> list[tuple[int, int, str]]:
    return [(*m.span(), "@" if m["at"] else ".")]


def address(m: re.Match) -> list[tuple[int, int, str]]:
    return [(*j.span(), "." if j["dot"] else "@") for j in JOINTS.finditer(m.string, m.start(), m.end())]


TRANSDUCERS = ((ODD, plain_char), (SPELLED, spelled_digits), (BRACKETED, bracketed), (SPELLED_ADDRESS, address))


def deobfuscated(text: str) -> Tape:
    tape = Tape(text)
    for pattern, put in TRANSDUCERS:
        tape = tape.rewrite(pattern, put)
    return tape


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """Spans of the deobfuscated text, on source characters, that no other span covers."""
    tape = deobfuscated(text)
    if tape.text == text:
        return []
    found = [(kind, *tape.source(a, b)) for kind, a, b in detect(tape.text)]
    for m in SPELLED.finditer(text):
        n = sum(w.group().lower() in DIGITS for w in SPELLED_WORD.finditer(m.group()))
        if PHONE_DIGITS[0] <= n <= PHONE_DIGITS[1]:
            found.append(("phone", *m.span()))
    spans: list[Span] = []
    for span in in_order(found, KINDS):
        if not any(c <= span[1] and span[2] <= d for _, c, d in base + spans):
            spans.append(span)
    return spans


def _hashes(words) -> np.ndarray:
    out = []
    for word in sorted(words):
        for form in {word, word.upper(), word.capitalize()}:
            data = lower_ascii(np.frombuffer(form.encode(), np.uint8))
            out.append(RangeHash(data)(np.array([0]), np.array([len(data)]))[0])
    return np.unique(np.array(out, np.uint64))


def suspects(t: Texts, digit_names: np.ndarray, dot_names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in which spelled digits follow each other or a dot is spelled out; rows with a dot inside a word."""
    out, dotted = np.zeros(len(t), bool), np.zeros(len(t), bool)
    if not len(t.data):
        return out, dotted
    start, end, doc, value = letter_runs(t)
    named = np.isin(value, digit_names)
    run = named.copy()
    for k in range(1, LEAST_SPELLED):
        near = np.zeros(len(named), bool)
        near[:-k] = named[k:] & (doc[k:] == doc[:-k])
        run &= near
    out[doc[run]] = True
    out[doc[np.isin(value, dot_names)]] = True
    alnum = np.zeros(len(t.data) + 2, bool)
    alnum[1:-1] = _ALNUM[t.data]
    inner = np.flatnonzero((t.data == ord(".")) & alnum[:-2] & alnum[2:])
    dotted[np.searchsorted(t.offsets, inner, "right") - 1] = True
    return out, dotted


def disguised(text: str, dotted: bool) -> bool:
    """Whether brackets, look-alikes, or an at before a known domain call for a rewrite."""
    return (
        bool(not text.isascii() and ODD.search(text))
        or (("@" in text or "(" in text or "[" in text or "{" in text or "<" in text) and bool(BRACKETED.search(text)))
        or (" @" in text or "@ " in text)
        or (dotted and bool(AT_DOMAIN.search(text)))
    )


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The row's key and its spans: array of (kind, start, end, base), ordered by start, then kind."""
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digit_names, dot_names = _hashes(DIGITS), _hashes(DOT_NAMES)
        for batch in batches:
            found = []
            for t in slices(batch.column(1)):
                values = batch.column(1).slice(t.row, len(t)).to_pylist()
                for value, flag, dotted in zip(values, *suspects(t, digit_names, dot_names), strict=True):
                    value = value or ""
                    base = detect(value)
                    added = added_spans(value, base) if flag or disguised(value, dotted) else []
                    rows = [{"kind": k, "start": a, "end": b, "base": True} for k, a, b in base]
                    rows += [{"kind": k, "start": a, "end": b, "base": False} for k, a, b in added]
                    found.append(sorted(rows, key=lambda r: (r["start"], KINDS.index(r["kind"]), r["end"])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, struct)], names=[key, "spans"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")


@query("op6_pii")
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *(counted("spans", kind) for kind in KINDS),
        F.sha2(span_text("spans", "base"), 256).alias("base_sha256"),
        span_text("spans").alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["base"])).cast("bigint").alias("n_added"),
    )
