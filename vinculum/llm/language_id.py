"""Language ID: script ranges narrow the candidates, then Viterbi labels spans word by word.

A language's model is its counts of hashed byte trigrams (letters in lower case, words
set off by blanks), counted over all texts it may learn from. A word's score for a
language is the sum of its trigrams' log probabilities; languages never seen in the
word's script are ruled out. Viterbi then finds the labels of the words that maximise
the sum of scores less a penalty for each switch, and a text's language is the one
that labels most of its letters.

Viterbi runs over many texts at once: texts are sorted by their number of words, and
step k advances every text that has a k-th word.

Defined cases: a text that is null or has no letter (Unicode category L) is ``und`` with score 0; equal
shares go to the first language in alphabetical order; without any text to learn from
every text is ``und``; repeated rows each keep their row.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vinculum.llm.common import Texts, fold_of, lower_ascii, slices, table
from vinculum.llm.registry import query

BUCKETS = 1 << 15
SWITCH_PENALTY = 8.0
SLICE = 2 << 20
UNKNOWN = "und"

# First code point of each script range; a range ends where the next begins.
SCRIPTS = (
    (0x00, "other"),
    (0x41, "latin"),
    (0x5B, "other"),
    (0x61, "latin"),
    (0x7B, "other"),
    (0xAA, "latin"),
    (0xAB, "other"),
    (0xB5, "latin"),
    (0xB6, "other"),
    (0xBA, "latin"),
    (0xBB, "other"),
    (0xC0, "latin"),
    (0x2B0, "other"),
    (0x370, "greek"),
    (0x400, "cyrillic"),
    (0x530, "armenian"),
    (0x590, "hebrew"),
    (0x600, "arabic"),
    (0x900, "devanagari"),
    (0x980, "indic"),
    (0xE00, "thai"),
    (0xE80, "asian"),
    (0x10A0, "georgian"),
    (0x1100, "hangul"),
    (0x1200, "african"),
    (0x1780, "asian"),
    (0x1E00, "latin"),
    (0x1F00, "greek"),
    (0x2000, "other"),
    (0x3040, "kana"),
    (0x3100, "han"),
    (0xA000, "asian"),
    (0xAC00, "hangul"),
    (0xD7B0, "other"),
    (0xF900, "han"),
    (0xFB00, "other"),
    (0xFF21, "latin"),
    (0xFF3B, "other"),
    (0xFF66, "kana"),
    (0xFFA0, "other"),
    (0x20000, "han"),
    (0x32000, "other"),
)
SCRIPT_STARTS = np.array([start for start, _ in SCRIPTS])
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
SCRIPT_OF = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS], np.int8)


@cache
def letters() -> np.ndarray:
    """Whether a code point is a letter, by its Unicode category. Scripts only narrow the candidates."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


class Words:
    """Words of some texts: runs of letters, with their script, trigrams and letters."""

    def __init__(self, t: Texts):
        data = lower_ascii(t.data).astype(np.int64)
        head = np.flatnonzero((t.data & 0xC0) != 0x80)  # first byte of each code point
        wide = np.r_[data, 0, 0, 0]
        a, b, c, d = (wide[head + k] for k in range(4))
        point = np.where(
            a < 0x80, a, np.where(a < 0xE0, (a & 31) << 6 | b & 63, np.where(a < 0xF0, (a & 15) << 12 | (b & 63) << 6 | c & 63, (a & 7) << 18 | (b & 63) << 12 | (c & 63) << 6 | d & 63))
        )
        script = SCRIPT_OF[np.searchsorted(SCRIPT_STARTS, point, "right") - 1]
        text = np.searchsorted(t.offsets, head, "right") - 1
        letter = letters()[np.minimum(point, 0x10FFFF)]
        inner = np.zeros(len(head) + 2, bool)
        inner[1:-1] = letter
        new_text = np.r_[True, text[1:] != text[:-1]] if len(text) else np.zeros(0, bool)
        first = np.flatnonzero(letter & (~inner[:-2] | new_text))
        last = np.flatnonzero(letter & (~inner[2:] | np.r_[new_text[1:], True])) if len(head) else first
        self.text, self.script, self.letters = text[first], script[first], last - first + 1
        # Code points of the text before the word, for spans.
        self.start = first - np.searchsorted(head, t.offsets[:-1])[self.text] if len(first) else first
        # Bytes of letters, everything else a blank: a trigram stands for its middle byte.
        size = np.diff(np.r_[head, len(data)])
        shown = np.where(np.repeat(letter, size), data, 32)
        padded = np.r_[32, shown, 32]
        self.trigram = ((padded[:-2] << 16 | padded[1:-1] << 8 | padded[2:]) * 0x9E3779B1 >> 12) & (BUCKETS - 1)
        self.byte_start = head[first]
        self.byte_end = np.r_[head, len(data)][last + 1] if len(first) else first

    def __len__(self) -> int:
        return len(self.text)


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # trigram x language
    scripts: np.ndarray  # language x script: seen in training

    def word_scores(self, w: Words) -> np.ndarray:
        """Word x language; languages never seen in the word's script are far below the others."""
        out = np.empty((len(w), len(self.languages)), np.float32)
        for k in range(len(self.languages)):
            sums = np.r_[0.0, np.cumsum(self.log_p[:, k][w.trigram], dtype=np.float64)]
            out[:, k] = sums[w.byte_end] - sums[w.byte_start]
        allowed = self.scripts.T[w.script]
        return out - np.where(allowed | ~allowed.any(axis=1, keepdims=True), 0, 1e6).astype(np.float32)


def viterbi(scores: np.ndarray, first: np.ndarray, size: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every word; text i has ``size[i]`` words from ``first[i]`` on."""
    label = np.zeros(len(scores), np.int16)
    stay = np.ones(scores.shape, bool)  # whether the best path to (word, label) did not switch
    source = np.zeros(len(scores), np.int16)  # else the label it came from
    order = np.argsort(-size, kind="stable")
    size, first = size[order], first[order]
    if not len(size) or size[0] == 0:
        return label
    active = np.searchsorted(-size, -np.arange(size[0]), "left")  # texts with a k-th word
    best = scores[first[: active[0]]].copy()
    ends = np.zeros(len(size), np.int16)
    for k in range(1, size[0]):
        n = active[k]
        if n < len(best):
            ends[n : len(best)] = best[n:].argmax(axis=1)
            best = best[:n]
        at = first[:n] + k
        top = best.argmax(axis=1)
        moved = best[np.arange(n), top] - penalty
        keep = best >= moved[:, None]
        stay[at], source[at] = keep, top
        best = np.where(keep, best, moved[:, None]) + scores[at]
    ends[: len(best)] = best.argmax(axis=1)
    now = np.zeros(len(size), np.int16)
    for k in range(size[0] - 1, -1, -1):
        n = active[k]
        begins = size[:n] == k + 1
        now[:n][begins] = ends[:n][begins]
        at = first[:n] + k
        label[at] = now[:n]
        now[:n] = np.where(stay[at, now[:n]], now[:n], source[at])
    return label


def count_trigrams(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(kind, lang, item, n): trigram and script counts of each language, summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[str, str], np.ndarray] = {}
        for batch in batches:
            names = batch.column(1).to_pylist()
            known = sorted(set(names))
            code = np.array([known.index(n) for n in names])
            for t in slices(batch.column(0), SLICE):
                w = Words(t)
                own = code[t.row : t.row + len(t)]
                of_byte = np.repeat(own, np.diff(t.offsets))
                inside = np.zeros(len(t.data) + 1, np.int8)
                inside[w.byte_start] += 1
                inside[w.byte_end] -= 1
                inside = np.cumsum(inside[:-1]).astype(bool)
                for k, name in enumerate(known):
                    for kind, values, length in (("trigram", w.trigram[inside & (of_byte == k)], BUCKETS), ("script", w.script[own[w.text] == k], len(SCRIPT_NAMES))):
                        had = totals.setdefault((kind, name), np.zeros(length, np.int64))
                        had += np.bincount(values, minlength=length)
        for (kind, name), counts in totals.items():
            item = np.flatnonzero(counts)
            n = len(item)
            yield pa.RecordBatch.from_arrays([pa.array([kind] * n), pa.array([name] * n, pa.string()), pa.array(item), pa.array(counts[item])], names=["kind", "lang", "item", "n"])

    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(text, lang)
    return rows.mapInArrow(run, "kind string, lang string, item bigint, n bigint").groupBy("kind", "lang", "item").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """The counts of all ``docs`` with a language: at most BUCKETS rows a language reach the driver."""
    rows = count_trigrams(docs, text, lang).toPandas()
    languages = sorted(rows["lang"].unique())
    counts = np.zeros((BUCKETS, len(languages)))
    scripts = np.zeros((len(languages), len(SCRIPT_NAMES)), bool)
    code = rows["lang"].map({name: k for k, name in enumerate(languages)}).to_numpy(int)
    tri = (rows["kind"] == "trigram").to_numpy()
    counts[rows["item"].to_numpy()[tri], code[tri]] = rows["n"].to_numpy()[tri]
    scripts[code[~tri], rows["item"].to_numpy()[~tri]] = True
    return Model(languages, np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * BUCKETS)).astype(np.float32), scripts)


def label_spans(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", penalty: float = SWITCH_PENALTY) -> DataFrame:
    """``key``, ``lang_pred``, ``score`` (its share of the letters) and ``spans``: (lang, start, end) in code points."""
    struct = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    languages = model.languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, shares, spans = [], [], []
            for t in slices(batch.column(1), SLICE):
                n, w = len(t), Words(t)
                size = np.bincount(w.text, minlength=n)
                first = np.r_[0, np.cumsum(size)[:-1]]
                if not languages:
                    names, shares, spans = names + [UNKNOWN] * n, shares + [0.0] * n, spans + [[] for _ in range(n)]
                    continue
                label = viterbi(model.word_scores(w), first, size, penalty)
                letters = np.bincount(w.text * len(languages) + label, weights=w.letters, minlength=n * len(languages)).reshape(n, -1)
                top = letters.argmax(axis=1)
                share = np.round(letters[np.arange(n), top] / np.maximum(letters.sum(axis=1), 1), 6)
                cut = np.flatnonzero(np.r_[True, (w.text[1:] != w.text[:-1]) | (label[1:] != label[:-1])]) if len(w) else np.zeros(0, int)
                stop = np.r_[cut[1:], len(w)] - 1
                rows: list[list[dict]] = [[] for _ in range(n)]
                for doc, k, a, b in zip(w.text[cut], label[cut], w.start[cut], (w.start + w.letters)[stop] if len(w) else [], strict=True):
                    rows[doc].append({"lang": languages[k], "start": int(a), "end": int(b)})
                names += [languages[k] if s else UNKNOWN for k, s in zip(top, size, strict=True)]
                shares += share.tolist()
                spans += rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(shares, pa.float64()), pa.array(spans, struct)], names=[key, "lang_pred", "score", "spans"]
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double, spans array<struct<lang:string,start:bigint,end:bigint>>")


@query("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(fold_of("doc_id", 3) != 1))
    return label_spans(docs, model).select(
        "doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", F.size("spans").cast("bigint").alias("n_spans")
    )
