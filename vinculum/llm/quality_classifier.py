"""Quality classifier: factorisation machine over hashed words, structure statistics and metadata.

Defined cases: an empty or null text has no words and is scored from its structure
bins alone; a null ``n_chars`` is a bin of its own; labels that are null or contradict
each other are not learned from; without labels of both classes every score is 0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vinculum.llm import factorisation as fm
from vinculum.llm.common import RangeHash, Texts, fold_of, lower_ascii, mix, table, word_spans
from vinculum.llm.registry import query

BINS = 16
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>!@^~=_+{}[]\\/", np.uint8))


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(flags)][offsets])


def features(t: Texts, n_chars: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Words in lower case, and the bin of each structure statistic and of ``n_chars``."""
    n, data, lower = len(t), t.data, lower_ascii(t.data)
    start, end, doc = word_spans(t)
    word = RangeHash(lower)(start, end)
    words = np.maximum(np.bincount(doc, minlength=n), 1)
    size = np.maximum(np.diff(t.offsets), 1)
    same = np.r_[False, (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])] if len(word) else np.zeros(0, bool)
    distinct = np.bincount(fm.distinct_pairs(doc, word)[0], minlength=n)
    letters = np.maximum(_per_row((lower >= 97) & (lower <= 122), t.offsets), 1)
    shares = [
        _per_row(lower != data, t.offsets) / letters,
        _per_row(SYMBOLS[data], t.offsets) / size * 2,
        _per_row((data >= 48) & (data <= 57), t.offsets) / size * 4,
        _per_row(data == 10, t.offsets) / words,
        _per_row(data >= 128, t.offsets) / size,
        np.bincount(doc, weights=same, minlength=n) / words,
        distinct / words,
        np.bincount(doc, weights=end - start, minlength=n) / words / 24,
        np.log2(words) / 20,
    ]
    if n_chars is not None:
        shares.append(np.where(n_chars < 0, 1.0, np.log2(np.maximum(n_chars, 0) + 1) / 32))
    bins = [np.uint64(k * BINS) + np.minimum(np.floor(s * BINS), BINS - 1).astype(np.uint64) for k, s in enumerate(shares)]
    return np.r_[doc, np.tile(np.arange(n), len(bins))], np.r_[word, mix(np.concatenate(bins) + np.uint64(1))]


def quality_scores(docs: DataFrame, labels: DataFrame, per_class: int = fm.PER_CLASS) -> DataFrame:
    """``doc_id`` and ``score`` of every row, from the rows of ``labels`` given."""
    sample = fm.labelled_sample(labels, "quality", "doc_id", per_class)
    model = fm.train(docs, sample, features, ["text", "n_chars"])
    return fm.score(docs, model, features, ["text", "n_chars"])


@query("op5_quality_classifier")
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(fold_of("doc_id", 3) != 1)
    return quality_scores(table(spark, sf_dir, "documents"), labels).select(
        "doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
