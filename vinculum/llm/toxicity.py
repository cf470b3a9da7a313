"""Toxicity: factorisation machine over hashed terms.

Terms are runs of letters in lower case and their first bytes (inflected insults share
a stem). The factors learn which pairs of terms (an
insult with the mention of a group, say) matter together, beyond what each adds.

Defined cases: a text without terms, empty or null scores the model's bias; labels
that are null or contradict each other are not learned from; without labels of both
classes every score is 0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vinculum.llm import factorisation as fm
from vinculum.llm.common import RangeHash, Texts, fold_of, letter_runs, lower_ascii, table
from vinculum.llm.registry import query

PREFIXES = (4, 5, 6, 7, 8)


def features(t: Texts, _: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    start, end, doc, term = letter_runs(t)
    part = RangeHash(lower_ascii(t.data))
    docs, terms = [doc], [term]
    for size in PREFIXES:
        longer = np.flatnonzero(end - start > size)
        docs.append(doc[longer])
        terms.append(part(start[longer], start[longer] + size) ^ np.uint64(size))
    return np.concatenate(docs), np.concatenate(terms)


def toxicity_scores(docs: DataFrame, labels: DataFrame, per_class: int = fm.PER_CLASS) -> DataFrame:
    """``doc_id`` and ``score`` of every row, from the rows of ``labels`` given."""
    model = fm.train(docs, fm.labelled_sample(labels, "toxic", "doc_id", per_class), features, ["text"])
    return fm.score(docs, model, features, ["text"])


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(fold_of("doc_id", 5) != 0)
    return toxicity_scores(table(spark, sf_dir, "documents"), labels).select(
        "doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
