"""Factorisation machine over hashed features: training on a bounded sample, scoring of every text.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2))

The last sum is every pairwise product <v_i, v_j> x_i x_j in time linear in the
features of a text; x_i is 1 for a feature the text has. Features are 64-bit hashes.
Those whose share of texts differs between the classes by ``LEAST_Z`` standard errors
form the model's sorted vocabulary: distinct terms do not collide, and terms that say
nothing are not there to be learned by heart.

Only the sample (``PER_CLASS`` labelled rows of each class, lowest hashes of the id)
reaches the driver, as features; the model is a few megabytes at most. Every text is
then scored whole inside its own row, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinculum.llm.common import Texts, slices

PER_CLASS = 3_000  # labelled rows of each class the model is fitted on, at most
TERMS_PER_ROW = 4_096  # distinct features of one sampled text used in fitting, lowest hashes first
LEAST_DOCS = 4
LEAST_Z = 3.3  # a feature's share of texts must differ so many standard errors between the classes
VOCABULARY = 50_000  # features of the model at most, those that differ most
FACTORS = 4
EPOCHS = 8
BATCH = 64
RATE = 0.05
DECAY = 1e-5
SEED = 7
FILTER_MASK = np.uint64((1 << 20) - 1)

#: document number and 64-bit feature of every feature occurrence of some texts
Features = Callable[[Texts, np.ndarray | None], tuple[np.ndarray, np.ndarray]]


def distinct_pairs(doc: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature) pairs, by document."""
    order = np.lexsort((feature, doc))
    doc, feature = doc[order], feature[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (feature[1:] != feature[:-1])
    return doc[keep], feature[keep]


def _by_row(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Sum of the values of each row; ``row`` ascends."""
    out = np.zeros((n, *values.shape[1:]))
    if len(row):
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        out[row[first]] = np.add.reduceat(values, first, axis=0)
    return out


@dataclass
class Model:
    vocabulary: np.ndarray  # sorted hashes
    linear: np.ndarray
    factors: np.ndarray
    bias: float

    def __post_init__(self):
        self.filter = np.zeros(int(FILTER_MASK) + 1, bool)
        self.filter[self.vocabulary & FILTER_MASK] = True

    def known(self, doc: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of document and vocabulary index."""
        if not len(self.vocabulary) or not len(feature):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        likely = np.flatnonzero(self.filter[feature & FILTER_MASK])  # most features are in no vocabulary
        doc, feature = doc[likely], feature[likely]
        at = np.minimum(np.searchsorted(self.vocabulary, feature), len(self.vocabulary) - 1)
        own = self.vocabulary[at] == feature
        pairs = np.unique(doc[own].astype(np.int64) * len(self.vocabulary) + at[own])
        return np.divmod(pairs, len(self.vocabulary))

    def margin(self, row: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
        vx = self.factors[index]  # every x_i is 1
        return self.bias + _by_row(self.linear[index], row, n) + 0.5 * (_by_row(vx, row, n) ** 2 - _by_row(vx * vx, row, n)).sum(axis=1)

    def scores(self, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        return sigmoid(self.margin(*self.known(doc, feature), n))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: list[np.ndarray], labels: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS) -> Model:
    """Fit by AdaGrad on the distinct features of each row. Without both classes the model says 0 everywhere."""
    n = len(rows)
    if n == 0 or labels.min() == labels.max():
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros((0, factors)), -30.0)
    found, df = np.unique(np.concatenate(rows), return_counts=True)  # a row's features are distinct
    positive = np.zeros(len(found))
    own = np.unique(np.concatenate([np.zeros(0, np.uint64), *(r for r, y in zip(rows, labels, strict=True) if y == 1)]), return_counts=True)
    positive[np.searchsorted(found, own[0])] = own[1]
    n1 = int(labels.sum())
    rate = df / n
    z = np.abs(positive / n1 - (df - positive) / (n - n1)) / np.sqrt(np.maximum(rate * (1 - rate), 1e-12) * (1 / n1 + 1 / (n - n1)))
    often = np.flatnonzero((df >= min(LEAST_DOCS, n)) & (z >= LEAST_Z))
    often = np.sort(often[np.argsort(-z[often], kind="stable")[:VOCABULARY]])
    vocabulary = found[often]
    rng = np.random.default_rng(SEED)
    m = Model(vocabulary, np.zeros(len(often)), rng.normal(0, 0.01, (len(often), factors)), 0.0)
    doc, index = m.known(np.repeat(np.arange(n), [len(r) for r in rows]), np.concatenate(rows))
    first = np.searchsorted(doc, np.arange(n + 1))
    seen_w, seen_v = np.full(len(often), 1e-8), np.full((len(often), factors), 1e-8)
    balance = np.where(labels == 1, n / (2 * labels.sum()), n / (2 * (n - labels.sum())))
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            own = order[at : at + BATCH]
            size = first[own + 1] - first[own]
            row = np.repeat(np.arange(len(own)), size)
            entry = index[np.repeat(first[own] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())]
            vx = m.factors[entry]
            sums = _by_row(vx, row, len(own))
            p = sigmoid(m.bias + _by_row(m.linear[entry], row, len(own)) + 0.5 * (sums**2 - _by_row(vx * vx, row, len(own))).sum(axis=1))
            g = (p - labels[own]) * balance[own] / len(own)
            m.bias -= RATE * g.sum()
            grads = np.column_stack([g[row], g[row][:, None] * (sums[row] - vx)])
            by = np.argsort(entry, kind="stable")
            feature, place = np.unique(entry[by], return_inverse=True)
            grads = _by_row(grads[by], place, len(feature))
            gw, gv = grads[:, 0] + DECAY * m.linear[feature], grads[:, 1:] + DECAY * m.factors[feature]
            seen_w[feature] += gw**2
            seen_v[feature] += gv**2
            m.linear[feature] -= RATE * gw / np.sqrt(seen_w[feature])
            m.factors[feature] -= 0.1 * RATE * gv / np.sqrt(seen_v[feature])
    return m


def labelled_sample(labels: DataFrame, label: str, key: str, rows: int) -> DataFrame:
    """``rows`` ids of each class at most, by the hash of the id; ids labelled both ways are left out."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.min(label).alias("label"), F.max(label).alias("_max"))
    known = known.where(F.col("label") == F.col("_max")).select(key, "label")
    by_hash = [F.xxhash64(key), F.col(key)]
    parts = [known.where(F.col("label") == c).orderBy(*by_hash).limit(rows) for c in (0, 1)]
    return parts[0].unionByName(parts[1])


def train(docs: DataFrame, sample: DataFrame, features: Features, columns: list[str], key: str = "doc_id") -> Model:
    """Fit on the texts of ``sample`` (key, label), which is bounded and so joined as a broadcast.

    ``columns`` are the text column and, if used, one numeric column of metadata.
    """
    picked = docs.select(key, *columns).join(F.broadcast(sample), key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            for t in slices(batch.column(1)):
                doc, feature = distinct_pairs(*features(t, _extra(batch, t, len(columns))))
                cuts = np.searchsorted(doc, np.arange(len(t) + 1))
                out += [feature[a : min(b, a + TERMS_PER_ROW)].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(batch.num_columns - 1), pa.array(out, pa.binary())], names=["key", "label", "features"])

    kind = docs.schema[key].dataType.simpleString()
    rows = sorted(picked.mapInArrow(run, f"key {kind}, label int, features binary").collect())
    return fit([np.frombuffer(r.features, np.uint64) for r in rows], np.array([r.label for r in rows]))


def _extra(batch: pa.RecordBatch, t: Texts, columns: int) -> np.ndarray | None:
    if columns < 2:
        return None
    return np.asarray(batch.column(2).slice(t.row, len(t)).cast(pa.float64()).fill_null(-1.0))


def score(docs: DataFrame, model: Model, features: Features, columns: list[str], key: str = "doc_id") -> DataFrame:
    """``key`` and ``score`` (rounded to six decimals) of every row; repeated rows each keep their row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.scores(*features(t, _extra(batch, t, len(columns))), len(t)) for t in slices(batch.column(1))]
            out = np.round(np.concatenate(parts), 6) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=[key, "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, *columns).mapInArrow(run, f"`{key}` {kind}, score double")
