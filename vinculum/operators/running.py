"""The running best of each query while a task reads its documents."""

from __future__ import annotations

import numpy as np

SCALE = 1_000_000.0


class Best:
    """The running best ``k`` and the worst one of each query, for one collection; ties go to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.bar = k, np.full(n, -np.inf)
        self.row, self.score, self.ids = np.zeros(0, "int64"), np.zeros(0), np.zeros(0, object)
        self.low, self.low_id = np.full(n, np.inf), np.full(n, None, object)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        """``score`` is queries x documents, minus infinity where a document is no candidate."""
        seen = np.where(np.isneginf(score), np.inf, score)
        worst = seen.argmin(axis=1)
        low = seen[np.arange(len(seen)), worst]
        less = low < self.low
        self.low[less], self.low_id[less] = low[less], ids[worst[less]]
        n = score.shape[1]
        bar = self.bar if n <= self.k else np.maximum(self.bar, np.partition(score, n - self.k, axis=1)[:, n - self.k])
        row, column = np.nonzero((score >= bar[:, None]) & ~np.isneginf(score))
        row, value, own = np.r_[self.row, row], np.r_[self.score, score[row, column]], np.r_[self.ids, ids[column].astype(object)]
        order = np.lexsort((np.unique(own, return_inverse=True)[1], -value, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = order[place < self.k]
        self.row, self.score, self.ids = row[place < self.k], value[kept], own[kept]
        full = place == self.k - 1
        self.bar[row[full]] = value[order[full]]
