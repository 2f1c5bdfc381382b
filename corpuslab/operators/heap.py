"""The best of many scores."""

from __future__ import annotations

import numpy as np
import pandas as pd


class Heap:
    """The k best of all vectors seen so far for each query, ties to the smaller id; a bounded matrix, however many come."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, np.full((n, 0), 0.0), np.empty((n, 0), object)

    def add(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        """``scores`` of vectors ``ids`` for the queries ``rows``."""
        if not len(ids) or not scores.shape[0]:
            return
        by_id = np.argsort(ids, kind="stable")
        best = by_id[np.argsort(-scores[:, by_id], axis=1, kind="stable")[:, : self.k]]
        scores, ids = np.take_along_axis(scores, best, 1), ids.astype(object)[best]
        if self.scores.shape[1] < self.k:
            room = self.k - self.scores.shape[1]
            self.scores = np.concatenate([self.scores, np.full((len(self.scores), room), -np.inf)], axis=1)
            self.ids = np.concatenate([self.ids, np.full((len(self.ids), room), None, object)], axis=1)
        scores, ids = np.concatenate([self.scores[rows], scores], axis=1), np.concatenate([self.ids[rows], ids], axis=1)
        known = ids != None  # noqa: E711
        place = np.full(ids.shape, np.iinfo(np.int64).max)
        place[known] = np.unique(ids[known], return_inverse=True)[1]
        order = np.argsort(place, axis=1, kind="stable")
        order = np.take_along_axis(order, np.argsort(-np.take_along_axis(scores, order, 1), axis=1, kind="stable"), 1)[:, : self.k]
        self.scores[rows], self.ids[rows] = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)

    def rows(self, qids: list) -> pd.DataFrame:
        row, column = np.nonzero(self.scores > -np.inf) if self.scores.size else (np.zeros(0, int), np.zeros(0, int))
        return pd.DataFrame({"qid": [qids[r] for r in row], "doc_id": list(self.ids[row, column]), "score": self.scores[row, column]})
