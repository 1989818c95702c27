"""The best of each question in one pass over parts of the rows, with as much memory as the answer takes."""

from __future__ import annotations

import numpy as np


class Best:
    """What ranks first for each question so far, by score rounded to four digits, then id: what ranks last is forgotten.

    last_id_first: of equal scores the larger id ranks first. Scores below 0 are never wanted.
    """

    def __init__(self, questions: int, most: int, last_id_first: bool = False):
        self.most, self.sign, self.least = most, -1 if last_id_first else 1, np.zeros(questions)
        self.row, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object)
        self.pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    @staticmethod
    def rounded(score: np.ndarray) -> np.ndarray:
        """To four digits, halves away from zero as F.round does: dyadic scores lie between two."""
        return np.copysign(np.floor(np.abs(score) * 1e4 + 0.5), score)

    def offer(self, first: int, score: np.ndarray, names: np.ndarray) -> None:
        """Scores of the questions from `first` on (rows) for names (columns); they count from the next `settle`."""
        least = self.least[first : first + len(score), None]
        if score.shape[1] > self.most:
            least = np.maximum(least, np.partition(score, -self.most, axis=1)[:, -self.most, None])
        # scores are ranked when they are rounded to four digits: what may tie with the last candidate stays
        row, at = np.nonzero(score >= least - 1e-4)
        self.pending.append((row + first, score[row, at], names[at]))

    def settle(self) -> None:
        if self.pending:
            found, self.pending = self.pending, []
            self.add(*(np.concatenate(x) for x in zip(*found, strict=True)))

    def add(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        row, score, ids = np.concatenate([self.row, row]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((self.sign * np.unique(ids, return_inverse=True)[1], -self.rounded(score), row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = order[place < self.most]
        self.row, self.score, self.id = row[place < self.most], score[kept], ids[kept]
        last = np.flatnonzero(place[place < self.most] == self.most - 1)
        self.least[self.row[last]] = np.maximum(self.score[last], 0.0)
