"""Running best rows of a partition, for searches that score whole blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

HELD_ROWS = 500_000


class Best:
    """The k best items of each question seen so far in a task.

    Scores are compared downward, then ids upward. What is held is handed out when it exceeds HELD_ROWS rows, so memory is
    bounded whatever the number of questions; usually a task hands out at most k rows per question once, at its end.
    """

    def __init__(self, k: int):
        self.k, self.rows, self.held = k, 0, {}

    def add(self, question: object, ids: np.ndarray, scores: np.ndarray) -> None:
        if question in self.held:
            old_ids, old_scores = self.held[question]
            self.rows -= len(old_ids)
            ids, scores = np.concatenate((old_ids, ids)), np.concatenate((old_scores, scores))
        if len(ids) > self.k:
            floor = -np.partition(-scores, self.k - 1)[self.k - 1]
            near = np.flatnonzero(scores >= floor)
            near = near[np.lexsort((ids[near].astype(str), -scores[near]))][: self.k]
            ids, scores = ids[near], scores[near]
        self.held[question] = ids, scores
        self.rows += len(ids)

    def floor(self, question: object) -> float:
        """The score that an item has to reach to be among the k best so far."""
        _, scores = self.held.get(question, ((), ()))
        return float(scores.min()) if len(scores) == self.k else float("-inf")

    @property
    def full(self) -> bool:
        return self.rows > HELD_ROWS

    def hand_out(self) -> pa.RecordBatch:
        asked = [q for q, (ids, _) in self.held.items() for _ in range(len(ids))]
        ids = [i for found, _ in self.held.values() for i in found]
        scores = np.concatenate([s for _, s in self.held.values()]) if self.held else np.zeros(0)
        self.rows, self.held = 0, {}
        return pa.RecordBatch.from_arrays([pa.array(asked, pa.string()), pa.array(ids, pa.string()), pa.array(scores, pa.float64())], names=["asked", "chunk_id", "score"])
