"""The k best rows of each query, in a task and over all tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

#: Queries of one scan; what a task gets of them is bounded, and more are answered by further scans.
QUERIES_PER_SCAN = 16_384

#: Queries that a task multiplies a batch with at once.
QUERIES_AT_ONCE = 128


def best(scores: DataFrame, k: int, by: str = "query_id", row_id: str = "doc_id",
         score: str = "score") -> DataFrame:
    """The k best rows per query with their rank; Spark cuts to k before it shuffles."""
    w = Window.partitionBy(by).orderBy(F.desc(score), F.asc(row_id))
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def in_chunks(df: DataFrame, size: int = QUERIES_PER_SCAN) -> Iterator[list]:
    """The rows of a table on the driver, never more than ``size`` at a time."""
    few = df.limit(size + 1).collect()
    if len(few) <= size:
        if few:
            yield few
        return
    held = []
    for row in df.toLocalIterator():
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


class Kept:
    """The k best (score, id) pairs of each query that a task has seen, ties to the smaller id."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.floor = np.full(n_queries, -np.inf)
        self.query = np.empty(0, np.int64)
        self.row = np.empty(0, np.int64)
        self.score = np.empty(0)

    def add(self, first: int, ids: np.ndarray, scores: np.ndarray, least: float = -np.inf) -> None:
        """``scores``: a row per id, a column per query from ``first`` on; none up to ``least`` counts."""
        last = first + scores.shape[1]
        border = self.floor[first:last].copy()
        if len(ids) > self.k:
            border = np.maximum(border, np.partition(scores, len(ids) - self.k, axis=0)[len(ids) - self.k])
        at, query = np.nonzero((scores >= border) & (scores > least))
        own = (self.query >= first) & (self.query < last)
        q = np.concatenate([self.query[own], query + first])
        r = np.concatenate([self.row[own], ids[at]])
        s = np.concatenate([self.score[own], scores[at, query]])
        order = np.lexsort((r, -s, q))
        q, r, s = q[order], r[order], s[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        full = rank == self.k - 1
        self.floor[q[full]] = s[full]
        self.query = np.concatenate([self.query[~own], q[keep]])
        self.row = np.concatenate([self.row[~own], r[keep]])
        self.score = np.concatenate([self.score[~own], s[keep]])

    def batch(self, query_ids: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(query_ids[self.query]), pa.array(self.row), pa.array(self.score)],
            names=["query_id", "row_id", "score"])
