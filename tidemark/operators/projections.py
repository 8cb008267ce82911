"""Approximate nearest rows: buckets of random projections, several probed per query, scores exact.

A row's bucket is the side it takes of random planes through the corpus mean. Rows of a bucket are packed into
segments of bounded size, stored by the leading planes. A query visits buckets in the order of the distance it
would have to move to get there; how many is set by a sample of rows whose true neighbours are known, and a query keeps
the distance of its last one. A bounded number of queries goes to the tasks at a time; each segment finds the queries that
come that far, and every visited row is scored on its full vector. No vector is copied for each bucket that it visits.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.ranking import QUERIES_PER_SCAN, Kept, best, in_chunks
from tidemark.operators.selection import random_sample
from tidemark.operators.sizing import broadcast_if_small
from tidemark.operators.vectors import matrix, top_k_cosine, unit_rows
from tidemark.session import scratch_path, stored

#: Rows that a bucket has on average, rows of a segment at most on average, queries that a segment is multiplied with at once.
BUCKET_ROWS = 128
SEGMENT_ROWS = 2048
BLOCK_QUERIES = 256

#: Planes at most, leading planes that name the folder of a bucket, and planes whose buckets are all listed to rank them.
MAX_PLANES = 30
FOLDER_PLANES = 8
LISTED_PLANES = 16

#: Rows whose true neighbours set the number of probes, neighbours of each, and the share of them to reach.
SAMPLE_ROWS = 512
SAMPLE_NEIGHBOURS = 10
RECALL = 0.95

_META = "planes array<double>, mean array<double>, n_planes int, probes bigint"


def _usable(df: DataFrame, row_id: str, vec: str) -> DataFrame:
    """Rows with a vector of numbers; others take no part."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return df.filter(F.col(vec).isNotNull()).filter(F.forall(vec, number)).select(
        F.col(row_id).cast("bigint").alias("row_id"), F.col(vec).cast("array<double>").alias("vec"))


def _sides(values: np.ndarray) -> np.ndarray:
    """The bucket of each row of projections; the first plane is the highest bit."""
    weights = 1 << np.arange(values.shape[1] - 1, -1, -1, dtype=np.int64)
    return (values > 0).astype(np.int64) @ weights


def probe_order(values: np.ndarray, probes: int) -> list[int]:
    """The first ``probes`` buckets of one query, nearest first.

    To change side at plane i costs the square of its distance; the sets of planes are made in the order of
    their sum, each from one before it by adding or moving its last plane.
    """
    home = int(_sides(values[None, :])[0])
    near = np.argsort(np.abs(values), kind="stable")
    cost = (values * values)[near]
    bit = [1 << (len(values) - 1 - int(i)) for i in near]
    out, heap = [home], [(cost[0], 0, bit[0])] if len(values) else []
    while heap and len(out) < probes:
        total, last, flips = heapq.heappop(heap)
        out.append(home ^ flips)
        if last + 1 < len(values):
            heapq.heappush(heap, (total + cost[last + 1], last + 1, flips | bit[last + 1]))
            moved = (flips ^ bit[last]) | bit[last + 1]
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], last + 1, moved))
    return out


def probe_ranks(asked: np.ndarray, found: np.ndarray) -> np.ndarray:
    """How many probes the query of each row of projections needs to reach the bucket of the row beside it."""
    other = (asked > 0) != (found > 0)
    needed = np.where(other, asked * asked, 0.0).sum(axis=1)
    ranks = np.empty(len(asked), dtype=np.int64)
    for at, (values, cost, flips) in enumerate(zip(asked, needed, other)):
        ranks[at] = 1 if not flips.any() else 1 + _cheaper(np.sort(values * values), cost)
    return ranks


def _cheaper(costs: np.ndarray, limit: float) -> int:
    """Sets of costs whose sum is at most ``limit``, counted by meeting two halves."""
    half = len(costs) // 2
    left, right = np.zeros(1), np.zeros(1)
    for c in costs[:half]:
        left = np.concatenate([left, left + c])
    for c in costs[half:]:
        right = np.concatenate([right, right + c])
    right.sort()
    return int(np.searchsorted(right, limit * (1 + 1e-12) - left, side="right").sum()) - 1


class ProjectionIndex:
    """Packed segments (``folder, bucket, part, ids, vecs``) of all rows, the planes, and the number of probes."""

    def __init__(self, segments: DataFrame, planes: np.ndarray, mean: np.ndarray, probes: int):
        self.segments = segments
        self.planes = planes
        self.mean = mean
        self.probes = probes

    @classmethod
    def build(cls, corpus: DataFrame, row_id: str = "vec_id", vec: str = "embedding", recall: float = RECALL,
              seed: int = 42, bucket_rows: int = BUCKET_ROWS) -> "ProjectionIndex":
        """Indexes every row that has a vector; vectors have one length. Zero vectors score 0 with all.

        ``recall`` is the share of true neighbours that the probes reach on ``SAMPLE_ROWS`` rows.
        """
        spark = corpus.sparkSession
        rows = stored(_usable(corpus, row_id, vec).mapInArrow(_unit, "row_id bigint, vec array<double>"), "unit-rows")
        n = rows.count()
        if not n:
            empty = spark.createDataFrame([], "bucket bigint, part int, ids array<bigint>, vecs array<double>, folder int")
            return cls(empty, np.zeros((0, 0)), np.zeros(0), 1)
        mean = rows.agg(Summarizer.mean(array_to_vector("vec")).alias("m")).first()["m"].toArray()
        n_planes = int(min(MAX_PLANES, max(0, np.ceil(np.log2(n / bucket_rows)))))
        planes = np.random.default_rng(seed).standard_normal((len(mean), n_planes))
        planes = planes / np.sqrt((planes * planes).sum(axis=0)) if n_planes else planes
        placed = rows.mapInArrow(_placed(planes, mean), "row_id bigint, vec array<double>, bucket bigint")
        placed = stored(placed, "placed-rows")
        dealt = _dealt(placed, "row_id", SEGMENT_ROWS)
        packed = dealt.groupBy("bucket", "part").agg(F.collect_list(F.struct("row_id", "vec")).alias("r")).select(
            "bucket", "part", F.col("r.row_id").alias("ids"), F.flatten("r.vec").alias("vecs"),
            _folder(n_planes).alias("folder"))
        index = cls(packed, planes, mean, 1)
        path = scratch_path(spark, "projection-index")
        index._write(path)
        index.segments = _segments(spark, path)
        index.probes = index._probes(rows, recall, seed)
        return index

    def _probes(self, rows: DataFrame, recall: float, seed: int) -> int:
        """The probes that reach ``recall`` of the true neighbours of the sampled rows."""
        sample = stored(random_sample(rows, SAMPLE_ROWS, "row_id", seed), "sampled-rows")
        near = top_k_cosine(rows, sample.withColumnRenamed("row_id", "query_id"), SAMPLE_NEIGHBOURS + 1,
                            row_id="row_id", vec="vec").filter("row_id <> query_id")
        vectors = broadcast_if_small(sample.select(F.col("row_id").alias("query_id"), F.col("vec").alias("asked")))
        pairs = near.join(rows, "row_id").join(vectors, "query_id").select("asked", "vec").limit(
            SAMPLE_ROWS * (SAMPLE_NEIGHBOURS + 1)).collect()
        if not pairs or not self.planes.shape[1]:
            return 1
        sides = [(np.array([p[i] for p in pairs]) - self.mean) @ self.planes for i in (0, 1)]
        ranks = np.sort(probe_ranks(*sides))
        return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)])

    def query(self, queries: DataFrame, k: int = 5, row_id: str = "vec_id", vec: str = "embedding",
              probes: int | None = None) -> DataFrame:
        """``query_id, <row_id>, score, rank``: the k best of the rows in the probed buckets, by exact cosine.

        ``queries`` has ``query_id`` and ``vec``; those without a vector of numbers get no row. Equal scores go to
        the smaller id. ``probes`` sets another number of buckets; all buckets make the answer exact.
        """
        spark = queries.sparkSession
        if k < 1:
            raise ValueError("k must be positive")
        n_planes = self.planes.shape[1]
        if not len(self.mean):
            return spark.createDataFrame([], f"query_id bigint, {row_id} bigint, score double, rank int")
        asked = _usable(queries, "query_id", vec).withColumnRenamed("row_id", "query_id").mapInArrow(
            _asked(self.planes, self.mean, min(probes or self.probes, 1 << n_planes)),
            "query_id bigint, vec array<double>, furthest double")
        found = None
        for chunk in in_chunks(stored(asked, "asked")):
            ids = np.array([r["query_id"] for r in chunk], np.int64)
            vecs = np.array([r["vec"] for r in chunk], np.float64)
            values, furthest = (vecs - self.mean) @ self.planes, np.array([r["furthest"] for r in chunk])
            # Queries of near buckets side by side: whole blocks of them pass a segment by.
            order = np.argsort(_sides(values), kind="stable")
            ids, vecs, values, furthest = ids[order], vecs[order], values[order], furthest[order]
            folders = _folders(values, furthest)
            one = self.segments.filter(F.col("folder").isin(folders)).select("bucket", "ids", "vecs").mapInArrow(
                _scores(ids, vecs, values, furthest, k), f"query_id bigint, {row_id} bigint, score double")
            if found is None and len(chunk) < QUERIES_PER_SCAN:
                return best(one, k, row_id=row_id)
            one = stored(one, "found-rows")
            found = one if found is None else found.unionByName(one)
        if found is None:
            return spark.createDataFrame([], f"query_id bigint, {row_id} bigint, score double, rank int")
        return best(found, k, row_id=row_id)

    def save(self, path: str) -> None:
        self._write(path)
        meta = [(self.planes.ravel().tolist(), self.mean.tolist(), self.planes.shape[1], self.probes)]
        self.segments.sparkSession.createDataFrame(meta, _META).write.mode("overwrite").parquet(f"{path}/meta")

    def _write(self, path: str) -> None:
        self.segments.write.mode("overwrite").partitionBy("folder").parquet(f"{path}/segments")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "ProjectionIndex":
        meta = spark.read.parquet(f"{path}/meta").first()
        planes = np.array(meta["planes"]).reshape(len(meta["mean"]), meta["n_planes"])
        return cls(_segments(spark, path), planes, np.array(meta["mean"]), meta["probes"])


def _segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(
        "bucket bigint, part int, ids array<bigint>, vecs array<double>, folder int").parquet(f"{path}/segments")


def _folder(n_planes: int):
    return F.shiftright("bucket", max(0, n_planes - FOLDER_PLANES)).cast("int")


def _dealt(df: DataFrame, row_id: str, size: int) -> DataFrame:
    """Adds ``part``: a bucket's rows by hash over as many parts as its counted size asks for."""
    counts = df.groupBy("bucket").agg(F.ceil(F.count("*") / size).alias("parts"))
    return df.join(broadcast_if_small(counts), "bucket").withColumn(
        "part", F.pmod(F.xxhash64(row_id), F.col("parts")).cast("int"))


def _lists(m: np.ndarray) -> pa.Array:
    offsets = np.arange(0, m.size + 1, m.shape[1], dtype=np.int32) if m.shape[1] else np.zeros(len(m) + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(m.ravel()))


def _unit(batches):
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _lists(unit_rows(matrix(batch.column(1))))], names=["row_id", "vec"])


def _placed(planes, mean):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                bucket = _sides((matrix(batch.column(1)) - mean) @ planes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(bucket)], names=["row_id", "vec", "bucket"])

    return run


def _asked(planes, mean, probes):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            vecs = unit_rows(matrix(batch.column(1)))
            furthest = [furthest_probe(values, probes) for values in (vecs - mean) @ planes]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _lists(vecs), pa.array(furthest, pa.float64())], names=["query_id", "vec", "furthest"])

    return run


def furthest_probe(values: np.ndarray, probes: int) -> float:
    """The cost of the last of the first ``probes`` buckets of a query."""
    if probes >= 1 << len(values):
        return float("inf")
    if len(values) > LISTED_PLANES:
        other = probe_order(values, probes)[-1] ^ int(_sides(values[None, :])[0])
        bits = other >> np.arange(len(values) - 1, -1, -1) & 1
        return float((values * values) @ bits)
    costs = np.zeros(1)
    for c in values * values:
        costs = np.concatenate([costs, costs + c])
    return float(np.partition(costs, probes - 1)[probes - 1])


def _within(values: np.ndarray, bits: np.ndarray, furthest: np.ndarray) -> np.ndarray:
    """Which queries visit the bucket (or folder) of these sides; one that costs as much as the last is visited too."""
    values = values[:, :len(bits)]
    return np.where((values > 0) != bits, values * values, 0.0).sum(axis=1) <= furthest * (1 + 1e-12) + 1e-300


def _bits(number: int, n: int) -> np.ndarray:
    return (number >> np.arange(n - 1, -1, -1) & 1).astype(bool)


def _folders(values: np.ndarray, furthest: np.ndarray) -> list[int]:
    """Folders that hold a bucket which some query visits."""
    n = min(values.shape[1], FOLDER_PLANES)
    return [f for f in range(1 << n) if _within(values, _bits(f, n), furthest).any()]


def _scores(query_ids, queries, values, furthest, k):
    """The k best rows of each query among the segments that a task has, of the buckets which the query visits."""
    n_planes, width = values.shape[1], queries.shape[1]

    def run(batches):
        kept = [Kept(len(query_ids[at:at + BLOCK_QUERIES]), k) for at in range(0, len(query_ids), BLOCK_QUERIES)]
        for batch in batches:
            for row in range(batch.num_rows):
                ids, vecs = (batch.column(i)[row].values.to_numpy(zero_copy_only=False) for i in (1, 2))
                ids, vecs = ids.astype(np.int64), vecs.reshape(-1, width)
                visits = _within(values, _bits(batch.column(0)[row].as_py(), n_planes), furthest)
                for i, best_rows in enumerate(kept):
                    block = queries[i * BLOCK_QUERIES:(i + 1) * BLOCK_QUERIES]
                    at = np.flatnonzero(visits[i * BLOCK_QUERIES:(i + 1) * BLOCK_QUERIES])
                    if len(at):
                        scores = np.full((len(ids), len(block)), -np.inf)
                        scores[:, at] = np.round(vecs @ block[at].T, 9)
                        best_rows.add(0, ids, scores)
        for i, best_rows in enumerate(kept):
            yield best_rows.batch(query_ids[i * BLOCK_QUERIES:(i + 1) * BLOCK_QUERIES])

    return run
