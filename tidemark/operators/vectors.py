"""Dense vectors: nearest rows, nearest centroid, group means and centroid distances.

A small side (queries, centroids) goes to the tasks as a matrix; the large side
streams past it in Arrow batches and is multiplied there, so no pair of rows is
ever a row of a table. Each task keeps only its k best rows per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from tidemark.operators.ranking import QUERIES_AT_ONCE, QUERIES_PER_SCAN, Kept, best, in_chunks
from tidemark.session import stored


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths as a float matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def unit_rows(m: np.ndarray) -> np.ndarray:
    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norms > 0, norms, 1.0)


def l2_norm(vec):
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def top_k_cosine(corpus: DataFrame, queries: DataFrame, k: int = 5, row_id: str = "vec_id",
                 vec: str = "embedding") -> DataFrame:
    """``query_id, <row_id>, score, rank``: the k corpus rows closest to each query, exactly.

    ``queries`` has ``query_id`` and ``vec``; rows without a vector take no part. One scan of
    the corpus answers thousands of queries; every query is answered.
    """
    found = None
    rows = corpus.filter(F.col(vec).isNotNull()).select(F.col(row_id).cast("bigint"), vec)
    for chunk in in_chunks(queries.filter(F.col(vec).isNotNull()).select("query_id", vec)):
        ids = np.array([r["query_id"] for r in chunk], dtype=np.int64)
        q = unit_rows(np.array([r[vec] for r in chunk], dtype=np.float64))
        one = rows.mapInArrow(_best_rows(ids, q, k), f"query_id bigint, {row_id} bigint, score double")
        if found is None and len(chunk) < QUERIES_PER_SCAN:
            return best(one, k, row_id=row_id)
        one = stored(one, "nearest-rows")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return corpus.sparkSession.createDataFrame(
            [], f"query_id bigint, {row_id} bigint, score double, rank int")
    return best(found, k, row_id=row_id)


def _best_rows(query_ids, queries, k):
    def run(batches):
        kept = Kept(len(query_ids), k)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            rows = unit_rows(matrix(batch.column(1)))
            for at in range(0, len(queries), QUERIES_AT_ONCE):
                kept.add(at, ids, np.round(rows @ queries[at:at + QUERIES_AT_ONCE].T, 9))
        yield kept.batch(query_ids)

    return run


def nearest_centroid(df: DataFrame, centroids: DataFrame, row_id: str, vec: str = "embedding",
                     min_similarity: float = 0.25) -> DataFrame:
    """``<row_id>, cluster_id, similarity`` of the closest centroid by cosine; -1 if too far.

    ``centroids`` has ``cluster_id`` and ``centroid``; without any all rows get -1, and so do
    rows without a vector. Centroids that do not fit one scan are answered by further scans.
    """
    id_type = dict(df.dtypes)[row_id]
    schema = f"{row_id} {id_type}, cluster_id int, similarity double"
    usable = centroids.filter(F.col("centroid").isNotNull()).select("cluster_id", "centroid")
    parts = []
    for chunk in in_chunks(usable.orderBy("cluster_id")):
        labels = np.array([r["cluster_id"] for r in chunk], dtype=np.int64)
        c = unit_rows(np.array([r["centroid"] for r in chunk], dtype=np.float64))
        parts.append(df.select(row_id, vec).mapInArrow(_nearest(labels, c), schema))
    if not parts:
        return df.select(row_id, F.lit(-1).alias("cluster_id"), F.lit(0.0).alias("similarity"))
    near = parts[0]
    if len(parts) > 1:
        for one in parts[1:]:
            near = near.unionByName(one)
        near = near.groupBy(row_id).agg(F.min(F.struct(
            (-F.col("similarity")).alias("s"), "cluster_id")).alias("m")).select(
            row_id, "m.cluster_id", (-F.col("m.s")).alias("similarity"))
    return near.withColumn("cluster_id", F.when(
        F.col("similarity") < min_similarity, -1).otherwise(F.col("cluster_id")))


def _nearest(labels, c):
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            label, sim = np.full(n, -1), np.zeros(n)
            has = np.flatnonzero(batch.column(1).is_valid().to_numpy(zero_copy_only=False))
            if len(has):
                sims = np.round(unit_rows(matrix(batch.column(1).take(pa.array(has)))) @ c.T, 9)
                at = sims.argmax(axis=1)
                label[has], sim[has] = labels[at], sims[np.arange(len(has)), at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(label.astype(np.int32)), pa.array(sim)],
                names=["row_id", "cluster_id", "similarity"],
            )

    return run


def group_means(df: DataFrame, group: str, vec: str = "embedding", unit: bool = True) -> DataFrame:
    """Mean vector and size per group; with ``unit`` the mean is scaled to length 1."""
    means = df.groupBy(group).agg(
        Summarizer.mean(array_to_vector(F.col(vec).cast("array<double>"))).alias("_m"),
        F.count("*").alias("size"),
    ).withColumn("centroid", vector_to_array("_m"))
    if unit:
        norm = l2_norm("centroid")
        means = means.withColumn("_n", norm).withColumn(
            "centroid",
            F.when(F.col("_n") > 0, F.zip_with(
                "centroid", F.array_repeat("_n", F.size("centroid")), lambda x, n: x / n))
            .otherwise(F.col("centroid")),
        ).drop("_n")
    return means.drop("_m")
