"""Exact top-k search by inner product over KD-trees, one per shard of the table.

A tree splits its widest dimension at the median; every node keeps the tight box of its rows and their
smallest id. The largest inner product of a query with a box bounds all rows inside, so nodes are opened
best first until the best bound falls behind the kth score. A query first searches the shard it lies in; that
kth score travels with it to all other shards, block of queries by group of shards.
"""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm import common
from tidemark.session import stored

K = 5
SHARD_ROWS = 4096
LEAF_ROWS = 128

#: One task searches one group of shards for one block of queries; both sizes are fixed.
GROUP_SHARDS = 2
BLOCK_QUERIES = 2048

_FAR = np.iinfo(np.int64).max


def build(ids: np.ndarray, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS) -> dict:
    """A tree over rows in ascending order of id within each leaf."""
    order, nodes = np.arange(len(ids)), []
    todo = [(0, len(ids), -1)]
    while todo:
        start, end, parent = todo.pop()
        at = order[start:end]
        rows = vectors[at]
        low, high = rows.min(axis=0), rows.max(axis=0)
        nodes.append([start, end, -1, ids[at].min(), low, high])
        if parent >= 0:
            nodes[parent][2] = len(nodes) - 1  # the later of two children; the other one follows its parent
        widest = int(np.argmax(high - low))
        if end - start <= leaf_rows or high[widest] == low[widest]:
            order[start:end] = at[np.argsort(ids[at], kind="stable")]
            continue
        middle = (end - start) // 2
        order[start:end] = at[np.argpartition(rows[:, widest], middle)]
        me = len(nodes) - 1
        todo += [(start + middle, end, me), (start, start + middle, me)]
    return {
        "ids": ids[order], "vectors": vectors[order],
        "start": np.array([n[0] for n in nodes]), "end": np.array([n[1] for n in nodes]),
        "second": np.array([n[2] for n in nodes]), "least": np.array([n[3] for n in nodes]),
        "low": np.array([n[4] for n in nodes]), "high": np.array([n[5] for n in nodes]),
    }


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: by floating point where no sum can leave its exact range."""
    bound = max(1, int(np.abs(a).max(initial=0))) * max(1, int(np.abs(b).max(initial=0))) * max(1, a.shape[1])
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores of each row, ties to the smaller id."""
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def search(tree: dict, queries: np.ndarray, own: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> None:
    """Improves the best ``scores`` and ``ids`` (rows by query, k columns) in place.

    Each round every open query goes down to its next best leaf; queries at one leaf are multiplied together.
    """
    upper = _products(np.maximum(queries, 0), tree["high"]) + _products(np.minimum(queries, 0), tree["low"])
    least, start, end, second = (tree[c].tolist() for c in ("least", "start", "end", "second"))
    bounds = upper.tolist()
    heaps = [[(-b[0], least[0], 0)] for b in bounds]
    live = list(range(len(queries)))
    while live:
        at_leaf: dict[int, list[int]] = {}
        for q in live:
            heap, bound = heaps[q], bounds[q]
            behind = (-int(scores[q, k - 1]), int(ids[q, k - 1]))
            while heap and heap[0][:2] < behind:
                node = heapq.heappop(heap)[2]
                if second[node] < 0:
                    at_leaf.setdefault(node, []).append(q)
                    break
                for child in (node + 1, second[node]):
                    heapq.heappush(heap, (-bound[child], least[child], child))
        for node, here in at_leaf.items():
            rows = slice(start[node], end[node])
            there = tree["ids"][rows]
            found = _products(queries[here], tree["vectors"][rows])
            named = np.broadcast_to(there, found.shape)
            same = there[None, :] == own[here][:, None]
            if same.any():
                found = np.where(same, np.iinfo(np.int64).min + 1, found)
                named = np.where(same, _FAR, named)
            scores[here], ids[here] = _best(np.hstack([scores[here], found]), np.hstack([ids[here], named]), k)
        live = [q for here in at_leaf.values() for q in here]


def _empty(n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.full((n, k), np.iinfo(np.int64).min + 1), np.full((n, k), _FAR)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.array(list(values), pa.list_(pa.int64()))


_TREE = "ids binary, vectors binary, start binary, end binary, second binary, least binary, low binary, high binary"
_PARTS = [c.split()[0] for c in _TREE.split(", ")]


def _unpacked(row: dict) -> dict:
    tree = {c: np.frombuffer(row[c], np.int64) for c in _PARTS}
    return tree | {c: tree[c].reshape(-1, row["dim"]) for c in ("vectors", "low", "high")}


def _shards(rows: DataFrame, k: int, shard_rows: int) -> DataFrame:
    """A row for each tree (query_id null) and for each query with what it finds in its own shard."""
    schema = f"shard long, dim int, {_TREE}, query_id long, query array<long>, scores array<long>, found array<long>"

    def made(ids, vectors, asked, shard):
        tree = build(ids, vectors)
        n, dim = int(asked.sum()), vectors.shape[1]
        scores, found = _empty(n, k)
        search(tree, vectors[asked], ids[asked], scores, found, k)
        blobs = [pa.array([np.ascontiguousarray(tree[c], np.int64).tobytes(), *[None] * n], pa.binary()) for c in _PARTS]
        none = [None]
        return pa.RecordBatch.from_arrays(
            [pa.array([shard] * (n + 1), pa.int64()), pa.array([dim] * (n + 1), pa.int32()), *blobs,
             pa.array(none + ids[asked].tolist(), pa.int64()),
             *(pa.array(none + list(x), pa.list_(pa.int64())) for x in (vectors[asked], scores, found))],
            names=["shard", "dim", *_PARTS, "query_id", "query", "scores", "found"],
        )

    def run(batches):
        shards = itertools.count(TaskContext.get().partitionId() << 32)
        waiting: dict[int, list] = {}
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims):
                own = batch.filter(pa.array(dims == dim))
                vectors = own["vector"].flatten().to_numpy().reshape(-1, dim)
                waiting.setdefault(int(dim), []).append((own["id"].to_numpy(), vectors, own["asked"].to_numpy(zero_copy_only=False)))
                held = waiting[int(dim)]
                while sum(len(x[0]) for x in held) >= shard_rows:
                    ids, vectors, asked = (np.concatenate(x) for x in zip(*held, strict=True))
                    yield made(ids[:shard_rows], vectors[:shard_rows], asked[:shard_rows], next(shards))
                    held[:] = [(ids[shard_rows:], vectors[shard_rows:], asked[shard_rows:])]
        for held in waiting.values():
            ids, vectors, asked = (np.concatenate(x) for x in zip(*held, strict=True))
            if len(ids):
                yield made(ids, vectors, asked, next(shards))

    return rows.mapInArrow(run, schema)


def _elsewhere(k: int):
    """Searches a group of shards for a block of queries that lie in other shards."""

    def run(key, trees, queries):
        out = {"query_id": [], "vec_id": [], "score": []}
        if trees.num_rows and queries.num_rows:
            own, home = queries["query_id"].to_numpy(), queries["home"].to_numpy()
            vectors = np.array(queries["query"].to_pylist(), np.int64)
            known = np.array(queries["scores"].to_pylist(), np.int64), np.array(queries["found"].to_pylist(), np.int64)
            scores, ids = known[0].copy(), known[1].copy()
            for row in trees.to_pylist():
                away = np.flatnonzero(home != row["shard"])
                best = scores[away], ids[away]
                search(_unpacked(row), vectors[away], own[away], *best, k)
                scores[away], ids[away] = best
            new = (ids[:, :, None] != known[1][:, None, :]).all(axis=2) & (ids != _FAR)
            q, at = np.nonzero(new)
            out = {"query_id": own[q], "vec_id": ids[q, at], "score": scores[q, at]}
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return run


def nearest(rows: DataFrame, asked: Column, k: int = K, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The k highest integer inner products of each query: query_id, rank, vec_id, score.

    ``rows`` has vec_id and embedding; ``asked`` tells the queries. Components are floor(256 x). Every row with
    another vec_id is a candidate; ties go to the smaller vec_id, and a query with fewer candidates
    gets all. Rows whose id, vector or any component is null, or whose components are not finite, take no part,
    and neither do empty vectors; vectors of different lengths do not meet. Rows that repeat an id count once, by
    the smallest of their vectors. An empty table gives no rows. Other columns are not looked at.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = rows.where("vec_id is not null and size(embedding) > 0").where(finite).select(
        F.col("vec_id").cast("long").alias("id"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vector"),
        asked.alias("asked"),
    )
    once = usable.groupBy("id").agg(F.min("vector").alias("vector"), F.max("asked").alias("asked"))
    once = once.select("id", F.size("vector").alias("dim"), "vector", F.coalesce("asked", F.lit(False)).alias("asked"))
    made = stored(_shards(once, k, shard_rows), "kd-trees")
    trees = made.where("query_id is null").select("shard", "dim", *_PARTS)
    asking = made.where("query_id is not null").select(
        F.col("shard").alias("home"), "dim", "query_id", "query", "scores", "found"
    )
    n_trees, n_queries = trees.count(), asking.count()
    groups, blocks = max(1, -(-n_trees // GROUP_SHARDS)), max(1, -(-n_queries // BLOCK_QUERIES))
    dealt_trees = trees.select(
        "*", F.pmod(F.xxhash64("shard"), F.lit(groups)).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b")
    )
    dealt_queries = asking.select(
        "*", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("b"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"),
    )
    key = ["g", "b", "dim"]
    away = (
        dealt_trees.groupBy(*key)
        .cogroup(dealt_queries.select(*key, "query_id", "query", "scores", "found", "home").groupBy(*key))
        .applyInArrow(_elsewhere(k), "query_id long, vec_id long, score long")
    )
    at_home = asking.select("query_id", F.explode(F.arrays_zip("found", "scores")).alias("f")).select(
        "query_id", F.col("f.found").alias("vec_id"), F.col("f.scores").alias("score")
    ).where(F.col("vec_id") != _FAR)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return at_home.union(away).select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op1_topk_search(spark, sf_dir):
    return nearest(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {"op1_topk_search": op1_topk_search}

ORACLES = {"op1_topk_search": f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
ranked AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, c.v) DESC, c.vec_id) AS rank
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= {K}"""}
