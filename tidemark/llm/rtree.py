"""Hard-negative mining by inner product over R-trees packed by sort-tile-recursive (STR) order.

Rows are dealt to slabs by label and the widest coordinate and sorted within a slab by the next one, so that every
shard, a run of rows of bounded size, is a tile of space; inside a shard the tiling goes on down to leaves. A node
has the bounding box of its rows, which gives an interval for each product of coordinates and so for the inner
product with a query, and the range of their labels. A query is an anchor with a window of scores and
a wanted relation of labels; nodes are opened best first, and boxes outside the window or strictly below the
query's kth score are left closed. Queries search their own shard first; then root boxes decide which other
shards they have to visit, and only these are visited.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm import common
from tidemark.session import stored

POSITIVES = 5
NEGATIVES = 5

#: A negative scores at least so many hundredths of its positive.
LEAST_PERCENT = 80

#: Components in a shard, rows in a leaf, children of a node.
SHARD_CELLS = 1 << 19
LEAF_ROWS = 64
FAN_OUT = 8

#: Shards whose root boxes are looked at together, home shards whose queries are, and home shards whose queries
#: visit a shard together.
ROUTE_SHARDS = 1024
ROUTE_BLOCKS = 256
VISIT_BLOCKS = 64

_FAR = np.iinfo(np.int64).max
_NONE = np.iinfo(np.int64).min + 1
_HUGE = np.iinfo(np.int64).max


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors; those beyond 64 bits become the nearest value that has them."""
    extent = [max(1, -int(x.min(initial=0)), int(x.max(initial=0))) for x in (a, b)]
    bound = extent[0] * extent[1] * max(1, a.shape[1])
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < _HUGE:
        return a @ b.T
    return np.clip((a.astype(object) @ b.astype(object).T), _NONE + 1, _HUGE).astype(np.int64)


def _intervals(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each query with each box."""
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    return _sum(products(plus, low), products(minus, high)), _sum(products(plus, high), products(minus, low))


def _sum(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A sum that stays at the last value of 64 bits where it would go beyond."""
    over = (x > 0) & (y > _HUGE - np.maximum(x, 0))
    under = (x < 0) & (y < _NONE + 1 - np.minimum(x, 0))
    return np.where(over, _HUGE, np.where(under, _NONE + 1, np.where(over | under, 0, x) + np.where(over | under, 0, y)))


def tiled(rows: np.ndarray, keys: list[np.ndarray], leaf_rows: int) -> list[np.ndarray]:
    """Rows in sort-tile-recursive order: by each key in turn cut into slabs, at last into leaves."""
    if len(rows) <= leaf_rows:
        return [rows]
    ordered = rows[np.argsort(keys[0][rows], kind="stable")]
    pages = -(-len(rows) // leaf_rows)
    slabs = pages if len(keys) == 1 else int(np.ceil(pages ** (1 / len(keys))))
    size = -(-pages // slabs) * leaf_rows
    parts = [ordered[i : i + size] for i in range(0, len(rows), size)]
    return parts if len(keys) == 1 else [leaf for part in parts for leaf in tiled(part, keys[1:], leaf_rows)]


def build(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> dict:
    """A packed tree; nodes stand root first, and those from ``leaf`` on are leaves."""
    pages = max(1, -(-len(ids) // LEAF_ROWS))
    widest = np.argsort(vectors.min(axis=0) - vectors.max(axis=0), kind="stable")[: max(1, int(np.ceil(np.log2(pages))))]
    leaves = tiled(np.argsort(ids, kind="stable"), [labels, *(vectors[:, c] for c in widest)], LEAF_ROWS)
    order = np.concatenate(leaves)
    ids, labels, vectors = ids[order], labels[order], vectors[order]
    begin = np.cumsum([0, *map(len, leaves)])[:-1]
    levels, end = [], np.append(begin[1:], len(ids))
    boxes = [
        np.minimum.reduceat(ids, begin), np.minimum.reduceat(labels, begin), np.maximum.reduceat(labels, begin),
        np.minimum.reduceat(vectors, begin), np.maximum.reduceat(vectors, begin),
    ]
    while True:
        levels.insert(0, [begin, end, *boxes])
        if len(begin) == 1:
            break
        first = np.arange(0, len(begin), FAN_OUT)
        fold = (np.minimum, np.minimum, np.maximum, np.minimum, np.maximum)
        boxes = [f.reduceat(x, first) for f, x in zip(fold, boxes, strict=True)]
        begin, end = first, np.append(first[1:], len(begin))
    at = np.cumsum([0, *(len(level[0]) for level in levels)])
    for i, level in enumerate(levels[:-1]):
        level[0], level[1] = level[0] + at[i + 1], level[1] + at[i + 1]
    names = ("begin", "end", "least", "from_label", "to_label", "low", "high")
    return {n: np.concatenate([level[i] for level in levels]) for i, n in enumerate(names)} | {
        "ids": ids, "labels": labels, "vectors": vectors, "leaf": int(at[-2]),
    }


def _open(tree: dict, asks: dict, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which boxes may hold what a query wants, and the best score that it could find in each."""
    lower, upper = (x[asks["at"]] for x in _intervals(asks["vectors"], tree["low"], tree["high"]))
    label = asks["labels"][asks["at"]][:, None]
    if same:
        wanted = (tree["from_label"] <= label) & (label <= tree["to_label"])
    else:
        wanted = (tree["from_label"] != label) | (tree["to_label"] != label)
    ceiling = asks["ceiling"][:, None]
    return wanted & (upper >= asks["floor"][:, None]) & (lower <= ceiling), np.minimum(upper, ceiling)


def search(tree: dict, asks: dict, same: bool) -> None:
    """Improves the best ``scores`` and ``found`` of the queries (rows by query, k columns) in place.

    Each round every open query goes down to its next best leaf; queries at one leaf are multiplied together.
    """
    scores, found = asks["scores"], asks["found"]
    allowed, best = _open(tree, asks, same)
    begin, end, least, leaf = tree["begin"].tolist(), tree["end"].tolist(), tree["least"].tolist(), tree["leaf"]
    own = asks["ids"][asks["at"]]
    heaps = [[(-int(best[q, 0]), least[0], 0)] if allowed[q, 0] else [] for q in range(len(scores))]
    live = [q for q, heap in enumerate(heaps) if heap]
    while live:
        at_leaf: dict[int, list[int]] = {}
        for q in live:
            heap, can, bound = heaps[q], allowed[q], best[q]
            behind = (-int(scores[q, -1]), int(found[q, -1]))
            while heap and heap[0][:2] < behind:
                node = heapq.heappop(heap)[2]
                if node >= leaf:
                    at_leaf.setdefault(node, []).append(q)
                    break
                for child in range(begin[node], end[node]):
                    if can[child]:
                        heapq.heappush(heap, (-int(bound[child]), least[child], child))
        for node, here in at_leaf.items():
            rows = slice(begin[node], end[node])
            there, anchors = tree["ids"][rows], asks["at"][here]
            got = products(asks["vectors"][anchors], tree["vectors"][rows])
            equal = tree["labels"][rows][None, :] == asks["labels"][anchors][:, None]
            fits = (equal if same else ~equal) & (there[None, :] != own[here][:, None])
            fits &= (got >= asks["floor"][here][:, None]) & (got <= asks["ceiling"][here][:, None])
            every = np.hstack([scores[here], np.where(fits, got, _NONE)])
            named = np.hstack([found[here], np.where(fits, there[None, :], _FAR)])
            top = np.lexsort((named, -every), axis=1)[:, : scores.shape[1]]
            scores[here], found[here] = np.take_along_axis(every, top, 1), np.take_along_axis(named, top, 1)
        live = [q for here in at_leaf.values() for q in here]


_TREE = ["ids", "labels", "vectors", "begin", "end", "least", "from_label", "to_label", "low", "high"]
_ROOT = ["root_low", "root_high", "root_from", "root_to", "root_least"]
_ASKS = ["q_ids", "q_labels", "q_vectors", "q_at", "q_floor", "q_ceiling", "q_scores", "q_found"]


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, np.int64).tobytes()


def _array(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64)


def _tree(row: dict) -> dict:
    tree = {c: _array(row[c]) for c in _TREE}
    return tree | {c: tree[c].reshape(-1, row["dim"]) for c in ("vectors", "low", "high")} | {"leaf": row["leaf"]}


def _asks(row: dict, some: np.ndarray | None = None) -> dict:
    """Queries of one home shard, or some of them; scores and ids found are copies that can be improved."""
    asks = {c[2:]: _array(row[c]) for c in _ASKS}
    asks["vectors"] = asks["vectors"].reshape(-1, row["dim"])
    some = np.arange(len(asks["at"])) if some is None else some
    k = len(asks["scores"]) // max(1, len(asks["at"])) or 1
    picked = {c: asks[c].reshape(-1, k)[some] for c in ("scores", "found")}
    return asks | {c: asks[c][some] for c in ("at", "floor", "ceiling")} | picked


def _shards(rows: DataFrame, shard_cells: int) -> DataFrame:
    """A row for each run of rows: its tree, its root box and the anchors in it."""
    blobs = [*_TREE, *_ROOT, "q_ids", "q_labels", "q_vectors"]
    schema = f"shard long, dim int, leaf int, {', '.join(f'{c} binary' for c in blobs)}"

    def made(number, dim, held):
        ids, labels, vectors, asked = (np.concatenate(x) for x in zip(*held, strict=True))
        tree = build(ids, labels, vectors)
        root = {"root_low": tree["low"][:1], "root_high": tree["high"][:1], "root_from": tree["from_label"][:1],
                "root_to": tree["to_label"][:1], "root_least": tree["least"][:1]}
        anchors = {"q_ids": ids[asked], "q_labels": labels[asked], "q_vectors": vectors[asked]}
        row = {"shard": [number], "dim": [dim], "leaf": [tree["leaf"]]}
        row |= {c: [_blob((tree | root | anchors)[c])] for c in blobs}
        return pa.RecordBatch.from_pydict(row, schema=pa.schema(
            [("shard", pa.int64()), ("dim", pa.int32()), ("leaf", pa.int32()), *((c, pa.binary()) for c in blobs)]
        ))

    def run(batches):
        number, dim, held, n = TaskContext.get().partitionId() << 32, None, [], 0
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for start, end in zip(cuts := [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist()], [*cuts[1:], len(dims)], strict=True):
                if held and dims[start] != dim:
                    yield made(number, dim, held)
                    number, held, n = number + 1, [], 0
                dim = int(dims[start]) if end > start else dim
                part = batch.slice(start, end - start)
                columns = (
                    part["id"].to_numpy(), part["label"].to_numpy(), part["vector"].flatten().to_numpy().reshape(end - start, -1),
                    part["asked"].to_numpy(zero_copy_only=False),
                )
                limit, at = max(LEAF_ROWS, shard_cells // max(1, dim or 1)), 0
                while at < end - start:
                    take = min(limit - n, end - start - at)
                    held.append(tuple(c[at : at + take] for c in columns))
                    at, n = at + take, n + take
                    if n == limit:
                        yield made(number, dim, held)
                        number, held, n = number + 1, [], 0
        if held:
            yield made(number, dim, held)

    return rows.mapInArrow(run, schema)


def _at_home(same: bool, k: int):
    """Searches each home shard for its own queries: the same queries with what they found."""

    def run(key, shards, asks):
        if not asks.num_rows or not shards.num_rows:
            return asks.slice(0, 0)
        row = asks.to_pylist()[0]
        n = len(row["q_at"]) // 8
        row |= {"q_scores": _blob(np.full((n, k), _NONE)), "q_found": _blob(np.full((n, k), _FAR))}
        own = _asks(row)
        search(_tree(shards.to_pylist()[0]), own, same)
        return pa.Table.from_pylist([row | {"q_scores": _blob(own["scores"]), "q_found": _blob(own["found"])}], schema=asks.schema)

    return run


def _routed(same: bool):
    """The shards that queries of some home shards have to visit: shard, block, some (which queries)."""

    def run(key, boxes, asks):
        out = {"shard": [], "block": [], "some": []}
        if boxes.num_rows and asks.num_rows:
            shards = boxes["shard"].to_numpy()
            parts = {c: np.concatenate([_array(b) for b in boxes[c].to_pylist()]) for c in _ROOT}
            dim = boxes["dim"][0].as_py()
            tree = {
                "low": parts["root_low"].reshape(-1, dim), "high": parts["root_high"].reshape(-1, dim),
                "from_label": parts["root_from"], "to_label": parts["root_to"],
            }
            for row in asks.to_pylist():
                own = _asks(row)
                allowed, best = _open(tree, own, same)
                kth, last = own["scores"][:, -1:], own["found"][:, -1:]
                allowed &= (best > kth) | ((best == kth) & (parts["root_least"] < last))
                allowed[:, shards == row["block"]] = False
                for s in np.flatnonzero(allowed.any(axis=0)).tolist():
                    out["shard"].append(int(shards[s]))
                    out["block"].append(row["block"])
                    out["some"].append(_blob(np.flatnonzero(allowed[:, s])))
        return pa.table(out, schema=pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("some", pa.binary())]))

    return run


def _elsewhere(same: bool):
    """Searches one shard for queries of other shards: block, query (its place there), vec_id, score."""

    def run(key, shards, asks):
        out = {"block": [], "query": [], "vec_id": [], "score": []}
        if shards.num_rows and asks.num_rows:
            tree = _tree(shards.to_pylist()[0])
            for i in range(asks.num_rows):
                row = asks.slice(i, 1).to_pylist()[0]
                some = _array(row["some"])
                own = _asks(row, some)
                before = own["found"].copy()
                search(tree, own, same)
                new = (own["found"][:, :, None] != before[:, None, :]).all(axis=2) & (own["found"] != _FAR)
                q, at = np.nonzero(new)
                out["block"].append(np.full(len(q), row["block"]))
                out["query"].append(some[q])
                out["vec_id"].append(own["found"][q, at])
                out["score"].append(own["scores"][q, at])
        empty = np.empty(0, np.int64)
        return pa.table({c: pa.array(np.concatenate([empty, *v]), pa.int64()) for c, v in out.items()})

    return run


def _held(key, asks):
    """What the queries of a home shard have found so far."""
    own = _asks(asks.to_pylist()[0])
    q, at = np.nonzero(own["found"] != _FAR)
    return pa.table({
        "block": pa.array(np.full(len(q), key[0].as_py()), pa.int64()), "query": pa.array(q, pa.int64()),
        "vec_id": pa.array(own["found"][q, at], pa.int64()), "score": pa.array(own["scores"][q, at], pa.int64()),
    })


_FOUND = "block long, query long, vec_id long, score long"


def _find(shards: DataFrame, asks: DataFrame, same: bool, k: int) -> DataFrame:
    """block, query, rank, vec_id, score: what the queries of each home shard find in all shards."""
    trees = shards.select("shard", "dim", "leaf", *_TREE)
    ddl = f"block long, dim int, {', '.join(f'{c} binary' for c in _ASKS)}"
    blank = [F.lit(b"").alias(c) for c in ("q_scores", "q_found")]
    asks = stored(
        trees.groupBy("shard").cogroup(asks.select("block", "dim", *_ASKS[:6], *blank).groupBy("block")).applyInArrow(_at_home(same, k), ddl),
        "asks",
    )
    n_shards, n_blocks = shards.count(), asks.count()
    chunks, groups, salts = (max(1, -(-n // size)) for n, size in ((n_shards, ROUTE_SHARDS), (n_blocks, ROUTE_BLOCKS), (n_blocks, VISIT_BLOCKS)))
    spread = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    boxes = shards.select("shard", "dim", *_ROOT, spread("shard", chunks).alias("c"), every(groups).alias("g"))
    asking = asks.select("*", spread("block", groups).alias("g"), every(chunks).alias("c"))
    key = ["c", "g", "dim"]
    routes = stored(
        boxes.groupBy(*key).cogroup(asking.groupBy(*key)).applyInArrow(_routed(same), "shard long, block long, some binary")
        .withColumn("salt", spread("block", salts)),
        "routes",
    )
    visits = routes.join(asks, "block")
    wanted = routes.select(F.col("shard").alias("to"), F.col("salt").alias("part")).distinct()
    visited = trees.join(wanted, F.col("shard") == F.col("to"))
    away = visited.groupBy("to", "part").cogroup(visits.groupBy("shard", "salt")).applyInArrow(_elsewhere(same), _FOUND)
    found = asks.groupBy("block").applyInArrow(_held, _FOUND).union(away)
    rank = F.row_number().over(Window.partitionBy("block", "query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _windows(least_percent: int, k: int):
    """Queries of the second search: for each anchor and positive, in their order, the window of its negatives."""

    def run(key, asks, positives):
        if not asks.num_rows or not positives.num_rows:
            return pa.table({c: [] for c in _ASK_SCHEMA.names}, schema=_ASK_SCHEMA)
        row = asks.to_pylist()[0]
        anchors = len(row["q_ids"]) // 8
        floor, ceiling = np.full(anchors * k, 1), np.full(anchors * k, 0)  # windows without a positive stay empty
        for query, rank, score in zip(*(positives[c].to_pylist() for c in ("query", "rank", "score")), strict=True):
            floor[query * k + rank - 1] = max(_NONE + 1, min(_HUGE, -(-least_percent * score // 100)))
            ceiling[query * k + rank - 1] = score
        row |= {"q_at": _blob(np.repeat(np.arange(anchors), k)), "q_floor": _blob(floor), "q_ceiling": _blob(ceiling)}
        return pa.Table.from_pylist([row], schema=_ASK_SCHEMA)

    return run


_ASK_SCHEMA = pa.schema([("block", pa.int64()), ("dim", pa.int32()), *((c, pa.binary()) for c in _ASKS[:6])])


def _widest(vectors: DataFrame) -> list[int]:
    """The two coordinates that vary most."""
    spread = (
        vectors.select(F.posexplode("vector").alias("pos", "x")).groupBy("pos").agg(F.var_pop("x").alias("spread"))
        .orderBy(F.desc("spread"), "pos").limit(2).collect()
    )
    return ([r["pos"] for r in spread] + [0, 0])[:2]


def _unlimited(asks: DataFrame) -> DataFrame:
    """Every anchor as one query without bounds."""

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                n = len(row["q_ids"]) // 8
                row |= {"q_at": _blob(np.arange(n)), "q_floor": _blob(np.full(n, _NONE + 1)), "q_ceiling": _blob(np.full(n, _HUGE))}
            yield pa.RecordBatch.from_pylist(rows, schema=_ASK_SCHEMA)

    return asks.mapInArrow(run, f"block long, dim int, {', '.join(f'{c} binary' for c in _ASKS[:6])}")


def hard_negatives(
    rows: DataFrame, asked: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
    least_percent: int = LEAST_PERCENT, shard_cells: int = SHARD_CELLS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has vec_id, embedding and label; ``asked`` tells the anchors. Components are floor(256 x) and scores
    integer inner products with the anchor; higher scores come first, ties by smaller vec_id. An anchor's
    positives are its first ``positives`` other rows of its label; for each of them the first ``negatives`` rows of
    other labels follow whose score is at most the positive's and at least ``least_percent`` hundredths of it. An
    anchor without positives, and a positive with a score below 0, has no rows. Rows take no part whose id, label,
    vector or any component is null, whose components are not finite, or whose vector is empty; vectors of
    different lengths do not meet. Rows that repeat an id count once, by the smallest vector and then label. Scores
    beyond 64 bits count as the nearest value that has them. An empty table gives no rows. Other columns are not
    looked at.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = rows.where("vec_id is not null and label is not null and size(embedding) > 0").where(finite).select(
        F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vector"), asked.alias("asked"),
    )
    once = usable.groupBy("id").agg(F.min(F.struct("vector", "label")).alias("row"), F.max("asked").alias("asked"))
    vectors = stored(
        once.select("id", "row.*", F.size("row.vector").alias("dim"), F.coalesce("asked", F.lit(False)).alias("asked")), "vectors"
    )
    first, second = _widest(vectors)
    cells = vectors.agg(F.sum("dim")).first()[0] or 0
    slabs = max(1, int(np.ceil(np.sqrt(cells / shard_cells))))
    tiles = (
        vectors.repartitionByRange(slabs, "dim", "label", F.get("vector", F.lit(first)), "id")
        .sortWithinPartitions("dim", "label", F.get("vector", F.lit(second)), "id")
    )
    shards = stored(_shards(tiles, shard_cells), "r-trees")
    asks = shards.where("length(q_ids) > 0").select(F.col("shard").alias("block"), "dim", *_ASKS[:3])
    best = stored(_find(shards, _unlimited(asks), True, positives), "positives")
    wanted = _unlimited(asks).groupBy("block").cogroup(best.groupBy("block")).applyInArrow(
        _windows(least_percent, positives), f"block long, dim int, {', '.join(f'{c} binary' for c in _ASKS[:6])}"
    )
    hard = _find(shards, wanted, False, negatives).select("block", F.col("query").alias("window"), "rank", "vec_id", "score")
    anchors = asks.groupBy("block").applyInArrow(_anchors, "block long, query long, anchor_id long")
    pairs = best.join(anchors, ["block", "query"]).select(
        "block", (F.col("query") * positives + F.col("rank") - 1).alias("window"), "anchor_id",
        F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"),
    )
    return hard.join(pairs, ["block", "window"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def _anchors(key, asks):
    ids = _array(asks["q_ids"][0].as_py())
    return pa.table({
        "block": pa.array(np.full(len(ids), key[0].as_py()), pa.int64()), "query": pa.array(np.arange(len(ids))),
        "anchor_id": pa.array(ids),
    })


def op11_hard_negatives(spark, sf_dir):
    rows = common.table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


QUERIES = {"op11_hard_negatives": op11_hard_negatives}

ORACLES = {"op11_hard_negatives": f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM scored WHERE same),
negatives AS (
  SELECT anchor_id, positive_id, n.vec_id AS negative_id, positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positives p JOIN scored n USING (anchor_id)
  WHERE r <= {POSITIVES} AND NOT same AND {LEAST_PERCENT} * positive_score <= 100 * n.score AND n.score <= positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE rank <= {NEGATIVES}"""}
