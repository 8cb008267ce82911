import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import with_clashes
from tidemark.llm import rtree

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every=100, positives=5, negatives=5):
    own = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            row = ([math.floor(256 * x) for x in v], label)
            own[i] = min(own.get(i, row), row)
    out = []
    for a, (q, label) in own.items():
        if a % every:
            continue
        found = sorted((-sum(x * y for x, y in zip(q, v)), i, other) for i, (v, other) in own.items() if i != a and len(v) == len(q))
        for p, pos, _ in [f for f in found if f[2] == label][:positives]:
            fits = [(s, i) for s, i, other in found if other != label and 80 * -p <= 100 * -s <= 100 * -p]
            out += [(a, pos, r + 1, i, -p, -s) for r, (s, i) in enumerate(fits[:negatives])]
    return sorted(out)


def moved(rows):
    return [(i, v, label if label is None or i % 7 else (label + 1) % 10) for i, v, label in rows]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_equal_to_brute_force(spark, sf):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = rows_of(rtree.op11_hard_negatives(spark, sf))
    assert got == brute(moved(rows)) and got


@pytest.mark.parametrize("shard_cells", [1 << 19, 120])
def test_shards_windows_and_ties(spark, shard_cells, monkeypatch):
    for name, size in (("LEAF_ROWS", 4), ("FAN_OUT", 2), ("ROUTE_SHARDS", 5), ("ROUTE_BLOCKS", 3), ("VISIT_BLOCKS", 2)):
        monkeypatch.setattr(rtree, name, size)
    rng = random.Random(11)
    centres = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in centres[i % 5]], rng.choice([i % 5, rng.randrange(5)])) for i in range(300)]
    rows += [(1000 + i, [0.5] * 6, i % 3) for i in range(150)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = rows_of(rtree.hard_negatives(df, F.col("vec_id") % 10 == 0, shard_cells=shard_cells))
    want = brute(rows, every=10)
    assert got == want and len(want) > 300


def test_tree_holds_every_row_in_its_boxes():
    rng = np.random.default_rng(2)
    ids, labels, vectors = rng.permutation(1000), rng.integers(0, 7, 1000), rng.integers(-50, 50, (1000, 9))
    tree = rtree.build(ids, labels, vectors)
    seen = []

    def down(node):
        if node >= tree["leaf"]:
            rows = slice(tree["begin"][node], tree["end"][node])
            assert rows.stop - rows.start <= rtree.LEAF_ROWS
            seen.extend(tree["ids"][rows].tolist())
            inside = tree["ids"][rows], tree["labels"][rows], tree["vectors"][rows]
        else:
            parts = [down(child) for child in range(tree["begin"][node], tree["end"][node])]
            inside = tuple(np.concatenate(x) for x in zip(*parts))
        assert tree["least"][node] == inside[0].min()
        assert tree["from_label"][node] == inside[1].min() and tree["to_label"][node] == inside[1].max()
        assert (tree["low"][node] == inside[2].min(axis=0)).all() and (tree["high"][node] == inside[2].max(axis=0)).all()
        return inside

    down(0)
    assert sorted(seen) == sorted(ids.tolist())


def test_root_boxes_leave_shards_out(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(8 * (i % 6 == c), 0.1) for c in range(6)], (i // 6) % 2) for i in range(600)]
    tiles = spark.createDataFrame(rows, SCHEMA).selectExpr(
        "vec_id as id", "cast(label as long) label", "transform(embedding, x -> floor(256 * x)) as vector", "6 as dim", "vec_id % 30 = 0 as asked"
    ).orderBy("label", F.expr("vec_id % 6"), "id").coalesce(1)
    shards = rtree._shards(tiles, 600).cache()
    asks = shards.select(F.col("shard").alias("block"), "dim", *rtree._ASKS[:3])
    seen = []
    stored = rtree.stored
    try:
        rtree.stored = lambda df, name: seen.append((name, out := stored(df, name))) or out
        rtree._find(shards, rtree._unlimited(asks), True, 5).count()
    finally:
        rtree.stored = stored
    routes = dict(seen)["routes"].count()
    assert routes < shards.count() * asks.count() / 2


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0], 1), (0, [0.5, 9.0], 2), (100, [3.0], 1), (101, [2.5], 1), (102, [2.4], 2), (200, [nan, 1.0], 1), (300, None, 1),
        (400, [], 1), (500, [None, 1.0], 1), (600, [inf, 0.0], 1), (700, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (7, [1.0, 2.0], 1),
        (7, [1.0, 2.0], 1), (8, [1.0, 1.9], 2), (9, [1.0, 1.8], 3), (800, [-1.0, -1.0], 4), (11, [1.0, 0.0], 4), (900, [0.0, 0.0], 1),
    ]
    df = with_clashes(spark.createDataFrame(rows, SCHEMA)).withColumn("shard", F.lit("own"))
    got = rtree.hard_negatives(df, F.col("vec_id") % 100 == 0)
    assert rows_of(got) == brute(rows)
    assert rtree.hard_negatives(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0).count() == 0
    huge = [(0, [1e16, 1e16], 1), (1, [1e16, 1e16], 1), (2, [1e16, 1e16], 2), (3, [1e8, 1.0], 2)]
    top = rows_of(rtree.hard_negatives(spark.createDataFrame(huge, SCHEMA), F.col("vec_id") == 0))
    most = 2**63 - 1
    assert top == [(0, 1, 1, 2, most, most)] or top == [(0, 1, 1, 2, most, most), (0, 1, 2, 3, most, most)]
