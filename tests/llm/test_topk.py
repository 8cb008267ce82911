import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import topk

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, k=5, every=50):
    own = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(256 * x) for x in v]
            own[i] = min(own.get(i, q), q)
    out = []
    for i, q in own.items():
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in own.items() if j != i and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


def test_equal_to_brute_force(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in topk.op1_topk_search(spark, sf).collect()) == brute(rows)


@pytest.mark.parametrize("shard_rows", [16, 4096])
def test_shards_blocks_and_ties(spark, shard_rows, monkeypatch):
    monkeypatch.setattr(topk, "LEAF_ROWS", 4)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 8)
    rng = random.Random(4)
    centres = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in rng.choice(centres)]) for i in range(300)]
    rows += [(1000 + i, [0.5] * 6) for i in range(150)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    got = topk.nearest(df, F.col("vec_id") % 10 == 0, shard_rows=shard_rows).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, every=10)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (0, [0.5, 9.0]), (50, [3.0]), (100, [1e9, -1e9]), (150, [nan, 1.0]), (200, None), (250, []), (300, [None, 1.0]),
        (350, [inf, 0.0]), (None, [1.0, 1.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [-0.001, 0.0]),
    ]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumn("shard", F.lit("own"))
    got = topk.nearest(df, F.col("vec_id") % 50 == 0).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)
    assert topk.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0
