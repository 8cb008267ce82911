import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import projections
from tidemark.operators.projections import ProjectionIndex, furthest_probe, probe_order, probe_ranks
from tidemark.operators.vectors import top_k_cosine

SCHEMA = "vec_id bigint, embedding array<float>"


def frame(spark, m, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(m)], SCHEMA)


def pairs(df):
    return {(r["query_id"], r["vec_id"]): (r["score"], r["rank"]) for r in df.collect()}


def asked(df, step=20):
    return df.filter(F.col("vec_id") % step == 0).withColumnRenamed("vec_id", "query_id")


@pytest.fixture(scope="module")
def grouped():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 24))
    return centres[rng.integers(0, 40, 3000)] + 0.25 * rng.standard_normal((3000, 24))


def test_probes_come_in_order_of_cost():
    rng = np.random.default_rng(1)
    for _ in range(20):
        values = rng.standard_normal(7)
        home = sum(1 << (6 - i) for i in range(7) if values[i] > 0)
        every = sorted((sum(values[i] ** 2 for i in s), home ^ sum(1 << (6 - i) for i in s))
                       for n in range(8) for s in itertools.combinations(range(7), n))
        order = [b for _, b in every]
        assert probe_order(values, 128) == order and probe_order(values, 5) == order[:5]
        other = rng.standard_normal(7)
        bucket = sum(1 << (6 - i) for i in range(7) if other[i] > 0)
        assert probe_ranks(values[None, :], other[None, :]).tolist() == [order.index(bucket) + 1]
    assert probe_order(np.zeros(0), 3) == [0]


def test_recall_over_all_queries_and_exact_scores(spark, grouped):
    df = frame(spark, grouped)
    index = ProjectionIndex.build(df, bucket_rows=64)
    assert index.segments.agg(F.sum(F.size("ids"))).first()[0] == 3000
    assert index.probes < 2 ** index.planes.shape[1] / 2
    found, exact = pairs(index.query(asked(df), 10)), pairs(top_k_cosine(df, asked(df), 10))
    assert len(found) == len(exact) == 1500
    assert len(found.keys() & exact.keys()) >= 0.9 * len(exact)
    assert all(found[p][0] == exact[p][0] for p in found.keys() & exact.keys())


def test_all_buckets_give_the_exact_answer_and_a_saved_index_the_same(spark, grouped, tmp_path):
    df = frame(spark, grouped[:800])
    index = ProjectionIndex.build(df, bucket_rows=32)
    every = 2 ** index.planes.shape[1]
    exact = pairs(top_k_cosine(df, asked(df), 5))
    assert pairs(index.query(asked(df), 5, probes=every)) == exact
    index.save(str(tmp_path / "index"))
    again = ProjectionIndex.load(spark, str(tmp_path / "index"))
    assert again.probes == index.probes
    assert pairs(again.query(asked(df), 5)) == pairs(index.query(asked(df), 5))


def test_a_third_of_equal_rows_and_structureless_ones(spark):
    rng = np.random.default_rng(5)
    m = rng.standard_normal((1500, 16))
    m[::3] = m[0]
    df = frame(spark, m)
    index = ProjectionIndex.build(df, bucket_rows=16)
    q = asked(df, 7)
    found, exact = pairs(index.query(q, 5)), pairs(top_k_cosine(df, q, 5))
    assert len(found.keys() & exact.keys()) >= 0.9 * len(exact)


def test_odd_rows(spark):
    rows = [(1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, [0.0, 0.0]),
            (6, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [-1.0, 0.5])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("bucket", F.lit("x"))
    index = ProjectionIndex.build(df, bucket_rows=1)
    got = pairs(index.query(df.withColumnRenamed("vec_id", "query_id"), 9, probes=64))
    assert {q for q, _ in got} == {5, 6, 7, 8} and len(got) == 16
    assert got[(6, 6)] == (1.0, 1) and got[(6, 7)] == (1.0, 2) and got[(5, 5)][0] == 0.0
    none = ProjectionIndex.build(df.limit(0))
    assert none.query(df.withColumnRenamed("vec_id", "query_id")).count() == 0
    assert index.query(df.limit(0).withColumnRenamed("vec_id", "query_id")).count() == 0
    with pytest.raises(ValueError):
        index.query(df.withColumnRenamed("vec_id", "query_id"), 0)


def test_the_last_probe_has_its_cost(monkeypatch):
    rng = np.random.default_rng(2)
    for listed in (16, 0):
        monkeypatch.setattr(projections, "LISTED_PLANES", listed)
        values = rng.standard_normal(6)
        costs = sorted(sum(values[i] ** 2 for i in s) for n in range(7) for s in itertools.combinations(range(6), n))
        assert [furthest_probe(values, n) for n in range(1, 64)] == pytest.approx(costs[:63])
        assert furthest_probe(values, 64) == float("inf")


def test_a_query_is_stored_once_however_many_buckets_it_visits(spark, grouped, monkeypatch):
    df, kept = frame(spark, grouped[:800]), {}
    index = ProjectionIndex.build(df, bucket_rows=16)
    store = projections.stored
    monkeypatch.setattr(projections, "stored", lambda rows, name: kept.setdefault(name, store(rows, name)))
    assert index.query(asked(df), 5, probes=20).count() == 200
    assert sum(t.count() for t in kept.values()) == 40
