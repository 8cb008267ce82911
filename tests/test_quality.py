import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import quality


def plain(labels, m):
    """Davies-Bouldin by its definition; clusters in one place have no ratio."""
    ids = sorted(set(labels) - {-1})
    parts = [m[np.array(labels) == i] for i in ids]
    c = [p.mean(axis=0) for p in parts]
    s = [np.mean(np.linalg.norm(p - x, axis=1)) for p, x in zip(parts, c)]
    worst = []
    for i in range(len(ids)):
        far = [(s[i] + s[j]) / np.linalg.norm(c[i] - c[j]) for j in range(len(ids))
               if j != i and np.linalg.norm(c[i] - c[j]) > 0]
        worst.append(max(far, default=0.0))
    return np.mean(worst) if len(ids) > 1 else None


def frame(spark, labels, m):
    return spark.createDataFrame([(int(c), [float(x) for x in v]) for c, v in zip(labels, m)],
                                 "cluster_id int, embedding array<double>")


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_centroid_pairs_by_blocks(spark, block):
    rng = np.random.default_rng(2)
    labels = rng.integers(-1, 11, 300)
    m = rng.standard_normal((300, 6)) + labels[:, None] * 0.3
    got = quality.davies_bouldin(frame(spark, labels, m), block=block).first()[0]
    assert got == pytest.approx(plain(list(labels), m), rel=1e-9)


def test_clusters_in_one_place_single_clusters_and_none(spark):
    m = np.array([[0.0, 0.0], [2.0, 0.0], [1.0, 1.0], [1.0, -1.0], [9.0, 0.0]])
    assert quality.davies_bouldin(frame(spark, [0, 0, 1, 1, 2], m), block=2).first()[0] == pytest.approx(
        plain([0, 0, 1, 1, 2], m))
    assert quality.davies_bouldin(frame(spark, [0, 0, 1, 1, -1], m), block=1).first()[0] == 0.0
    assert quality.davies_bouldin(frame(spark, [0, 0, 0, -1, -1], m)).first()[0] is None
    assert quality.davies_bouldin(frame(spark, [-1] * 5, m)).first()[0] is None
    assert quality.davies_bouldin(frame(spark, [-1], m[:1]).withColumn("id", F.lit("x")).limit(0)).first()[0] is None
