import numpy as np

from tests.llm.cases import ODD, SCHEMA, documents, with_clashes
from tidemark.llm import quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = quality.op3_quality(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = got.where("held_out").join(labels, "doc_id").select("score", "predicted", "quality").collect()
    score, y = np.array([r["score"] for r in rows]), np.array([r["quality"] for r in rows])
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(len(y))
    good = y == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() - 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.9
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.93
    assert np.mean([r["predicted"] for r in rows if r["quality"] == 1]) > 0.97
    assert 0 <= score.min() and score.max() <= 1


def test_only_texts_of_training_rows_matter(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "CASE WHEN pmod(crc32(cast(doc_id AS string)), 5) = 0 THEN 1 - quality ELSE quality END AS quality")
    a, b = (quality.score(docs, quality.fit_known(docs, x)).orderBy("doc_id") for x in (labels, flipped))
    assert [r["score"] for r in a.collect()] == [r["score"] for r in b.collect()]


def test_odd_rows_few_labels_and_clashing_columns(spark):
    df = with_clashes(documents(spark, ODD))
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.score(df, quality.fit(df, none))
    assert out.columns == df.columns and {r["rest"] for r in out.collect()} == {"own"}
    assert all(abs(r["score"] - 0.5) < 0.01 for r in out.collect())
    one = spark.createDataFrame([(4, 1), (5, 1), (4, None), (None, 0), (99, 0)], "doc_id long, quality int")
    assert all(r["score"] > 0.99 for r in quality.score(df, quality.fit(df, one)).collect())
    both = spark.createDataFrame([(4, 1), (5, 0), (6, 1), (6, 0)], "doc_id long, quality int")
    assert all(0 <= r["score"] <= 1 for r in quality.score(df, quality.fit(df, both)).collect())
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.score(empty, quality.fit(empty, both)).count() == 0
