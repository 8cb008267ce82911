"""Every query with reference SQL is run at the smallest scale by tools/check_oracle.py; here a sample is."""

import duckdb
import pytest
from pyspark.errors import AnalysisException

import __spark_entry__ as entry
from tidemark.sources import complaints as source
from tools.check_oracle import TABLES, rows_of

SAMPLE = ["s1_csv_round_trip", "t1_clean_text", "x2_stratified_split", "k8_k13_routing", "k18_similar_cases",
          "g14_surge_alerts", "c11_model_metrics", "r2_weekly_theme_stream"]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_reference_sql(spark, sf, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    res = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in res.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, res.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_missing_path(spark):
    with pytest.raises(AnalysisException):
        source.read_csv(spark, "/tmp/no/such/complaints.csv").count()


def test_labels_and_blanks(spark):
    df = spark.createDataFrame(
        [(1, "a\tb", "credit_card"), (2, " \n ", "credit_card"), (3, "x", "other"), (4, None, "credit_card"),
         (5, "x", None), (6, "<p>", "retail_banking")], "doc_id int, narrative string, product string")
    assert {r["doc_id"] for r in source.labelled(df).collect()} == {1, 2, 6}
    assert {r["doc_id"]: r["category"] for r in source.corpus(df).collect()} == {1: "Credit Card", 6: "Retail Banking"}
    assert {r["doc_id"] for r in source.corpus(df, clean=True).collect()} == {1}
