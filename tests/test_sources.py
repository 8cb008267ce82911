import os
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import types as T

from tidemark.session import scratch_path
from tidemark.sources import complaints, reports

SCHEMA = T.StructType([T.StructField("product", T.StringType()), T.StructField("narrative", T.StringType()),
                       T.StructField("n", T.IntegerType())])
FILES = {
    "a.csv": 'product,narrative,n\ncredit_card,"one, ""two""\nthree",5\nmortgage,short\nx,y,zz\nx,y,7,8\n,,\n'
             'x,y,zz\n"",é,1\n\n"m\nm",q\n',
    "b.csv": "product,narrative,n\nq," + "long " * 50_000 + ",3\n",
    "c.csv": 'product,narrative,n\nq,fine,4\nq,"never closed,5\nq,lost,6\n',
    "d.csv": "product,narrative,n\n",
}


@pytest.fixture(scope="module")
def tables(spark):
    path = scratch_path(spark, "csv-test")
    os.makedirs(path)
    for name, text in FILES.items():
        with open(f"{path}/{name}", "w", encoding="utf-8") as f:
            f.write(text)
    return complaints.read_all(spark, path, SCHEMA)


def test_good_records(tables):
    got = sorted(map(tuple, tables[0].collect()), key=str)
    assert got == sorted([
        ("credit_card", 'one, "two"\nthree', 5), (None, None, None), ("", "é", 1),
        ("q", "long " * 50_000, 3), ("q", "fine", 4)], key=str)


def test_rejected_records(tables):
    got = sorted((r["file"].rsplit("/", 1)[1], r["record"], r["reason"]) for r in tables[1].collect())
    assert got == sorted([
        ("a.csv", "mortgage,short", "columns"), ("a.csv", "x,y,zz", "values"), ("a.csv", "x,y,7,8", "columns"),
        ("a.csv", "x,y,zz", "values"), ("a.csv", '"m\nm",q', "columns"),
        ("c.csv", 'q,"never closed,5\nq,lost,6', "columns")])


def test_one_column_of_each(tables):
    # Pruned columns do not change which records are good.
    assert tables[0].select("product").count() == 5 and tables[1].select("reason").count() == 6


def test_lines_add_up_where_no_record_spans_them(spark):
    path = scratch_path(spark, "csv-lines")
    os.makedirs(path)
    lines = [f"p,{i},{i if i % 3 else 'none'}{',x' if i % 5 == 0 else ''}" for i in range(1_000)]
    with open(f"{path}/lines.csv", "w") as f:
        f.write("\n".join(["product,narrative,n", *lines]) + "\n")
    good, rejected = complaints.read_all(spark, path, SCHEMA, multi_line=False)
    assert good.count() + rejected.count() == len(lines)
    reasons = {r["reason"]: r["count"] for r in rejected.groupBy("reason").count().collect()}
    assert reasons == {"columns": 200, "values": sum(i % 3 == 0 and i % 5 > 0 for i in range(1_000))}


def test_missing_path(spark):
    with pytest.raises(AnalysisException):
        complaints.read_all(spark, "/tmp/no/such/folder", SCHEMA)


def test_report_of_models_with_its_time(spark):
    averages = spark.createDataFrame([(0.5, 0.25)], "accuracy double, macro_f1 double")
    classes = spark.createDataFrame([("b", 0.5, 1.0, 0.25, 3), ("a", 0.0, 0.0, 0.0, 0)],
                                    "class string, precision double, recall double, f1 double, support bigint")
    path = scratch_path(spark, "report-test")
    reports.write_report(reports.stamped(reports.model_report({"m": (averages, classes), "n": (averages, classes)})), path)
    back = reports.read_report(spark, path, reports.CLASSIFICATION_REPORT)
    when = datetime.fromisoformat(back.first()["generated_at"])
    assert when.utcoffset() == timedelta(0) and abs(datetime.now(timezone.utc) - when) < timedelta(minutes=10)
    got = sorted(map(tuple, reports.model_rows(back).collect()))
    assert got == [(m, 0.5, 0.25, *c) for m in "mn" for c in [("a", 0.0, 0.0, 0.0, 0), ("b", 0.5, 1.0, 0.25, 3)]]
