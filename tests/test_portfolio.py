import json
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import portfolio

SCHEMA = "category string, sub_issue string, severity_level string, risk_score double, narrative string"
ROWS = [(f"c{i % 3}", f"s{i % 7}", portfolio.TIER_ORDER[i % 4], round(i % 5 * 0.2, 2), "w " * (i % 11)) for i in range(200)]
ROWS += [("c0", "s0", "Low", 0.0, "long " * 5_000), ("c0", "s0", "Low", 0.0, "")] + [("hot", "s1", "High", 0.5, "a b")] * 100


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_counts_equal_plain_groups(scored):
    got = Counter()
    for r in portfolio.section_counts(scored).collect():
        keys = portfolio.SECTIONS[r["section"]]
        assert all(r[k] is None for k in portfolio._KEYS if k not in keys)
        got[(r["section"], *(r[k] for k in keys))] += r["complaints"]
    want = Counter()
    for c, s, t, risk, text in ROWS:
        row = {"category": c, "sub_issue": s, "severity_level": t, "risk_score": risk, "n_words": len(text.split())}
        for section, keys in portfolio.SECTIONS.items():
            want[(section, *(row[k] for k in keys))] += 1
    assert got == want


def test_document(scored):
    doc = json.loads(portfolio.summary_document(scored).select(F.to_json(F.struct("*"))).first()[0])
    words, risk = [len(r[4].split()) for r in ROWS], [r[3] for r in ROWS]
    assert doc["total_complaints"] == len(ROWS)
    assert doc["category_counts"] == Counter(r[0] for r in ROWS)
    assert sum(doc["severity_percentages"].values()) == pytest.approx(100, abs=0.05)
    assert doc["mean_risk_score"] == pytest.approx(np.mean(risk), abs=6e-4)
    assert doc["median_risk_score"] == pytest.approx(np.median(risk), abs=6e-4)
    assert doc["narrative_length_stats"] == {
        "mean_words": pytest.approx(np.mean(words), abs=0.06), "median_words": int(np.percentile(words, 50)),
        "p90_words": int(np.percentile(words, 90)), "max_words": 5_000}
    assert doc["severity_by_category"]["hot"] == {"High": 100}
    assert all(len(v) <= 5 for v in doc["sub_issues_by_category"].values())
    assert list(doc["category_counts"]) == sorted(doc["category_counts"])


def test_nulls_and_empty(spark, scored):
    odd = spark.createDataFrame([(None, None, None, None, None), ("c", "s", "Low", 0.1, "x y")], SCHEMA)
    row = portfolio.summary_document(odd).first()
    assert row["total_complaints"] == 2 and row["category_counts"] == {"c": 1}
    none = portfolio.summary_document(scored.filter(F.lit(False))).first()
    assert none["total_complaints"] == 0 and none["category_counts"] == {} and none["mean_risk_score"] is None
