import pytest

from tidemark.operators import classify, clustering, retrieval
from tidemark.functions.text import with_clean_text
from tidemark.plans import triage
from tests.test_classify import TRAIN, VALIDATION

WIRE = ("An unauthorized wire transfer took all that my savings account held. My bank calls it my own fault, "
        "and nobody there has answered since I told them about the fraud.")
HARASS = ("A collector threatens me with arrest and wage garnishment about a debt of somebody else, rings at night, "
          "and went on after my attorney wrote to the debt collector.")
PIZZA = "The pizza was burnt and the waiter laughed about it."


@pytest.fixture(scope="module")
def arriving(spark):
    return spark.createDataFrame([(1, WIRE), (2, HARASS), (3, PIZZA), (4, None)],
                                 "doc_id bigint, narrative string")


def test_full_triage(spark, arriving):
    rows = [(100 + i, t, c) for i, (t, c) in enumerate((TRAIN + VALIDATION) * 4)]
    cases = spark.createDataFrame(rows, "doc_id bigint, narrative string, category string")
    cleaned = with_clean_text(cases)
    model = classify.TextClassifier.fit(cleaned, "cleaned").calibrate(cleaned, "cleaned")
    index = retrieval.TfidfIndex.build(cases)
    topic_model = clustering.TopicModel.fit(cleaned, n_clusters=5)
    got = {r["doc_id"]: r for r in triage.analyze(arriving, model, index, cases, topic_model, 3).collect()}
    assert set(got) == {1, 2, 3, 4}
    for i in (3, 4):
        r = got[i]
        assert not r["in_domain"] and r["category"] == "Out of Domain" and r["sla_hours"] == 72
        assert r["target_queue"] == "Unsupported Input Review" and r["explanation"] is None
        assert r["similar_complaints"] == [] and r["all_probabilities"] is None
    assert got[2]["category"] == "Debt Collection" and got[2]["priority"] in ("P1 - Critical", "P2 - High")
    assert got[1]["risk_score"] >= 0.30 and got[1]["severity_level"] in ("Medium", "High", "Critical")
    for i in (1, 2):
        r = got[i]
        assert r["in_domain"] and r["suggested_actions"] and r["triage_rationale"]
        assert [m["rank"] for m in r["similar_complaints"]] == [1, 2, 3]
        assert "primarily due to" in r["explanation"] and len(r["all_probabilities"]) == 5
        assert r["assigned_cluster_id"] is not None


def test_without_models(spark, arriving):
    got = {r["doc_id"]: r for r in triage.analyze(arriving).collect()}
    assert got[1]["category"] == "Unclassified" and got[1]["confidence"] == 0.5 and got[1]["is_uncertain"]
    assert got[1]["classification_status"] == "Model unavailable"
    assert got[1]["sub_issue"] == "General Financial Complaint"


def test_request_checks(spark):
    df = spark.createDataFrame([("ok", 4), (" ", 4), (None, 4), ("ok", 0), ("ok", 21)], "narrative string, k int")
    got = [r[0] for r in df.select(triage.request_problem("narrative", "k")).collect()]
    assert got[0] is None and all(got[1:])
    with pytest.raises(ValueError):
        triage.check_top_k(21)
