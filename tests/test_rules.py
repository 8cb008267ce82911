import pytest
from pyspark.sql import functions as F

from tidemark.functions.domain import with_domain_gate
from tidemark.functions.routing import with_routing
from tidemark.functions.severity import with_severity
from tidemark.functions.sub_issue import with_sub_issue
from tidemark.functions.text import collapse_whitespace, is_blank, with_clean_text
from tidemark.policy import routing as policy

IN_DOMAIN = [
    "My savings account was emptied by a transfer that the bank cannot explain to me.",
    "TransUnion shows a loan from 2009 on my credit report although it was paid off.",
    "A collection agency writes to my parents about a debt of my former flatmate.",
    "The mortgage company lost two payments and now wants a late fee for each of them.",
    "My credit card issuer raised the interest rate after a single late payment.",
]
OUT_OF_DOMAIN = [
    "The pizza arrived burnt and the restaurant would not pick up the phone.",
    "Our flight left three hours late and the airline lost a suitcase full of gifts.",
    "My graphics card gets hot and the laptop shuts down during every game.",
    "The plumber left a hole in the kitchen wall and never came back to close it.",
    "The hotel room smelled of paint and the breakfast was cold on both mornings.",
]


def gate(spark, text):
    return with_domain_gate(spark.createDataFrame([(text,)], "narrative string")).first()


def test_domain_gate(spark):
    df = spark.createDataFrame([(t,) for t in IN_DOMAIN + OUT_OF_DOMAIN], "narrative string")
    got = {r["narrative"]: r for r in with_domain_gate(df).collect()}
    for t in IN_DOMAIN:
        assert got[t]["in_domain"] and got[t]["domain_score"] > 0.15
        assert got[t]["rejection_reason"] is None and got[t]["guidance"] is None
    for t in OUT_OF_DOMAIN:
        assert not got[t]["in_domain"] and got[t]["rejection_reason"] and got[t]["guidance"]


def test_domain_edges(spark):
    assert "Empty" in gate(spark, "")["rejection_reason"]
    assert "Empty" in gate(spark, None)["rejection_reason"]
    assert "too brief" in gate(spark, "bad day")["rejection_reason"]
    r = gate(spark, "clicking noises come from the graphics card fan next to my account")
    assert (r["domain_score"], r["unrelated_terms"]) == (0.1, ["clicking noises", "graphics card", "fan"])
    assert "clicking noises, graphics card, fan" in r["rejection_reason"]


def score(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, narrative string")
    return with_severity(with_clean_text(df)).orderBy("i").collect()


@pytest.mark.parametrize("text, expected, tier", [
    ("Please tell me on which day my statement is printed.", 0.0, "Low"),
    ("I am locked out and need the money today, this is urgent.", 0.25, "Medium"),
    ("Fraud emptied the account, it is urgent, and my attorney has written to the regulator.", 0.75, "Critical"),
    ("urgent and ignored", 0.40, "High"),
    ("fraud, urgent, thousands lost", 0.65, "Critical"),
    ("fraud urgent lawyer months thousands", 1.0, "Critical"),
    ("", 0.0, "Low"),
    (None, 0.0, "Low"),
])
def test_severity(spark, text, expected, tier):
    r = score(spark, text)[0]
    assert (r["risk_score"], r["severity_level"]) == (expected, tier)


def test_severity_evidence(spark):
    r = score(spark, "Foreclosure and wire fraud. The attorney will sue over wire-fraud issues.")[0]
    groups = {b["group_name"]: b["matched_keywords"] for b in r["signal_breakdown"]}
    assert groups["financial_harm"] == ["fraud", "wire fraud"]
    assert groups["urgency"] == groups["financial_magnitude"] == ["foreclosure"]
    assert groups["legal_regulatory"] == ["attorney", "sue"]
    assert r["detected_keywords"] == ["fraud", "wire fraud", "foreclosure", "attorney", "sue"]
    assert r["severity_explanation"].startswith("Assigned 'Critical' (score 0.85) due to: Financial Harm (weight 30%, matched: fraud, wire fraud); ")


@pytest.mark.parametrize("text, category, part", [
    ("Two unauthorized charges from a shop in another country are on the card.", "Credit Card", "Unauthorized"),
    ("The annual fee doubled and a late fee came on top of it.", "Credit Card", "Interest, Fees"),
    ("The dispute letter of spring lies at the bureau unanswered.", "Credit Reporting", "Dispute"),
    ("An unauthorized wire transfer left my account at night.", "Retail Banking", "Unauthorized"),
    ("The app says my account is locked and all funds are frozen.", "Retail Banking", "Lockout"),
    ("Nothing to match here", "No Such Category", "General Financial Complaint"),
    ("Nothing to match here", "Credit Card", "General Servicing"),
])
def test_sub_issue(spark, text, category, part):
    df = spark.createDataFrame([(text, category)], "cleaned string, category string")
    assert part in with_sub_issue(df).first()["sub_issue"]


def route(spark, category, score, tier, signals, confidence, uncertain=False):
    df = spark.createDataFrame(
        [(category, score, tier, signals, confidence, uncertain)],
        "category string, risk_score double, severity_level string, matched_signals array<string>, "
        "confidence double, is_uncertain boolean")
    return with_routing(df).first()


def test_routing(spark):
    r = route(spark, "Credit Reporting", 0.05, "Low", [], 0.81)
    assert (r["priority"], r["sla_hours"], r["escalation_required"]) == ("P4 - Routine", 72, False)
    assert r["target_queue"] == policy.QUEUES["Credit Reporting"]
    assert any("FCRA" in a for a in r["suggested_actions"])

    r = route(spark, "Credit Card", 0.41, "High", ["financial_harm"], 0.77)
    assert r["escalation_required"] and "Fraud" in r["target_queue"] and r["sla_hours"] == 24
    assert r["priority"] == "P2 - High" and any("affidavit" in a for a in r["suggested_actions"])

    r = route(spark, "Debt Collection", 0.7, "Critical", ["legal_regulatory", "financial_harm"], 0.66)
    assert r["priority"] == "P1 - Critical" and "Legal" in r["target_queue"] and r["sla_hours"] == 4
    assert any("litigation hold" in a for a in r["suggested_actions"])

    r = route(spark, "Retail Banking", 0.5, "High", ["urgency"], 0.8)
    assert "locked out" in r["escalation_reason"] and r["sla_hours"] == 12
    assert r["handling_tier"] == policy.TIER_POLICY["High"][2]

    r = route(spark, "Retail Banking", 0.25, "Medium", ["urgency"], 0.8)
    assert not r["escalation_required"] and r["priority"] == "P3 - Medium"

    r = route(spark, "Retail Banking", 0.3, "Medium", ["financial_harm"], 0.8)
    assert r["priority"] == "P2 - High"

    r = route(spark, "Retail Banking", 0.05, "Low", [], 0.35, True)
    assert r["target_queue"] == policy.MANUAL_REVIEW_QUEUE
    assert r["suggested_actions"] == [policy.LOW_CONFIDENCE_ADVICE % "35.0%"]
    assert r["triage_rationale"] == (
        "Classified as 'Retail Banking' with 35.0% confidence. Evaluated severity: 'Low' (score: 0.05). "
        f"Routed to '{policy.MANUAL_REVIEW_QUEUE}' with a 72h SLA.")


def test_filters_on_results_do_not_recompute_the_text(spark):
    df = spark.createDataFrame([("My bank account fee was charged",)], "narrative string")
    plan = with_severity(with_clean_text(df)).filter(F.col("severity_level") == "Low")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("regexp_replace(cleaned") < 20 and text.count("Generate inline") == 2


def test_blank_texts(spark):
    texts = ["", " ", "\t\n\u00a0\u2003", " x ", "\u200b", "\x00", "\x1c\x1f", None, "a" * 50]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    same = df.select(is_blank("t").alias("new"), (collapse_whitespace("t") == "").alias("old")).collect()
    assert [r["new"] for r in same] == [r["old"] for r in same] and [r["new"] for r in same][:4] == [True, True, True, False]
