import math

import numpy as np
import pytest

from tidemark.operators import classify, explain, metrics

TRAIN = [
    ("An annual fee and a foreign purchase that is not mine stand on the credit card bill", "Credit Card"),
    ("The bureau lists a stranger's address and a closed loan in my credit report", "Credit Reporting"),
    ("A collector rings at night about a debt that belongs to somebody else", "Debt Collection"),
    ("The lender counts our mortgage escrow twice and will not correct it", "Mortgages & Loans"),
    ("My bank keeps a deposit from the savings account for a monthly charge", "Retail Banking"),
]
VALIDATION = [
    ("Purchase on the card bill that I never made", "Credit Card"),
    ("Closed account still open in the bureau report", "Credit Reporting"),
    ("Collector wants money for an unknown debt", "Debt Collection"),
    ("Escrow of the mortgage does not add up", "Mortgages & Loans"),
    ("Cash deposit never reached the savings account", "Retail Banking"),
]


@pytest.fixture(scope="module")
def model(spark):
    train = spark.createDataFrame(TRAIN * 10, "text string, category string")
    held_out = spark.createDataFrame(VALIDATION * 4, "text string, category string")
    return classify.TextClassifier.fit(train).calibrate(held_out)


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(
        [(1, "a purchase on the credit card bill"), (2, "escrow and mortgage of the lender"),
         (3, "xyzzy"), (4, "")], "doc_id bigint, text string")


def test_probabilities_and_reload(spark, model, asked, tmp_path):
    rows = model.predict(asked).orderBy("doc_id").collect()
    for r in rows:
        assert abs(sum(r["probabilities"]) - 1) < 1e-9
        assert r["prediction"] in model.classes and 0 <= r["entropy_score"] <= 1
        ps = [e["p"] for e in r["ranked_probabilities"]]
        assert ps == sorted(ps, reverse=True) and len(ps) == 5
    assert rows[0]["prediction"] == "Credit Card" and rows[1]["prediction"] == "Mortgages & Loans"
    model.save(str(tmp_path / "m"))
    again = classify.TextClassifier.load(spark, str(tmp_path / "m")).predict(asked).orderBy("doc_id").collect()
    assert [r["probabilities"] for r in again] == [r["probabilities"] for r in rows]


def test_regression_minimises_the_penalised_loss(spark, model):
    """The gradient of sum of weighted log-loss plus half the squared weights vanishes."""
    train = spark.createDataFrame(TRAIN * 10, "text string, category string")
    rows = model.margins(train, "text", keep_vectors=True).collect()
    coef = model.regression.coefficientMatrix.toArray()
    grad = coef / classify.C
    for r in rows:
        p = np.array(r["probabilities"])
        p[model.classes.index(r["category"])] -= 1
        for i, w in zip(r["_idx"], r["_weights"]):
            grad[:, i] += p * w
    assert np.abs(grad).max() < 0.05 * np.abs(coef).max()


def test_sigmoids_equal_a_direct_fit(spark):
    rng = np.random.default_rng(3)
    labels = rng.integers(0, 3, 200)
    margins = rng.standard_normal((200, 3)) + 1.5 * np.eye(3)[labels]
    df = spark.createDataFrame([(str(y), [float(v) for v in m]) for y, m in zip(labels, margins)],
                               "label string, margins array<double>")
    counts = {str(k): int((labels == k).sum()) for k in range(3)}
    got = classify.fit_sigmoids(df, ["0", "1", "2"], counts)
    for k in range(3):
        pos = counts[str(k)]
        t = np.where(labels == k, (pos + 1) / (pos + 2), 1 / (200 - pos + 2))
        a, b = 0.0, 0.0
        for _ in range(100):
            p = 1 / (1 + np.exp(-(a * margins[:, k] + b)))
            x = np.stack([margins[:, k], np.ones(200)])
            step = np.linalg.solve((x * p * (1 - p)) @ x.T, x @ (p - t))
            a, b = a - step[0], b - step[1]
        assert abs(got[k][0] - a) < 1e-3 and abs(got[k][1] - b) < 1e-3


def test_explanations_equal_brute_force(model, asked):
    predicted = {r["doc_id"]: r for r in model.predict(asked, keep_vectors=True).collect()}
    coefs = model.regression.coefficientMatrix.toArray()
    for e in explain.explain(model, asked, "text").collect():
        r = predicted[e["doc_id"]]
        k, j = (model.classes.index(r[c]) for c in ("prediction", "runner_up"))
        all_ = [(model.features.terms[i], w * coefs[k, i], w * (coefs[k, i] - coefs[j, i]))
                for i, w in zip(r["_idx"], r["_weights"])]
        pos = sorted([(-round(c, 4), t) for t, c, _ in all_ if round(c, 4) > 0])[:6]
        neg = sorted([(round(c, 4), t) for t, c, _ in all_ if round(c, 4) < 0])[:6]
        con = sorted([(-round(c, 4), t) for t, _, c in all_ if c > 0])[:6]
        assert [f["term"] for f in e["top_positive"]] == [t for _, t in pos]
        assert [f["term"] for f in e["top_negative"]] == [t for _, t in neg]
        assert [f["term"] for f in e["contrastive"]] == [t for _, t in con]
        if not all_:
            assert e["summary_text"] == explain.NO_TERMS
        else:
            assert e["summary_text"].startswith(f"Assigned '{r['prediction']}'")


def test_metrics(spark):
    rows = [("a", "a", 0, [0.9, 0.1, 0.0]), ("b", "a", 1, [0.5, 0.4, 0.1]), ("b", "b", 1, [0.2, 0.8, 0.0]),
            ("c", "b", 2, [0.1, 0.6, 0.3])]
    df = spark.createDataFrame(rows, "label string, prediction string, label_index int, probabilities array<double>")
    m = metrics.evaluation(df).first()
    assert m["accuracy"] == 0.5 and m["macro_recall"] == 0.5 and m["macro_precision"] == 0.3333
    assert m["log_loss"] == round(-sum(map(math.log, (0.9, 0.4, 0.8, 0.3))) / 4, 4)
    assert m["brier_score"] == round((0.02 + 0.62 + 0.08 + 0.86) / 4, 4)
    grid = {(r["actual"], r["predicted"]): r["n"] for r in metrics.confusion(df).collect()}
    assert len(grid) == 9 and grid[("b", "a")] == 1 and grid[("c", "c")] == 0
    perfect = spark.createDataFrame([("a", "a", 0, [1.0, 0.0]), ("b", "b", 1, [0.0, 1.0])], df.schema)
    assert metrics.evaluation(perfect).first()["brier_score"] == 0.0


def test_uncertainty_gate(spark):
    rows = [(1, [0.9, 0.05, 0.05]), (2, [0.5, 0.45, 0.05]), (3, [0.36, 0.33, 0.31]), (4, [0.5, 0.5, 0.0])]
    df = spark.createDataFrame(rows, "i int, probabilities array<double>")
    got = {r["i"]: r for r in classify.with_confidence(df, ["x", "y", "z"]).collect()}
    assert got[1]["status"] == "Confident" and not got[1]["is_uncertain"]
    assert got[2]["status"] == "Moderate Confidence"
    assert got[3]["is_uncertain"] and got[3]["status"].startswith("Uncertain")
    assert got[4]["prediction"] == "x" and got[4]["runner_up"] == "y"


def test_a_fit_reads_each_text_at_most_twice(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            if "text" in b.schema.names:
                read.add(b.num_rows)
            yield b

    rows = [(f"card bill number word{i % 7} fee", "a") if i % 2 else (f"loan house rate word{i % 5} bank", "b") for i in range(60)]
    df = spark.createDataFrame(rows, "text string, category string")
    model = classify.TextClassifier.fit(df.mapInArrow(count, df.schema), max_iter=5)
    # Once for the labels, once for the words.
    assert read.value <= 120 and {"card bill", "loan house"} <= set(model.features.terms)
