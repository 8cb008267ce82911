"""Queries: classification, calibration, evaluation and explanation."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tidemark.functions import lexicon
from tidemark.operators import classify, explain, metrics, vectors
from tidemark.operators.sizing import collect_bounded
from tidemark.plans import training
from tidemark.plans.catalog import sql
from tidemark.plans.catalog.themes import _UNIT, _means, unit_embeddings
from tidemark.session import scratch_path
from tidemark.sources import complaints as corpus_source, intake, reports

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


_SPLIT: dict = {}
_TRAINED: dict = {}


def once(cache, spark, sf, make):
    """Made once per session and data set; the first query that asks pays for it."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in cache:
        cache[key] = make()
    return cache[key]


def rows(spark, sf):
    return once(_SPLIT, spark, sf, lambda: training.split_corpus(
        corpus_source.corpus(intake.complaints(spark, sf))))


def trained(spark, sf):
    """The calibrated classifier of a session and data set."""
    return once(_TRAINED, spark, sf, lambda: training.train(rows(spark, sf)))


N_CLASSES = 10
CLASSES = [str(i) for i in range(N_CLASSES)]


def soft_labels(spark, sf):
    """Vectors with a probability per label from the softmax of their similarities to the label centroids."""
    e = unit_embeddings(spark, sf)
    means = collect_bounded(vectors.group_means(e, "label").select("label", "centroid"), N_CLASSES)
    centroids = lexicon.literal([r["centroid"] for r in sorted(means)], "array<array<double>>")
    raw = F.transform(centroids, lambda c: F.exp(8 * F.aggregate(
        F.zip_with("embedding", c, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)))
    out = e.select("vec_id", F.col("label").alias("label_index"), raw.alias("_e")).withColumn(
        "_s", F.array_repeat(F.aggregate("_e", F.lit(0.0), lambda a, x: a + x), N_CLASSES))
    out = out.withColumn("probabilities", F.zip_with("_e", "_s", lambda x, s: x / s))
    out = out.withColumn("label", F.col("label_index").cast("string")).drop("_e", "_s")
    return classify.with_confidence(out, CLASSES)


_SOFT = f"""{_UNIT}, {_means("unit_e", "label", "m")},
cs AS (SELECT list(c ORDER BY label) AS cs FROM m),
x AS (SELECT vec_id, label, list_transform(cs, lambda c: exp(8 * list_dot_product(v, c))) AS e FROM unit_e, cs),
soft AS (SELECT vec_id, label::VARCHAR AS label, label AS label_index, list_transform(e, lambda v: v / list_sum(e)) AS p FROM x),
pred AS (SELECT *, list_max(p) AS top, (list_position(p, list_max(p)) - 1)::VARCHAR AS prediction,
  -list_sum(list_transform(p, lambda v: CASE WHEN v > 0 THEN v * ln(v) ELSE 0 END)) / ln({N_CLASSES}) AS h FROM soft)"""
_PER_CLASS = """labels AS (SELECT label AS c FROM pred UNION SELECT prediction FROM pred),
k AS (SELECT c AS class, count(*) FILTER (label = c AND prediction = c) AS tp, count(*) FILTER (label = c) AS support,
  count(*) FILTER (prediction = c) AS predicted FROM labels, pred GROUP BY c),
pc AS (SELECT class, CASE WHEN predicted = 0 THEN 0 ELSE tp::DOUBLE / predicted END AS precision,
  CASE WHEN support = 0 THEN 0 ELSE tp::DOUBLE / support END AS recall,
  CASE WHEN support + predicted = 0 THEN 0 ELSE 2 * tp::DOUBLE / (support + predicted) END AS f1, support, tp FROM k)"""


@query(
    "c3_class_weights",
    sql.with_(sql.CORPUS) + """SELECT category, round(sum(count(*)) OVER ()::DOUBLE / (count(*) OVER () * count(*)), 6) AS weight
      FROM corpus GROUP BY category""",
)
def class_weights(spark, sf):
    c = corpus_source.corpus(intake.complaints(spark, sf))
    return classify.class_weights(c, "category").withColumn("weight", F.round("weight", 6))


@query(
    "c8_uncertainty_gate",
    sql.with_(_SOFT) + """SELECT vec_id, prediction, round(top, 4) AS confidence, round(h, 4) AS entropy_score,
      top < 0.40 OR h > 0.82 AS is_uncertain, CASE WHEN top >= 0.70 THEN 'Confident' WHEN top >= 0.40
      THEN 'Moderate Confidence' ELSE 'Uncertain / Low Confidence' END AS status FROM pred""",
)
def uncertainty_gate(spark, sf):
    """Argmax, confidence, entropy and status."""
    return soft_labels(spark, sf).select(
        "vec_id", "prediction", "confidence", "entropy_score", "is_uncertain", "status")


@query(
    "o2_w5_ranked_probabilities",
    sql.with_(_SOFT, """u AS (SELECT vec_id, unnest(p) AS p, generate_subscripts(p, 1) - 1 AS k FROM pred)""")
    + """SELECT vec_id, k::VARCHAR AS class, round(p, 4) AS p, (row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, k))::INTEGER AS rank FROM u""",
)
def ranked_probabilities(spark, sf):
    """Classes by falling probability; the runner-up has rank 2."""
    s = soft_labels(spark, sf)
    return s.select("vec_id", F.posexplode("ranked_probabilities").alias("i", "e")).select(
        "vec_id", F.col("e.class").alias("class"), F.col("e.p").alias("p"),
        (F.col("i") + 1).alias("rank"))


@query(
    "c11_model_metrics",
    sql.with_(_SOFT, _PER_CLASS) + """SELECT round(sum(tp)::DOUBLE / sum(support), 4) AS accuracy, round(avg(f1), 4) AS macro_f1,
      round(sum(f1 * support) / sum(support), 4) AS weighted_f1, round(avg(precision), 4) AS macro_precision,
      round(avg(recall), 4) AS macro_recall, (SELECT round(avg(-ln(p[label_index + 1])), 4) FROM pred) AS log_loss,
      (SELECT round(avg(list_sum(list_transform(p, lambda v, i: power(v - CASE WHEN i = label_index + 1 THEN 1 ELSE 0 END, 2)))), 4) FROM pred) AS brier_score
      FROM pc""",
)
def model_metrics(spark, sf):
    """Averages, log-loss and Brier score."""
    return metrics.evaluation(soft_labels(spark, sf))


@query(
    "c12_per_class_metrics",
    sql.with_(_SOFT, _PER_CLASS)
    + "SELECT class, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, support FROM pc",
)
def per_class_metrics(spark, sf):
    return metrics.rounded(metrics.per_class(soft_labels(spark, sf)).drop("tp"))


@query(
    "c13_confusion_matrix",
    sql.with_(_SOFT, "labels AS (SELECT label AS c FROM pred UNION SELECT prediction FROM pred)")
    + """SELECT a.c AS actual, b.c AS predicted, count(p.vec_id) AS n,
      round(coalesce(count(p.vec_id)::DOUBLE / nullif(sum(count(p.vec_id)) OVER (PARTITION BY a.c), 0), 0), 4) AS row_share
      FROM labels a CROSS JOIN labels b LEFT JOIN pred p ON p.label = a.c AND p.prediction = b.c GROUP BY a.c, b.c""",
)
def confusion_matrix(spark, sf):
    return metrics.rounded(metrics.confusion(soft_labels(spark, sf)))


def beside_constant(spark, sf):
    """Predictions of the soft labels, and of a model that answers the first label and is sure of nothing."""
    soft = soft_labels(spark, sf)
    constant = soft.withColumn("prediction", F.lit(CLASSES[0])).withColumn(
        "probabilities", F.array_repeat(F.lit(1.0 / N_CLASSES), N_CLASSES))
    return {"baseline": constant, "improved_calibrated": soft}


_BESIDE = sql.with_(
    _SOFT, _PER_CLASS,
    f"""base_pred AS (SELECT * REPLACE ('{CLASSES[0]}' AS prediction,
      list_transform(p, lambda v: (1.0 / {N_CLASSES})::DOUBLE) AS p) FROM pred)""",
    re.sub(r"\b(pred|labels|k|pc)\b", r"base_\1", _PER_CLASS),
    *[f"""{name}averages AS (SELECT round(sum(tp)::DOUBLE / sum(support), 4) AS accuracy, round(avg(f1), 4) AS macro_f1,
      round(avg(recall), 4) AS macro_recall, (SELECT round(avg(-ln(p[label_index + 1])), 4) FROM {name}pred) AS log_loss
      FROM {name}pc)""" for name in ("", "base_")])


@query("c17_metric_deltas", _BESIDE + "SELECT " + ", ".join(
    f"round(a.{c} - b.{c}, 4) AS {c}_delta" for c in ("accuracy", "macro_f1", "macro_recall", "log_loss"))
    + " FROM averages a, base_averages b")
def metric_deltas(spark, sf):
    """What the soft labels gain over the constant answer."""
    report = None
    for name, predicted in beside_constant(spark, sf).items():
        one = metrics.evaluation(predicted).withColumn("model", F.lit(name))
        report = one if report is None else report.unionByName(one)
    return metrics.deltas(report)


@query("s5_model_report_rows", _BESIDE + " UNION ALL ".join(
    f"""SELECT '{model}' AS model, accuracy, macro_f1, class, round(precision, 4) AS precision, round(recall, 4) AS recall,
      round(f1, 4) AS f1, support, TRUE AS has_time FROM {name}averages, {name}pc"""
    for name, model in (("", "improved_calibrated"), ("base_", "baseline"))))
def model_report_rows(spark, sf):
    """A report of two models with the time of its run, written as JSON, read back and flattened (also F8)."""
    doc = reports.stamped(reports.model_report({
        name: (metrics.evaluation(p), metrics.rounded(metrics.per_class(p))) for name, p in beside_constant(spark, sf).items()}))
    path = scratch_path(spark, "classification-report")
    reports.write_report(doc, path)
    back = reports.read_report(spark, path, reports.CLASSIFICATION_REPORT)
    # The time itself differs from run to run.
    known = back.select(F.try_to_timestamp("generated_at") <= F.current_timestamp()).scalar()
    return reports.model_rows(back).withColumn("has_time", known)


@query("c1_c7_calibrated_predictions")
def calibrated_predictions(spark, sf):
    """Improved, calibrated model on the test split."""
    p = trained(spark, sf).predict(training.part(rows(spark, sf), "test"), "text")
    return p.select("doc_id", "category", "prediction", "confidence", "entropy_score",
                    "is_uncertain", "status")


@query("c5_probability_sums",
       sql.with_(sql.CORPUS) + """SELECT ceil(round(0.15::DOUBLE * count(*), 9))::BIGINT AS rows_scored,
         1.0::DOUBLE AS lowest_sum, 1.0::DOUBLE AS highest_sum FROM corpus""")
def probability_sums(spark, sf):
    """Calibrated probabilities of a row add up to 1."""
    p = trained(spark, sf).predict(training.part(rows(spark, sf), "test"), "text")
    total = F.aggregate("probabilities", F.lit(0.0), lambda a, x: a + x)
    return p.agg(F.count("*").alias("rows_scored"), F.round(F.min(total), 6).alias("lowest_sum"),
                 F.round(F.max(total), 6).alias("highest_sum"))


@query("c10_coefficients")
def coefficients(spark, sf):
    return trained(spark, sf).coefficient_table()


@query("c16_c17_model_comparison")
def model_comparison(spark, sf):
    """Three stages on the same test split, with the final model's gain over the baseline."""
    report, _ = training.compare_models(rows(spark, sf))
    d = metrics.deltas(report)
    return report.withColumn("gains", F.to_json(d.select(F.struct("*")).scalar()))


@query("k14_k16_explanations")
def explanations(spark, sf):
    """Positive, negative and contrastive terms of every test prediction."""
    test = training.part(rows(spark, sf), "test")
    out = explain.explain(trained(spark, sf), test, "text")
    return out.select("doc_id", "prediction", "runner_up", F.to_json("top_positive").alias("top_positive"),
                      F.to_json("top_negative").alias("top_negative"),
                      F.to_json("contrastive").alias("contrastive"), "summary_text")


@query("s6_saved_classifier_round_trip",
       sql.with_(sql.CORPUS) + """SELECT 0::BIGINT AS differing_rows,
         ceil(round(0.15::DOUBLE * count(*), 9))::BIGINT AS answers FROM corpus""")
def saved_classifier_round_trip(spark, sf):
    """A reloaded classifier predicts like the saved one: differing rows, expected none."""
    path = scratch_path(spark, "classifier")
    model = trained(spark, sf)
    model.save(path)
    test = training.part(rows(spark, sf), "test")
    cols = ("doc_id", "prediction", "confidence")
    a = model.predict(test, "text").select(*cols)
    b = classify.TextClassifier.load(spark, path).predict(test, "text").select(*cols)
    return a.exceptAll(b).unionAll(b.exceptAll(a)).agg(
        F.count("*").alias("differing_rows"), F.lit(b.count()).alias("answers"))


