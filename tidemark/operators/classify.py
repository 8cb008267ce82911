"""Linear text classifier: TF-IDF, multinomial logistic regression, sigmoid calibration."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.functions import lexicon
from tidemark.operators.sizing import collect_bounded
from tidemark.operators.tfidf import TfidfModel, Weighting, stored_words

# The two model configurations and the uncertainty gate.
BASELINE = Weighting(max_features=5_000, ngram_max=1, sublinear=False, min_df=1, max_df=1.0)
IMPROVED = Weighting(max_features=15_000, ngram_max=2, sublinear=True, min_df=3, max_df=0.95)
C = 1.0
CONFIDENCE_THRESHOLD = 0.40
ENTROPY_THRESHOLD = 0.82
CONFIDENT = 0.70
MAX_ITER = 1_000
TOLERANCE = 1e-4


def with_vector(df: DataFrame, size: int, idx: str = "idx", weights: str = "weights",
                out: str = "features") -> DataFrame:
    """Turns index and weight arrays into ML vectors, for which there is no built-in function.

    All columns pass through Arrow unchanged, so only narrow rows should be given.
    """
    packed = df.withColumn(out, F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"),
        F.col(idx).alias("indices"), F.col(weights).alias("values"))).drop(idx, weights)
    schema = T.StructType([
        T.StructField(f.name, VectorUDT()) if f.name == out else f for f in packed.schema.fields])

    def same(batches):
        yield from batches

    return packed.mapInArrow(same, schema)


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """``n / (classes * n_class)`` per class."""
    counts = df.groupBy(label).agg(F.count("*").alias("_k"))
    totals = counts.agg(F.struct(F.sum("_k").alias("n"), F.count("*").alias("c"))).scalar()
    return counts.select(label, (totals["n"] / (totals["c"] * F.col("_k"))).alias("weight"))


def entropy(probabilities: Column | str) -> Column:
    """Shannon entropy to the base of the number of classes, so within [0, 1]."""
    p = F.col(probabilities) if isinstance(probabilities, str) else probabilities
    raw = -F.aggregate(p, F.lit(0.0), lambda a, x: a + F.when(x > 0, x * F.ln(x)).otherwise(0.0))
    return F.when(F.size(p) > 1, raw / F.ln(F.size(p))).otherwise(F.lit(0.0))


def with_confidence(df: DataFrame, classes: list[str], probabilities: str = "probabilities",
                    confidence_threshold: float = CONFIDENCE_THRESHOLD,
                    entropy_threshold: float = ENTROPY_THRESHOLD) -> DataFrame:
    """Adds prediction, runner-up, confidence, entropy, uncertainty, status and ranked classes."""
    p = F.col(probabilities)
    names = lexicon.strings(classes)
    ranked = F.reverse(F.array_sort(F.zip_with(
        F.zip_with(p, F.sequence(F.lit(0), F.lit(1 - len(classes)), F.lit(-1)),
                   lambda x, i: F.struct(x.alias("p"), i.alias("earlier"))),
        names, lambda s, c: F.struct(s["p"].alias("p"), s["earlier"].alias("earlier"), c.alias("class")))))
    out = df.withColumn("_ranked", ranked).withColumn("_top", F.get("_ranked", F.lit(0)))
    out = out.withColumn("_h", entropy(probabilities))
    return (
        out.withColumn("prediction", F.col("_top.class"))
        .withColumn("runner_up", F.get("_ranked", F.lit(1))["class"])
        .withColumn("is_uncertain", (F.col("_top.p") < confidence_threshold)
                    | (F.col("_h") > entropy_threshold))
        .withColumn("status", F.when(F.col("_top.p") >= CONFIDENT, "Confident")
                    .when(F.col("_top.p") >= confidence_threshold, "Moderate Confidence")
                    .otherwise("Uncertain / Low Confidence"))
        .withColumn("confidence", F.bround(F.col("_top.p"), 4))
        .withColumn("entropy_score", F.bround("_h", 4))
        .withColumn("ranked_probabilities", F.transform("_ranked", lambda s: F.struct(
            s["class"].alias("class"), F.bround(s["p"], 4).alias("p"))))
        .drop("_ranked", "_top", "_h")
    )


def fit_sigmoids(rows: DataFrame, classes: list[str], counts: dict[str, int]) -> list[tuple[float, float]]:
    """Slope and offset per class that best map a margin to the chance of that class.

    One binary regression per class with Platt's softened targets: each row counts for the
    class with its target and against it with the rest. ``rows`` has ``label`` and ``margins``.
    """
    n = sum(counts.values())
    fitted = []
    for k, name in enumerate(classes):
        pos = counts.get(name, 0)
        target = F.when(F.col("label") == name, (pos + 1.0) / (pos + 2.0)).otherwise(1.0 / (n - pos + 2.0))
        both = rows.select(
            array_to_vector(F.array(F.get("margins", F.lit(k)))).alias("features"),
            F.explode(F.array(F.struct(F.lit(1.0).alias("y"), target.alias("w")),
                              F.struct(F.lit(0.0).alias("y"), (1.0 - target).alias("w")))).alias("t"),
        ).select("features", "t.y", "t.w")
        fit = LogisticRegression(
            labelCol="y", weightCol="w", regParam=0.0, maxIter=MAX_ITER, tol=1e-10).fit(both)
        warn_if_open(fit, f"sigmoid of {name}")
        fitted.append((float(fit.coefficients[0]), float(fit.intercept)))
    return fitted


def warn_if_open(fit: LogisticRegressionModel, what: str) -> None:
    """Tells that an iterative fit used up its iterations."""
    if fit.hasSummary and fit.summary.totalIterations >= fit.getMaxIter():
        warnings.warn(f"{what} did not converge in {fit.getMaxIter()} iterations", stacklevel=3)


def _margins(matrix: np.ndarray, intercepts: np.ndarray):
    """Margins of each row from its term ids and weights; only these two columns reach Python."""

    @F.arrow_udf("array<double>")
    def margins(idx: pa.Array, weights: pa.Array) -> pa.Array:
        size = pc.fill_null(pc.list_value_length(idx), 0).to_numpy(zero_copy_only=False)
        out = np.tile(intercepts, (len(size), 1))
        filled = np.flatnonzero(size)
        if len(filled):
            terms = idx.flatten().to_numpy(zero_copy_only=False)
            products = matrix[terms] * weights.flatten().to_numpy(zero_copy_only=False)[:, None]
            out[filled] += np.add.reduceat(products, (np.cumsum(size) - size)[filled], axis=0)
        return pa.ListArray.from_arrays(
            pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32)), pa.array(out.ravel()))

    return margins


@dataclass
class TextClassifier:
    """A fitted classifier; ``sigmoids`` holds slope and offset per class once calibrated."""

    features: TfidfModel
    regression: LogisticRegressionModel
    classes: list[str]
    sigmoids: list[tuple[float, float]] | None = None

    @classmethod
    def fit(cls, df: DataFrame, text: str = "text", label: str = "category", kind: str = "improved",
            max_iter: int = MAX_ITER) -> "TextClassifier":
        """``text`` should be cleaned as it will be when predicting."""
        weighting = BASELINE if kind == "baseline" else IMPROVED
        data = df.select(F.col(text).alias("_text"), F.col(label).alias("label"))
        counts = {r["label"]: r["count"] for r in collect_bounded(
            data.groupBy("label").count())}
        classes, n = sorted(counts), sum(counts.values())
        worded = stored_words(data, "_text", weighting, "label")
        features = TfidfModel.fit(worded, "_text", weighting, n, words="words")
        rows = features.transform(worded, "_text", words="words").select("label", "idx", "weights")
        rows = with_vector(rows, max(1, len(features.terms)))
        rows = rows.withColumn("y", _index(classes, "label").cast("double"))
        if kind == "baseline":
            rows = rows.withColumn("w", F.lit(1.0))
        else:
            balanced = {c: n / (len(classes) * k) for c, k in counts.items()}
            rows = rows.withColumn("w", F.element_at(
                lexicon.literal(balanced, "map<string,double>"), F.col("label")))
        # The fit reads the rows twice and keeps blocks of them in memory; a second copy there would crowd these out.
        rows = rows.select("features", "y", "w").persist(StorageLevel.DISK_ONLY)
        try:
            regression = LogisticRegression(
                featuresCol="features", labelCol="y", weightCol="w", family="multinomial",
                standardization=False, elasticNetParam=0.0, regParam=1.0 / (C * n),
                maxIter=max_iter, tol=TOLERANCE).fit(rows)
            warn_if_open(regression, f"{kind} model")
        finally:
            rows.unpersist()
        return cls(features, regression, classes)

    def margins(self, df: DataFrame, text: str, keep_vectors: bool = False) -> DataFrame:
        """Adds ``margins`` and the uncalibrated ``probabilities``, in class order."""
        of = _margins(self.regression.coefficientMatrix.toArray().T.copy(),
                      self.regression.interceptVector.toArray())
        rows = self.features.transform(df, text, "_idx", "_weights")
        rows = rows.withColumn("margins", of("_idx", "_weights"))
        top = F.array_repeat(F.array_max("margins"), F.size("margins"))
        rows = rows.withColumn("_e", F.zip_with("margins", top, lambda m, t: F.exp(m - t)))
        rows = rows.withColumn("_s", F.array_repeat(
            F.aggregate("_e", F.lit(0.0), lambda a, x: a + x), F.size("_e")))
        rows = rows.withColumn("probabilities", F.zip_with("_e", "_s", lambda x, t: x / t))
        return rows.drop("_e", "_s") if keep_vectors else rows.drop("_e", "_s", "_idx", "_weights")

    def calibrate(self, df: DataFrame, text: str = "text", label: str = "category") -> "TextClassifier":
        """Fits one sigmoid per class to the margins of held-out rows.

        Only labels and margins are kept while the sigmoids are fitted.
        """
        rows = self.margins(df.select(F.col(text).alias("_text"), F.col(label).alias("label")), "_text")
        rows = rows.select("label", "margins").persist(StorageLevel.MEMORY_AND_DISK)
        counts = {r["label"]: r["count"] for r in collect_bounded(
            rows.groupBy("label").count())}
        n = sum(counts.values())
        fitted = fit_sigmoids(rows, self.classes, counts)
        rows.unpersist()
        self.sigmoids = fitted
        return self

    def predict(self, df: DataFrame, text: str = "text", calibrated: bool = True,
                keep_vectors: bool = False) -> DataFrame:
        """Adds probabilities in class order and everything ``with_confidence`` derives."""
        out = self.margins(df, text, keep_vectors)
        if calibrated and self.sigmoids:
            slopes = lexicon.literal(
                [{"a": a, "b": b} for a, b in self.sigmoids], "array<struct<a:double,b:double>>")
            raw = F.zip_with("margins", slopes,
                             lambda m, s: 1.0 / (1.0 + F.exp(-(s["a"] * m + s["b"]))))
            out = out.withColumn("_p", raw).withColumn(
                "_s", F.array_repeat(F.aggregate("_p", F.lit(0.0), lambda a, x: a + x), F.size("_p")))
            even = F.lit(1.0 / len(self.classes))
            out = out.withColumn("probabilities", F.zip_with(
                "_p", "_s", lambda x, s: F.when(s > 0, x / s).otherwise(even))).drop("_p", "_s")
        return with_confidence(out.drop("margins"), self.classes)

    def coefficients(self) -> DataFrame:
        """``term_id, term, coefs``: the weights of every term, one per class."""
        m = self.regression.coefficientMatrix.toArray().T.tolist()
        return self.features.spark.createDataFrame(
            list(zip(range(len(self.features.terms)), self.features.terms, m)),
            "term_id int, term string, coefs array<double>")

    def coefficient_table(self) -> DataFrame:
        """``class, term, coefficient`` in long form."""
        names = lexicon.strings(self.classes)
        return self.coefficients().select("term", F.posexplode("coefs").alias("k", "coefficient")).select(
            F.get(names, F.col("k")).alias("class"), "term", "coefficient")

    def save(self, path: str) -> None:
        self.features.save(f"{path}/features")
        self.regression.write().overwrite().save(f"{path}/regression")
        spark = self.features.spark
        sig = self.sigmoids or [(None, None)] * len(self.classes)
        spark.createDataFrame(
            [(i, c, a, b) for i, (c, (a, b)) in enumerate(zip(self.classes, sig))],
            "k int, class string, slope double, offset double",
        ).write.mode("overwrite").parquet(f"{path}/classes")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "TextClassifier":
        rows = spark.read.parquet(f"{path}/classes").orderBy("k").collect()
        sig = [(r["slope"], r["offset"]) for r in rows]
        return cls(TfidfModel.load(spark, f"{path}/features"),
                   LogisticRegressionModel.load(f"{path}/regression"),
                   [r["class"] for r in rows], sig if sig and sig[0][0] is not None else None)


def _index(classes: list[str], label: str) -> Column:
    return F.array_position(lexicon.strings(classes), F.col(label)) - 1
