"""Classification metrics from a table of true labels, predictions and probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

EPS = 2.220446049250313e-16


def confusion(df: DataFrame, y: str = "label", y_hat: str = "prediction") -> DataFrame:
    """Counts over the full grid of labels seen on either side, and their share of the row."""
    counts = df.groupBy(F.col(y).alias("actual"), F.col(y_hat).alias("predicted")).agg(
        F.count("*").alias("n"))
    both = counts.select(F.explode(F.array("actual", "predicted")).alias("c")).distinct()
    # One array of the few labels spans the grid; no pair of rows is joined.
    names = both.agg(F.collect_set("c")).scalar()
    grid = both.select(F.col("c").alias("actual"), F.explode(names).alias("predicted"))
    out = grid.join(counts, ["actual", "predicted"], "left").na.fill(0, ["n"])
    total = F.sum("n").over(Window.partitionBy("actual"))
    return out.withColumn("row_share", F.coalesce(F.try_divide("n", total), F.lit(0.0)))


def per_class(df: DataFrame, y: str = "label", y_hat: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class; a zero denominator gives 0."""
    pairs = df.groupBy(F.col(y).alias("y"), F.col(y_hat).alias("p")).agg(F.count("*").alias("n"))
    sides = pairs.select(
        F.inline(F.array(
            F.struct(F.col("y").alias("class"), F.col("n").alias("support"),
                     F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("tp"),
                     F.lit(0).cast("bigint").alias("predicted")),
            F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("support"),
                     F.lit(0).cast("bigint").alias("tp"), F.col("n").alias("predicted")),
        ))
    )
    sums = sides.groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("tp").alias("tp"),
        F.sum("predicted").alias("predicted"))

    def ratio(a, b):
        return F.coalesce(F.try_divide(F.col(a).cast("double"), b), F.lit(0.0))

    return sums.select(
        "class", ratio("tp", F.col("predicted")).alias("precision"),
        ratio("tp", F.col("support")).alias("recall"),
        ratio("tp", (F.col("support") + F.col("predicted")) / 2).alias("f1"),
        "support", "tp")


def summary(df: DataFrame, y: str = "label", y_hat: str = "prediction") -> DataFrame:
    """Accuracy, macro and weighted averages."""
    return per_class(df, y, y_hat).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"))


def probability_scores(df: DataFrame, label_index: str = "label_index",
                       probabilities: str = "probabilities") -> DataFrame:
    """Multiclass log-loss and Brier score."""
    p_true = F.get(F.col(probabilities), F.col(label_index))
    squares = F.aggregate(F.col(probabilities), F.lit(0.0), lambda a, p: a + p * p)
    return df.agg(
        F.avg(-F.ln(F.least(F.greatest(p_true, F.lit(EPS)), F.lit(1.0 - EPS)))).alias("log_loss"),
        F.avg(squares - 2 * p_true + 1).alias("brier_score"))


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[
        F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def evaluation(df: DataFrame, y: str = "label", y_hat: str = "prediction") -> DataFrame:
    """One row: averages and, where probabilities are present, log-loss and Brier score."""
    out = summary(df, y, y_hat)
    if "probabilities" in df.columns:
        p = probability_scores(df)
        out = out.withColumn("log_loss", p.select("log_loss").scalar()).withColumn(
            "brier_score", p.select("brier_score").scalar())
    return rounded(out)


def deltas(report: DataFrame, baseline: str = "baseline", final: str = "improved_calibrated") -> DataFrame:
    """What the final model gains over the baseline; ``report`` has one row per ``model``."""
    names = ["accuracy", "macro_f1", "macro_recall", "log_loss"]

    def of(model, c):
        return F.max(F.when(F.col("model") == model, F.col(c)))

    return report.agg(*[F.round(of(final, c) - of(baseline, c), 4).alias(f"{c}_delta") for c in names])
