"""Nested JSON reports: writing them, and reading them back as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

QUALITY = (
    "struct<n_samples:bigint,n_clusters:bigint,noise_count:bigint,noise_rate:double,"
    "cluster_sizes:map<string,bigint>,min_cluster_size:bigint,max_cluster_size:bigint,"
    "mean_cluster_size:double,median_cluster_size:double,silhouette:double,"
    "davies_bouldin:double,intra_cluster_coherence:double,term_distinctiveness:double,"
    "is_actionable:boolean,actionability_reasons:array<string>>"
)
CONFIGURATION = (
    "struct<config:struct<name:string,method:string,min_cluster_size:int,min_samples:int,"
    "n_clusters:int>,fit_time_sec:double,quality_report:" + QUALITY + ">"
)
CLUSTERING_REPORT = (
    f"configurations map<string,{CONFIGURATION}>, recommended_configuration string, "
    "selection_rationale string"
)
MODEL_METRICS = (
    "struct<accuracy:double,macro_f1:double,weighted_f1:double,macro_precision:double,"
    "macro_recall:double,per_class:map<string,struct<precision:double,recall:double,"
    "f1:double,support:bigint>>,confusion_matrix:array<array<bigint>>,classes:array<string>,"
    "log_loss:double,brier_score:double>"
)


CLASSIFICATION_REPORT = f"generated_at string, models map<string,{MODEL_METRICS}>"


def stamped(df: DataFrame, name: str = "generated_at") -> DataFrame:
    """Adds the time of the run in UTC, as ISO text with microseconds; one time for all rows of a query."""
    now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return df.withColumn(name, F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"))


def write_report(df: DataFrame, path: str) -> None:
    """Each row becomes one JSON document; null fields are kept."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode(
        "overwrite"
    ).text(path)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON report files, one document per file or per line."""
    return (
        spark.read.text(path, wholetext=True)
        .select(F.from_json("value", schema).alias("doc"))
        .select("doc.*")
    )


def clustering_rows(report: DataFrame) -> DataFrame:
    """One display row per clustering configuration of a report."""
    q = F.col("entry.quality_report")

    def fixed(c):
        return F.format_string("%.4f", F.coalesce(c, F.lit(0.0)))

    return report.select(F.explode("configurations").alias("configuration", "entry")).select(
        "configuration",
        F.upper(F.coalesce("entry.config.method", F.lit(""))).alias("algorithm"),
        F.coalesce(q["n_clusters"], F.lit(0)).alias("clusters"),
        F.format_string("%.1f%%", F.coalesce(q["noise_rate"], F.lit(0.0)) * 100).alias("noise_rate"),
        fixed(q["silhouette"]).alias("silhouette_score"),
        fixed(q["intra_cluster_coherence"]).alias("semantic_coherence"),
        fixed(q["term_distinctiveness"]).alias("term_distinctiveness"),
        F.when(q["is_actionable"], "Yes").otherwise("No").alias("actionable"),
    )


def model_report(models: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """One row with a ``models`` map, from the averages (one row) and the rows per class of each model."""
    entries = []
    for name, (averages, classes) in models.items():
        scores = classes.agg(F.map_from_entries(F.array_sort(
            F.collect_list(F.struct("class", F.struct("precision", "recall", "f1", "support"))),
            lambda a, b: F.when(a["class"] < b["class"], -1).otherwise(1))).alias("per_class"))
        entries.append(averages.withColumn("per_class", scores.scalar()).select(
            F.lit(name).alias("model"), F.struct("*").alias("metrics")))
    rows = entries[0]
    for other in entries[1:]:
        rows = rows.unionByName(other)
    return rows.agg(F.map_from_entries(F.collect_list(F.struct("model", "metrics"))).alias("models"))


def model_rows(report: DataFrame) -> DataFrame:
    """One row per model and class of a classification report (``models`` map)."""
    return (
        report.select(F.explode("models").alias("model", "metrics"))
        .select("model", "metrics.accuracy", "metrics.macro_f1",
                F.explode("metrics.per_class").alias("class", "scores"))
        .select("model", "accuracy", "macro_f1", "class", "scores.*")
    )
