"""Quality of a clustering: sizes, noise, separation, coherence, distinctiveness, verdict."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.text import percent
from tidemark.operators.sizing import broadcast_if_small
from tidemark.operators.vectors import group_means, l2_norm, matrix
from tidemark.session import stored

NOISE = -1

#: Centroids of a block; a task holds two.
CENTROIDS_A_BLOCK = 1024
PASSES = "Passes all quality checks: coherent clusters, controlled noise, distinct themes."
NO_CLUSTERS = "No valid clusters formed; all points classified as noise."


def with_unit_vectors(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """Scales vectors to length 1; a zero vector stays zero."""
    norm = F.array_repeat(l2_norm(vec), F.size(vec))
    return df.withColumn(
        vec, F.zip_with(F.col(vec).cast("array<double>"), norm,
                        lambda x, n: F.when(n > 0, x / n).otherwise(F.lit(0.0))))


def sizes(df: DataFrame, label: str = "cluster_id") -> DataFrame:
    return df.filter(F.col(label) != NOISE).groupBy(label).agg(F.count("*").alias("size"))


def size_distribution(df: DataFrame, label: str = "cluster_id") -> DataFrame:
    """Counts of rows, clusters and noise, and the spread of cluster sizes, in one pass."""
    per_label = df.groupBy(label).agg(F.count("*").alias("size"))
    real = F.when(F.col(label) != NOISE, F.col("size"))
    n = F.coalesce(F.sum("size"), F.lit(0))
    noise = F.coalesce(F.sum(F.when(F.col(label) == NOISE, F.col("size"))), F.lit(0))
    return per_label.agg(
        n.alias("n_samples"),
        F.count(real).alias("n_clusters"),
        noise.alias("noise_count"),
        F.coalesce(F.try_divide(noise, n), F.lit(0.0)).alias("noise_rate"),
        F.coalesce(F.min(real), F.lit(0)).alias("min_cluster_size"),
        F.coalesce(F.max(real), F.lit(0)).alias("max_cluster_size"),
        F.coalesce(F.avg(real), F.lit(0.0)).alias("mean_cluster_size"),
        F.coalesce(F.percentile(real, 0.5), F.lit(0.0)).alias("median_cluster_size"),
        F.map_from_entries(F.collect_list(F.when(F.col(label) != NOISE, F.struct(
            F.col(label).cast("string"), "size")))).alias("cluster_sizes"),
    )


def pairwise_coherence(df: DataFrame, label: str = "cluster_id", vec: str = "embedding") -> DataFrame:
    """Mean pairwise cosine inside each cluster of two or more, and over such clusters.

    On unit vectors the pairs need not be formed: they follow from the length of
    the vector sum. So every row counts, where a pair table would need a sample.
    """
    unit = with_unit_vectors(df.filter(F.col(label) != NOISE), vec)
    sums = unit.groupBy(label).agg(
        Summarizer.sum(array_to_vector(vec)).alias("_s"), F.count("*").alias("size")
    ).withColumn("_s", vector_to_array("_s"))
    square = F.aggregate("_s", F.lit(0.0), lambda a, x: a + x * x)
    n = F.col("size").cast("double")
    return sums.filter(F.col("size") >= 2).select(
        label, "size", ((square - n) / (n * (n - 1))).alias("pairwise_coherence"))


def davies_bouldin(df: DataFrame, label: str = "cluster_id", vec: str = "embedding",
                   block: int = CENTROIDS_A_BLOCK) -> DataFrame:
    """Mean over clusters of the worst ratio of scatter to centroid distance; null below two clusters.

    Distances are Euclidean. Centroids are dealt to blocks by hash; a task compares two blocks, and a cluster's
    worst ratio of each is all that leaves it. Centroids in one place count as no ratio.
    """
    valid = df.filter(F.col(label) != NOISE).select(label, F.col(vec).cast("array<double>").alias("_v"))
    means = stored(group_means(valid, label, "_v", unit=False).select(label, "centroid"), "centroids")
    distance = F.sqrt(F.aggregate(F.zip_with("_v", "centroid", lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                                  lambda s, x: s + x))
    scatter = (
        valid.join(broadcast_if_small(means), label).withColumn("_d", distance)
        .groupBy(label).agg(F.avg("_d").alias("scatter"))
    )
    blocks = max(1, -(-means.count() // block))
    dealt = scatter.join(means, label).select(
        F.col(label).cast("bigint").alias("id"), "scatter", "centroid",
        F.pmod(F.xxhash64(label), F.lit(blocks)).cast("int").alias("own"))
    # Each block meets every block once: pairs (a, b) with a <= b.
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "id", "scatter", "centroid")
    worst = met.groupBy("a", "b").applyInArrow(_worst_ratios, "id bigint, worst double")
    per_cluster = worst.groupBy("id").agg(F.coalesce(F.max("worst"), F.lit(0.0)).alias("worst"))
    return per_cluster.agg(F.when(F.count("*") > 1, F.avg("worst")).alias("davies_bouldin"))


def _worst_ratios(key: tuple, table: pa.Table) -> pa.Table:
    """The worst ratio of each cluster of two blocks among those of the other, or of its own if they are one."""
    ids, scatter = (table[c].to_numpy() for c in ("id", "scatter"))
    own = table["own"].to_numpy()
    centroids = matrix(table["centroid"].combine_chunks())
    first, second = np.flatnonzero(own == key[0].as_py()), np.flatnonzero(own == key[1].as_py())
    worst = np.full(len(ids), np.nan)
    for at in first:
        others = second[second != at]
        gaps = centroids[others] - centroids[at]
        apart = np.sqrt((gaps * gaps).sum(axis=1))
        others, apart = others[apart > 0], apart[apart > 0]
        ratios = (scatter[others] + scatter[at]) / apart
        worst[at] = np.fmax(worst[at], ratios.max(initial=-np.inf)) if len(ratios) else worst[at]
        worst[others] = np.fmax(worst[others], ratios)
    return pa.table({"id": pa.array(ids), "worst": pa.array(worst, mask=np.isnan(worst))})


def silhouette(df: DataFrame, label: str = "cluster_id", vec: str = "embedding") -> float | None:
    """Mean cosine silhouette of the rows that are not noise; null below two clusters."""
    valid = df.filter(F.col(label) != NOISE).select(
        F.col(label).cast("int").alias("prediction"),
        array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    if valid.select("prediction").distinct().count() < 2:
        return None
    return ClusteringEvaluator(distanceMeasure="cosine").evaluate(valid)


def term_distinctiveness(terms: DataFrame, label: str = "cluster_id", term: str = "term") -> DataFrame:
    """Different top terms over all top terms; null for fewer than two clusters."""
    t = terms.filter(F.col(label) != NOISE).select(label, F.lower(F.trim(term)).alias("_t"))
    return t.agg(F.when(
        F.count_distinct(label) > 1,
        F.try_divide(F.count_distinct("_t").cast("double"), F.count("*"))
    ).alias("term_distinctiveness"))


def verdict(report: DataFrame) -> DataFrame:
    """Adds ``is_actionable`` and its reasons to a report row.

    Needs n_samples, n_clusters, noise_rate, min/max_cluster_size,
    intra_cluster_coherence and term_distinctiveness.
    """
    c = F.col
    noisy = c("noise_rate") > 0.65
    mega = c("max_cluster_size") > 0.70 * c("n_samples")
    loose = F.coalesce(c("intra_cluster_coherence") < 0.10, F.lit(False))
    tiny = c("min_cluster_size") < 5
    alike = F.coalesce(c("term_distinctiveness") < 0.30, F.lit(False))
    none = c("n_clusters") == 0
    reasons = F.array_compact(F.array(
        F.when(noisy, F.format_string(
            "Noise rate is too high (%s). More than 65%% of complaints unclustered.",
            percent("noise_rate"))),
        F.when(tiny, F.format_string(
            "Smallest cluster has only %d complaints; may be an outlier artifact.",
            c("min_cluster_size"))),
        F.when(mega, F.format_string(
            "Largest cluster contains %s of all data (undifferentiated megacluster).",
            percent(c("max_cluster_size") / c("n_samples")))),
        F.when(loose, F.format_string(
            "Intra-cluster semantic coherence is low (%.3f < 0.10).", c("intra_cluster_coherence"))),
        F.when(alike, F.format_string(
            "Clusters share many top terms; distinctiveness is low (%.2f).",
            c("term_distinctiveness"))),
    ))
    return report.withColumn("is_actionable", ~none & ~noisy & ~mega & ~loose).withColumn(
        "_r", reasons
    ).withColumn(
        "actionability_reasons",
        F.when(none, F.array(F.lit(NO_CLUSTERS)))
        .when(c("is_actionable") & (F.size("_r") == 0), F.array(F.lit(PASSES)))
        .otherwise(c("_r")),
    ).drop("_r")


def report(df: DataFrame, top_terms: DataFrame | None = None, label: str = "cluster_id",
           vec: str = "embedding") -> DataFrame:
    """One row with all quality figures of a labelled set of vectors."""
    out = size_distribution(df, label)
    coherence = pairwise_coherence(df, label, vec).agg(F.avg("pairwise_coherence"))
    out = out.withColumn("silhouette", F.lit(silhouette(df, label, vec)).cast("double"))
    out = out.withColumn("davies_bouldin", davies_bouldin(df, label, vec).scalar())
    out = out.withColumn("intra_cluster_coherence", coherence.scalar())
    distinct = (term_distinctiveness(top_terms, label).scalar() if top_terms is not None
                else F.lit(None).cast("double"))
    out = verdict(out.withColumn("term_distinctiveness", distinct))
    for name, digits in [("noise_rate", 4), ("mean_cluster_size", 2), ("median_cluster_size", 2),
                         ("silhouette", 4), ("davies_bouldin", 4),
                         ("intra_cluster_coherence", 4), ("term_distinctiveness", 4)]:
        out = out.withColumn(name, F.bround(name, digits))
    return out


def dominant(df: DataFrame, label: str = "cluster_id", category: str = "category") -> DataFrame:
    """Share of each category per cluster and the most frequent one (name on a tie)."""
    counts = df.groupBy(label, category).agg(F.count("*").alias("_k"))
    w = Window.partitionBy(label)
    shares = counts.withColumn("share", F.col("_k") / F.sum("_k").over(w)).withColumn(
        "_rn", F.row_number().over(w.orderBy(F.desc("_k"), F.asc(category))))
    return shares.groupBy(label).agg(
        F.max(F.when(F.col("_rn") == 1, F.col(category))).alias("dominant_category"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(category, "share"))))
        .alias("category_distribution"),
    )
