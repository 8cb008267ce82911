"""Topic terms by class-based TF-IDF, topic summaries, and surges between periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.severity import with_severity
from tidemark.functions.text import python_title, with_clean_text
from tidemark.operators.cutoff import most_frequent
from tidemark.operators.ngrams import counts_of, frequent_terms
from tidemark.operators.quality import NOISE, dominant
from tidemark.operators.sizing import broadcast_if_small
from tidemark.operators.tfidf import Weighting, stored_words
from tidemark.policy import stop_words
from tidemark.session import stored

TOP_TERMS = 8
EXEMPLARS = 3
MAX_TERMS = 5_000

# Thresholds of the surge rule and its early-warning levels.
GROWTH_THRESHOLD = 0.25
MIN_RECENT_VOLUME = 10
MIN_COHERENCE = 0.15
BASELINE_FLOOR = 0.5
URGENCY_ORDER = {"Critical": 0, "High": 1, "Moderate": 2, "Monitor": 3}


def adaptive_min_df(n_rows: int) -> int:
    """Lower document-frequency bound that shrinks on small corpora."""
    return min(3, max(1, n_rows // 15))


def class_terms(
    df: DataFrame,
    text: str,
    label: str = "cluster_id",
    n: int = TOP_TERMS,
    stop: tuple = tuple(stop_words.ENGLISH),
    max_terms: int = MAX_TERMS,
    words: str | None = None,
) -> DataFrame:
    """``<label>, term, score, rank``: the most distinctive terms of each cluster.

    Term counts per cluster take the place of concatenated cluster texts, so a
    cluster may be of any size; bigrams do not cross narratives. ``words`` is a column that
    already holds the words of the text, without stop words.

    Terms are counted over all clusters first; only the ``max_terms`` that are kept, which reach the driver, are
    then counted by cluster, so that what is shuffled does not grow with the number of clusters times that of all terms.
    """
    rows = df.filter(F.col(label) != NOISE)
    if words is None:
        weighting = Weighting(ngram_max=1, stop_words=tuple(stop))
        worded = stored_words(rows, text, weighting, label).withColumnRenamed("words", "_terms")
    else:
        worded = rows.select(label, F.col(words).alias("_terms"))
    totals = stored(frequent_terms(worded, "_terms", max_terms).select("term", F.col("cf").alias("f_t")), "term-totals")
    top = totals.filter(most_frequent(totals, "f_t", "term", max_terms))
    counts = counts_of(worded, "_terms", [r["term"] for r in top.select("term").collect()], label).select(
        F.col("label").cast(dict(df.dtypes)[label]).alias(label), "term", F.col("cf").alias("n_tc"))
    kept = stored(counts, "class-term-counts").join(F.broadcast(top), "term")
    w = Window.partitionBy(label)
    mean = kept.agg(F.sum("n_tc") / F.count_distinct(label)).scalar()
    scored = (
        kept.withColumn("_mean", mean)
        .withColumn("words", F.sum("n_tc").over(w))
        .withColumn("score", F.round(
            F.col("n_tc") / F.col("words") * F.ln(1.0 + F.col("_mean") / F.col("f_t")), 12))
    )
    order = w.orderBy(F.desc("score"), F.asc("term"))
    return scored.withColumn("rank", F.row_number().over(order)).filter(
        (F.col("rank") <= n) & (F.col("score") > 0)).select(label, "term", "score", "rank")


def term_lists(terms: DataFrame, label: str = "cluster_id") -> DataFrame:
    """The ranked terms of each cluster as one array."""
    return terms.groupBy(label).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"])
        .alias("top_terms"))


def summaries(
    df: DataFrame,
    terms: DataFrame,
    row_id: str = "doc_id",
    text: str = "narrative",
    category: str | None = "category",
    label: str = "cluster_id",
    n_exemplars: int = EXEMPLARS,
) -> DataFrame:
    """One row per topic: size, prevalence, terms, closest narratives, coherence, categories.

    ``df`` carries ``similarity``, the cosine of each row to its centroid.
    """
    n_all = df.agg(F.count("*")).scalar()
    real = df.filter(F.col(label) != NOISE)
    base = real.groupBy(label).agg(
        F.count("*").alias("size"), F.avg("similarity").alias("coherence"))
    order = Window.partitionBy(label).orderBy(F.desc(F.round("similarity", 9)), F.asc(row_id))
    nearest = (
        real.select(label, row_id, text, "similarity")
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n_exemplars)
        .groupBy(label).agg(F.transform(
            F.array_sort(F.collect_list(F.struct("rank", row_id, text))), lambda s: s[text])
            .alias("representative_complaints"))
    )
    out = (
        base.withColumn("prevalence_pct", F.bround(F.col("size") * 100.0 / n_all, 2))
        .withColumn("coherence", F.bround("coherence", 4))
        .join(term_lists(terms, label), label, "left")
        .join(nearest, label, "left")
    )
    if category:
        out = out.join(dominant(real, label, category), label, "left")
    return out


def surges(
    assigned: DataFrame,
    topics: DataFrame,
    text: str = "narrative",
    growth_threshold: float = GROWTH_THRESHOLD,
    min_recent_volume: int = MIN_RECENT_VOLUME,
    min_coherence: float = MIN_COHERENCE,
    signals: dict | None = None,
) -> DataFrame:
    """Alerts for themes whose share of the recent period outgrew the baseline.

    ``assigned`` has cluster_id, period (baseline or recent) and the narrative;
    ``topics`` has cluster_id, coherence, top_terms, dominant_category and
    representative_complaints. The mean severity is taken over all recent
    narratives of a theme.
    """
    volumes = assigned.groupBy("cluster_id").agg(
        F.sum(F.when(F.col("period") == "recent", 1).otherwise(0)).alias("recent"),
        F.sum(F.when(F.col("period") == "baseline", 1).otherwise(0)).alias("baseline"))
    per_theme = growth(topics, volumes).filter(
        (F.col("recent_volume") >= min_recent_volume)
        & (F.col("growth_rate") >= growth_threshold)
        & (F.col("coherence") >= min_coherence))

    recent = assigned.filter((F.col("period") == "recent") & (F.col("cluster_id") != NOISE))
    recent = recent.join(broadcast_if_small(per_theme.select("cluster_id")), "cluster_id", "left_semi")
    extra = {} if signals is None else {"signals": signals}
    scored = with_severity(
        with_clean_text(recent.select("cluster_id", text), text), details=False, **extra)
    risk = scored.groupBy("cluster_id").agg(F.avg("risk_score").alias("avg_severity_score"))
    return alert_rows(per_theme.join(risk, "cluster_id", "left"))


def growth(topics: DataFrame, volumes: DataFrame) -> DataFrame:
    """Joins recent and baseline volumes to every topic and relates them.

    ``volumes`` has cluster_id, recent, baseline, including the noise label: the
    sizes of both periods set the scale on which volumes are compared.
    """
    sizes = volumes.agg(F.sum("recent").alias("r"), F.sum("baseline").alias("b"))
    scale = sizes.select(
        F.greatest(F.coalesce("r", F.lit(0)), F.lit(1)).cast("double")
        / F.greatest(F.coalesce("b", F.lit(0)), F.lit(1))).scalar()
    out = topics.filter(F.col("cluster_id") != NOISE).join(volumes, "cluster_id", "left")
    out = out.withColumn("recent_volume", F.coalesce("recent", F.lit(0)).cast("bigint"))
    out = out.withColumn("baseline_volume", F.coalesce("baseline", F.lit(0)).cast("bigint"))
    expected = F.greatest(F.col("baseline_volume") * scale, F.lit(BASELINE_FLOOR))
    return out.withColumn("_b", expected).withColumn(
        "growth_rate", (F.col("recent_volume") - F.col("_b")) / F.col("_b")
    ).drop("_b", "recent", "baseline")


def alert_rows(themes: DataFrame) -> DataFrame:
    """Severity level, urgency, name and order of the alerts."""
    sev = F.coalesce("avg_severity_score", F.lit(0.0))
    pct = F.col("growth_rate") * 100.0
    level = F.when(sev >= 0.60, "High").when(sev >= 0.30, "Medium").otherwise("Low")
    fast = pct >= 50.0
    urgency = (
        F.when((F.col("severity_level") == "High") & fast, "Critical")
        .when((F.col("severity_level") == "High") | fast, "High")
        .when(pct >= 25.0, "Moderate").otherwise("Monitor")
    )
    rank = F.when(F.col("urgency") == "Critical", 0)
    for name, i in list(URGENCY_ORDER.items())[1:]:
        rank = rank.when(F.col("urgency") == name, i)
    out = themes.withColumn("avg_severity_score", sev).withColumn("severity_level", level)
    out = out.withColumn("urgency", urgency).withColumn("urgency_rank", rank.otherwise(4))
    name = python_title(F.array_join(F.slice("top_terms", 1, 3), " / "))
    return (
        out.withColumn("theme_name", F.when(
            F.coalesce(F.size("top_terms"), F.lit(0)) > 0, name)
            .otherwise(F.concat(F.lit("Theme #"), F.col("cluster_id").cast("string"))))
        .withColumn("dominant_category", F.coalesce("dominant_category", F.lit("Unknown")))
        .withColumn("growth_percentage", F.bround(pct, 1))
        .orderBy("urgency_rank", F.desc("growth_rate"), "cluster_id")
        .withColumn("growth_rate", F.bround("growth_rate", 4))
        .withColumn("avg_severity_score", F.bround("avg_severity_score", 4))
    )
