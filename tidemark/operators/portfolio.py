"""Portfolio aggregates over labelled and scored complaints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.text import word_count
from tidemark.session import stored

TIER_ORDER = ["Critical", "High", "Medium", "Low"]


def share(count, digits: int = 2):
    """Percentage of the total of a count column over the (small) aggregated result."""
    total = F.sum(count).over(Window.partitionBy(F.lit(1)))
    return F.round(F.col(count) / total * 100, digits)


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("complaints"))


def category_shares(df: DataFrame, key: str = "category") -> DataFrame:
    """Count and percentage per category, largest first."""
    return (
        counts_by(df, key).withColumn("pct", share("complaints"))
        .orderBy(F.desc("complaints"), F.asc(key))
    )


def top_sub_issues(df: DataFrame, n: int = 5) -> DataFrame:
    """The n most frequent sub-issues of each category."""
    w = Window.partitionBy("category").orderBy(F.desc("complaints"), F.asc("sub_issue"))
    return (
        counts_by(df, "category", "sub_issue").withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= n)
    )


def severity_cross_tab(df: DataFrame) -> DataFrame:
    """Category rows, one count column per tier."""
    return (
        df.groupBy("category").pivot("severity_level", TIER_ORDER)
        .agg(F.count(F.lit(1))).na.fill(0)
    )


def word_length_stats(df: DataFrame, text: str = "narrative") -> DataFrame:
    """Mean, median, 90th percentile and maximum of the words per narrative."""
    n = df.select(word_count(text).alias("n"))
    return n.agg(
        F.round(F.avg("n"), 1).alias("mean_words"),
        F.percentile("n", 0.5).cast("int").alias("median_words"),
        F.percentile("n", 0.9).cast("int").alias("p90_words"),
        F.max("n").alias("max_words"),
    )


def risk_stats(df: DataFrame) -> DataFrame:
    return df.agg(
        F.round(F.avg("risk_score"), 3).alias("mean_risk_score"),
        F.round(F.percentile("risk_score", 0.5), 3).alias("median_risk_score"),
    )


def dominant_category(df: DataFrame) -> DataFrame:
    """The largest category with its count and share."""
    return category_shares(df).limit(1)


def elevated_risk_share(df: DataFrame) -> DataFrame:
    """Percentage of High and Critical complaints."""
    hot = F.col("severity_level").isin("High", "Critical")
    return df.agg(
        F.round(F.avg(F.when(hot, 100.0).otherwise(0.0)), 2).alias("elevated_risk_pct")
    )


def tier_bar(df: DataFrame) -> DataFrame:
    """All tiers from Critical to Low, absent ones as 0, with their share."""
    tiers = df.sparkSession.createDataFrame(
        list(enumerate(TIER_ORDER)), "tier_ord int, severity_level string"
    )
    return (
        tiers.join(counts_by(df, "severity_level"), "severity_level", "left")
        .na.fill(0, ["complaints"])
        .withColumn("pct", share("complaints", 1))
        .orderBy("tier_ord")
    )


def split_summary(df: DataFrame) -> DataFrame:
    """Size of each split and the class shares inside it."""
    w = Window.partitionBy("split")
    return (
        counts_by(df, "split", "category")
        .withColumn("split_size", F.sum("complaints").over(w))
        .withColumn("share", F.round(F.col("complaints") / F.col("split_size"), 6))
    )


def monthly_volume(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Complaints per month and category."""
    return df.groupBy(
        F.date_format(F.date_trunc("month", ts), "yyyy-MM").alias("month"), "category"
    ).agg(F.count("*").alias("complaints"))


#: Sections of the portfolio summary and the columns that each is counted by.
SECTIONS = {
    "total": [],
    "category": ["category"],
    "severity": ["severity_level"],
    "sub_issue": ["category", "sub_issue"],
    "category_severity": ["category", "severity_level"],
    "risk": ["risk_score"],
    "words": ["n_words"],
}
_KEYS = ["category", "sub_issue", "severity_level", "risk_score", "n_words"]


def section_counts(scored: DataFrame, text: str = "narrative") -> DataFrame:
    """``section``, the key columns and ``complaints``: all counts of the summary from one pass.

    Grouping sets over one scan and one exchange; each row is counted in every section before the exchange. A null
    key is a group of its own. The table has a row per category, tier, sub-issue, risk score and number of words,
    however many complaints there are; without complaints it is empty.
    """
    rows = scored.select(*_KEYS[:-1], word_count(text).alias("n_words"))
    sets = [[F.col(k) for k in keys] for keys in SECTIONS.values()]
    names = {sum(1 << (len(_KEYS) - 1 - i) for i, k in enumerate(_KEYS) if k not in keys): name
             for name, keys in SECTIONS.items()}
    section = F.when(F.lit(False), "")
    for number, name in names.items():
        section = section.when(F.col("_set") == number, name)
    counted = rows.groupingSets(sets, *_KEYS).agg(F.count("*").alias("complaints"), F.grouping_id().alias("_set"))
    return counted.select(section.alias("section"), *_KEYS, "complaints")


def summary_document(scored: DataFrame) -> DataFrame:
    """The whole portfolio summary as one JSON document row; keys of maps in order, a null key is left out.

    ``scored`` needs category, sub_issue, severity_level, risk_score and narrative. Its texts are read once, for
    the counts of all sections; those are stored and are all that the document is made of. Mean, median and 90th
    percentile follow from the counts of each value. An empty portfolio has empty maps and null statistics.
    """
    counts = stored(section_counts(scored), "portfolio-counts")

    def section(name):
        rows = counts.filter(F.col("section") == name)
        for key in SECTIONS[name]:
            rows = rows.filter(F.col(key).isNotNull())
        return rows.select(*SECTIONS[name], "complaints")

    def as_map(key, value):
        # By the key alone: values may be maps, which have no order.
        return F.map_from_entries(F.array_sort(
            F.collect_list(F.struct(key, value)),
            lambda a, b: F.when(a[key] < b[key], -1).when(a[key] > b[key], 1).otherwise(0)))

    def with_share(name):
        return section(name).withColumn("pct", share("complaints"))

    w = Window.partitionBy("category").orderBy(F.desc("complaints"), F.asc("sub_issue"))
    leading = section("sub_issue").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= 5)
    nested = leading.groupBy("category").agg(as_map("sub_issue", "complaints").alias("v"))
    by_tier = section("category_severity").groupBy("category").agg(
        as_map("severity_level", "complaints").alias("v"))
    cats, tiers = with_share("category"), with_share("severity")
    k = F.col("complaints")

    def mean(c, digits):
        return F.round(F.sum(F.col(c) * k) / F.sum(k), digits)

    words = section("words").agg(
        mean("n_words", 1).alias("mean_words"),
        F.percentile("n_words", 0.5, k).cast("int").alias("median_words"),
        F.percentile("n_words", 0.9, k).cast("int").alias("p90_words"),
        F.max("n_words").alias("max_words"))
    risk = section("risk").agg(
        mean("risk_score", 3).alias("mean"), F.round(F.percentile("risk_score", 0.5, k), 3).alias("median"))

    def one(df, key, value):
        return df.agg(as_map(key, value).alias("m")).scalar()

    return section("total").agg(F.coalesce(F.sum("complaints"), F.lit(0)).alias("total_complaints")).select(
        "total_complaints",
        one(cats, "category", "complaints").alias("category_counts"),
        one(cats, "category", "pct").alias("category_percentages"),
        one(tiers, "severity_level", "complaints").alias("severity_counts"),
        one(tiers, "severity_level", "pct").alias("severity_percentages"),
        risk.select("mean").scalar().alias("mean_risk_score"),
        risk.select("median").scalar().alias("median_risk_score"),
        one(nested, "category", "v").alias("sub_issues_by_category"),
        one(by_tier, "category", "v").alias("severity_by_category"),
        words.select(F.struct("*")).scalar().alias("narrative_length_stats"),
    )
