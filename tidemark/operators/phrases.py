"""Lexicons as tables: token n-grams of the texts meet the keywords by a join.

For lexicons too large to be a literal of the plan. A keyword of n words can only match n tokens in a row, so the
texts send their distinct n-grams of the lengths that the lexicon has. A lexicon of checked size is broadcast and
no text is shuffled; a larger one meets n-grams and row ids in a shuffle, where a frequent n-gram is one row of the
lexicon and its other side may be split.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, functions as F

from tidemark.functions import lexicon
from tidemark.functions.severity import _tier
from tidemark.operators.sizing import BROADCAST_ROWS, broadcast_if_small, collect_bounded
from tidemark.policy import severity as policy
from tidemark.session import stored

#: Word counts of keywords that may differ; each costs one n-gram per token.
MAX_LENGTHS = 64


def keywords_of(table: DataFrame) -> DataFrame:
    """Distinct keywords with their number of words. Null and blank ones match nothing and go."""
    return table.select("keyword").filter(F.trim("keyword") != "").distinct().withColumn(
        "n_words", F.size(F.split("keyword", " ")))


def matches(df: DataFrame, table: DataFrame, text: str = "cleaned", row_id: str = "doc_id",
            max_broadcast: int = BROADCAST_ROWS) -> DataFrame:
    """``<row_id>, keyword``: each keyword of ``table`` that occurs in the row's text on word boundaries, once.

    Matches what ``lexicon.with_matches`` does with the same keywords. ``text`` must have single blanks only;
    null and empty texts match nothing. Rows are named by ``row_id``; rows of one id count as one text each, and a
    keyword that several of them hold is given for each.
    """
    keywords = stored(keywords_of(table), "keywords")
    lengths = sorted(r[0] for r in collect_bounded(keywords.select("n_words").distinct(), MAX_LENGTHS))
    rows = df.select(row_id, F.col(text).alias("_text")).filter(F.col("_text").isNotNull())
    rows = lexicon.with_padded_tokens(rows, "_text", "_padded", "_tokens").select(row_id, "_tokens")
    grams = F.array_distinct(F.concat(*[_grams(n) for n in lengths])) if lengths else F.array().cast("array<string>")
    found = rows.select(row_id, F.explode(grams).alias("keyword"))
    return found.join(broadcast_if_small(keywords.select("keyword"), max_broadcast), "keyword").select(row_id, "keyword")


def _grams(n: int):
    """All runs of ``n`` tokens as texts; tokens may be empty where a sign stands beside a blank."""
    tokens = F.col("_tokens")
    if n == 1:
        return tokens
    starts = F.sequence(F.lit(1), F.size(tokens) - n + 1)
    return F.when(F.size(tokens) >= n, F.transform(
        starts, lambda at: F.array_join(F.slice(tokens, at, n), " "))).otherwise(F.array().cast("array<string>"))


def signal_table(spark, signals: dict = policy.SIGNALS) -> DataFrame:
    """Signal groups as a lexicon table: ``group_name, group_ord, weight, keyword, keyword_ord``."""
    rows = [(g, i, w, k, j) for i, (g, (w, ks)) in enumerate(signals.items()) for j, k in enumerate(ks)]
    return spark.createDataFrame(
        rows, "group_name string, group_ord int, weight decimal(9,2), keyword string, keyword_ord int")


def severity(df: DataFrame, signals: DataFrame, text: str = "cleaned", row_id: str = "doc_id",
             tiers: list = policy.TIERS, max_broadcast: int = BROADCAST_ROWS) -> DataFrame:
    """``<row_id>, risk_score, severity_level, matched_signals, detected_keywords``, a row per row of ``df``.

    The rule of ``functions.severity.with_severity`` with groups, weights and keywords from a table
    (``signal_table``), of any number. ``row_id`` must name one row.
    """
    hits = matches(df, signals, text, row_id, max_broadcast)
    evidence = hits.join(broadcast_if_small(signals, max_broadcast), "keyword")
    # At most one row per keyword that the text itself holds.
    groups = evidence.groupBy(row_id, "group_name", "group_ord").agg(
        F.max("weight").alias("weight"), F.collect_set(F.struct("group_ord", "keyword_ord", "keyword")).alias("words"))
    scores = groups.groupBy(row_id).agg(
        F.least(F.sum("weight"), F.lit(Decimal("1.00"))).alias("_score"),
        F.array_sort(F.collect_list(F.struct("group_ord", "group_name"))).alias("_groups"),
        F.array_sort(F.flatten(F.collect_list("words"))).alias("_words"))
    none = F.array().cast("array<string>")
    out = df.select(row_id).join(scores, row_id, "left").withColumn(
        "_score", F.coalesce("_score", F.lit(Decimal("0.00"))))
    return out.select(
        row_id, F.col("_score").cast("double").alias("risk_score"), _tier(F.col("_score"), tiers).alias("severity_level"),
        F.coalesce(F.col("_groups.group_name"), none).alias("matched_signals"),
        F.coalesce(F.array_distinct(F.col("_words.keyword")), none).alias("detected_keywords"))
