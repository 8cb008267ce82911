"""Transparent severity scoring from weighted keyword signals."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, functions as F

from tidemark.functions import lexicon
from tidemark.functions.pinning import pin
from tidemark.policy import severity as policy

BREAKDOWN = (
    "array<struct<group_name:string,weight:double,matched_keywords:array<string>,"
    "is_triggered:boolean,contribution:double>>"
)


def _tier(score, tiers):
    names = sorted(tiers, key=lambda t: t[1], reverse=True)
    expr = F.when(score >= F.lit(names[0][1]), names[0][0])
    for name, lower in names[1:]:
        expr = expr.when(score >= F.lit(lower), name)
    return expr.otherwise("Low")


def with_severity(
    df: DataFrame,
    cleaned: str = "cleaned",
    signals: dict = policy.SIGNALS,
    tiers: list = policy.TIERS,
    details: bool = True,
) -> DataFrame:
    """Adds score, tier and matched signals; with details also the evidence behind them.

    ``cleaned`` is the cleaned narrative; blank text scores 0. Only the presence
    of a signal group counts, not how many of its keywords occur. Weights add up
    as decimals, so tier borders are exact.
    """
    keywords = list(dict.fromkeys(k for _, ks in signals.values() for k in ks))
    out = lexicon.with_padded_tokens(df, cleaned, "_padded", "_tokens")
    out = lexicon.with_matches(out, keywords, "_padded", "_tokens", "_found")
    out = out.drop("_padded", "_tokens").withColumn(
        "_by_group",
        F.struct(*[lexicon.in_order(ks, "_found").alias(g) for g, (_, ks) in signals.items()]),
    ).drop("_found")
    out = pin(out, "_by_group")

    def hit(group):
        return F.size(F.col(f"_by_group.{group}")) > 0

    total = F.lit(Decimal("0.00"))
    for group, (weight, _) in signals.items():
        total = total + F.when(hit(group), F.lit(weight)).otherwise(F.lit(Decimal("0.00")))
    out = out.withColumn("_score", F.least(total, F.lit(Decimal("1.00"))))
    out = (
        out.withColumn("risk_score", F.col("_score").cast("double"))
        .withColumn("severity_level", _tier(F.col("_score"), tiers))
        .withColumn(
            "matched_signals",
            F.array_compact(F.array(*[F.when(hit(g), F.lit(g)) for g in signals])),
        )
    )
    if details:
        out = (
            out.withColumn(
                "signal_breakdown",
                F.array(*[
                    F.struct(
                        F.lit(g).alias("group_name"),
                        F.lit(float(w)).alias("weight"),
                        F.col(f"_by_group.{g}").alias("matched_keywords"),
                        hit(g).alias("is_triggered"),
                        F.when(hit(g), F.lit(float(w))).otherwise(F.lit(0.0)).alias("contribution"),
                    )
                    for g, (w, _) in signals.items()
                ]).cast(BREAKDOWN),
            )
            .withColumn(
                "detected_keywords",
                F.array_distinct(F.concat(*[F.col(f"_by_group.{g}") for g in signals])),
            )
            .withColumn("is_critical", F.col("severity_level") == "Critical")
            .withColumn("severity_explanation", _explanation(cleaned, signals, hit))
        )
    return out.drop("_by_group", "_score")


def _explanation(cleaned, signals, hit):
    parts = F.concat_ws(
        "; ",
        *[
            F.when(
                hit(g),
                F.concat(
                    F.lit(f"{g.replace('_', ' ').title()} (weight {w * 100:.0f}%, matched: "),
                    F.array_join(F.col(f"_by_group.{g}"), ", "),
                    F.lit(")"),
                ),
            )
            for g, (w, _) in signals.items()
        ],
    )
    return (
        F.when(F.size("matched_signals") == 0, policy.NO_SIGNAL)
        .otherwise(
            F.concat(
                F.lit("Assigned '"), F.col("severity_level"), F.lit("' (score "),
                F.format_string("%.2f", F.col("risk_score")), F.lit(") due to: "), parts,
                F.lit("."),
            )
        )
    )
