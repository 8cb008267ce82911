"""Rows that every operator on documents must cope with."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

CLASHING = ("rest", "k1", "h1", "n", "tokens", "score", "kept", "n_lines", "drop", "topic", "owner")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """Rows of (doc_id, text, lang, source); n_chars follows."""
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], SCHEMA)


def with_clashes(df):
    return df.withColumns({c: F.lit("own") for c in CLASHING})


def lower(text):
    return (text or "").encode().lower().decode()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def sample(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


ODD = [
    (None, "no id at all " * 8, "en", "a"), (1, None, "en", None), (2, "", None, "a"), (3, " \t\n\x0b ", "en", "a"),
    (4, "word", "en", "b"), (5, "ÉÀ é à word", "fr", "b"), (6, "Repeated row here.", "en", "a"),
    (6, "Repeated row here.", "en", "a"), (7, "x" * 200_000, "en", "a"), (8, "long text with words " * 20_000, "en", "c"),
]
