"""Matching a keyword list against text on word boundaries, without a regex per keyword."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.policy import text_patterns as P


def literal(value, schema: str) -> Column:
    """A nested Python value as one constant column."""
    return F.from_json(F.lit(json.dumps(value, default=str)), schema)


def strings(values) -> Column:
    return literal(list(values), "array<string>")


def with_padded_tokens(df: DataFrame, text: str, padded: str, tokens: str) -> DataFrame:
    """Adds the text with every word set off by blanks, and its tokens.

    ``text`` must have single blanks only. ``\\bkeyword\\b`` then means that the
    padded text contains ``' keyword '``. Tokens may include empty strings.
    """
    return df.withColumn(
        padded,
        F.concat(F.lit(" "), F.regexp_replace(text, P.NON_WORD_CHAR, " $1 "), F.lit(" ")),
    ).withColumn(tokens, F.split(padded, " "))


def with_matches(df: DataFrame, keywords: list[str], padded: str, tokens: str, found: str) -> DataFrame:
    """Adds the keywords that occur in the text; use ``in_order`` to read the result.

    One hash pass over the tokens finds the words and the first words of the
    phrases; only phrases whose first word occurs are searched for. First words
    may stay in the result, ``in_order`` leaves them out.
    """
    words = [k for k in keywords if " " not in k]
    phrases = [
        {"first": k.split(" ")[0], "padded": f" {k} ", "phrase": k} for k in keywords if " " in k
    ]
    probes = dict.fromkeys(words + [p["first"] for p in phrases])
    out = df.withColumn(found, F.array_intersect(strings(probes), F.col(tokens)))
    if not phrases:
        return out
    entries = literal(phrases, "array<struct<first:string,padded:string,phrase:string>>")
    hits = F.filter(
        entries,
        lambda p: F.array_contains(F.col(found), p["first"])
        & F.contains(F.col(padded), p["padded"]),
    )
    return out.withColumn(found, F.concat(F.col(found), F.transform(hits, lambda p: p["phrase"])))


def in_order(keywords: list[str], found: Column | str) -> Column:
    """The found keywords that belong to this list, in list order."""
    found = F.col(found) if isinstance(found, str) else found
    return F.array_intersect(strings(keywords), found)
