"""TF-IDF weighting over a pruned vocabulary.

Only the vocabulary, bounded by ``max_features``, and the words that its pairs may
be made of reach the driver. Words are counted first, then pairs of frequent ones;
weighting a document looks at that document alone, so it needs no shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.pinning import pin
from tidemark.functions.text import terms, terms_text, with_bigrams
from tidemark.operators.cutoff import most_frequent
from tidemark.operators.ngrams import count_logs, frequent_terms, term_weights, without
from tidemark.session import stored


@dataclass(frozen=True)
class Weighting:
    """How text becomes weighted terms."""

    max_features: int = 25_000
    ngram_max: int = 2
    sublinear: bool = True
    min_df: int = 2
    max_df: float = 0.95
    stop_words: tuple = field(default=())


def with_terms(df: DataFrame, text: str, weighting: Weighting, out: str = "_terms") -> DataFrame:
    """Adds the word n-grams of a text; stop words go before n-grams are built."""
    df = df.withColumn(out, terms(text))
    if weighting.stop_words:
        remover = StopWordsRemover(
            inputCol=out, outputCol="_kept", stopWords=list(weighting.stop_words),
            caseSensitive=True,
        )
        df = remover.transform(df).drop(out).withColumnRenamed("_kept", out)
    if weighting.ngram_max == 2:
        df = df.withColumn(out, with_bigrams(out))
    return df


def with_words(df: DataFrame, text: str, weighting: Weighting, *keep: str) -> DataFrame:
    """``keep`` and ``words``: the words of each text without stop words, a blank between them."""
    worded = terms_text(text)
    return df.select(*keep, (without(weighting.stop_words)(worded) if weighting.stop_words else worded).alias("words"))


def stored_words(df: DataFrame, text: str, weighting: Weighting, *keep: str) -> DataFrame:
    """The same, stored: found once for all passes over them."""
    return stored(with_words(df, text, weighting, *keep), "words")


def vocabulary(df: DataFrame, weighting: Weighting, n_rows: int, words: str = "_terms") -> DataFrame:
    """Terms within the frequency bounds, the most frequent ``max_features`` of them, from the words of each row.

    The counted terms are stored, as the cut-off passes over them; only the kept ones are sorted.
    """
    most_rows = weighting.max_df * n_rows
    counted = frequent_terms(
        df, words, weighting.max_features, weighting.ngram_max == 2, weighting.min_df, most_rows)
    kept = stored(counted.select("term", "df", "cf").filter(
        (F.col("df") >= weighting.min_df) & (F.col("df") <= most_rows)), "term-counts")
    kept = kept.filter(most_frequent(kept, "cf", "term", weighting.max_features))
    return kept.orderBy(F.desc("cf"), F.asc("term"))


def smoothed_idf(n_rows: int, df: int) -> float:
    return math.log((1 + n_rows) / (1 + df)) + 1.0


class TfidfModel:
    """A fitted vocabulary with its inverse document frequencies."""

    def __init__(self, spark: SparkSession, entries: list[tuple[str, int, int]], n_rows: int,
                 weighting: Weighting):
        self.spark = spark
        self.entries = entries
        self.terms = [e[0] for e in entries]
        self.idf = [smoothed_idf(n_rows, e[1]) for e in self.entries]
        self.n_rows = n_rows
        self.weighting = weighting

    @classmethod
    def fit(cls, df: DataFrame, text: str, weighting: Weighting, n_rows: int | None = None,
            words: str | None = None) -> "TfidfModel":
        """``words``: a stored column with the words of each row (``stored_words``), over which to pass instead of the text."""
        n = df.count() if n_rows is None else n_rows
        worded = with_words(df, text, weighting) if words is None else df
        rows = vocabulary(worded, weighting, n, words or "words").collect()
        return cls(df.sparkSession, [(r["term"], r["df"], r["cf"]) for r in rows], n, weighting)

    def vocabulary_frame(self) -> DataFrame:
        """``term_id, term, df, cf, idf``; the term id is the position in a vector."""
        rows = [(i, t, d, c, w) for i, ((t, d, c), w) in enumerate(zip(self.entries, self.idf))]
        return self.spark.createDataFrame(
            rows, "term_id int, term string, df bigint, cf bigint, idf double")

    def transform(self, df: DataFrame, text: str, idx: str = "idx", weights: str = "weights",
                  words: str | None = None) -> DataFrame:
        """Adds the term ids of each row, ascending, and their L2-normalised weights."""
        if not self.terms:
            return df.withColumn(idx, F.array().cast("array<int>")).withColumn(
                weights, F.array().cast("array<double>"))
        weigh = term_weights(self.terms, self.idf, self.weighting.sublinear, count_logs(self.spark), self.weighting.stop_words)
        # Pinned: a filter on the result would weigh the row again.
        out = pin(df.withColumn("_v", weigh(terms_text(text) if words is None else F.col(words))), "_v")
        return out.withColumn(idx, F.col("_v.idx")).withColumn(weights, F.col("_v.weights")).drop("_v")

    def save(self, path: str) -> None:
        """Vocabulary and settings as Parquet tables."""
        self.vocabulary_frame().write.mode("overwrite").parquet(f"{path}/vocabulary")
        w = self.weighting
        self.spark.createDataFrame(
            [(self.n_rows, w.max_features, w.ngram_max, w.sublinear, w.min_df, w.max_df,
              list(w.stop_words))],
            "n_rows bigint, max_features int, ngram_max int, sublinear boolean, min_df int, "
            "max_df double, stop_words array<string>",
        ).write.mode("overwrite").parquet(f"{path}/weighting")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "TfidfModel":
        s = spark.read.parquet(f"{path}/weighting").first()
        rows = spark.read.parquet(f"{path}/vocabulary").orderBy("term_id").select("term", "df", "cf").collect()
        return cls(
            spark, [tuple(r) for r in rows], s["n_rows"],
            Weighting(s["max_features"], s["ngram_max"], s["sublinear"], s["min_df"], s["max_df"],
                      tuple(s["stop_words"])),
        )


def postings(vectors: DataFrame, *keys: str, idx: str = "idx", weights: str = "weights",
             weight: str = "weight") -> DataFrame:
    """One row per term of each vector."""
    # The outer form: the plain one would compute the vectors twice, to filter on their size.
    return vectors.select(
        *keys,
        F.inline_outer(F.arrays_zip(F.col(idx).alias("term_id"), F.col(weights).alias(weight))),
    ).filter(F.col("term_id").isNotNull())
