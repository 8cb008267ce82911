"""Counts of words and of adjacent pairs of frequent words, put together by batch before Spark adds them up.

A pair occurs no more often than either of its words. Where only the most frequent terms are wanted, words tell how
frequent a pair must be, and pairs of rarer words need no counting: they are most of all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.functions.pinning import unnest
from tidemark.operators.cutoff import most_frequent
from tidemark.session import stored

#: Words that a task takes at once, and frequent words that may be sent to the tasks.
WORDS_AT_ONCE = 1_000_000
FREQUENT_WORDS = 400_000

#: Counts whose logarithms are kept.
LOGS = 32_768


def _parts(words: pa.Array):
    """Rows with about ``WORDS_AT_ONCE`` words each: the first, the last, the words and the row of each word.

    The words of a row come as a list, or as a string with blanks between them; of a string, words of one character do not count.
    """
    text = pa.types.is_string(words.type) or pa.types.is_large_string(words.type)
    lists = pc.split_pattern(words, " ") if text else words
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.cumsum(sizes)
    at = 0
    while at < len(lists):
        start = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, start + WORDS_AT_ONCE, side="right")))
        flat, row = pc.list_flatten(lists.slice(at, end - at)), np.repeat(np.arange(end - at), sizes[at:end])
        if text:
            flat, row = _kept(flat, row, pc.greater(pc.utf8_length(flat), 1))
        yield at, end, flat, row
        at = end


def _kept(flat: pa.Array, row: np.ndarray, keep: pa.Array) -> tuple[pa.Array, np.ndarray]:
    return flat.filter(keep), row[keep.to_numpy(zero_copy_only=False)]


def _runs(batches):
    """Rows with about ``WORDS_AT_ONCE`` words each: their labels, words and the row of each word."""
    for batch in batches:
        labels = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for at, end, flat, row in _parts(batch.column(1)):
            yield labels[at:end], flat, row


class _Terms:
    """Finds words and pairs of words among given terms."""

    def __init__(self, names: list[str]):
        parts = [t.split(" ") for t in names]
        self.known = pa.array(sorted({w for p in parts for w in p}), pa.string())
        at_word = {w: i for i, w in enumerate(self.known.to_pylist())}
        self.single = np.full(len(self.known) + 1, -1)
        for i, p in enumerate(parts):
            if len(p) == 1:
                self.single[at_word[p[0]]] = i
        pairs = sorted((at_word[p[0]] * len(self.known) + at_word[p[1]], i) for i, p in enumerate(parts) if len(p) == 2)
        self.pair_keys, self.pair_terms = np.array([k for k, _ in pairs], np.int64), np.array([i for _, i in pairs], np.int64)

    def found(self, flat: pa.Array, row: np.ndarray):
        """Position among the terms and row of each known word, and then of each known pair."""
        code = pc.fill_null(pc.index_in(flat, self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        key = self.single[code]
        at = np.flatnonzero(key >= 0)
        yield key[at], row[at]
        if len(self.pair_keys):
            at = np.flatnonzero((code[:-1] >= 0) & (code[1:] >= 0) & (row[:-1] == row[1:]))
            key = code[at] * len(self.known) + code[at + 1]
            near = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            hit = np.flatnonzero(self.pair_keys[near] == key)
            yield self.pair_terms[near[hit]], row[at[hit]]


def _tallied(labels, row, key):
    """Label, key, rows and occurrences of each label and key."""
    if not len(key):
        return key, key, key, key
    names, place = np.unique(labels, return_inverse=True)
    span = int(key.max()) + 1
    both = place[row] * span + key
    # Rows ascend, and a stable sort leaves them so within a key.
    order = np.argsort(both, kind="stable")
    both, row = both[order], row[order]
    new = np.append(True, both[1:] != both[:-1])
    first = np.flatnonzero(new)
    another = new | np.append(True, row[1:] != row[:-1])
    rows = np.add.reduceat(another.astype(np.int64), first)
    return names[both[first] // span], both[first] % span, rows, np.diff(np.append(first, len(both)))


def word_counts(df: DataFrame, words: str, label: str | None = None) -> DataFrame:
    """``label, term, df, cf``: the rows that hold a word and its occurrences, by label (0 without one)."""

    def run(batches):
        for labels, flat, row in _runs(batches):
            coded = pc.dictionary_encode(flat)
            at = np.flatnonzero(coded.indices.is_valid().to_numpy(zero_copy_only=False))
            key = pc.fill_null(coded.indices, 0).to_numpy(zero_copy_only=False).astype(np.int64)[at]
            label, key, rows, n = _tallied(labels, row[at], key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(label), coded.dictionary.take(pa.array(key)), pa.array(rows), pa.array(n)],
                names=["label", "term", "df", "cf"])

    return _summed(_asked(df, words, label).mapInArrow(run, _COUNTS), "term")


def pair_counts(df: DataFrame, words: str, frequent: list[str], label: str | None = None) -> DataFrame:
    """``label, term, df, cf`` of the pairs of words next to each other that are both frequent, by label."""
    known = pa.array(sorted(frequent), pa.string())
    n_known = len(known)

    def run(batches):
        for labels, flat, row in _runs(batches):
            code = pc.fill_null(pc.index_in(flat, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.flatnonzero((code[:-1] >= 0) & (code[1:] >= 0) & (row[:-1] == row[1:]))
            label, key, rows, n = _tallied(labels, row[at], code[at] * n_known + code[at + 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(label), pa.array(key), pa.array(rows), pa.array(n)], names=["label", "pair", "df", "cf"])

    def named(batches):
        for batch in batches:
            pair = batch.column(1).to_numpy()
            term = pc.binary_join_element_wise(
                known.take(pa.array(pair // n_known)), known.take(pa.array(pair % n_known)), " ")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), term, batch.column(2), batch.column(3)], names=["label", "term", "df", "cf"])

    counted = _asked(df, words, label).mapInArrow(run, "label bigint, pair bigint, df bigint, cf bigint")
    return _summed(counted, "pair").mapInArrow(named, _COUNTS)


def all_pair_counts(df: DataFrame, words: str, label: str | None = None) -> DataFrame:
    """The same for all pairs, each a row on its way to its count."""
    t = F.col(words) if isinstance(df.schema[words].dataType, T.ArrayType) else F.filter(
        F.split(words, " "), lambda w: F.length(w) > 1)
    n = F.greatest(F.size(t) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(t, 1, n), F.slice(t, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))
    paired = _asked(df, words, label).withColumn("_pairs", pairs)
    both = paired.select("label", F.inline(F.array(
        F.struct(F.lit(0).alias("df"), F.lit(1).alias("cf"), F.col("_pairs").alias("_terms")),
        F.struct(F.lit(1).alias("df"), F.lit(0).alias("cf"), F.array_distinct("_pairs").alias("_terms")))))
    return _summed(unnest(both, ["label", "df", "cf"], "_terms", "term"), "term")


def counts_of(df: DataFrame, words: str, terms: list[str], label: str) -> DataFrame:
    """``label, term, df, cf`` of some words and pairs of words only; no other term leaves a task."""
    names = sorted(set(terms))
    wanted = _Terms(names)

    def run(batches):
        for labels, flat, row in _runs(batches):
            for key, of in wanted.found(flat, row):
                label, key, rows, n = _tallied(labels, of, key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(label), pa.array(key), pa.array(rows), pa.array(n)], names=["label", "key", "df", "cf"])

    def named(batches):
        for batch in batches:
            term = pa.array(names, pa.string()).take(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), term, batch.column(2), batch.column(3)], names=["label", "term", "df", "cf"])

    counted = _asked(df, words, label).mapInArrow(run, "label bigint, key bigint, df bigint, cf bigint")
    return _summed(counted, "key").mapInArrow(named, _COUNTS)


_logs: list[np.ndarray] = []


def count_logs(spark: SparkSession) -> np.ndarray:
    """Logarithms of the counts below ``LOGS`` as Spark takes them; numpy's differ in the last bit, for 3 already."""
    if not _logs:
        rows = spark.range(1, LOGS).select(F.ln(F.col("id").cast("double"))).toArrow()
        _logs.append(np.append(-np.inf, rows.column(0).to_numpy()))
    return _logs[0]


def term_weights(terms: list[str], idf: list[float], sublinear: bool, logs: np.ndarray, stop: tuple = ()):
    """A function of the words of a row: positions of its terms, ascending, and their weights, scaled to length 1."""
    wanted, idf, stopped = _Terms(terms), np.array(idf), pa.array(stop, pa.string())

    @F.arrow_udf("struct<idx:array<int>,weights:array<double>>")
    def weighed(words: pa.Array) -> pa.Array:
        sizes, terms, weights = [], [], []
        for at, end, flat, row in _parts(words):
            if len(stopped):
                flat, row = _kept(flat, row, pc.invert(pc.is_in(flat, stopped)))
            both = [np.concatenate(x) for x in zip(*wanted.found(flat, row))]
            key, tf = np.unique(both[1] * len(idf) + both[0], return_counts=True)
            row, term = np.divmod(key, len(idf))
            w = tf * idf[term]
            if sublinear:
                log = np.where(tf < len(logs), logs[np.minimum(tf, len(logs) - 1)], np.log(tf))
                w = (1.0 + log) * w / tf
            norm = np.sqrt(np.bincount(row, w * w, end - at))
            sizes.append(np.bincount(row, minlength=end - at))
            terms.append(term)
            weights.append(w / norm[row])
        upto = pa.array(np.concatenate([[0], *sizes]).cumsum().astype(np.int32))
        term, weight = (np.concatenate(x) if x else np.empty(0) for x in (terms, weights))
        return pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(upto, pa.array(term.astype(np.int32))),
             pa.ListArray.from_arrays(upto, pa.array(weight))], names=["idx", "weights"])

    return weighed


def without(stop: tuple):
    """A function of the words of a row, as one string: the same without some words."""
    stopped = pa.array(stop, pa.string())

    @F.arrow_udf("string")
    def kept(words: pa.Array) -> pa.Array:
        out = []
        for at, end, flat, row in _parts(words):
            flat, row = _kept(flat, row, pc.invert(pc.is_in(flat, stopped)))
            upto = np.append(0, np.bincount(row, minlength=end - at)).cumsum().astype(np.int32)
            out.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(upto), flat), " ").cast(pa.string()))
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    return kept


def frequent_terms(
    df: DataFrame, words: str, n: int, pairs: bool = True, min_df: int = 1, max_df: float | None = None,
    label: str | None = None, frequent_words: int = FREQUENT_WORDS,
) -> DataFrame:
    """``label, term, df, cf`` of words and, with ``pairs``, of pairs, by label (0 without one).

    Among them are the ``n`` of most occurrences in all labels, ties by any rule, of those terms that lie in ``min_df`` to
    ``max_df`` rows, with exact counts. A pair is left out only if one of its words shows that it cannot be one of them.
    """
    counts = stored(word_counts(df, words, label), "word-counts")
    if not pairs:
        return counts
    totals = counts
    if label is not None:
        totals = stored(counts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")), "word-totals")
    enough = F.col("df") >= min_df
    eligible = totals.filter(enough if max_df is None else enough & (F.col("df") <= max_df))
    found, least = eligible.filter(most_frequent(eligible, "cf", "term", n)).agg(F.count("*"), F.min("cf")).first()
    if found < n:
        least = min_df
    frequent = totals.filter(enough & (F.col("cf") >= least)).select("term").limit(frequent_words + 1).collect()
    if len(frequent) > frequent_words:
        return counts.unionByName(all_pair_counts(df, words, label))
    return counts.unionByName(pair_counts(df, words, [r["term"] for r in frequent], label))


_COUNTS = "label bigint, term string, df bigint, cf bigint"


def _asked(df: DataFrame, words: str, label: str | None) -> DataFrame:
    return df.select((F.lit(0) if label is None else F.col(label)).cast("bigint").alias("label"), words)


def _summed(counts: DataFrame, key: str) -> DataFrame:
    return counts.groupBy("label", key).agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
