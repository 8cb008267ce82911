import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ngrams
from tidemark.operators.selection import chronological_split

SCHEMA = "topic int, words array<string>"


def corpus(seed=3, n=300):
    rng = np.random.default_rng(seed)
    words = [f"w{i:03d}" for i in range(200)]
    rows = [(int(rng.integers(3)), [words[min(199, int(x))] for x in rng.zipf(1.4, size=int(rng.integers(0, 30)))])
            for _ in range(n)]
    return [*rows, (0, []), (1, None), (2, ["w000"] * 50), (0, ["é", "日本", "é", "日本"])]


def counted(rows, label):
    """Rows and occurrences of every word and pair, in plain loops."""
    rows_of, n = collections.Counter(), collections.Counter()
    for topic, words in rows:
        words = words or []
        for terms in (words, [f"{a} {b}" for a, b in zip(words, words[1:])]):
            keys = [(topic if label else 0, t) for t in terms]
            n.update(keys)
            rows_of.update(set(keys))
    return {k: (rows_of[k], n[k]) for k in n}


@pytest.mark.parametrize("label", [None, "topic"])
@pytest.mark.parametrize("wanted, min_df, max_df, words", [
    (20, 1, None, 1000), (20, 3, 40, 1000), (100000, 2, None, 1000), (20, 2, None, 3)])
def test_the_most_frequent_terms_are_counted_exactly(spark, monkeypatch, label, wanted, min_df, max_df, words):
    monkeypatch.setattr(ngrams, "WORDS_AT_ONCE", 100)
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = ngrams.frequent_terms(df, "words", wanted, True, min_df, max_df, label, words).collect()
    got = {(r["label"], r["term"]): (r["df"], r["cf"]) for r in out}
    want = counted(rows, label)
    assert len(got) == len(out) and got.items() <= want.items()
    total = collections.Counter()
    held = collections.Counter()
    for (_, term), (d, c) in want.items():
        total[term] += c
        held[term] += d
    eligible = sorted((t for t in total if min_df <= held[t] <= (max_df or 10**9)), key=lambda t: (-total[t], t))
    for term in eligible[:wanted]:
        for topic in range(3) if label else (0,):
            assert got.get((topic, term)) == want.get((topic, term))


def test_pairs_of_rare_words_are_not_counted(spark):
    rows = [(0, ["a", "b", f"x{i}", f"y{i}"]) for i in range(50)]
    out = ngrams.frequent_terms(spark.createDataFrame(rows, SCHEMA), "words", 2).collect()
    assert {r["term"] for r in out if " " in r["term"]} == {"a b"}


def test_words_of_a_string_count_as_those_of_a_list(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "WORDS_AT_ONCE", 100)
    rows = [(t, [f"x{w}" for w in ws] if ws else ws) for t, ws in corpus()]
    lists = spark.createDataFrame(rows, SCHEMA)
    strings = spark.createDataFrame(
        [(t, ws if ws is None else " y " + " z  ".join(ws) + " é") for t, ws in rows], "topic int, words string")
    for least in (1000, 3):
        want, got = (sorted(map(tuple, ngrams.frequent_terms(df, "words", 40, label="topic", frequent_words=least).collect()))
                     for df in (lists, strings))
        assert got == want
    assert [r[0] for r in strings.select(ngrams.without(("xw000",))("words")).collect()] == [
        " ".join(w for w in ws or [] if w != "xw000") for _, ws in rows]


def test_weights_take_the_logarithms_of_spark(spark):
    df = spark.createDataFrame([("aa aa aa bb",)], "words string")
    got = df.select(ngrams.term_weights(["aa", "bb"], [1.5, 1.25], True, ngrams.count_logs(spark))("words")).first()[0]
    ln3 = spark.range(1).select(F.ln(F.lit(3.0))).first()[0]
    w = [(1.0 + ln3) * (3 * 1.5) / 3, 1.25]
    norm = (w[0] * w[0] + w[1] * w[1]) ** 0.5
    assert got["idx"] == [0, 1] and got["weights"] == [w[0] / norm, w[1] / norm]


def test_the_split_makes_its_rows_twice_only(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(40).select(F.col("id").alias("doc_id"), F.timestamp_seconds("id").alias("ts"))
    rows = chronological_split(df.mapInArrow(count, df.schema), 0.5).collect()
    assert sum(r["period"] == "baseline" for r in rows) == 20 and seen.value == 80
