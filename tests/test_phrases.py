import random

from pyspark.sql import functions as F

from tidemark.functions import lexicon
from tidemark.functions.severity import with_severity
from tidemark.operators import phrases
from tidemark.policy import severity as policy

TEXTS = [(1, "the bank took a late fee, and a late fee again"), (2, "late  fee"), (3, ""), (4, None),
         (5, "a late-fee is no late fee."), (6, "wire fraud, identity theft and fraud"), (7, "fee" + " fee" * 3000),
         (8, "late fee late"), (9, "late fee late")]


def frame(spark, rows=TEXTS):
    return spark.createDataFrame(rows, "doc_id bigint, cleaned string")


def found(df):
    return sorted(tuple(r) for r in df.collect())


def literal(df, keywords):
    out = lexicon.with_padded_tokens(df, "cleaned", "_p", "_t")
    out = lexicon.with_matches(out, keywords, "_p", "_t", "_f")
    return out.select("doc_id", F.explode(lexicon.in_order(keywords, "_f")).alias("keyword"))


def test_equal_to_the_literal_lexicon(spark):
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choice(["a", "b,", "c", "d's", "e-f", "(a"]) for _ in range(rng.randrange(0, 40))))
             for i in range(200)]
    keywords = ["a", "b", "a b", "c a b", "s", "e", "f c", "- f", "a a a a", "zz", "d ' s"]
    table = spark.createDataFrame([(k, "x") for k in keywords + ["", None, "  ", "a"]], "keyword string, note string")
    for df, ks, t in ((frame(spark, texts), keywords, table),
                      (frame(spark), ["late fee", "fee", "wire fraud"],
                       spark.createDataFrame([("late fee",), ("fee",), ("wire fraud",)], "keyword string"))):
        want = found(literal(df, ks))
        assert want and found(phrases.matches(df, t)) == want
        assert found(phrases.matches(df, t, max_broadcast=0)) == want


def test_severity_from_a_table_equals_the_literal_path(spark):
    words = [k for _, ks in policy.SIGNALS.values() for k in ks] + ["and", "the,"]
    rng = random.Random(9)
    df = frame(spark, TEXTS + [(100 + i, " ".join(rng.sample(words, rng.randrange(0, 9)))) for i in range(150)])
    columns = ["doc_id", "risk_score", "severity_level", "matched_signals", "detected_keywords"]
    want = sorted(with_severity(df.fillna("")).select(*columns).collect())
    table = phrases.signal_table(spark)
    assert sorted(phrases.severity(df, table).collect()) == want
    assert sorted(phrases.severity(df, table, max_broadcast=0).collect()) == want
    assert {r["severity_level"] for r in want} == {"Critical", "High", "Medium", "Low"}


def test_empty_lexicon_and_empty_texts(spark):
    none = phrases.signal_table(spark).limit(0)
    assert phrases.matches(frame(spark), none).count() == 0
    assert {r["risk_score"] for r in phrases.severity(frame(spark), none).collect()} == {0.0}
    assert phrases.severity(frame(spark).limit(0), phrases.signal_table(spark)).count() == 0


def test_a_hundred_thousand_keywords(spark):
    table = spark.range(100_000).select(F.concat_ws(
        " ", F.concat(F.lit("w"), "id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("v"), "id"))).alias("keyword"))
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat_ws(
        " ", F.lit("x"), F.concat(F.lit("w"), F.col("id") * 50), F.concat(F.lit("v"), F.col("id") * 50),
        F.concat(F.lit("w"), F.col("id") * 50 + 1)).alias("cleaned"))
    got = phrases.matches(df, table)
    assert got.count() == 4000 and got.filter("keyword LIKE '% %'").count() == 2000
