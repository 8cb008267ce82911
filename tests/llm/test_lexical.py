import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.cases import ODD, SCHEMA, documents, lower, sample, with_clashes
from tidemark.llm import lexical

ITEMS = "item_id long, text string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text))


def brute(docs, items, k=20):
    counts = [(doc, Counter(terms(text))) for doc, text in docs if doc is not None and terms(text)]
    total = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c in counts:
            m = 75 + 25 * sum(c.values()) * len(counts) // total
            score = sum(
                math.floor(1000 * math.log((2 * len(counts) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                for t in terms(text) if t in c
            )
            if score > 0:
                found.append((-score, doc))
        out += [(item, r + 1, doc, -s) for r, (s, doc) in enumerate(sorted(found)[:k])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def test_equal_to_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in sample(spark, sf).collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = rows_of(lexical.op12_lexical_search(spark, sf))
    assert got == brute(docs, items) and len(got) > 400


@pytest.mark.parametrize("cells", [1, 50, 2_000_000])
def test_blocks_steps_and_ties(spark, monkeypatch, cells):
    monkeypatch.setattr(lexical, "CELLS", cells)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choices(words, weights=[30 - j for j in range(30)], k=rng.randint(1, 30)))) for i in range(150)]
    docs += [(1000 - i, "w1 w2 W2 w29") for i in range(40)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 8)))) for i in range(25)]
    df, asked = documents(spark, [(*d, "en", "a") for d in docs]).repartition(5), spark.createDataFrame(items, ITEMS)
    want = brute(docs, items)
    assert rows_of(lexical.ranked(df, asked)) == want
    assert rows_of(lexical.ranked(df, asked, block_chars=60)) == want
    assert rows_of(lexical.ranked(df, asked, k=3)) == brute(docs, items, 3)


def test_sums_beyond_the_exact_range_of_doubles():
    items = [("a", "x y"), ("b", "y y y z")]
    index = lexical.inverted(items)
    weights = np.array([3, 5, 7])
    args = weights, np.array([0, 1, 2, 1]), np.array([2, 1, 4, 9]), np.array([0, 0, 0, 1]), np.array([100, 80]), 2
    assert (lexical.scores_of(index | {"exact": True}, *args) == lexical.scores_of(index | {"exact": False}, *args)).all()
    assert lexical.normalised(np.array([10**9]), 10**12, 10**13).tolist() == [75 + 25 * 10**9 // 10]


def test_odd_rows_and_clashing_columns(spark):
    docs = [*ODD, (1, "word again", "en", "a"), (11, "x x x", "en", "a")]
    items = [(1, "word É LONG"), (2, None), (3, ""), (None, "word"), (1, "zz"), (4, "text " * 3000), (5, "nowhere found"), (5, "nowhere found")]
    asked = with_clashes(spark.createDataFrame(items, ITEMS))
    got = lexical.ranked(with_clashes(documents(spark, docs)), asked)
    once = [(1, "word É LONG"), (4, "text " * 3000), (5, "nowhere found")]
    assert rows_of(got) == brute([(d[0], d[1]) for d in docs], once)
    empty = spark.createDataFrame([], SCHEMA)
    assert lexical.ranked(empty, asked).count() == 0
    assert lexical.ranked(documents(spark, docs), spark.createDataFrame([], ITEMS)).count() == 0
    named = lexical.ranked(documents(spark, docs), spark.createDataFrame([("one", "word")], "item_id string, text string"))
    assert {r["item_id"] for r in named.collect()} == {"one"}
