import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ranking, retrieval, sizing, tfidf, vectors

TEXTS = [
    ("Card bill with a purchase in a city that I never saw", "Credit Card"),
    ("Collector sends letters about an old gym debt every week", "Debt Collection"),
    ("Bureau report mixes my file with that of a namesake", "Credit Reporting"),
    ("Lender moved the mortgage due date without a letter", "Mortgages & Loans"),
    ("Savings account closed at the branch without a reason", "Retail Banking"),
]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(6 * k + i, t, c) for k in range(6) for i, (t, c) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id bigint, narrative string, category string")


def grams(text):
    words = re.findall(r"\w{2,}", text.lower())
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute_vectors(texts, w):
    counts = [Counter(grams(t)) for t in texts]
    df = Counter(t for c in counts for t in c)
    cf = sum(counts, Counter())
    n = len(texts)
    kept = sorted((t for t in df if w.min_df <= df[t] <= w.max_df * n), key=lambda t: (-cf[t], t))[: w.max_features]
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in kept}

    def vector(c):
        v = {t: (1 + math.log(k)) * idf[t] for t, k in c.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    return vector, [vector(c) for c in counts]


def test_index_equals_brute_force(spark, corpus):
    w = tfidf.Weighting(max_features=40)
    index = retrieval.TfidfIndex.build(corpus, weighting=w)
    texts = {r["doc_id"]: r["narrative"] for r in corpus.collect()}
    ids = sorted(texts)
    vector, want = brute_vectors([texts[i] for i in ids], w)
    got = {r["doc_id"]: dict(zip((index.model.terms[i] for i in r["idx"]), r["weights"]))
           for r in index.vectors.collect()}
    for i, v in zip(ids, want):
        assert got[i].keys() == v.keys()
        assert all(abs(got[i][t] - v[t]) < 1e-12 for t in v)
    q = "purchase on the card bill of a closed account"
    asked = spark.createDataFrame([(7, q)], "query_id bigint, query string")
    qv = vector(Counter(grams(q)))
    scores = {i: sum(qv.get(t, 0) * x for t, x in v.items()) for i, v in zip(ids, want)}
    best = sorted(ids, key=lambda i: (-round(scores[i], 9), i))[:4]
    found = index.query(asked, 4).orderBy("rank").collect()
    assert [r["doc_id"] for r in found] == best and [r["rank"] for r in found] == [1, 2, 3, 4]


def test_query_without_common_terms_is_filled(spark, corpus):
    index = retrieval.TfidfIndex.build(corpus)
    asked = spark.createDataFrame([(1, "zzz qqq"), (2, "")], "query_id bigint, query string")
    rows = index.query(asked, 3).collect()
    assert len(rows) == 6 and all(r["score"] == 0.0 for r in rows)


def test_blocks_of_queries_give_the_same_answer(spark, corpus, monkeypatch):
    index = retrieval.TfidfIndex.build(corpus)
    asked = spark.createDataFrame(
        [(i, t) for i, (t, _) in enumerate(TEXTS)], "query_id bigint, query string")
    one = sorted(map(tuple, index.query(asked, 3).collect()))
    monkeypatch.setattr(retrieval, "QUERIES_AT_ONCE", 2)
    monkeypatch.setattr(retrieval, "VALUES_AT_ONCE", 7)
    assert sorted(map(tuple, index.query(asked, 3).collect())) == one
    for name, size in (("SEGMENT_ROWS", 4), ("SEGMENTS_AT_ONCE", 2), ("QUERIES_A_VISIT", 2)):
        monkeypatch.setattr(retrieval, name, size)
    small = retrieval.TfidfIndex(index.model, index.vectors)
    assert small.segments.count() >= 30 / 4
    assert sorted(map(tuple, small.query(asked, 3).collect())) == one


def test_segments_below_the_kth_score_are_not_visited(spark, monkeypatch):
    topic = lambda i: " ".join(f"{'abcdefgh'[i % 8]}word{(i * 7 + j) % 23}" for j in range(6))
    rows = [(i, topic(i // 40), "x") for i in range(320)]
    cases = spark.createDataFrame(rows, "doc_id bigint, narrative string, category string").coalesce(1)
    monkeypatch.setattr(retrieval, "SEGMENT_ROWS", 40)
    index = retrieval.TfidfIndex.build(cases.orderBy("doc_id").coalesce(1))
    asked = spark.createDataFrame([(i, topic(i)) for i in range(8)], "query_id bigint, query string")
    visits = []
    visited = retrieval.TfidfIndex._visited
    monkeypatch.setattr(retrieval.TfidfIndex, "_visited", lambda self, dealt, to, k: visits.append(to) or visited(self, dealt, to, k))
    got = index.query(asked, 5, fill=False).collect()
    assert all(r["doc_id"] // 40 == r["query_id"] for r in got) and len(got) == 40
    assert visits[0].count() == 8 and visits[1].count() == 0


def test_queries_stay_off_the_driver(spark, corpus, monkeypatch):
    index = retrieval.TfidfIndex.build(corpus)
    asked = spark.range(3000).selectExpr("id as query_id", "concat('card purchase number', id % 7) as query")
    index.segments
    frame, brought = type(asked), []
    for name in ("collect", "toLocalIterator", "toPandas", "toArrow"):
        monkeypatch.setattr(frame, name, lambda self, *a, f=getattr(frame, name), **b: brought.append(1) or f(self, *a, **b))
    found = index.query(asked, 2)
    assert not brought
    assert found.groupBy("query_id").count().filter("count = 2").count() == 3000


def test_evaluation_and_saved_index(spark, corpus, tmp_path):
    index = retrieval.TfidfIndex.build(corpus)
    queries = spark.createDataFrame(
        [(1, "purchase on a card bill", "Credit Card"), (2, "letters of the collector", "Debt Collection")],
        "query_id bigint, query string, category string")
    matches = index.query(queries, 3)
    perf = retrieval.evaluate(matches, queries, corpus, 3).first()
    assert perf["hit_rate_at_k"] == 1.0 and perf["precision_at_k"] > 0.5
    assert perf["queries_evaluated"] == 2 and perf["top_k"] == 3
    index.save(str(tmp_path / "index"))
    again = retrieval.TfidfIndex.load(spark, str(tmp_path / "index")).query(queries, 3)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, matches.collect()))
    cases = retrieval.with_case_details(matches, corpus, snippet=12).collect()
    assert all(len(r["text"]) <= 12 for r in cases)


def test_engine_choice(spark):
    def pick(*rows):
        s = spark.createDataFrame(rows, "engine string, paraphrase_top1_accuracy double, mrr_at_k double")
        return retrieval.choose_engine(s).first()["chosen_engine"]

    assert pick(("tfidf", 1.0, 0.81), ("dense", 0.8, 0.83)) == "tfidf"
    assert pick(("tfidf", 0.6, 0.81), ("dense", 0.8, 0.83)) == "dense"
    assert pick(("tfidf", 0.6, 0.84), ("dense", 0.8, 0.83)) == "tfidf"


def test_dense_top_k_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    m = rng.standard_normal((300, 8))
    m[50:80] = m[40]  # ties are broken by id
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)],
                               "vec_id bigint, embedding array<double>").repartition(5)
    q = spark.createDataFrame([(i, [float(x) for x in m[i]]) for i in (40, 3, 7, 11)],
                              "query_id bigint, embedding array<double>")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for per_scan in (16_384, 2):
        monkeypatch.setattr(ranking.in_chunks, "__defaults__", (per_scan,))
        monkeypatch.setattr(vectors, "QUERIES_PER_SCAN", per_scan)
        got = {}
        for r in vectors.top_k_cosine(df, q, 6).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        for i in (40, 3, 7, 11):
            s = np.round(unit @ unit[i], 9)
            assert got[i] == sorted(range(300), key=lambda j: (-s[j], j))[:6]


def test_driver_side_collections_are_bounded(spark):
    with pytest.raises(ValueError):
        sizing.collect_bounded(spark.range(11), 10)
    assert len(sizing.collect_bounded(spark.range(10), 10)) == 10


def test_vectors_may_be_missing_and_queries_may_repeat(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "vec_id bigint, embedding array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.1]), (8, None)], "query_id bigint, embedding array<double>")
    assert [r["vec_id"] for r in vectors.top_k_cosine(df, q, 5).orderBy("rank").collect()] == [1, 3]


def test_nearest_centroid_in_several_scans(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows, cents = rng.standard_normal((50, 4)), rng.standard_normal((7, 4))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)] + [(99, None)],
                               "doc_id int, embedding array<double>")
    c = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(cents)], "cluster_id int, centroid array<double>")
    one = sorted(map(tuple, vectors.nearest_centroid(df, c, "doc_id").collect()))
    assert one[-1][:2] == (99, -1)
    monkeypatch.setattr(ranking.in_chunks, "__defaults__", (3,))
    assert sorted(map(tuple, vectors.nearest_centroid(df, c, "doc_id").collect())) == one


def test_weights_of_odd_texts_equal_brute_force(spark):
    texts = ["", " a b c ", "a " * 20_000 + "long run a end", "Élan vital, élan b vital; 東京 x 東京", "end_of 12 7 long run",
             "run\trun--run é run", "the élan of the run"]
    w = tfidf.Weighting(max_features=30, min_df=1, max_df=1.0, stop_words=("the", "of"))
    df = spark.createDataFrame([*enumerate(texts), (len(texts), None)], "doc_id bigint, cleaned string")
    plain = [" ".join(x for x in re.findall(r"\w{2,}", t.lower()) if x not in w.stop_words) for t in [*texts, ""]]
    _, want = brute_vectors(plain, w)
    worded = tfidf.stored_words(df, "cleaned", w, "doc_id")
    for model, rows in [(tfidf.TfidfModel.fit(worded, "cleaned", w, words="words"), "words"), (tfidf.TfidfModel.fit(df, "cleaned", w), None)]:
        out = model.transform(worded if rows else df, "cleaned", words=rows).filter(F.size("idx") >= 0)
        got = {r["doc_id"]: dict(zip((model.terms[i] for i in r["idx"]), r["weights"])) for r in out.collect()}
        assert len(got) == len(want)
        for i, v in enumerate(want):
            assert got[i].keys() == v.keys() and all(abs(got[i][t] - v[t]) < 1e-12 for t in v)


def test_an_index_is_made_from_words_found_once(spark, corpus, monkeypatch):
    asked = []
    monkeypatch.setattr(tfidf, "terms_text", lambda c, real=tfidf.terms_text: asked.append(c) or real(c))
    retrieval.TfidfIndex.build(corpus, weighting=tfidf.Weighting(max_features=40))
    assert len(asked) == 1


def test_few_queries_pass_over_segments_without_storing_them(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "SEGMENT_ROWS", 7)
    rng = np.random.default_rng(2)
    texts = [" ".join(f"word{min(40, int(x))}" for x in rng.zipf(1.3, 12)) for _ in range(150)] + ["word1 word2"] * 12
    corpus = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, narrative string").repartition(3)
    asked = spark.createDataFrame([*((i, t) for i, t in enumerate(texts[::9])), (900, "unknown"), (901, ""), (902, None)],
                                  "query_id bigint, query string")
    few = retrieval.TfidfIndex.build(corpus, weighting=tfidf.Weighting(max_features=60))
    answers = []
    for at_once in (1024, 3):
        monkeypatch.setattr(retrieval, "QUERIES_A_VISIT", at_once)
        answers.append([sorted(map(tuple, few.query(asked, 4, fill=fill).collect())) for fill in (True, False)])
        assert (few._segments is None) == (at_once > len(texts))
    assert answers[0] == answers[1] and len(answers[0][0]) == 4 * asked.count()


def test_many_queries_meet_blocks_of_segments(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"word{min(70, int(x))}" for x in rng.zipf(1.3, int(rng.integers(1, 30)))) for _ in range(170)]
    texts += ["word1 word2 word3"] * 20 + texts[:15] + ["", "unknown", " ".join(f"word{i % 60}" for i in range(400))]
    corpus = spark.createDataFrame([(7 * i % 211, t) for i, t in enumerate(texts)], "doc_id bigint, narrative string").repartition(3)
    asked = spark.createDataFrame([*((i, t) for i, t in enumerate(texts)), (900, None), (None, "word1 word2")], "query_id bigint, query string")
    index = retrieval.TfidfIndex.build(corpus, weighting=tfidf.Weighting(max_features=120))
    rows = {r["doc_id"]: dict(zip(r["idx"], r["weights"])) for r in index.vectors.collect()}
    want = set()
    for q, t in enumerate(texts):
        of = rows[7 * q % 211]
        found = sorted((-round(sum(w * v.get(i, 0.0) for i, w in of.items()), 9), d) for d, v in rows.items())
        want |= {(q, d, -s, r) for r, (s, d) in enumerate(found[:4], 1) if s < 0}
    # Before, each query met segments by their bounds, nearly all of them one by one.
    for name in ("_bounds", "_visited"):
        monkeypatch.setattr(retrieval.TfidfIndex, name, lambda *_: pytest.fail("one visit after the other"))
    monkeypatch.setattr(retrieval, "QUERIES_A_VISIT", 100)
    for sizes in ({}, {"SEGMENT_ROWS": 11, "BLOCK_ROWS": 40, "BLOCK_VALUES": 300, "ASKED_ROWS": 50, "ASKED_VALUES": 90, "LEAST_ASKED": 2,
                       "DENSE_TERMS": 3, "DENSE_QUERIES": 5}):
        for name, size in sizes.items():
            monkeypatch.setattr(retrieval, name, size)
        index = retrieval.TfidfIndex(index.model, index.vectors)
        got = index.query(asked, 4, fill=False).collect()
        assert {(r["query_id"], r["doc_id"], r["rank"]) for r in got} == {(q, d, r) for q, d, _, r in want} and len(got) == len(want)
        assert {(r["query_id"], r["rank"]): r["score"] for r in got} == pytest.approx({(q, r): s for q, _, s, r in want}, abs=2e-9)
        filled = index.query(asked, 4)
        assert filled.count() == 4 * asked.count()


def test_rows_of_one_id_take_one_place_among_many_queries(spark, monkeypatch):
    texts = ["card bill late", "card bill", "card fee late", "loan card", "bill fee loan", "fee late bill card"] * 3
    corpus = spark.createDataFrame([(i % 7 if i < 14 else 3, t) for i, t in enumerate(texts)], "doc_id bigint, narrative string").coalesce(1)
    index = retrieval.TfidfIndex.build(corpus, weighting=tfidf.Weighting(min_df=1, max_df=1.0))
    asked = spark.createDataFrame([*enumerate(texts[:6])], "query_id bigint, query string")
    rows = [(r["doc_id"], dict(zip(r["idx"], r["weights"]))) for r in index.vectors.collect()]
    own = {r["narrative"]: v for r, (_, v) in zip(corpus.collect(), rows)}
    monkeypatch.setattr(retrieval, "QUERIES_A_VISIT", 2)
    got = {(r["query_id"], r["rank"]): r["doc_id"] for r in index.query(asked, 4).collect()}
    for q, t in enumerate(texts[:6]):
        best = {}
        for d, v in rows:
            best[d] = max(best.get(d, 0.0), round(sum(w * v.get(i, 0.0) for i, w in own[t].items()), 9))
        assert [got[q, r] for r in range(1, 5)] == sorted(best, key=lambda d: (-best[d], d))[:4]
