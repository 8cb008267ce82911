import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import ODD, SCHEMA, documents, sample, with_clashes, words
from tidemark.llm import lm


def tokens(text):
    return [*words(text), None]


def base_scores(rows):
    counts = Counter(t for doc, text in rows if zlib.crc32(str(doc).encode()) % 7 != 2 for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    out = {}
    for doc, text in rows:
        own = tokens(text)
        out[doc] = (
            zlib.crc32(str(doc).encode()) % 7 == 2, len(own), sum(t in counts for t in own), n,
            sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own),
        )
    return out


def test_base_scores_and_likelihood(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in sample(spark, sf).collect()]
    got = lm.op10_lm_score(spark, sf).collect()
    want = base_scores(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == want[r["doc_id"]][:4]
        assert r["base_score"] == pytest.approx(want[r["doc_id"]][4])
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_scores_equal_a_plain_mixture(spark, monkeypatch):
    rows = [(i, " ".join("abcab"[(i * k) % 5] for k in range(i % 9))) for i in range(60)] + [(100, "z z a")]
    fixed = np.tile([0.6, 0.3, 0.1], (lm.BUCKETS, 1))
    monkeypatch.setattr(lm, "learnt", lambda *a: fixed)
    df = documents(spark, [(i, t, "en", "a") for i, t in rows]).repartition(3)
    got = {r["doc_id"]: r["score"] for r in lm.scored(df, F.col("doc_id") < 50, chunk_tokens=40).collect()}
    uni, pair, context = Counter(), Counter(), Counter()
    for i, t in rows:
        if i < 50:
            own = tokens(t)
            uni.update(own)
            pair.update(zip(["^", *own], own, strict=False))
            context.update(["^", *own[:-1]])
    n, v = sum(uni.values()), len(uni)
    for i, t in rows:
        own, total = tokens(t), 0.0
        for u, w in zip(["^", *own], own, strict=False):
            weights = np.array([0.6, 0.3, 0.1]) if context[u] else np.array([0, 0.3, 0.1]) / 0.4
            total += math.log10(weights @ [pair[u, w] / max(1, context[u]), uni[w] / n, 1 / (v + 1)])
        assert got[i] == pytest.approx(total)


def test_weights_maximise_the_held_out_likelihood():
    import pyarrow as pa

    rows = pa.table({"bucket": [3, 3, 5], "p2": [-5, lm.NEVER, -2], "p1": [-30, -20, -30], "n": [70, 30, 10]})
    w = lm.learnt(rows, 1e-6, rounds=400)
    like = lambda x: 70 * math.log(x * 10**-0.5 + (1 - x) * 1e-3) + 30 * math.log((1 - x) * 1e-2)
    best = max((k / 1000 for k in range(1, 1000)), key=like)
    assert w[3, 0] == pytest.approx(best, abs=0.01) and w[5, 0] > 0.9
    assert np.allclose(w.sum(axis=1), 1) and np.allclose(w[0], lm.DEFAULT)


def test_packing_round_trip():
    rng = np.random.default_rng(1)
    for values in ([], [0], [1 << 63, 5], rng.integers(0, 1 << 20, 1000)):
        values = np.array(values, np.uint64)
        assert (lm.unpack(lm.pack(values)) == values).all()
        assert (lm.unpack_sorted(lm.pack_sorted(np.sort(values))) == np.sort(values)).all()


def test_odd_rows_and_clashing_columns(spark):
    df = with_clashes(documents(spark, ODD)).withColumns({"chunk": F.lit(1), "fold": F.lit(2), "trained": F.lit(3)})
    rows = lm.scored(df, F.lit(True)).collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_tokens"] == by[2]["n_tokens"] == by[3]["n_tokens"] == 1
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in rows)
    untrained = lm.scored(df, F.lit(False)).collect()
    assert all(r["n_known"] == 0 and r["score"] == 0.0 for r in untrained)
    assert lm.scored(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0


def test_levels_of_ranges_change_nothing(spark, sf, monkeypatch):
    docs = sample(spark, sf).where("doc_id < 60")
    training = F.col("doc_id") % 5 != 0
    show = lambda df: sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in df.collect())
    want = show(lm.scored(docs, training))
    monkeypatch.setattr(lm, "MIN_RANGES", 20)
    monkeypatch.setattr(lm, "FAN_OUT", 3)
    assert lm._levels(20) == [3, 3, 3]
    assert show(lm.scored(docs, training, 500)) == want


def test_requests_grow_in_proportion(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    for name, size in (("MIN_RANGES", 1), ("RANGE_TOKENS", 20), ("FAN_OUT", 4)):
        monkeypatch.setattr(lm, name, size)

    def requests(n, chunk_tokens):
        docs = documents(spark, [(i, " ".join(rng.choices(words, k=40)), "en", "a") for i in range(n)]).repartition(2)
        made, counted, chunks = lm.stored, [], []

        def keep(df, name):
            out = made(df, name)
            if name in ("requests", "token-chunks"):
                (counted if name == "requests" else chunks).append(out.count())
            return out

        monkeypatch.setattr(lm, "stored", keep)
        lm.scored(docs, F.lit(True), chunk_tokens).count()
        monkeypatch.setattr(lm, "stored", made)
        return chunks[0], counted

    for n, chunk_tokens in ((100, 100), (200, 100), (400, 100), (100, 25)):
        chunks, rows = requests(n, chunk_tokens)
        assert len(rows) >= 3 and max(rows) <= 2 * lm.FAN_OUT * chunks, (n, chunk_tokens, chunks, rows)
