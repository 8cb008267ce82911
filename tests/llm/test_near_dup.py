import random

import numpy as np
import pytest

from tests.llm.cases import ODD, SCHEMA, documents, sample, with_clashes, words
from tidemark.llm import near_dup


def sets_of(rows, width):
    out = []
    for _, text in rows:
        w = words(text)
        out.append(frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())
    return out


def brute(rows, width, percent=80):
    sets = sets_of(rows, width)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), doc), doc)
    return sorted((rows[i][0], len(sets[i]), low[find(i)], rows[i][0] == low[find(i)]) for i in range(len(rows)))


def run(df, width):
    return sorted(tuple(r)[:4] for r in near_dup.near_duplicates(df, width).select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_equal_to_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in sample(spark, sf).collect()]
    assert sorted(tuple(r) for r in near_dup.op6_near_dup(spark, sf).collect()) == brute(rows, 4)


@pytest.mark.parametrize("width", [4, 5])
def test_chains_shared_passages_and_hot_groups(spark, width, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    shared = [word() for _ in range(60)]
    texts = [" ".join(shared + [word() for _ in range(rng.randint(5, 60))]) for _ in range(120)]
    base = [word() for _ in range(100)]
    for _ in range(60):
        base = base[:]
        at = rng.randrange(100)
        base[at] = word()
        texts.append(" ".join(base))
    texts += [texts[0].upper()] * 30 + ["one two", "ONE  two", "one two three", "", ""]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(100 + i, texts[k]) for i, k in enumerate(order)]
    df = documents(spark, [(i, t, "en", "a") for i, t in rows])
    assert run(df, width) == brute(rows, width)


def test_odd_rows_and_clashing_columns(spark):
    df = with_clashes(documents(spark, ODD + [(None, ODD[0][1], "en", "z"), (30, ODD[9][1], "en", "a")]))
    rows = near_dup.near_duplicates(df).collect()
    assert len(rows) == len(ODD) + 2
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_shingles"] == by[2]["n_shingles"] == by[3]["n_shingles"] == 0 and by[1]["kept"] and by[3]["kept"]
    assert by[30]["component_id"] == 8 and not by[30]["kept"]
    one = near_dup.one_of_each(df)
    assert one.columns == df.columns
    ids = [r["doc_id"] for r in one.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 5, 6, 7, 8] and ids.count(None) == 1
    assert near_dup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_estimates_are_near_the_truth():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        items = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
        k = int(2000 * (1 - share) / (1 + share))
        other = np.concatenate([items[k:], rng.integers(0, 1 << 63, k, dtype=np.uint64)])
        agree = (near_dup.registers(items) == near_dup.registers(other)).mean()
        n = np.array([2000])
        got = near_dup.estimates(np.array([agree]), n, n)[0]
        assert abs(got - share) < 4 * (share * (1 - share) / near_dup.REGISTERS) ** 0.5
    assert 0 < near_dup.chance(500, 500) < 0.01
