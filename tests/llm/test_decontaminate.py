import hashlib
import re

from tests.llm.cases import ODD, SCHEMA, documents, lower, sample, with_clashes
from tidemark.llm.decontaminate import contamination, op4_decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = []
    for doc, text in docs:
        w = WORD.findall(lower(text))
        hit, named = set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if (own := tuple(w[i : i + size])) in windows:
                    hit |= set(range(i, i + size))
                    named |= {str(x) for x in windows[own] if x is not None}
        out.append((doc, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_equal_to_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in sample(spark, sf).collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(tuple(r) for r in op4_decontaminate(spark, sf).collect()) == brute(docs, items)


def test_short_items_overlaps_and_odd_rows(spark):
    phrase = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    items = [(1, phrase), (2, "lone"), (3, "two-words"), (4, None), (5, "!!"), (6, phrase.upper()), (None, "nameless entry"), (1, phrase)]
    docs = [
        (10, f"x {phrase} y"), (11, " ".join(phrase.split()[1:11])), (12, "alpha beta gamma"), (13, "Lone, lone; alone"),
        (14, "two words two\nwords"), (15, (phrase + " ") * 40), (16, "a nameless ENTRY"), (17, "kappa lambda mu alpha beta"),
    ]
    odd = [(d, t) for d, t, *_ in ODD if d is not None]
    df = with_clashes(documents(spark, [(d, t, "en", "a") for d, t in docs + odd]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for r in contamination(df, bench).collect():
        got[(r["k1"], r["k2"])] = (r["n_words"], r["n_hit"], ",".join(r["items"]))
    from tidemark.llm.common import content_key
    rows = df.select("doc_id", *content_key("text")).collect()
    have = sorted((r["doc_id"], *got[(r["k1"], r["k2"])]) for r in rows)
    want = brute(docs + odd, items)
    assert [(d, n, k) for d, n, k, _ in have] == [(d, n, k) for d, n, k, *_ in want]
    assert [hashlib.sha256(i.encode()).hexdigest() for *_, i in have] == [w[4] for w in want]
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r["n_hit"] == 0 for r in contamination(df, none).collect())
    assert contamination(spark.createDataFrame([], SCHEMA), bench).count() == 0
