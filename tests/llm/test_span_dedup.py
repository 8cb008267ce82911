import random

from tests.llm.cases import ODD, SCHEMA, documents, sample, with_clashes
from tidemark.llm import span_dedup


def brute(rows):
    """Every repeated run, of any length, keeps its first place only: sentences removed and what is left, in plain loops."""
    first, cut = {}, {}
    for doc, text in rows:
        data = (text or "").encode()
        ends, word_ends, _ = span_dedup.sentences(data)
        words, starts = data.lower().split(), [0, *word_ends[:-1].tolist()]
        own = [
            (i, j, hash(tuple(words[s : word_ends[j]]))) for i, s in enumerate(starts)
            for j in range(i + span_dedup.MIN_SENTENCES - 1, len(starts)) if word_ends[j] - s >= span_dedup.MIN_WORDS
        ]
        cut[doc] = (data, [0, *ends.tolist()], own)
        for i, _, run in own:
            first[run] = min(first.get(run, (doc, i)), (doc, i))
    out = {}
    for doc, (data, edges, own) in cut.items():
        gone = {k for i, j, run in own if first[run] != (doc, i) for k in range(i, j + 1)}
        left = [data[a:b] for k, (a, b) in enumerate(zip(edges, edges[1:])) if k not in gone]
        out[doc] = (len(gone), b"".join(left).decode())
    return out


def test_equal_to_brute_force(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in sample(spark, sf).collect()}
    got = span_dedup.op9_span_dedup(spark, sf).collect()
    want = brute(sorted(texts.items()))
    assert {r["doc_id"]: (r["n_removed"], r["text"] or "") for r in got} == want
    for r in got:
        kept, at = "", 0
        for s in r["removed"]:
            kept += texts[r["doc_id"]][at : s["start"]]
            at = s["end"]
        assert kept + texts[r["doc_id"]][at:] == r["text"]
    assert any(r["n_removed"] for r in got)


def test_passages_go_wherever_they_stand(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 9)))
    prose = lambda n: " ".join(word() + ("." if rng.random() < 0.1 else "") for _ in range(n))
    passage = prose(80) + "."
    unbroken = " ".join(word() for _ in range(80))
    rows = [(i, f"{prose(60)} {passage} {prose(60)} {unbroken} {prose(30)}", "en", "a") for i in range(12)]
    rows += [(50 + i, prose(200), "en", "a") for i in range(5)]
    out = {r["doc_id"]: r for r in span_dedup.drop_repeated_spans(documents(spark, rows)).collect()}
    middle = lambda t: " ".join(t.split()[30:50])
    assert middle(passage) in out[0]["text"] and middle(unbroken) in out[0]["text"] and out[0]["n_removed"] == 0
    for i in range(1, 12):
        assert middle(passage) not in out[i]["text"] and middle(unbroken) not in out[i]["text"]
        assert 0 in out[i]["first_docs"]
        assert len(out[i]["text"].split()) >= 150
    assert all(out[50 + i]["n_removed"] == 0 for i in range(5))


def test_odd_rows_and_clashing_columns(spark):
    df = with_clashes(documents(spark, ODD))
    out = span_dedup.drop_repeated_spans(df)
    assert out.columns == [*df.columns, "n_removed", "removed", "first_docs"]
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == len(ODD) and rows[1]["text"] is None
    assert rows[6]["text"] == "Repeated row here." and len(rows[8]["text"]) < 10_000
    assert {r["rest"] for r in rows.values()} == {"own"}
    assert span_dedup.drop_repeated_spans(spark.createDataFrame([], SCHEMA)).count() == 0


def test_passages_go_to_their_last_sentence(spark):
    rng = random.Random(7)
    sentence = lambda n: " ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(n)) + "."
    rows, passages = [], {}
    for p, sizes in enumerate([(15, 8, 6), (12, 9, 3, 2), (20, 4), (10, 10, 1, 1, 1), (2, 18, 2), (12, 3, 12)]):
        passages[p] = " ".join(map(sentence, sizes))
        rows += [(10 * p + i, f"{sentence(14)} {sentence(11)} {passages[p]} {sentence(13)} {sentence(9)}", "en", "a") for i in range(3)]
    out = {r["doc_id"]: r["text"] for r in span_dedup.drop_repeated_spans(documents(spark, rows)).collect()}
    for doc, text, *_ in rows:
        want = text if doc % 10 == 0 else text.replace(passages[doc // 10], "")
        assert out[doc].split() == want.split()
