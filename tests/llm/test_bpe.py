import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings, strategies as st

from tests.llm.cases import ODD, SCHEMA, documents, sample, with_clashes
from tidemark.llm import bpe

PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def plain(ranks):
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equal_to_the_library_and_round_trip(spark, sf, plain):
    texts = {r["doc_id"]: r["text"] or "" for r in sample(spark, sf).collect()}
    got = {r["doc_id"]: r for r in bpe.op13_byte_bpe(spark, sf).collect()}
    assert got.keys() == texts.keys()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for doc, text in texts.items():
        ids = plain.encode_ordinary(text)
        assert got[doc]["n_tokens"] == len(ids)
        assert got[doc]["ids_sha256"] == sha(np.array(ids, "<u4").tobytes())
        assert got[doc]["decoded_sha256"] == sha(text.encode())


def test_many_chunks_and_ranges(spark, ranks, plain, monkeypatch):
    rng = random.Random(3)
    words = ["the", "thé", "x1y2", "日本語", "don't", "<|endoftext|>", "...", "\n\n", " ", " ", "🙂", "Ünï"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60))) + rng.choice(["", " ", "\n", "  \n x"])) for i in range(200)]
    rows += [(500 + i, "the same text, again and again") for i in range(100)]
    monkeypatch.setattr(bpe, "RANGE_CHARS", 500)
    df = documents(spark, [(i, t, "en", "a") for i, t in rows]).repartition(3)
    for tokens, kinds in ((50, 500_000), (4_000_000, 5)):
        out = bpe.decode(bpe.encode(df, ranks, PATTERN, tokens, kinds), ranks).collect()
        assert sorted((r["doc_id"], bpe.id_list(r["ids"]), r["decoded"].decode()) for r in out) == [
            (i, plain.encode_ordinary(t), t) for i, t in rows
        ]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1 '\n\t é!s."), max_size=60), st.integers(1, 8))
def test_cuts_change_no_pre_token(text, size):
    split = regex.compile(PATTERN).findall
    parts = list(bpe.pieces(text, size))
    assert "".join(parts) == text and [w for p in parts for w in split(p)] == split(text)


def test_odd_rows_and_clashing_columns(spark, ranks, plain):
    odd = [*ODD, (9, " " * 100_000 + "x", "en", "a"), (10, "\x00� end", "en", "a"), (None, None, None, None)]
    out = bpe.decode(bpe.encode(with_clashes(documents(spark, odd)), ranks, PATTERN), ranks).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted(((r["doc_id"], r["decoded"].decode()) for r in out), key=key)
    assert got == sorted(((i, t or "") for i, t, *_ in odd), key=key)
    by = {r["doc_id"]: r for r in out}
    assert by[1]["n_tokens"] == by[2]["n_tokens"] == 0 and by[1]["ids"] == b""
    assert bpe.id_list(by[8]["ids"]) == plain.encode_ordinary(ODD[-1][1])
    assert bpe.id_list(by[9]["ids"]) == plain.encode_ordinary(odd[-3][1])
    assert bpe.encode(spark.createDataFrame([], SCHEMA), ranks, PATTERN).count() == 0


def test_decoding_unknown_ids(spark, ranks):
    rows = [(1, b"\x00\x00\x00\x00"), (2, b"\xff\xff\xff\xff"), (3, None), (4, b""), (5, b"\x01")]
    df = spark.createDataFrame(rows, "doc_id long, ids binary").selectExpr("*", "'x' as decoded", "1 as `od d`")
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode(df, ranks).collect()}
    first = next(t for t, r in ranks.items() if r == 0)
    assert got == {1: first, 2: None, 3: None, 4: b"", 5: None}
