"""LM scoring by deleted interpolation: bigram, unigram and uniform estimates, mixed by context frequency.

Texts are read once, into chunks of tokens. Each chunk asks for the counts of its distinct words and word pairs
in sorted blocks, one per range of hash values; a range adds up what all chunks report and answers each of them
in the order of its request. Where the corpus needs more ranges than a request is cut into, chunks are joined to sets
whose blocks are added up and cut again, level by level, so that requests grow with the corpus and not with
its square; answers go down the same way. No row per token is ever shuffled. The mixture weights of each bucket of context
frequency are learnt by expectation-maximisation on held-out training documents, against counts that leave
these out; what they gather is a table of fixed size.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm import common
from tidemark.session import stored

CHUNK_TOKENS = 1_000_000

#: Distinct entries a range holds, about, and the fewest ranges.
RANGE_TOKENS = 2_000_000
MIN_RANGES = 64

#: Ranges that a block is cut into, and about the most chunks or sets whose blocks are added up before the next cut.
FAN_OUT = 256

#: One training document in so many teaches the mixture weights.
FOLD = 20

#: Context counts fall in buckets by their binary logarithm, probabilities in steps of a tenth of a decade.
BUCKETS = 40
STEPS = 10

#: The step of zero, whose power of ten is zero too.
NEVER = -10_000

#: Weights of the bigram, unigram and uniform estimates where nothing was held out.
DEFAULT = (0.5, 0.4, 0.1)
LEAST = 1e-4

_END = np.uint64(xxhash.xxh3_64_intdigest(b"\n"))
_BEGIN = np.uint64(xxhash.xxh3_64_intdigest(b"\n\n"))
_PAIR = np.uint64(0xFFFFFFFFFFFF0000)


def pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on, in planes of one byte each, compressed."""
    values = np.ascontiguousarray(values, np.uint64)
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.reshape(-1).view(np.uint64)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def _chunks(docs: DataFrame, training: Column, chunk_tokens: int) -> DataFrame:
    """The tokens of some documents: doc_ids, trained and sizes by document; words, places and fold by chunk."""
    schema = "chunk long, fold boolean, doc_ids array<bigint>, trained array<boolean>, sizes array<bigint>, words binary, places binary"

    def made(held, fold, number):
        ids, trained, parts = zip(*held, strict=True)
        words, places = np.unique(np.concatenate(parts), return_inverse=True)
        row = {
            "chunk": number, "fold": fold, "doc_ids": list(ids), "trained": list(trained), "sizes": list(map(len, parts)),
            "words": pack_sorted(words), "places": pack(places),
        }
        return pa.RecordBatch.from_pylist([row], schema=pa.schema([
            ("chunk", pa.int64()), ("fold", pa.bool_()), ("doc_ids", pa.list_(pa.int64())), ("trained", pa.list_(pa.bool_())),
            ("sizes", pa.list_(pa.int64())), ("words", pa.binary()), ("places", pa.binary()),
        ]))

    def run(batches):
        waiting = {False: [], True: []}
        tokens = {False: 0, True: 0}
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("doc_id", "trained", "fold"))
            for doc, trained, fold, text in zip(*columns, common.as_bytes(batch["text"]), strict=True):
                own = np.append(common.word_hashes((text or b"").lower().split()), _END)
                waiting[fold].append((doc, trained, own))
                tokens[fold] += len(own)
                if tokens[fold] >= chunk_tokens:
                    yield made(waiting[fold], fold, number)
                    waiting[fold], tokens[fold] = [], 0
                    number += 1
        for fold, held in waiting.items():
            if held:
                yield made(held, fold, number)
                number += 1

    fold = training & (F.pmod(F.xxhash64("doc_id"), F.lit(FOLD)) == 0)
    return docs.select(
        F.col("doc_id").cast("long"), training.alias("trained"), F.coalesce(fold, F.lit(False)).alias("fold"), "text"
    ).mapInArrow(run, schema)


def _opened(chunk: dict) -> dict:
    """Words, pairs and where each token has them, of one chunk."""
    words, sizes = unpack_sorted(chunk["words"]), np.array(chunk["sizes"], np.int64)
    at = unpack(chunk["places"]).astype(np.int64)
    ends = np.cumsum(sizes)
    first = np.zeros(len(at), bool)
    first[ends - sizes] = True
    before = np.where(first, _BEGIN, words[np.roll(at, 1)])
    pairs, pair_at = np.unique(common.mix(before * np.uint64(0x9E3779B97F4A7C15) + words[at]) & _PAIR, return_inverse=True)
    counted = np.repeat(np.array(chunk["trained"], bool), sizes)
    return {"words": words, "at": at, "first": first, "starts": ends - sizes, "pairs": pairs, "pair_at": pair_at, "counted": counted}


_BLOCKS = ("words", "pairs", "word_counts", "pair_counts", "word_later", "pair_later")
_REQUEST = pa.schema([("asker", pa.int64()), ("range", pa.int64()), ("fold", pa.bool_()), *((c, pa.binary()) for c in _BLOCKS)])
_REQUEST_DDL = f"asker long, range long, fold boolean, {', '.join(f'{c} binary' for c in _BLOCKS)}"


def _marks(first: int, n: int, of: int) -> np.ndarray:
    """Where ``n`` ranges from ``first`` on begin, of ``of`` equal ranges of hash values."""
    return np.array([((first + i) << 64) // of for i in range(n)], np.uint64)


def _cut(asker: int, fold: bool, first: int, marks: np.ndarray, words: tuple, pairs: tuple) -> pa.RecordBatch:
    """A request for each range that holds any of the sorted ``words`` or ``pairs`` (keys, counts, later counts or None)."""
    rows = []
    cuts = [np.append(np.searchsorted(keys, marks), len(keys)).tolist() for keys, _, _ in (words, pairs)]
    for i in range(len(marks)):
        row = {"asker": asker, "range": first + i, "fold": fold}
        for name, (keys, counts, later), at in zip(("word", "pair"), (words, pairs), cuts, strict=True):
            part = slice(at[i], at[i + 1])
            row |= {f"{name}s": pack_sorted(keys[part]), f"{name}_counts": pack(counts[part])}
            row[f"{name}_later"] = None if later is None else pack(later[part])
        if any(at[i + 1] > at[i] for at in cuts):
            rows.append(row)
    return pa.RecordBatch.from_pylist(rows, schema=_REQUEST)


def _requests(chunks: DataFrame, ranges: int) -> DataFrame:
    """A row per chunk and range with the words and pairs there, and how often the training tokens have them."""
    marks = _marks(0, ranges, ranges)

    def run(batches):
        for batch in batches:
            for chunk in batch.to_pylist():
                own = _opened(chunk)
                kinds = (
                    (keys, np.bincount(at[own["counted"]], minlength=len(keys)), None)
                    for keys, at in ((own["words"], own["at"]), (own["pairs"], own["pair_at"]))
                )
                yield _cut(chunk["chunk"], chunk["fold"], 0, marks, *kinds)

    return chunks.mapInArrow(run, _REQUEST_DDL)


def _summed(table: pa.Table, name: str) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """The distinct keys of some requests, where each request has its own, their total and their held-out counts."""
    keys = [unpack_sorted(b) for b in table[f"{name}s"].to_pylist()]
    counts = [unpack(b).astype(np.int64) for b in table[f"{name}_counts"].to_pylist()]
    later = [
        unpack(b).astype(np.int64) if b is not None else own if fold else np.zeros_like(own)
        for b, own, fold in zip(table[f"{name}_later"].to_pylist(), counts, table["fold"].to_pylist(), strict=True)
    ]
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    total, apart = (
        np.bincount(place, weights=np.concatenate(x), minlength=len(every)).astype(np.int64) for x in (counts, later)
    )
    edges = np.append(0, np.cumsum(list(map(len, keys))))
    return every, [place[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], total, apart


def _merged(width: int, cuts: int):
    """Adds up the requests of a set of askers for one of ``width`` ranges and cuts them into ``cuts`` finer ones."""

    def run(key, table):
        asker, first = key[0].as_py(), key[1].as_py() * cuts
        kinds = ((every, total, apart) for every, _, total, apart in (_summed(table, n) for n in ("word", "pair")))
        return pa.Table.from_batches([_cut(asker, True, first, _marks(first, cuts, width * cuts), *kinds)], _REQUEST)

    return run


def _answered(table: pa.Table) -> pa.Table:
    """Total counts and held-out counts of one range, for every asker in the order of its request."""
    n = table.num_rows
    out = {c: table[c].to_pylist() for c in ("asker", "range", "fold")}
    tokens, kinds = [0] * n, [0] * n
    for name in ("word", "pair"):
        _, spans, total, apart = _summed(table, name)
        if name == "word":
            tokens[0], kinds[0] = int(total.sum()), int((total > 0).sum())
        out |= _handed(name, out["fold"], spans, total, apart)
    return pa.table(out | {"tokens": tokens, "kinds": kinds}, schema=_ANSWER)


def _handed(name: str, folds: list, spans: list, total: np.ndarray, apart: np.ndarray) -> dict:
    return {
        f"{name}_total": [pack(total[s]) for s in spans],
        f"{name}_apart": [pack(apart[s]) if f else None for s, f in zip(spans, folds, strict=True)],
    }


def _handed_down(key, requests: pa.Table, answers: pa.Table) -> pa.Table:
    """What a set of askers was answered, for each of them in the order of its request."""
    if not requests.num_rows:
        return _ANSWER.empty_table()
    out = {c: requests[c].to_pylist() for c in ("asker", "range", "fold")}
    for name in ("word", "pair"):
        _, spans, _, _ = _summed(requests, name)
        out |= _handed(name, out["fold"], spans, _counts(answers, f"{name}_total"), _counts(answers, f"{name}_apart"))
    none = [0] * requests.num_rows
    return pa.table(out | {"tokens": none, "kinds": none}, schema=_ANSWER)


_ANSWER = pa.schema([
    ("asker", pa.int64()), ("range", pa.int64()), ("fold", pa.bool_()), ("word_total", pa.binary()), ("word_apart", pa.binary()),
    ("pair_total", pa.binary()), ("pair_apart", pa.binary()), ("tokens", pa.int64()), ("kinds", pa.int64()),
])
_ANSWER_DDL = (
    "asker long, range long, fold boolean, word_total binary, word_apart binary, pair_total binary, pair_apart binary,"
    " tokens long, kinds long"
)


def _levels(ranges: int) -> list[int]:
    """Into how many parts blocks are cut at each level, to end with ``ranges`` ranges or a few more."""
    cuts = [min(ranges, FAN_OUT)]
    while (width := int(np.prod(cuts, dtype=object))) < ranges:
        cuts.append(min(FAN_OUT, -(-ranges // width)))
    return cuts


def _exchanged(chunks: DataFrame, ranges: int) -> tuple[DataFrame, int, int]:
    """The answers to all chunks, and the number of training tokens and of their kinds."""
    cuts = _levels(ranges)
    levels, width, askers = [_requests(chunks, cuts[0])], cuts[0], None
    for finer in cuts[1:]:
        askers = max(1, -(-(chunks.count() if askers is None else askers) // finer))
        below = stored(levels[-1].withColumn("set", F.pmod(F.xxhash64("asker"), F.lit(askers)).cast("long")), "requests")
        levels[-1] = below
        levels.append(below.groupBy("set", "range").applyInArrow(_merged(width, finer), _REQUEST_DDL))
        width *= finer
    answers = stored(levels[-1].groupBy("range").applyInArrow(_answered, _ANSWER_DDL), "answers")
    n, v = answers.agg(F.sum("tokens"), F.sum("kinds")).first()
    for below, finer in zip(reversed(levels[:-1]), reversed(cuts[1:]), strict=True):
        up = answers.withColumn("above", F.floor(F.col("range") / finer))
        down = below.groupBy("set", "range").cogroup(up.groupBy("asker", "above")).applyInArrow(_handed_down, _ANSWER_DDL)
        answers = stored(down, "answers")
    return answers.drop("tokens", "kinds").withColumnRenamed("asker", "chunk"), n or 0, v or 0


def _counts(answers: pa.Table, column: str) -> np.ndarray:
    return np.concatenate([unpack(b) for b in answers.sort_by("range")[column].to_pylist()]).astype(np.int64)


def _by_token(own: dict, words: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of each token, of its context and of both together; a text begins as often as one ends."""
    c = words[own["at"]]
    at_end = np.searchsorted(own["words"], _END)
    context = np.where(own["first"], words[at_end], np.roll(c, 1))
    return c, context, pairs[own["pair_at"]]


def bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(context + 1.0)).astype(np.int64), BUCKETS - 1)


def _step(p: np.ndarray) -> np.ndarray:
    """Steps of the logarithm; zero has its own."""
    return np.where(p > 0, np.round(np.log10(np.maximum(p, 1e-30)) * STEPS), NEVER).astype(np.int64)


def _held_out(key, chunks: pa.Table, answers: pa.Table, tokens: int) -> pa.Table:
    """How often held-out tokens have a bucket and steps of the two estimates, from counts without them."""
    own = _opened(chunks.to_pylist()[0])
    words = _counts(answers, "word_total") - _counts(answers, "word_apart")
    pairs = _counts(answers, "pair_total") - _counts(answers, "pair_apart")
    c, context, both = _by_token(own, words, pairs)
    rows = np.stack([bucket(context), _step(both / np.maximum(context, 1)), _step(c / max(1, tokens))], axis=1)
    kinds, n = np.unique(rows, axis=0, return_counts=True)
    return pa.table({"bucket": kinds[:, 0], "p2": kinds[:, 1], "p1": kinds[:, 2], "n": n})


def learnt(rows: pa.Table, uniform: float, rounds: int = 100) -> np.ndarray:
    """Weights of the three estimates in each bucket, by expectation-maximisation on held-out counts."""
    back = lambda s: 10.0 ** (s / STEPS)
    at, n = rows["bucket"].to_numpy(), rows["n"].to_numpy().astype(np.float64)
    p = np.stack([back(rows["p2"].to_numpy()), back(rows["p1"].to_numpy()), np.full(len(n), uniform)], axis=1)
    weights = np.tile(DEFAULT, (BUCKETS, 1))
    seen = np.bincount(at, weights=n, minlength=BUCKETS)
    for _ in range(rounds):
        share = weights[at] * p
        share *= (n / share.sum(axis=1))[:, None]
        new = np.stack([np.bincount(at, weights=share[:, k], minlength=BUCKETS) for k in range(3)], axis=1)
        weights = np.where(seen[:, None] > 0, new / np.maximum(seen, 1)[:, None], weights)
        weights = np.maximum(weights, LEAST) / np.maximum(weights, LEAST).sum(axis=1, keepdims=True)
    return weights


def _scored(key, chunks: pa.Table, answers: pa.Table, tokens: int, kinds: int, weights: np.ndarray) -> pa.Table:
    chunk = chunks.to_pylist()[0]
    own = _opened(chunk)
    c, context, both = _by_token(own, _counts(answers, "word_total"), _counts(answers, "pair_total"))
    base = np.log10((c + 1.0) / (tokens + (kinds + 1.0)))
    w = weights[bucket(context)]
    w[context == 0] = w[context == 0] * [0, 1, 1]
    if not tokens:
        w = w * [0, 0, 1]
    w /= w.sum(axis=1, keepdims=True)
    p = w[:, 0] * both / np.maximum(context, 1) + w[:, 1] * c / max(1, tokens) + w[:, 2] / (kinds + 1.0)
    by_doc = partial(np.add.reduceat, indices=own["starts"])
    return pa.table({
        "doc_id": pa.array(chunk["doc_ids"], pa.int64()), "trained": pa.array(chunk["trained"]),
        "n_tokens": pa.array(chunk["sizes"], pa.int64()), "n_known": by_doc((c > 0).astype(np.int64)),
        "base_score": by_doc(base), "score": by_doc(np.log10(p)),
    })


def scored(docs: DataFrame, training: Column, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """doc_id, trained, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``.

    Tokens are words (A-Z lower-cased, split at ASCII white space) and one end. ``training`` tells the rows to
    learn from; ``base_score`` is the add-one unigram score and ``score`` the mixture, both in log10 over the whole
    text. A null or empty text is one end; repeated rows count and score each. Without training rows every
    token is equally likely. An empty table gives no rows. Other columns are not used.
    """
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    ranges = max(MIN_RANGES, chars // (6 * RANGE_TOKENS))
    chunks = stored(_chunks(docs, training, chunk_tokens), "token-chunks")
    answers, tokens, kinds = _exchanged(chunks, ranges)
    of = lambda test: (
        chunks.where(test).groupBy("chunk").cogroup(answers.where(test).groupBy("chunk"))
    )
    held = tokens - _fold_tokens(chunks)
    gathered = (
        of("fold").applyInArrow(partial(_held_out, tokens=held), "bucket long, p2 long, p1 long, n long")
        .groupBy("bucket", "p2", "p1").agg(F.sum("n").alias("n"))
    )
    weights = learnt(gathered.toArrow().sort_by([(c, "ascending") for c in ("bucket", "p2", "p1")]), 1.0 / (kinds + 1.0))
    score = partial(_scored, tokens=tokens, kinds=kinds, weights=weights)
    return of("true").applyInArrow(
        score, "doc_id long, trained boolean, n_tokens long, n_known long, base_score double, score double"
    ).withColumn("train_tokens", F.lit(tokens).cast("long"))


def _fold_tokens(chunks: DataFrame) -> int:
    sizes = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    return chunks.where("fold").agg(F.sum(sizes)).first()[0] or 0


def op10_lm_score(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    apart = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2, F.lit(False))
    return scored(docs, ~apart).select(
        "doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


QUERIES = {"op10_lm_score": op10_lm_score}
ORACLES = {}
