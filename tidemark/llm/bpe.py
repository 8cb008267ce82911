"""Byte-level BPE: every distinct word is encoded once, ids are joined back and texts reassembled by position.

Texts are split into pre-tokens and kept as chunks: the distinct words of a chunk, and for every pre-token, in
order, which word it is. Only the distinct words of a chunk travel, in one packed block for each range of word
hashes that holds any, so there are never more blocks than distinct words of chunks. A range encodes each of its
words once and answers every block in the block's own order; the answers meet their chunk again, where the ids of
each text are put together by position. Decoding joins the token-byte table, which has as many rows as there
are ids and goes to every task.
"""

from __future__ import annotations

import base64
import uuid

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import common
from tidemark.llm.lm import pack, unpack
from tidemark.session import scratch_path

#: A chunk ends with the document that reaches either.
CHUNK_TOKENS = 1_500_000
CHUNK_WORDS = 250_000

#: Characters of the corpus for each range of word hashes, and the fewest ranges.
RANGE_CHARS = 12_000_000
MIN_RANGES = 8

#: Most buckets of a stored table of chunks.
MAX_BUCKETS = 50_000

#: Rows that a task decodes at a time.
DECODED_ROWS = 200

#: Longer texts are split piece by piece; a cut is made only where a pre-token begins.
PIECE_CHARS = 1 << 20
_CUT = regex.compile(r"(?<=\S) (?=\S)")


def read_ranks(path: str) -> dict[bytes, int]:
    """The token-byte table of a rank file: base64 bytes and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def pieces(text: str, piece_chars: int = PIECE_CHARS):
    """Cuts a long text before single spaces between other characters, where a new pre-token always begins."""
    start = 0
    while len(text) - start > piece_chars:
        cut = _CUT.search(text, start + piece_chars)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


class _Index(dict):
    """Numbers words in the order of their first use."""

    def __missing__(self, word):
        self[word] = len(self)
        return self[word]


def _packed_words(words: list[bytes]) -> tuple[bytes, bytes]:
    lengths = np.fromiter(map(len, words), np.uint64, len(words))
    return pack(lengths), zstandard.ZstdCompressor(level=3).compress(b"".join(words))


def _unpacked_words(lengths: bytes, data: bytes) -> list[bytes]:
    ends = np.cumsum(unpack(lengths)).tolist()
    data = zstandard.ZstdDecompressor().decompress(data)
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


_CHUNK = pa.schema([
    ("chunk", pa.int64()), ("range", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())),
    ("ranges", pa.binary()), ("places", pa.binary()), ("lengths", pa.binary()), ("words", pa.binary()),
])
_CHUNK_DDL = (
    "chunk long, range int, doc_ids array<bigint>, sizes array<bigint>, ranges binary, places binary,"
    " lengths binary, words binary"
)


def _chunk_rows(number: int, doc_ids: list, sizes: list, parts: list, index: _Index, ranges: int) -> pa.RecordBatch:
    """One row of a chunk (range is null) and one for each range that holds words of it.

    Words are numbered by falling frequency, so that places compress well; a block keeps that order.
    """
    places = np.concatenate(parts) if parts else np.empty(0, np.int64)
    order = np.argsort(-np.bincount(places, minlength=len(index)), kind="stable")
    new = np.empty_like(order)
    new[order] = np.arange(len(order))
    named = [word.encode() for word in index]
    words = [named[i] for i in order.tolist()]
    owner = ((common.word_hashes(words) >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    by_range = np.argsort(owner, kind="stable")
    held, starts = np.unique(owner[by_range], return_index=True)
    rows = [{
        "chunk": number, "doc_ids": doc_ids, "sizes": sizes, "ranges": pack(owner), "places": pack(new[places]),
    }]
    for r, at in zip(held.tolist(), np.split(by_range, starts[1:]), strict=True) if len(words) else ():
        lengths, data = _packed_words([words[i] for i in at.tolist()])
        rows.append({"chunk": number, "range": r, "lengths": lengths, "words": data})
    return pa.RecordBatch.from_pylist(rows, schema=_CHUNK)


def _chunks(docs: DataFrame, pattern: str, ranges: int, chunk_tokens: int, chunk_words: int) -> DataFrame:
    def run(batches):
        split = regex.compile(pattern).findall
        number = TaskContext.get().partitionId() << 32
        doc_ids, sizes, parts, tokens, index = [], [], [], 0, _Index()
        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), common.as_bytes(batch["text"]), strict=True):
                size = 0
                for piece in pieces((text or b"").decode("utf-8", "replace")):
                    words = split(piece)
                    parts.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)).astype(np.uint32))
                    size += len(words)
                doc_ids.append(doc)
                sizes.append(size)
                tokens += size
                if tokens >= chunk_tokens or len(index) >= chunk_words:
                    yield _chunk_rows(number, doc_ids, sizes, parts, index, ranges)
                    doc_ids, sizes, parts, tokens, index = [], [], [], 0, _Index()
                    number += 1
        if doc_ids:
            yield _chunk_rows(number, doc_ids, sizes, parts, index, ranges)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _CHUNK_DDL)


def _bucketed(chunks: DataFrame, buckets: int) -> DataFrame:
    """Stores chunks bucketed by their number, so that the answers come to them and they need no shuffle.

    The table's files lie in the shared folder; its name is given up at once, since the files are read by path
    from then on.
    """
    spark = chunks.sparkSession
    path = scratch_path(spark, "bpe-chunks")
    name = f"bpe_chunks_{uuid.uuid4().hex}"
    chunks.write.bucketBy(buckets, "chunk").option("path", path).saveAsTable(name)
    table = spark.table(name)
    table.schema  # resolved now, with its buckets
    spark.sql(f"DROP TABLE {name}")
    return table


def _encoder(ranks, pattern: str):
    return lambda blocks: _encoded(blocks, ranks.value, pattern)


def _encoded(blocks: pa.Table, ranks: dict[bytes, int], pattern: str) -> pa.Table:
    """The ids of all words of one range, each word encoded once, in the order of the blocks that ask."""
    encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
    known: dict[bytes, list[int]] = {}
    out = {"chunk": blocks["chunk"].to_pylist(), "range": blocks["range"].to_pylist(), "n_ids": [], "ids": []}
    for lengths, data in zip(blocks["lengths"].to_pylist(), blocks["words"].to_pylist(), strict=True):
        n_ids, ids = [], []
        for word in _unpacked_words(lengths, data):
            own = known.get(word)
            if own is None:
                own = known[word] = encode(word)
            n_ids.append(len(own))
            ids += own
        out["n_ids"].append(pack(np.array(n_ids, np.uint64)))
        out["ids"].append(pack(np.array(ids, np.uint64)))
    return pa.table(out, schema=pa.schema([("chunk", pa.int64()), ("range", pa.int32()), ("n_ids", pa.binary()), ("ids", pa.binary())]))


def gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin at ``starts``, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def _reassembled(key, chunks: pa.Table, answers: pa.Table) -> pa.Table:
    """The ids of each text of a chunk, from the answers to its blocks."""
    chunk = chunks.to_pylist()[0]
    answers = answers.sort_by("range")
    owner, places = unpack(chunk["ranges"]), unpack(chunk["places"]).astype(np.int64)
    none = np.empty(0, np.uint64)
    lengths = np.empty(len(owner), np.int64)
    lengths[np.argsort(owner, kind="stable")] = np.concatenate([none, *map(unpack, answers["n_ids"].to_pylist())]).astype(np.int64)
    ids = np.concatenate([none, *map(unpack, answers["ids"].to_pylist())]).astype("<u4")
    by_range = np.argsort(owner, kind="stable")
    starts = np.empty(len(owner), np.int64)
    starts[by_range] = np.cumsum(lengths[by_range]) - lengths[by_range]
    texts, at = [], 0
    for size in chunk["sizes"]:
        own = places[at : at + size]
        texts.append(gathered(ids, starts[own], lengths[own]).tobytes())
        at += size
    return pa.table({
        "doc_id": pa.array(chunk["doc_ids"], pa.int64()), "n_tokens": pa.array([len(t) // 4 for t in texts], pa.int64()),
        "ids": pa.array(texts, pa.binary()),
    })


def encode(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, chunk_tokens: int = CHUNK_TOKENS, chunk_words: int = CHUNK_WORDS
) -> DataFrame:
    """doc_id, n_tokens, ids (unsigned 32-bit integers, little-endian, in a row) for each row of ``docs``.

    ``ranks`` is a token-byte table (at most some hundred thousand entries, sent to every task) and ``pattern``
    the expression that splits texts into pre-tokens. Special tokens are ordinary text. A null or empty text
    has no ids. Rows that repeat an id, or have none, each give a row. A text of any length is one row; it is
    split piece by piece. Bytes that are no UTF-8 become the replacement character. An empty table gives no
    rows. Other columns are not used.
    """
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    ranges = max(MIN_RANGES, -(-chars // RANGE_CHARS))
    made = _bucketed(_chunks(docs, pattern, ranges, chunk_tokens, chunk_words), min(ranges, MAX_BUCKETS))
    table = spark.sparkContext.broadcast(ranks)
    answers = (
        made.where("range is not null").select("chunk", "range", "lengths", "words")
        .groupBy("range").applyInArrow(_encoder(table, pattern), "chunk long, range int, n_ids binary, ids binary")
    )
    chunks = made.where("range is null").select("chunk", "doc_ids", "sizes", "ranges", "places")
    return (
        chunks.groupBy("chunk").cogroup(answers.groupBy("chunk"))
        .applyInArrow(_reassembled, "doc_id long, n_tokens long, ids binary")
    )


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``encoded`` with ``decoded`` added: the bytes of its ``ids``, by a join with the token-byte table.

    A row without ids (null) or with an id that the table lacks gets null. An earlier column ``decoded`` is
    replaced; all others pass through.
    """
    named = {rank: token for token, rank in ranks.items()}
    tokens = [named.get(i) for i in range(max(named, default=-1) + 1)]
    table = encoded.sparkSession.sparkContext.broadcast(tokens)

    def run(batches):
        known = np.array([t is not None for t in table.value], bool)
        lengths = np.array([len(t or b"") for t in table.value], np.int64)
        data, starts = np.frombuffer(b"".join(t or b"" for t in table.value), np.uint8), np.cumsum(lengths) - lengths
        for whole in batches:
            for at in range(0, whole.num_rows, DECODED_ROWS):
                batch, out = whole.slice(at, DECODED_ROWS), []
                for ids in batch["ids"]:
                    own = None if not ids.is_valid or len(ids.as_buffer()) % 4 else np.frombuffer(ids.as_buffer(), "<u4")
                    if own is None or own.max(initial=0) >= len(known) or not known[own].all():
                        out.append(None)
                    else:
                        out.append(gathered(data, starts[own], lengths[own]).tobytes())
                yield batch.append_column("decoded", pa.array(out, pa.binary()))

    plain = encoded.drop("decoded")
    types = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in plain.schema)
    return plain.mapInArrow(run, f"{types}, decoded binary")


def id_list(ids: bytes | None) -> list[int]:
    """The ids of one row as a list."""
    return np.frombuffer(ids or b"", "<u4").tolist()


def op13_byte_bpe(spark, sf_dir):
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoded = encode(common.table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return decode(encoded, ranks).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


QUERIES = {"op13_byte_bpe": op13_byte_bpe}
ORACLES = {}
