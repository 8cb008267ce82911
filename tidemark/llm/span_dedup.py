"""Substring dedup over sliding runs of sentences.

A sentence ends after a word that ends in ``.``, ``!`` or ``?``, or before a line feed; a longer one is cut after words
that their own hash chooses, so that a passage is cut alike wherever it stands. The shortest run of at
least two sentences and enough words is hashed from each sentence on, and up to each sentence: together these cover
every sentence of any longer run. Runs that occur twice keep their first place; sentences that any other place covers go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import common
from tidemark.session import stored

MIN_SENTENCES = 2
MIN_WORDS = 20

#: A sentence of more words is cut after words whose hash is divisible by CUT_EVERY.
LONG_SENTENCE = 20
CUT_EVERY = 8

#: A sentence without such words is cut after so many.
MOST_WORDS = 64

DOCUMENTS_AT_ONCE = 1000

_SPACE = np.isin(np.arange(256), list(common.SPACE))
_STOP = np.isin(np.arange(256), list(b".!?"))


def sentences(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the sentences in bytes and in words, and the hashes of all words."""
    own = common.word_hashes(text.lower().split())
    if not len(own):
        return np.array([len(text)]), np.array([0]), own
    chars = np.frombuffer(text, np.uint8)
    turn = np.diff(np.concatenate([[True], _SPACE[chars], [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(turn < 0), np.flatnonzero(turn > 0)
    stop = _STOP[chars[ends - 1]]
    feeds = np.flatnonzero(chars == 10)
    stop[:-1] |= np.searchsorted(feeds, ends[:-1]) < np.searchsorted(feeds, starts[1:])
    stop[-1] = True
    size = np.diff(np.flatnonzero(stop), prepend=-1)
    if (size > LONG_SENTENCE).any():
        stop |= np.repeat(size > LONG_SENTENCE, size) & (own % np.uint64(CUT_EVERY) == 0)
        last = np.flatnonzero(stop)
        size = np.diff(last, prepend=-1)
        for k in np.flatnonzero(size > MOST_WORDS):
            stop[last[k] - size[k] + MOST_WORDS : last[k] : MOST_WORDS] = True
    word_ends = np.flatnonzero(stop) + 1
    return np.append(starts, len(text))[word_ends], word_ends, own


def runs(word_ends: np.ndarray, words: np.ndarray, min_sentences: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last sentence of each run in order, and its hash in two columns."""
    n = len(word_ends)
    starts = np.concatenate([[0], word_ends[:-1]])
    at = np.arange(n)
    last = np.maximum(np.searchsorted(word_ends, starts + min_words), at + min_sentences - 1)
    first = np.minimum(np.searchsorted(starts, word_ends - min_words, side="right") - 1, at - min_sentences + 1)
    onward, back = (last < n) & (word_ends > starts), (first >= 0) & (word_ends > starts)
    pairs = np.unique(np.concatenate([at[onward] * n + last[onward], first[back] * n + at[back]]))
    first, last = pairs // n, pairs % n
    raw = words.tobytes()
    spans = zip((starts[first] * 8).tolist(), (word_ends[last] * 8).tolist(), strict=True)
    return first, last, common.digests([raw[a:b] for a, b in spans])


def _hashed(docs: DataFrame, min_sentences: int, min_words: int) -> DataFrame:
    """Each distinct run of each document, and how often it stands there: h1, h2, doc_id, times."""

    def run(batches):
        for batch in batches:
            for part in _parts(batch):
                rows, hashes, times = [], [], []
                for i, text in enumerate(common.as_bytes(part["text"])):
                    if text:
                        _, word_ends, words = sentences(text)
                        h = runs(word_ends, words, min_sentences, min_words)[2]
                        once, n = np.unique(h[:, 0], return_index=True, return_counts=True)[1:]
                        rows.append(np.full(len(once), i))
                        hashes.append(h[once])
                        times.append(n)
                if rows:
                    h = np.concatenate(hashes)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])),
                         part["doc_id"].take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(times))],
                        names=["h1", "h2", "doc_id", "times"],
                    )

    return docs.select("doc_id", "text").mapInArrow(run, "h1 long, h2 long, doc_id long, times long")


_FOUND = "first int, last int, start int, stop int, again boolean, h1 long, h2 long"


def _candidates(docs: DataFrame, min_sentences: int, min_words: int, bits) -> DataFrame:
    """Runs that may be repeated, by sentence (first, last) and byte (start, stop); ``again``: not the first place
    in the document."""

    def run(batches):
        for batch in batches:
            for part in _parts(batch):
                out = [[] for _ in range(7)]
                for i, text in enumerate(common.as_bytes(part["text"])):
                    if not text:
                        continue
                    ends, word_ends, words = sentences(text)
                    first, last, h = runs(word_ends, words, min_sentences, min_words)
                    again = np.ones(len(first), bool)
                    again[np.unique(h[:, 0], return_index=True)[1]] = False
                    keep = common.in_bitmap(bits.value, h[:, 0], h[:, 1])
                    start, stop = np.append(0, ends)[first], ends[last]
                    for column, values in zip(out, (np.full(len(first), i), first, last, start, stop, again, h), strict=True):
                        column.append(values[keep])
                if out[0]:
                    row, first, last, start, stop, again, h = map(np.concatenate, out)
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [*(part[c].take(at) for c in ("k1", "k2", "doc_id")),
                         *(pa.array(x.astype(np.int32)) for x in (first, last, start, stop)), pa.array(again),
                         pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1]))],
                        names=["k1", "k2", "doc_id", "first", "last", "start", "stop", "again", "h1", "h2"],
                    )

    keyed = docs.select(*common.content_key("doc_id", "text"), "doc_id", "text")
    return keyed.mapInArrow(run, f"k1 long, k2 long, doc_id long, {_FOUND}")


def _parts(batch: pa.RecordBatch):
    """Few documents at a time, since a document makes a row for each of its sentences."""
    return (batch.slice(i, DOCUMENTS_AT_ONCE) for i in range(0, batch.num_rows, DOCUMENTS_AT_ONCE))


def joined_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans made one, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _without(df: DataFrame) -> DataFrame:
    """Takes the covered sentences out of the texts; adds n_removed and removed (code points)."""

    def run(batches):
        for batch in batches:
            texts, gone, spans = [], [], []
            for text, drops in zip(common.as_bytes(batch["text"]), batch["drops"].to_pylist(), strict=True):
                kept, removed, at, chars = [], [], 0, 0
                for a, b in joined_spans([(d["start"], d["stop"]) for d in drops or ()]):
                    before, out = text[at:a].decode("utf-8", "replace"), text[a:b].decode("utf-8", "replace")
                    kept.append(before)
                    removed.append({"start": chars + len(before), "end": chars + len(before) + len(out)})
                    chars += len(before) + len(out)
                    at = b
                texts.append(None if text is None else "".join(kept) + text[at:].decode("utf-8", "replace"))
                gone.append(sum(b - a for a, b in joined_spans([(d["first"], d["last"] + 1) for d in drops or ()])))
                spans.append(removed)
            yield pa.RecordBatch.from_arrays(
                [batch["rest"], batch["doc_id"], pa.array(texts, pa.string()), pa.array(gone, pa.int64()),
                 pa.array(spans, _SPAN), batch["first_docs"]],
                names=["rest", "doc_id", "text", "n_removed", "removed", "first_docs"],
            )

    types = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.mapInArrow(
        run, f"rest {types['rest']}, doc_id long, text string, n_removed long,"
        " removed array<struct<start:int,end:int>>, first_docs array<bigint>"
    )


def drop_repeated_spans(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without repeated spans in ``text``; adds n_removed (sentences), removed (spans of the old text in
    code points) and first_docs (the documents that keep what was removed).

    The first place of a run is in the smallest doc_id, at its first position there; case of A-Z and the kind
    of white space do not matter. Rows that repeat a doc_id count as that document and keep the same;
    a missing doc_id is larger than any other, and runs that only such rows hold keep a place in each. A null
    text stays null; texts too short for a run stay whole. An empty table gives an
    empty table. Other columns pass through; the added names replace columns of theirs.
    """
    named = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    repeated = stored(
        _hashed(named, min_sentences, min_words)
        .groupBy("h1", "h2").agg(F.sum("times").alias("n"), F.min("doc_id").alias("origin"))
        .where("n > 1").select("h1", "h2", "origin"),
        "repeated-runs",
    )
    bits = docs.sparkSession.sparkContext.broadcast(common.bitmap(repeated, "h1", "h2"))
    drops = (
        _candidates(named, min_sentences, min_words, bits)
        .join(repeated, ["h1", "h2"])
        .where(F.col("again") | ~F.col("doc_id").eqNullSafe(F.col("origin")))
        .groupBy("k1", "k2")
        .agg(F.collect_list(F.struct("first", "last", "start", "stop")).alias("drops"), F.sort_array(F.collect_set("origin")).alias("first_docs"))
    )
    keyed = named.select(
        common.others(named, "doc_id", "text"), "doc_id", "text", *common.content_key("doc_id", "text")
    )
    joined = keyed.join(drops, ["k1", "k2"], "left").select(
        "rest", "doc_id", "text", "drops", F.coalesce("first_docs", F.array().cast("array<bigint>")).alias("first_docs")
    )
    made = {c: F.col(c) for c in ("n_removed", "removed", "first_docs")}
    return _without(joined).select(*common.restored(joined, docs, "doc_id", "text", **made))


def op9_span_dedup(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_spans(docs).select(
        "doc_id", "n_removed", "removed", "first_docs", "text",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


QUERIES = {"op9_span_dedup": op9_span_dedup}
ORACLES = {}
