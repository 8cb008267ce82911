"""Ranked lexical search, reversed: items are indexed and documents stream past them.

The inverted index over the items' terms goes to every task, in blocks of items of bounded text. One pass over
the documents keeps what a score needs: each document's length and how often it has the terms that any item
has. Counts of documents and terms follow from that table; then each task streams its documents' counts through the
index and updates a heap of bounded size for every item. The heaps are merged in two steps.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm import common
from tidemark.llm.decontaminate import _words as sql_words, words_of
from tidemark.session import stored

K = 20

#: Characters of the items in one block, about; a block's index is broadcast and costs one pass over the texts.
BLOCK_CHARS = 16_000_000

#: Cells (documents by items) and postings that a task scores at a time.
CELLS = 2_000_000

#: Parts in which the heaps of one item are merged first.
PARTS = 64


def inverted(items: list[tuple]) -> dict:
    """Terms by number, and for each term the items that hold it and how often, from (item_id, text)."""
    vocabulary: dict[bytes, int] = {}
    terms, holders = [], []
    for i, (_, text) in enumerate(items):
        own = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of((text or "").encode("utf-8", "replace"))]
        terms += own
        holders += [i] * len(own)
    cells, repeats = np.unique(np.array(terms, np.int64) * max(1, len(items)) + np.array(holders, np.int64), return_counts=True)
    owner = cells // max(1, len(items))
    return {
        "ids": [i for i, _ in items], "vocabulary": vocabulary, "terms": owner, "items": cells % max(1, len(items)),
        "repeats": repeats.astype(np.int64), "starts": np.searchsorted(owner, np.arange(len(vocabulary) + 1)),
    }


def _counted(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id, n (all terms), terms and tfs (the sought terms and their counts) of documents with any term."""

    def run(batches):
        look = vocabulary.value.get
        width = max(1, len(vocabulary.value))
        for batch in batches:
            sizes, parts = [], []
            for text in common.as_bytes(batch["text"]):
                words = words_of(text)
                sizes.append(len(words))
                parts.append(np.array([t for t in map(look, words) if t is not None], np.int64))
            row = np.repeat(np.arange(len(parts)), list(map(len, parts)))
            cells, tfs = np.unique(row * width + np.concatenate([np.empty(0, np.int64), *parts]), return_counts=True)
            edges = pa.array(np.searchsorted(cells, np.arange(len(parts) + 1) * width), pa.int32())
            out = pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(edges, pa.array(cells % width, pa.int32())),
                 pa.ListArray.from_arrays(edges, pa.array(tfs, pa.int64()))],
                names=["doc_id", "n", "terms", "tfs"],
            )
            yield out.filter(pa.array(np.array(sizes, np.int64) > 0))

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n long, terms array<int>, tfs array<long>"
    )


class Heaps:
    """The ``k`` best documents of each item, by falling score and rising id."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.scores = np.zeros((items, k), np.int64)
        self.docs = np.full((items, k), np.iinfo(np.int64).max)

    def least(self) -> np.ndarray:
        """Scores below these change no heap."""
        return np.maximum(self.scores[:, -1], 1)

    def update(self, items: np.ndarray, docs: np.ndarray, scores: np.ndarray) -> None:
        touched = np.unique(items)
        every = np.concatenate([np.repeat(touched, self.k), items])
        docs = np.concatenate([self.docs[touched].ravel(), docs])
        scores = np.concatenate([self.scores[touched].ravel(), scores])
        order = np.lexsort((docs, -scores, every))
        every = every[order]
        place = np.arange(len(every)) - np.searchsorted(every, every)
        best = order[place < self.k]
        self.scores[touched] = scores[best].reshape(-1, self.k)
        self.docs[touched] = docs[best].reshape(-1, self.k)


def _steps(sizes: np.ndarray, width: int):
    """Cuts documents into runs of at most CELLS cells and postings; a document is never cut."""
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and (held + size > CELLS or (i - start + 1) * width > CELLS):
            yield start, i
            start, held = i, 0
        held += size
    if len(sizes) > start:
        yield start, len(sizes)


def scores_of(index: dict, weights: np.ndarray, terms, tfs, owner, m, docs: int) -> np.ndarray:
    """Scores of some documents (rows) for all items, from the counts of their terms."""
    n_items = len(index["ids"])
    gain = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 12 * m[owner]))
    first, last = index["starts"][terms], index["starts"][terms + 1]
    ends = np.cumsum(last - first)
    at = np.repeat(first - (ends - (last - first)), last - first) + np.arange(int(ends[-1]) if len(ends) else 0)
    cells = np.repeat(owner * n_items, last - first) + index["items"][at]
    added = np.repeat(gain, last - first) * index["repeats"][at]
    if index["exact"]:
        return np.bincount(cells, weights=added, minlength=docs * n_items).astype(np.int64).reshape(docs, n_items)
    out = np.zeros(docs * n_items, np.int64)
    np.add.at(out, cells, added)
    return out.reshape(docs, n_items)


def normalised(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """The length part of a score, in whole numbers; products beyond 64 bits are taken exactly."""
    if 25 * int(n.max(initial=0)) * documents >= 1 << 63:
        n = n.astype(object)
    return (100 - 25 + (25 * n * documents) // terms).astype(np.int64)


def _ranked(counted: DataFrame, index, documents: int, terms: int, k: int, item_type: str) -> DataFrame:
    """The heaps of every task: item_id, doc_id, score."""

    def run(batches):
        own = index.value
        weights, postings = own["weights"], np.diff(own["starts"])
        heaps = Heaps(len(own["ids"]), k)
        for batch in batches:
            ids, m = batch["doc_id"].to_numpy(), normalised(batch["n"].to_numpy(), documents, terms)
            edges = batch["terms"].offsets.to_numpy().astype(np.int64)
            edges = edges - edges[0]
            t, tfs = batch["terms"].flatten().to_numpy().astype(np.int64), batch["tfs"].flatten().to_numpy()
            total = np.append(0, np.cumsum(postings[t]))
            for a, b in _steps(total[edges[1:]] - total[edges[:-1]], len(own["ids"])):
                part = slice(edges[a], edges[b])
                owner = np.repeat(np.arange(b - a), np.diff(edges[a : b + 1]))
                scores = scores_of(own, weights, t[part], tfs[part], owner, m[a:b], b - a)
                row, item = np.nonzero(scores >= heaps.least())
                if len(row):
                    heaps.update(item, ids[a:b][row], scores[row, item])
        item, place = np.nonzero(heaps.scores)
        names = pa.array(own["ids"], _arrow(item_type)).take(pa.array(item, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [names, pa.array(heaps.docs[item, place]), pa.array(heaps.scores[item, place])], names=["item_id", "doc_id", "score"]
        )

    return counted.mapInArrow(run, f"item_id {item_type}, doc_id long, score long")


def _arrow(item_type: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[item_type]


def ranked(docs: DataFrame, items: DataFrame, k: int = K, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents with the highest scores above 0 for each item.

    Terms are runs of ASCII digits and letters and of other characters beyond ASCII; only A-Z are lower-cased.
    Equal scores go to the smaller doc_id. Documents without an id take no part, nor do items; rows that repeat a
    doc_id are documents of their own, items that repeat an item_id count once, by the smallest of their texts. A
    null or empty text has no terms: such a document counts nowhere and such an item has no rows. Empty
    tables give no rows. Other columns are not used. item_id may be an integer or a string.
    """
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    kind = kind if kind in ("bigint", "int") else "string"
    once = (
        items.where("item_id is not null").select(F.col("item_id").cast(kind), "text")
        .groupBy("item_id").agg(F.min("text").alias("text"))
    )
    chars = once.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    parts = []
    for block in range(blocks):
        here = once.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        parts.append(_block(docs, inverted([tuple(r) for r in here.collect()]), k, kind, spark))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    order = [F.desc("score"), "doc_id"]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    some = F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    best = found.withColumn("part", part).withColumn("rank", some).where(F.col("rank") <= k)
    return best.select("item_id", rank.alias("rank"), "doc_id", "score").where(F.col("rank") <= k)


def _block(docs: DataFrame, index: dict, k: int, kind: str, spark) -> DataFrame:
    vocabulary = index.pop("vocabulary")
    counted = stored(_counted(docs, spark.sparkContext.broadcast(vocabulary)), "term-counts")
    documents, terms = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = np.zeros(len(vocabulary), np.int64)
    for term, n in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        holding[term] = n
    index["weights"] = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in holding.tolist()], np.int64)
    of_item = np.zeros(len(index["ids"]), np.float64)
    np.add.at(of_item, index["items"], index["repeats"] * index["weights"][index["terms"]].astype(np.float64))
    index["exact"] = of_item.max(initial=0) * 1e6 < 1 << 53
    return _ranked(counted, spark.sparkContext.broadcast(index), documents, terms, k, kind)


def op12_lexical_search(spark, sf_dir):
    return ranked(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


QUERIES = {"op12_lexical_search": op12_lexical_search}

ORACLES = {"op12_lexical_search": f"""
WITH d AS (
  SELECT r, doc_id, w, len(w) AS n
  FROM (SELECT row_number() OVER () AS r, doc_id, {sql_words('text')} AS w FROM documents WHERE doc_id IS NOT NULL)
  WHERE len(w) > 0),
total AS (SELECT count(*) AS documents, sum(n)::BIGINT AS terms FROM d),
tf AS (
  SELECT r, doc_id, n, term, count(*) AS tf
  FROM (SELECT r, doc_id, n, unnest(w) AS term FROM d) GROUP BY r, doc_id, n, term),
weight AS (
  SELECT term, floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
asked AS (
  SELECT item_id, term, count(*) AS repeats
  FROM (SELECT item_id, unnest({sql_words('text')}) AS term
        FROM (SELECT item_id, min(text) AS text FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id))
  GROUP BY item_id, term),
scored AS (
  SELECT item_id, r, doc_id,
         sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * documents) // terms))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weight USING (term), total GROUP BY item_id, r, doc_id),
placed AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
  FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM placed WHERE rank <= {K}"""}
