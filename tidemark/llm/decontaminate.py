"""Benchmark decontamination by a prefix-filtered set join.

A window of an item is a set of shingles with their positions. All of a window's shingles must occur
for the window to occur, so one of them is a sufficient prefix, and the rarest makes the fewest
candidates. One pass over the documents counts the item shingles, one finds the rarest of each window;
both ask a bitmap of fixed size first. Candidates meet the windows in a join on the shingle's hash, where
positions and lengths are bounded and the words themselves are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import common
from tidemark.session import stored

WINDOW = 10
SHINGLE = 3

#: A-Z become a-z; every other ASCII character that is neither a digit nor a letter ends a word.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


def _windows(items: DataFrame, window: int, width: int) -> DataFrame:
    """item_id, w1, w2 (hash of the words), words, size, shingle, off, width: a row per window and shingle."""

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(7)]
            for i, text in enumerate(common.as_bytes(batch["text"])):
                words = words_of(text)
                size = min(window, len(words))
                own = common.shingles(common.word_hashes(words), min(width, size)) if size else ()
                for start in range(len(words) - size + 1 if size else 0):
                    joined = b" ".join(words[start : start + size])
                    for off in range(size - min(width, size) + 1):
                        shingle = int(own[start + off].view(np.int64))
                        row = (i, joined, size, shingle, off, min(width, size), xxhash.xxh3_128_digest(joined))
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
            w = np.frombuffer(b"".join(out[6]), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch["item_id"].take(pa.array(out[0], pa.int64())), pa.array(w[:, 0]), pa.array(w[:, 1]),
                 pa.array(out[1], pa.binary()).cast(pa.string()), *(pa.array(out[k], pa.int32()) for k in (2, 4, 5)),
                 pa.array(out[3], pa.int64())],
                names=["item_id", "w1", "w2", "words", "size", "off", "width", "shingle"],
            )

    return items.select(F.col("item_id").cast("string"), "text").mapInArrow(
        run, "item_id string, w1 long, w2 long, words string, size int, off int, width int, shingle long"
    )


def _marked(words: list, widths: list[int], bits) -> list[tuple[np.ndarray, np.ndarray]]:
    """Positions and hashes of the shingles that may be sought, for each width."""
    own = common.word_hashes(words)
    out = []
    for width in widths:
        s = common.shingles(own, width)
        at = common.in_bitmap(bits, s, s >> np.uint64(32))
        out.append((at, s[at]))
    return out


def _sought(shingles: DataFrame):
    """A broadcast bitmap of a column of shingles, by both halves of each hash."""
    both = shingles.select(F.col("shingle").alias("h1"), F.shiftrightunsigned("shingle", 32).alias("h2")).distinct()
    return shingles.sparkSession.sparkContext.broadcast(common.bitmap(both, "h1", "h2"))


def _occurrences(docs: DataFrame, bits, widths: list[int]) -> DataFrame:
    """How often the sought shingles occur in all documents: shingle, n."""

    def run(batches):
        for batch in batches:
            found = [
                s for text in common.as_bytes(batch["text"])
                for _, s in _marked(words_of(text), widths, bits.value)
            ]
            values, counts = np.unique(np.concatenate(found) if found else np.empty(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], names=["shingle", "n"])

    counted = docs.select("text").mapInArrow(run, "shingle long, n long")
    return counted.groupBy("shingle").agg(F.sum("n").alias("n"))


_FOUND = pa.struct([("shingle", pa.int64()), ("pos", pa.int32()), ("before", pa.int32()), ("near", pa.string())])


def _scanned(docs: DataFrame, bits, widths: list[int], window: int) -> DataFrame:
    """rest, doc_id, text, n_words and the places of anchors, each with the words around it."""

    def run(batches):
        for batch in batches:
            sizes, found = [], []
            for text in common.as_bytes(batch["text"]):
                words = words_of(text)
                own = []
                for at, s in _marked(words, widths, bits.value):
                    for p, shingle in zip(at.tolist(), s.view(np.int64).tolist(), strict=True):
                        start = max(0, p - window + 1)
                        near = b" ".join(words[start : p + window]).decode("utf-8", "replace")
                        own.append({"shingle": shingle, "pos": p, "before": p - start, "near": near})
                sizes.append(len(words))
                found.append(own)
            yield pa.RecordBatch.from_arrays(
                [batch["k1"], batch["k2"], pa.array(sizes, pa.int64()), pa.array(found, pa.list_(_FOUND))],
                names=["k1", "k2", "n_words", "found"],
            )

    return docs.select(*common.content_key("text"), "text").mapInArrow(
        run, "k1 long, k2 long, n_words long,"
        " found array<struct<shingle:bigint,pos:int,before:int,near:string>>"
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, width: int = SHINGLE) -> DataFrame:
    """k1, k2 (keys of the text), n_words, n_hit, items (sorted array of item ids) for each text of ``docs``.

    Words are the runs of digits, letters and non-ASCII characters, A-Z lower-cased. A window is a run of
    ``window`` words of an item, or the whole item where it has fewer; a word is hit if it lies in any
    occurrence of a window. Texts that repeat give one row. Null and empty texts have no words and no
    hits; null and empty items have no window. Items that repeat count once; an item without an id
    hits, but is not listed. Empty tables give no hits or no rows.
    """
    windows = stored(_windows(items, window, width), "item-windows")
    widths = sorted(r["width"] for r in windows.select("width").distinct().collect())
    counts = _occurrences(docs, _sought(windows), widths)
    anchors = stored(
        windows.select("w1", "w2", "words", "size", "off", "shingle").distinct()
        .join(counts, "shingle", "left")
        .groupBy("w1", "w2", "words", "size")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "off")).alias("rarest"))
        .select("w1", "w2", "words", "size", "rarest.shingle", "rarest.off"),
        "anchors",
    )
    scanned = stored(_scanned(docs, _sought(anchors), widths, window), "scanned-documents").dropDuplicates(["k1", "k2"])
    start = F.col("pos") - F.col("off")
    hits = stored(
        scanned.where(F.size("found") > 0)
        .select("k1", "k2", "n_words", F.explode("found").alias("f"))
        .select("k1", "k2", "n_words", "f.*")
        .join(anchors, "shingle")
        .where((start >= 0) & (start + F.col("size") <= F.col("n_words")))
        .where(
            F.array_join(F.slice(F.split("near", " "), F.col("before") - F.col("off") + 1, F.col("size")), " ")
            == F.col("words")
        )
        .select("k1", "k2", start.alias("start"), "size", "w1", "w2")
        .distinct(),
        "window-hits",
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0), x["start"] + x["size"] - F.greatest(x["start"], a["end"]))).alias("n"),
            F.greatest(a["end"], x["start"] + x["size"]).alias("end"),
        ),
        lambda a: a["n"],
    )
    words = (
        hits.groupBy("k1", "k2", "start").agg(F.max("size").alias("size"))
        .groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("start", "size"))).alias("spans"))
        .select("k1", "k2", covered.alias("n_hit"))
    )
    owners = windows.select("w1", "w2", "item_id").distinct()
    named = (
        hits.select("k1", "k2", "w1", "w2").distinct()
        .join(owners, ["w1", "w2"])
        .groupBy("k1", "k2").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    )
    return (
        scanned.select("k1", "k2", "n_words")
        .join(words, ["k1", "k2"], "left")
        .join(named, ["k1", "k2"], "left")
        .select(
            "k1", "k2", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    )


def op4_decontaminate(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    found = contamination(docs, common.table(spark, sf_dir, "benchmark"))
    return (
        docs.select("doc_id", *common.content_key("text"))
        .join(found, ["k1", "k2"])
        .select(
            "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
            (F.col("n_hit") > 0).alias("contaminated"),
        )
    )


QUERIES = {"op4_decontaminate": op4_decontaminate}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _words(column: str) -> str:
    lowered = f"translate(coalesce({column}, ''), '{_UPPER}', '{_UPPER.lower()}')"
    return rf"regexp_extract_all({lowered}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


ORACLES = {"op4_decontaminate": f"""
WITH items AS (
  SELECT item_id, w, least(len(w), {WINDOW}) AS size
  FROM (SELECT item_id, {_words('text')} AS w FROM benchmark) WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, size, array_to_string(w[s : s + size - 1], ' ') AS words
  FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM items)),
sizes AS (SELECT DISTINCT size FROM windows),
docs AS (SELECT doc_id, {_words('text')} AS w FROM documents),
places AS (
  SELECT doc_id, size, s, array_to_string(w[s : s + size - 1], ' ') AS words
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s
        FROM docs, sizes WHERE len(w) >= size)),
hits AS (SELECT p.doc_id, p.s, p.size, i.item_id FROM places p JOIN windows i USING (size, words)),
covered AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + size)) AS k FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)"""}
