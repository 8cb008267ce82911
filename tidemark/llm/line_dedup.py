"""Line dedup: boilerplate lines that many documents share are dropped from all but one of them.

Two passes read the texts without moving them: the first sends one hash per long line to a
combined count, the second picks the lines that may be frequent with a bitmap of fixed size.
Only those lines meet the table of frequent hashes, and the texts move once, to be reassembled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import common
from tidemark.session import stored

#: A line counts as boilerplate from so many code points and documents.
MIN_CHARS = 40
MIN_DOCUMENTS = 5


def line_keys(text: bytes, min_chars: int) -> tuple[list[int], list[bytes]]:
    """Positions and keys of the lines that are long enough."""
    at, keys = [], []
    for i, line in enumerate(text.lower().split(b"\n")):
        key = line.strip(common.SPACE)
        if len(key) >= min_chars and len(key.decode("utf-8", "replace")) >= min_chars:
            at.append(i)
            keys.append(key)
    return at, keys


def _line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """Each distinct key of each document: h1, h2, doc_id."""

    def run(batches):
        for batch in batches:
            ids, keys = [], []
            for i, text in enumerate(common.as_bytes(batch["text"])):
                own = set(line_keys(text or b"", min_chars)[1])
                ids += [i] * len(own)
                keys += own
            h = common.digests(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0]), pa.array(h[:, 1]), batch["doc_id"].take(pa.array(ids, pa.int64()))],
                names=["h1", "h2", "doc_id"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "h1 long, h2 long, doc_id long")


def _candidates(docs: DataFrame, min_chars: int, bits) -> DataFrame:
    """The lines that may be frequent: k1, k2, doc_id, pos, h1, h2."""

    def run(batches):
        for batch in batches:
            rows, at, keys = [], [], []
            for i, text in enumerate(common.as_bytes(batch["text"])):
                own_at, own = line_keys(text or b"", min_chars)
                rows += [i] * len(own)
                at += own_at
                keys += own
            h = common.digests(keys)
            hit = common.in_bitmap(bits.value, h[:, 0], h[:, 1])
            row = pa.array(np.asarray(rows, np.int64)[hit])
            yield pa.RecordBatch.from_arrays(
                [*(batch[c].take(row) for c in ("k1", "k2", "doc_id")),
                 pa.array(np.asarray(at, np.int32)[hit]), pa.array(h[hit, 0]), pa.array(h[hit, 1])],
                names=["k1", "k2", "doc_id", "pos", "h1", "h2"],
            )

    keyed = docs.select(*common.content_key("doc_id", "text"), "doc_id", "text")
    return keyed.mapInArrow(run, "k1 long, k2 long, doc_id long, pos int, h1 long, h2 long")


def _reassembled(df: DataFrame) -> DataFrame:
    """Joins the lines that stay by position; adds n_lines and n_dropped."""

    def run(batches):
        for batch in batches:
            texts, lines, dropped = [], [], []
            for text, drop in zip(batch["text"].to_pylist(), batch["drop"].to_pylist(), strict=True):
                parts = (text or "").split("\n")
                out = set(drop or ())
                lines.append(len(parts))
                dropped.append(len(out))
                texts.append("\n".join(x for i, x in enumerate(parts) if i not in out) if out else text)
            yield pa.RecordBatch.from_arrays(
                [batch["rest"], batch["doc_id"], pa.array(texts, pa.string()),
                 pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
                names=["rest", "doc_id", "text", "n_lines", "n_dropped"],
            )

    types = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.mapInArrow(
        run, f"rest {types['rest']}, doc_id long, text string, n_lines long, n_dropped long"
    )


def drop_repeated_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS
) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and n_lines and n_dropped added.

    A key is a line without ASCII white space at its ends and with A-Z lower-cased. Keys of at least
    ``min_chars`` code points found in at least ``min_documents`` documents stay in the largest
    ``doc_id`` that holds them only. Rows that repeat a doc_id are one document and are treated alike; each row
    without a doc_id is a document of its own, but never the largest, and a key found in such rows alone
    stays. A null text has one empty line and stays null.
    Empty tables give empty tables. Other columns pass through; n_lines and n_dropped replace columns
    of these names.
    """
    named = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    frequent = stored(
        _line_hashes(named, min_chars)
        .groupBy("h1", "h2")
        .agg((F.count_distinct("doc_id") + F.count_if(F.col("doc_id").isNull())).alias("n"), F.max("doc_id").alias("last"))
        .where((F.col("n") >= min_documents) & F.col("last").isNotNull())
        .select("h1", "h2", "last"),
        "frequent-lines",
    )
    bits = docs.sparkSession.sparkContext.broadcast(common.bitmap(frequent, "h1", "h2"))
    drops = (
        _candidates(named, min_chars, bits)
        .join(frequent, ["h1", "h2"])
        .where(~F.col("doc_id").eqNullSafe(F.col("last")))
        .groupBy("k1", "k2")
        .agg(F.collect_set("pos").alias("drop"))
    )
    keyed = named.select(
        common.others(named, "doc_id", "text"), "doc_id", "text", *common.content_key("doc_id", "text")
    )
    joined = keyed.join(drops, ["k1", "k2"], "left").select("rest", "doc_id", "text", "drop")
    made = {c: F.col(c) for c in ("n_lines", "n_dropped")}
    return _reassembled(joined).select(*common.restored(joined, docs, "doc_id", "text", **made))


def op5_line_dedup(spark, sf_dir):
    out = drop_repeated_lines(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "n_lines", "n_dropped",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


QUERIES = {"op5_line_dedup": op5_line_dedup}

_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

ORACLES = {"op5_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, pos, part,
         translate(trim(part, {_SPACES}), '{_UPPER}', '{_UPPER.lower()}') AS key
  FROM (SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS part
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
frequent AS (
  SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= {MIN_CHARS}
  GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCUMENTS}),
marked AS (
  SELECT l.doc_id, l.pos, l.part, f.key IS NOT NULL AND l.doc_id <> f.last AS gone
  FROM lines l LEFT JOIN frequent f ON l.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(part, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""}
