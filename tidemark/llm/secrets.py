"""Secret scans with corpus-wide ownership: who else holds the same value tells an example from a live secret.

One pass finds candidates and hashes their values. Hashes are then counted by distinct repository and owner:
a value that many owners hold was copied from an example, a value of one owner looks live. Pattern matches
always stay; a random-looking token is added where its value has one owner, or where a pattern finds
the same value elsewhere in the corpus.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm import common
from tidemark.session import stored

KINDS = ("assign", "access", "hex", "token")

#: Fixed patterns of the base kinds, with the least length of what must be long enough.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Candidates beyond the base kinds: long runs with a digit and a letter and enough entropy (bits a character).
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
TOKEN_ENTROPY = 3.5

#: From so many owners on, a value counts as a copied example.
EXAMPLE_OWNERS = 3

_WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
_DIGIT = re.compile(rb"[0-9]")


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def candidates(data: bytes) -> list[tuple[int, int, int, str]]:
    """kind, start, end (code points) and value of every candidate in a whole text."""
    text = data.decode("utf-8", "replace")
    found = []
    low = data.lower()
    if any(w in low for w in _WORDS):
        found += [(0, *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if b"AKIA" in data:
        found += [(1, *m.span(), m[0]) for m in ACCESS.finditer(text)]
    found += [(2, *m.span(), m[0]) for m in HEX.finditer(text)]
    if _DIGIT.search(data):
        taken = sorted((s, e) for _, s, e, _ in found)
        at = 0
        for m in TOKEN.finditer(text):
            start, end = m.span()
            while at < len(taken) and taken[at][1] <= start:
                at += 1
            free = at == len(taken) or taken[at][0] >= end
            value = m[0]
            if free and any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and entropy(value) >= TOKEN_ENTROPY:
                found.append((3, start, end, value))
    return found


_FOUND = pa.struct([
    ("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()),
])


def _scanned(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    def run(batches):
        for batch in batches:
            found, values = [], []
            for data in common.as_bytes(batch["text"]):
                own = candidates(data or b"")
                found.append(own)
                values += [v.encode() for *_, v in own]
            h = common.digests(values)
            flat = [(s, k, e) for own in found for k, s, e, _ in own]
            cols = np.array(flat, np.int32).reshape(-1, 3)
            parts = [pa.array(np.ascontiguousarray(c)) for c in (*cols.T, *h.T)]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32))
            spans = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, fields=list(_FOUND)))
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in ("doc_id", "owner", "repository")), spans], names=["doc_id", "owner", "repository", "found"]
            )

    named = docs.select(
        F.col("doc_id").cast("long"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
        F.coalesce(repository.cast("string"), F.lit("")).alias("repository"), "text",
    )
    return named.mapInArrow(
        run, "doc_id long, owner string, repository string,"
        " found array<struct<start:int,kind:int,end:int,h1:bigint,h2:bigint>>"
    )


def ownership(found: DataFrame) -> DataFrame:
    """h1, h2, owners, repositories (distinct), known (a base pattern finds it): a row per value.

    Counts are combined by (value, owner, repository) first, so a value in a third of all rows stays cheap.
    """
    each = found.groupBy("h1", "h2", "owner", "repository").agg(F.min("kind").alias("kind"))
    by_owner = each.groupBy("h1", "h2", "owner").agg(F.count(F.lit(1)).alias("n"), F.min("kind").alias("kind"))
    return by_owner.groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"), (F.min("kind") < 3).alias("known")
    )


def secrets(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """doc_id, found: a row per row of ``docs``; found is an array of start, kind (index in KINDS), end, owners,
    repositories, in order of start and kind.

    A null text is empty, a null owner or repository is the empty name, and repeated rows give repeated results. An
    empty table gives an empty table. Other columns are not used.
    """
    scanned = stored(_scanned(docs, owner, repository).withColumn("row", F.monotonically_increasing_id()), "candidates")
    each = scanned.where(F.size("found") > 0).select("row", "owner", "repository", F.explode("found").alias("f")).select(
        "row", "owner", "repository", "f.*"
    )
    kept = (
        each.join(ownership(each), ["h1", "h2"])
        .where((F.col("kind") < 3) | (F.col("owners") == 1) | F.col("known"))
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "owners", "repositories"))).alias("found"))
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int,owners:bigint,repositories:bigint>>")
    return scanned.select("row", "doc_id").join(kept, "row", "left").select("doc_id", F.coalesce("found", none).alias("found"))


def op7_secret_scan(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    out = secrets(docs, F.col("source"), F.concat_ws("/", "source", "lang"))
    name = F.array(*map(F.lit, KINDS))
    written = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ","
    )
    base = F.filter("found", lambda s: s["kind"] < 3)

    def of_kind(k):
        return lambda s: s["kind"] == k

    count = lambda test: F.size(F.filter("found", test)).cast("long")
    return out.select(
        "doc_id",
        *(count(of_kind(k)).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(written(base), 256).alias("base_sha256"), written("found").alias("spans"),
        count(lambda s: s["owners"] == 1).alias("n_live"),
        count(lambda s: s["owners"] >= EXAMPLE_OWNERS).alias("n_example"),
    )


QUERIES = {"op7_secret_scan": op7_secret_scan}
ORACLES = {}
