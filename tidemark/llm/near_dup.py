"""MinHash near-dedup with HyperMinHash registers.

Documents of one shingle set form one class, and classes carry on alone. A class keeps the smallest
hash of its set under each of many hash functions, compressed to a count of leading zeros and some
mantissa bits. Bands of registers propose candidates: first every member of a bucket meets the
bucket's smallest member; then, once these links are contracted, members of one bucket that still lie
in different components meet block by block, each pair in the first band it shares. An estimate from the registers,
corrected for registers that agree by chance, thins the candidates; the full sets decide.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import common
from tidemark.llm.components import components
from tidemark.session import stored

WIDTH = 5
PERCENT = 80

#: 40 bands of 6 registers miss a pair of similarity 0.8 with a probability of 5e-6.
BANDS, ROWS = 40, 6
REGISTERS = BANDS * ROWS
MANTISSA = 10

#: Members of one bucket meet in blocks of about this size; only links leave a task.
BLOCK = 256
PAIRS_AT_ONCE = 50_000

#: Tasks in which the members of one bucket meet its smallest member.
BUCKET_PARTS = 16

#: A candidate falls out if its estimate is so many standard errors below the threshold.
SLACK = 4.5

_rng = np.random.default_rng(20)
_FACTORS = _rng.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_TERMS = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_STEP = 1024
_BAND = np.uint64(63)


def registers(items: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of the smallest hash of ``items`` (uint64) under each function."""
    folded = (items >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(folded), _STEP):
        block = folded[i : i + _STEP, None] * _FACTORS + _TERMS
        np.minimum(least, block.min(axis=0), out=least)
    value = least.astype(np.float64) + 1.0
    digits = np.floor(np.log2(value)).astype(np.int64)
    mantissa = np.floor((value / np.exp2(digits) - 1.0) * (1 << MANTISSA)).astype(np.int64)
    return (((32 - digits) << MANTISSA) | mantissa).astype(np.uint16)


def band_hashes(regs: np.ndarray) -> np.ndarray:
    """One bucket number for each band of each row of registers; its last bits are the band."""
    bands = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    total = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), bands.shape[:2])
    for i in range(ROWS):
        total = common.mix(total * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, i])
    return total & ~_BAND | np.arange(BANDS, dtype=np.uint64)


@functools.lru_cache(maxsize=4096)
def chance(n: int, m: int) -> float:
    """The probability that registers of two sets without a common item, of n and m items, agree."""
    width = np.repeat(np.exp2(-np.arange(1.0, 33.0)), 1 << MANTISSA) / (1 << MANTISSA)
    low = np.repeat(np.exp2(-np.arange(1.0, 33.0)), 1 << MANTISSA) + np.tile(np.arange(1 << MANTISSA), 32) * width
    p = [np.exp(k * np.log1p(-low)) - np.exp(k * np.log1p(-np.minimum(low + width, 1 - 1e-15))) for k in (n, m)]
    return float(np.dot(*p))


def size_class(n: np.ndarray) -> np.ndarray:
    return np.rint(np.log(n) / np.log(1.25)).astype(np.int64)


def estimates(agree: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Similarities of pairs of sets from the share of registers that agree, without what agrees by chance."""
    kinds, place = np.unique(np.stack([size_class(n), size_class(m)], axis=1), axis=0, return_inverse=True)
    c = np.array([chance(round(1.25**x), round(1.25**y)) for x, y in kinds.tolist()])[place.ravel()]
    return (agree - c) / (1 - c)


def least_estimate(percent: int) -> float:
    return percent / 100 - SLACK * (percent / 100 * (1 - percent / 100) / REGISTERS) ** 0.5


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; a shorter text is one shingle."""
    words = common.word_hashes(text.lower().split())
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(common.shingles(words, min(width, len(words))))


def _sketches(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            sizes, prints, regs = [], [], []
            for text in common.as_bytes(batch["text"]):
                items = shingle_set(text or b"", width)
                sizes.append(len(items))
                prints.append(xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None)
                regs.append(registers(items).tobytes() if len(items) else None)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["k1"], batch["k2"], pa.array(sizes, pa.int64()),
                 pa.array(prints, pa.binary()), pa.array(regs, pa.binary())],
                names=["doc_id", "k1", "k2", "n", "print", "regs"],
            )

    keyed = docs.select("doc_id", *common.content_key("text"), "text")
    return keyed.mapInArrow(run, "doc_id long, k1 long, k2 long, n long, print binary, regs binary")


def _bands(classes: DataFrame) -> DataFrame:
    """bucket, id: a row for each class and band."""

    def run(batches):
        for batch in batches:
            regs = np.frombuffer(b"".join(batch["regs"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
            for i in range(0, len(regs), 1000):
                buckets = band_hashes(regs[i : i + 1000]).view(np.int64).ravel()
                ids = np.repeat(batch["id"].to_numpy()[i : i + 1000], BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(ids)], names=["bucket", "id"])

    return classes.select("id", "regs").mapInArrow(run, "bucket long, id long")


def _promising(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose sizes and registers allow the similarity."""
    side = lambda c: classes.select(
        F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("regs").alias(f"regs_{c}")
    )
    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(
        F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    )
    least = least_estimate(percent)

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("regs_a", "regs_b"))
            keep = np.zeros(len(x), bool)
            if len(x):
                keep = estimates((x == y).mean(axis=1), batch["n_a"].to_numpy(), batch["n_b"].to_numpy()) >= least
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep))

    return joined.select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(run, "a long, b long")


def _full_sets(docs: DataFrame, classes: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """id, items of the classes in ``ids``, from one text of each; stored."""
    keys = classes.join(ids.distinct(), "id", "left_semi").select("id", "k1", "k2")
    texts = docs.select(*common.content_key("text"), "text").join(keys, ["k1", "k2"])

    def run(batches):
        for batch in batches:
            items = [shingle_set(t, width).tobytes() for t in common.as_bytes(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(items, pa.binary())], names=["id", "items"])

    sets = texts.select("id", "text").mapInArrow(run, "id long, items binary")
    return stored(sets.groupBy("id").agg(F.first("items").alias("items")), "shingle-sets")


def similar(x: bytes, y: bytes, percent: int) -> bool:
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("items").alias(f"items_{c}"))

    def run(batches):
        for batch in batches:
            items = zip(batch["items_a"].to_pylist(), batch["items_b"].to_pylist(), strict=True)
            keep = pa.array([similar(x, y, percent) for x, y in items], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(keep)

    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.select("a", "b", "items_a", "items_b").mapInArrow(run, "a long, b long")


def _met(members: DataFrame, percent: int) -> DataFrame:
    """Links a, b of members of one bucket with different roots. ``members``: bucket, size, id, root, regs, items.

    A bucket is dealt into blocks, and two blocks meet in one task, so neither its members nor its pairs
    ever come together; pairs are compared in place and only links become rows.
    """
    dealt = (
        members.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"p": F.least("block", "other"), "q": F.greatest("block", "other")})
    )
    key = ["bucket", "p", "q"]
    least = least_estimate(percent)

    def links_of(rows: pa.Table):
        ids, root, block, bucket = (rows[c].to_numpy() for c in ("id", "root", "block", "bucket"))
        items = rows["items"].to_pylist()
        n = np.fromiter(map(len, items), np.int64, len(items)) // 8
        band = (bucket.view(np.uint64) & _BAND).astype(np.int64)
        same_block = rows["p"].to_numpy() == rows["q"].to_numpy()
        regs = np.frombuffer(b"".join(rows["regs"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
        starts = _edges(rows)[:-1]
        ends = np.repeat(np.append(starts[1:], len(ids)), np.diff(np.append(starts, len(ids))))
        after = ends - np.arange(len(ids)) - 1
        todo = np.cumsum(after)
        at = 0
        while at < len(ids):
            to = max(at + 1, int(np.searchsorted(todo, (todo[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
            left = np.repeat(np.arange(at, to), after[at:to])
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(after[at:to]) - after[at:to], after[at:to])
            small, large = np.minimum(n[left], n[right]), np.maximum(n[left], n[right])
            open_ = (root[left] != root[right]) & (100 * small >= percent * large)
            open_ &= same_block[left] | (block[left] != block[right])
            left, right = left[open_], right[open_]
            if len(left):
                agree = regs[left] == regs[right]
                first = agree.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1)
                good = (first == band[left]) & (estimates(agree.mean(axis=1), n[left], n[right]) >= least)
                pairs = zip(left[good].tolist(), right[good].tolist(), strict=True)
                found = np.array([(x, y) for x, y in pairs if similar(items[x], items[y], percent)], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(ids[found[:, 0]]), pa.array(ids[found[:, 1]])], names=["a", "b"])
            at = to

    def _edges(rows: pa.Table) -> np.ndarray:
        meeting = np.stack([rows[c].to_numpy() for c in key], axis=1)
        return np.append(np.flatnonzero(np.append(True, (meeting[1:] != meeting[:-1]).any(axis=1))), len(meeting))

    def run(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            if not rows.num_rows:
                continue
            last = int(_edges(rows)[-2])
            if last:
                yield from links_of(rows.slice(0, last).combine_chunks())
            held = rows.slice(last)
        if held is not None and held.num_rows:
            yield from links_of(held.combine_chunks())

    together = dealt.repartition(*key).sortWithinPartitions(*key)
    return together.select(*key, "block", "id", "root", "regs", "items").mapInArrow(run, "a long, b long")


def _class_components(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """id, root for the classes that are linked with another one."""
    bands = _bands(classes)
    shared = (
        bands.groupBy("bucket")
        .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("size"))
        .where("size > 1")
    )
    # Salted: a bucket of any size meets its smallest member in several tasks.
    part = F.pmod(F.xxhash64("id"), F.lit(BUCKET_PARTS)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(BUCKET_PARTS - 1)))
    met = bands.withColumn("part", part).join(shared.withColumn("part", every), ["bucket", "part"]).drop("part")
    members = stored(met.where("id <> first"), "bucket-members")
    stars = members.select(F.col("id").alias("a"), F.col("first").alias("b")).distinct()
    stars = stored(_promising(stars, classes, percent), "stars")
    sets = _full_sets(docs, classes, stars.select(F.explode(F.array("a", "b")).alias("id")), width)
    links = stored(_confirmed(stars, sets, percent), "links")
    roots = components(links)

    labelled = (
        members.where("size > 2").join(roots, "id", "left").select("bucket", "size", "id", F.coalesce("root", "id").alias("root"))
    )
    split = labelled.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    open_ = stored(labelled.join(split, "bucket", "left_semi"), "open-buckets")
    sets = _full_sets(docs, classes, open_.select("id"), width)
    known = sets.join(classes.select("id", "regs"), "id")
    more = stored(_met(open_.join(known, "id"), percent), "more-links")
    return components(links.union(more))


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, k1, k2 (keys of the text), stays.

    A document's set holds the distinct runs of ``width`` words (A-Z lower-cased, split at ASCII white
    space), or the whole sequence where there are fewer words. Documents whose sets have at least
    ``percent`` % of their union in common are linked; ``component_id`` is the smallest doc_id that
    links reach. A document without words, or with a null text, has an empty set, is linked with
    nothing and is its own component. Repeated rows are one class. A missing doc_id is larger than any
    other; where a component has no other, component_id is null. ``kept`` is doc_id = component_id,
    nulls being equal; ``stays`` marks the one (doc_id, text) of each component that survives a
    filter. An empty table gives an empty table.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sketches = stored(_sketches(docs, width), "sketches")
    classes = stored(
        sketches.where("n > 0")
        .groupBy("print")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k1", "k2")).alias("low"),
            F.first("n").alias("n"), F.first("regs").alias("regs"),
        )
        .select(F.monotonically_increasing_id().alias("id"), "print", "low", "low.k1", "low.k2", "n", "regs"),
        "classes",
    )
    roots = _class_components(docs, classes, width, percent)
    rooted = classes.select("id", "print", "low").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("lowest"))
    ids = rooted.join(lowest, "root").select("print", "lowest")
    own = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k1", "k2")
    lowest = F.coalesce(F.col("lowest"), own)
    return sketches.join(ids, "print", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), lowest["doc_id"].alias("component_id"),
        F.col("doc_id").eqNullSafe(lowest["doc_id"]).alias("kept"),
        "k1", "k2", own.eqNullSafe(lowest).alias("stays"),
    )


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component does; repeated rows stay once."""
    stay = near_duplicates(docs, width, percent).where("stays").select(
        F.coalesce("doc_id", F.lit(-1).cast("long")).alias("id"), F.col("doc_id").isNull().alias("no_id"), "k1", "k2"
    ).distinct()
    keyed = docs.select(
        common.others(docs, "doc_id", "text"), "doc_id", "text", *common.content_key("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")).alias("id"), F.col("doc_id").isNull().alias("no_id"),
    )
    key = ["id", "no_id", "k1", "k2"]
    kept = keyed.join(stay, key, "left_semi").dropDuplicates(key)
    return kept.select(*common.restored(kept, docs, "doc_id", "text"))


def op6_near_dup(spark, sf_dir):
    out = near_duplicates(common.table(spark, sf_dir, "documents"), width=4)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


QUERIES = {"op6_near_dup": op6_near_dup}
ORACLES = {}
