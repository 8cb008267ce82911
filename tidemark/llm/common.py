"""What several operators here share: content keys, word hashes, a bitmap of fixed size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

SPACE = b" \t\n\x0b\x0c\r"

#: Bits of a bitmap; it is sent to every executor and never grows.
BITMAP_BITS = 1 << 24


def content_key(*columns) -> list[Column]:
    """Two hashes that name a row by its content; they are never null and survive any replanning."""
    return [
        F.xxhash64(F.lit(1), *columns).alias("k1"),
        F.xxhash64(F.lit(2), *columns).alias("k2"),
    ]


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def others(df: DataFrame, *used: str) -> Column:
    """All columns but those named, as one struct, so that no name can clash with a working column."""
    rest = [c for c in df.columns if c not in used]
    fields = [F.col(f"`{c}`").alias(c) for c in rest] or [F.lit(None).cast("int").alias("nothing")]
    return F.struct(*fields).alias("rest")


def restored(df: DataFrame, like: DataFrame, *used: str, **made: Column) -> list[Column]:
    """The columns of ``like`` in their order, then those made here; a made column replaces its namesake."""
    kept = [
        made.pop(c).alias(c) if c in made
        else (F.col(c) if c in used else F.col("rest")[c]).alias(c)
        for c in like.columns
    ]
    return [*kept, *(column.alias(name) for name, column in made.items())]


def as_bytes(column: pa.Array) -> list:
    """The texts of an Arrow column as UTF-8 bytes, None for null."""
    return column.cast(pa.binary()).to_pylist()


def word_hashes(words: list) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (the finishing step of a splitmix generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = words[:n].copy()
    for i in range(1, width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
    return mix(total)


def digests(values: list) -> np.ndarray:
    """128-bit hashes of byte strings as two signed columns."""
    raw = b"".join(xxhash.xxh3_128_digest(v) for v in values)
    return np.frombuffer(raw, np.int64).reshape(-1, 2)


def bitmap(df: DataFrame, h1: str, h2: str) -> np.ndarray:
    """A Bloom filter of two hash columns. Its size is fixed, so it may be broadcast at any scale:
    more rows only let more candidates through to the exact join that follows."""
    bit = F.explode(F.array(*(F.col(h).bitwiseAND(BITMAP_BITS - 1) for h in (h1, h2)))).alias("bit")
    words = (
        df.select(bit)
        .groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
        .toArrow()
    )
    out = np.zeros(BITMAP_BITS // 64, np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def in_bitmap(bits: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Positions of the rows whose two hashes the bitmap may hold."""

    def held(h):
        at = h.view(np.uint64) & np.uint64(BITMAP_BITS - 1)
        return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1

    first = np.flatnonzero(held(h1))
    return first[held(h2[first])]
