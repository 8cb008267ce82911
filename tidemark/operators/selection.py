"""Exact ranks at scale: samples and splits of an exact size without a global sort.

A row's place is decided by a fixed-width text key (a hash for random order, an
encoded time for chronological order). The key at a wanted rank is found by
counting key prefixes, a few hex digits at a time: every pass is one narrow
aggregation whose result is bounded by the number of prefixes, and the hottest
stratum is counted map-side like any other. The rows themselves are then only
compared with the cut-off key and never shuffled.

Quotas and cut-offs of up to ``DRIVER_ROWS`` strata are worked out on the driver; those of more are tables, made by
the same rules with joins. Null is a stratum like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.sizing import DRIVER_ROWS, broadcast_if_small
from tidemark.session import stored

DIGITS_PER_PASS = 4
LOWEST = -(1 << 63)


def hash_key(row_id: Column | str, seed: int) -> Column:
    """Reproducible random order: a pure function of seed and id."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id) if isinstance(row_id, str) else row_id))


def time_key(ts: Column | str, row_id: Column | str) -> Column:
    """Chronological order, earlier id first on a tie; rows without a time come first."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    row_id = F.col(row_id) if isinstance(row_id, str) else row_id
    micros = F.coalesce(F.unix_micros(ts.cast("timestamp")), F.lit(LOWEST))

    def ordered(n):
        # Flipping the sign bit puts negative numbers first in the order of the digits.
        return F.lpad(F.hex(n.bitwiseXOR(F.lit(LOWEST))), 16, "0")

    return F.concat(ordered(micros), ordered(row_id.cast("bigint")))


def cutoffs(keys: DataFrame, wanted: list[tuple[str, int]]) -> dict[tuple[str, int], str]:
    """For each (stratum, rank): a key prefix such that exactly ``rank`` keys of the stratum
    are not beyond it. ``keys`` has the columns ``stratum`` and ``key``, keys being unique.
    """
    spark = keys.sparkSession
    found = {(s, r): "" for s, r in wanted if r <= 0}
    open_ = [(s, r, "", r) for s, r in wanted if r > 0]
    depth = 0
    while open_:
        active = F.broadcast(spark.createDataFrame(open_, _OPEN))
        rows = keys.join(_prefixes(active), _within(keys, depth), "left_semi")
        open_ = []
        for h in _hits(_bins(rows, depth), active).collect():
            if h["exact"]:
                found[(h["stratum"], h["rank"])] = h["bin"]
            else:
                open_.append((h["stratum"], h["rank"], h["bin"], h["left"]))
        depth += DIGITS_PER_PASS
    return found


def cutoff_table(keys: DataFrame, wanted: DataFrame) -> DataFrame:
    """``cutoffs`` for a table of (stratum, rank) of any length: ``stratum, rank, cut``.

    Keys are counted by bin before they meet the open ranks, so a stratum of any size sends at most 65,536
    counts of a prefix.
    """
    found = wanted.filter("rank <= 0").select("stratum", "rank", F.lit("").alias("cut"))
    open_ = wanted.filter("rank > 0").select(
        "stratum", "rank", F.lit("").alias("prefix"), F.col("rank").alias("remaining"))
    depth = 0
    while not open_.isEmpty():
        hits = stored(_hits(_bins(keys, depth), broadcast_if_small(open_)), "rank-hits")
        found = found.unionByName(hits.filter("exact").select("stratum", "rank", F.col("bin").alias("cut")))
        open_ = hits.filter("NOT exact").select(
            "stratum", "rank", F.col("bin").alias("prefix"), F.col("left").alias("remaining"))
        depth += DIGITS_PER_PASS
    return found


_OPEN = "stratum string, rank bigint, prefix string, remaining bigint"


def _prefixes(active: DataFrame) -> DataFrame:
    return F.broadcast(active.select(F.col("stratum").alias("_s"), F.col("prefix").alias("_p")).distinct())


def _within(keys: DataFrame, depth: int) -> Column:
    return (keys["stratum"] == F.col("_s")) & (F.substring(keys["key"], 1, depth) == F.col("_p"))


def _bins(keys: DataFrame, depth: int) -> DataFrame:
    """Keys per stratum, prefix of ``depth`` digits and the digits of this pass."""
    return keys.groupBy("stratum", F.substring("key", 1, depth).alias("prefix"),
                        F.substring("key", 1, depth + DIGITS_PER_PASS).alias("bin")).count()


def _hits(bins: DataFrame, active: DataFrame) -> DataFrame:
    """The bin that holds each open rank, whether it ends there, and what is left to find within it."""
    running = bins.withColumn(
        "upto", F.sum("count").over(Window.partitionBy("stratum", "prefix").orderBy("bin")))
    return running.join(active, ["stratum", "prefix"]).filter(
        (F.col("upto") >= F.col("remaining")) & (F.col("upto") - F.col("count") < F.col("remaining"))
    ).select("stratum", "rank", "bin",
             ((F.col("upto") == F.col("remaining")) | (F.col("bin") == F.col("prefix"))).alias("exact"),
             (F.col("remaining") - F.col("upto") + F.col("count")).alias("left"))


def not_beyond(key: Column | str, cutoff: Column) -> Column:
    """Is the key within the cut-off; an empty cut-off admits nothing."""
    key = F.col(key) if isinstance(key, str) else key
    return (F.length(cutoff) > 0) & (F.substr(key, F.lit(1), F.length(cutoff)) <= cutoff)


def quotas(counts: dict[str, int], total: int) -> dict[str, int]:
    """Proportional shares of ``total`` as whole numbers, by largest remainder, name on a tie."""
    n = sum(counts.values())
    if n == 0:
        return {c: 0 for c in counts}
    out = {c: k * total // n for c, k in counts.items()}
    by_remainder = sorted(counts, key=lambda c: (-(counts[c] * total % n), c))
    for c in by_remainder[: total - sum(out.values())]:
        out[c] += 1
    return out


def quota_table(counts: DataFrame, total: int) -> DataFrame:
    """``quotas`` for a table of (stratum, count) of any length: ``stratum, count`` and ``quota``.

    The strata that get one more are those up to a cut-off key of remainder and name, found by counting.
    """
    n = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    if n == 0:
        return counts.withColumn("quota", F.lit(0).cast("bigint"))
    product = F.col("count").cast("decimal(19,0)") * F.lit(total).cast("decimal(19,0)")
    whole = F.expr(f"(CAST(count AS DECIMAL(19,0)) * CAST({total} AS DECIMAL(19,0))) DIV CAST({n} AS DECIMAL(19,0))")
    shares = counts.withColumn("_whole", whole).withColumn(
        "_rest", (product - F.col("_whole") * F.lit(n).cast("decimal(19,0)")).cast("bigint"))
    # A final sign below all digits keeps a name apart from those that it begins.
    order = F.concat(F.lpad(F.hex(F.lit(n - 1) - F.col("_rest")), len(f"{n:x}"), "0"), F.hex("stratum"), F.lit("!"))
    shares = stored(shares.withColumn("_order", order), "shares")
    more = total - shares.agg(F.sum("_whole")).first()[0]
    cut = cutoffs(shares.select(F.lit("all").alias("stratum"), F.col("_order").alias("key")),
                  [("all", more)])[("all", more)]
    return shares.select("stratum", "count", (
        F.col("_whole") + not_beyond("_order", F.lit(cut)).cast("bigint")).alias("quota"))


def _named(stratum: str) -> Column:
    """The stratum as text that keeps the order of names; null comes first."""
    return F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit(""))


def _keyed(df: DataFrame, stratum: str, row_id: str, seed: int) -> DataFrame:
    return df.select(_named(stratum).alias("stratum"), hash_key(row_id, seed).alias("key"))


def _strata(keys: DataFrame, max_strata: int) -> tuple[dict[str, int] | None, DataFrame]:
    """The rows of each stratum, on the driver if the strata are few, and as a table."""
    counts = keys.groupBy("stratum").count()
    few = counts.limit(max_strata + 1).collect()
    if len(few) <= max_strata:
        return {r["stratum"]: r["count"] for r in few}, counts
    return None, stored(counts, "strata")


def _cut(df: DataFrame, stratum: str, table: DataFrame) -> DataFrame:
    """``df`` beside the cut-offs of its strata."""
    return df.withColumn("_stratum", _named(stratum)).join(
        broadcast_if_small(table.withColumnRenamed("stratum", "_stratum")), "_stratum")


def stratified_sample(
    df: DataFrame, size: int, stratum: str = "category", row_id: str = "doc_id", seed: int = 42,
    max_strata: int = DRIVER_ROWS,
) -> DataFrame:
    """Exactly ``size`` rows with the class shares of the whole; all rows if there are no more."""
    keys = _keyed(df, stratum, row_id, seed)
    counts, strata = _strata(keys, max_strata)
    if counts is not None:
        if size >= sum(counts.values()):
            return df
        wanted = quotas(counts, size)
        cuts = cutoffs(keys, list(wanted.items()))
        table = df.sparkSession.createDataFrame(
            [(s, cuts[(s, r)]) for s, r in wanted.items()], "stratum string, _cut string")
    else:
        if size >= strata.agg(F.sum("count")).first()[0]:
            return df
        wanted = quota_table(strata, size).select("stratum", F.col("quota").alias("rank"))
        table = cutoff_table(keys, stored(wanted, "quotas")).select("stratum", F.col("cut").alias("_cut"))
    return _cut(df, stratum, table).filter(
        not_beyond(hash_key(row_id, seed), F.col("_cut"))).select(*df.columns)


def random_sample(df: DataFrame, size: int, row_id: str = "doc_id", seed: int = 42) -> DataFrame:
    """Exactly ``min(size, rows)`` rows, whatever their class."""
    return stratified_sample(
        df.withColumn("_all", F.lit("all")), size, "_all", row_id, seed
    ).drop("_all")


def stratified_split(
    df: DataFrame,
    stratum: str = "category",
    row_id: str = "doc_id",
    test_ratio: float = 0.15,
    validation_ratio: float = 0.15,
    seed: int = 42,
    max_strata: int = DRIVER_ROWS,
) -> DataFrame:
    """Adds ``split``: test first, then validation as a share of the remainder, rest train."""
    keys = _keyed(df, stratum, row_id, seed)
    counts, strata = _strata(keys, max_strata)
    n = sum(counts.values()) if counts is not None else strata.agg(F.sum("count")).first()[0]
    fit_n = n - _ceil(test_ratio * n)
    train_n = fit_n - _ceil(validation_ratio * fit_n)
    if counts is not None:
        fit = quotas(counts, fit_n)
        train = quotas(fit, train_n)
        cuts = cutoffs(keys, list({(s, r) for q in (fit, train) for s, r in q.items()}))
        table = df.sparkSession.createDataFrame(
            [(s, cuts[(s, train[s])], cuts[(s, fit[s])]) for s in counts],
            "stratum string, _train string, _fit string")
    else:
        fit = stored(quota_table(strata, fit_n).select("stratum", F.col("quota").alias("count")), "fit-quotas")
        both = stored(quota_table(fit, train_n).withColumnRenamed("count", "fit"), "train-quotas")
        ranks = both.select("stratum", F.col("fit").alias("rank")).union(both.select("stratum", "quota")).distinct()
        cuts = stored(cutoff_table(keys, ranks), "cut-offs")
        table = both.join(cuts.select("stratum", F.col("rank").alias("fit"), F.col("cut").alias("_fit")),
                          ["stratum", "fit"]).join(
            cuts.select("stratum", F.col("rank").alias("quota"), F.col("cut").alias("_train")),
            ["stratum", "quota"]).select("stratum", "_train", "_fit")
    key = hash_key(row_id, seed)
    return (
        _cut(df, stratum, table)
        .withColumn(
            "split",
            F.when(not_beyond(key, F.col("_train")), "train")
            .when(not_beyond(key, F.col("_fit")), "validation")
            .otherwise("test"),
        )
        .select(*df.columns, "split")
    )


def chronological_split(
    df: DataFrame, ratio: float = 0.5, ts: str = "ts", row_id: str = "doc_id"
) -> DataFrame:
    """Adds ``period``: the first ``int(n * (1 - ratio))`` rows in time order are the baseline."""
    # Stored: the cut-off passes over the keys several times, and not over what the rows are made from.
    keys = stored(df.select(F.lit("all").alias("stratum"), time_key(ts, row_id).alias("key")), "time-keys")
    rank = int(keys.count() * (1.0 - ratio))
    cut = cutoffs(keys, [("all", rank)])[("all", rank)]
    return df.withColumn(
        "period",
        F.when(not_beyond(time_key(ts, row_id), F.lit(cut)), "baseline").otherwise("recent"),
    )


def _ceil(x: float) -> int:
    import math

    return math.ceil(round(x, 9))
