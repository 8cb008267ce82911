import hashlib

from pyspark.sql import functions as F

from tidemark.operators import selection


def rows(spark, n=1000):
    """One class holds more than half of all rows."""
    return spark.range(n).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 20 < 11, "a").when(F.col("id") % 20 < 16, "b").otherwise("c").alias("category"))


def digest(i, seed=42):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest()


def test_cutoffs_are_exact_ranks(spark):
    df = rows(spark)
    keys = df.select(F.col("category").alias("stratum"), selection.hash_key("doc_id", 42).alias("key"))
    by = {}
    for r in df.collect():
        by.setdefault(r["category"], []).append(digest(r["doc_id"]))
    wanted = [(c, k) for c, v in by.items() for k in (0, 1, 2, len(v) // 2, len(v) - 1, len(v))]
    for (c, k), cut in selection.cutoffs(keys, wanted).items():
        inside = [h for h in by[c] if cut and h[: len(cut)] <= cut]
        assert len(inside) == k and sorted(by[c])[:k] == sorted(inside)


def test_split_sizes_and_disjointness(spark):
    out = selection.stratified_split(rows(spark)).collect()
    sizes = {s: sum(r["split"] == s for r in out) for s in ("train", "validation", "test")}
    assert sizes == {"train": 722, "validation": 128, "test": 150}
    assert len({r["doc_id"] for r in out}) == 1000
    share = sum(r["category"] == "a" for r in out if r["split"] == "test") / 150
    assert 0.5 < share < 0.6
    again = {(r["doc_id"], r["split"]) for r in selection.stratified_split(rows(spark).repartition(3)).collect()}
    assert again == {(r["doc_id"], r["split"]) for r in out}


def test_samples_have_the_exact_size(spark):
    assert selection.stratified_sample(rows(spark), 201).count() == 201
    assert selection.stratified_sample(rows(spark), 5000).count() == 1000
    assert selection.random_sample(rows(spark), 77).count() == 77


def test_chronological_split_with_many_equal_times(spark):
    df = rows(spark).withColumn(
        "ts", F.when(F.col("doc_id") % 3 == 0, F.lit("2024-01-05 00:00:00"))
        .otherwise(F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit(" 10:00:00")))
        .cast("timestamp"))
    got = {r["doc_id"] for r in selection.chronological_split(df, 0.3).collect() if r["period"] == "baseline"}
    order = [r["doc_id"] for r in df.orderBy("ts", "doc_id").collect()]
    assert got == set(order[:700])


def test_quotas_use_the_largest_remainder():
    assert selection.quotas({"a": 5, "b": 3, "c": 2}, 7) == {"a": 4, "b": 2, "c": 1}
    assert sum(selection.quotas({"a": 1, "b": 1, "c": 1}, 2).values()) == 2


def test_dates_before_1970_and_missing_times_come_first(spark):
    rows = [(1, "1960-05-01 00:00:00"), (2, "1980-01-01 00:00:00"), (3, None), (-4, "1960-05-01 00:00:00"), (5, "2001-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "doc_id bigint, t string").withColumn("ts", F.col("t").cast("timestamp"))
    for ratio, early in ((0.75, {3}), (0.55, {3, -4}), (0.35, {3, -4, 1}), (0.15, {3, -4, 1, 2})):
        out = selection.chronological_split(df, ratio).collect()
        assert {r["doc_id"] for r in out if r["period"] == "baseline"} == early


def test_many_strata_as_tables_equal_few_on_the_driver(spark):
    """Names that begin other names, a null stratum, single rows and one that holds a third."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "big").when(
        F.col("id") % 97 == 1, None).otherwise(F.concat(F.lit("s"), (F.col("id") % 41).cast("string"), F.when(
            F.col("id") % 2 == 0, "!").otherwise(""))).alias("category"))
    for size in (0, 7, 500, 2999, 3000):
        few = {r["doc_id"] for r in selection.stratified_sample(df, size).collect()}
        many = {r["doc_id"] for r in selection.stratified_sample(df, size, max_strata=0).collect()}
        assert many == few and len(few) == size
    few = {tuple(r) for r in selection.stratified_split(df).collect()}
    assert {tuple(r) for r in selection.stratified_split(df, max_strata=0).collect()} == few and len(few) == 3000
    assert selection.stratified_sample(df.limit(0), 5, max_strata=0).count() == 0


def test_quota_table_equals_the_driver(spark):
    counts = {"a": 10**12, "ab": 3, "a!": 3, "": 1, "b": 3, "é": 10**12 + 7, "c": 1}
    table = spark.createDataFrame(list(counts.items()), "stratum string, count bigint")
    for total in (0, 1, 5, 12345, 10**12 + 3, sum(counts.values())):
        got = {r["stratum"]: r["quota"] for r in selection.quota_table(table, total).collect()}
        assert got == selection.quotas(counts, total)


def test_many_strata_give_exact_sizes(spark):
    df = spark.range(400_000).select(F.col("id").alias("doc_id"), F.when(
        F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 150_000).cast("string").alias("category"))
    got = selection.stratified_sample(df, 123_457).groupBy("category").count()
    assert got.agg(F.sum("count")).first()[0] == 123_457
    shares = df.groupBy("category").agg((F.count("*") * 123_457 / 400_000).alias("share"))
    off = shares.join(got, "category", "left").filter(
        F.abs(F.coalesce("count", F.lit(0)) - F.col("share")) >= 1).count()
    assert off == 0
    split = {r["split"]: r["count"] for r in selection.stratified_split(df).groupBy("split").count().collect()}
    assert split == {"train": 289_000, "validation": 51_000, "test": 60_000}
