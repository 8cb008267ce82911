"""From raw documents to a training mix: five stages, each written as a table and read by the next.

Stages take any further columns along; one that has the name of a column that an operator makes is replaced. Null and
empty texts have no lines to drop, no shingles and no benchmark words, so only the classifier and the mix decide
about them. Rows that repeat each other are near duplicates if they have a word: one stays. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import common, decontaminate, line_dedup, mixing, near_dup, quality
from tidemark.session import stored


#: Parts into which the rows of one text are spread.
TEXT_PARTS = 16


def drop_poor_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels outside the held-out part."""
    model = quality.fit_known(docs, common.table(spark, sf_dir, "labels"))
    good = quality.score(docs, model).where(F.col("score") >= quality.THRESHOLD)
    return good.select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many share; n_chars follows the text."""
    out = line_dedup.drop_repeated_lines(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return near_dup.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    found = decontaminate.contamination(docs, common.table(spark, sf_dir, "benchmark"))
    hit = stored(found.where("n_hit > 0").select("k1", "k2"), "contaminated-texts")
    keyed = docs.select(common.others(docs, "text"), "text", *common.content_key("text"))
    # Salted: the rows of one text, however many, are spread over several tasks.
    keyed = keyed.withColumn("part", F.pmod(F.xxhash64(F.col("rest")["doc_id"]), F.lit(TEXT_PARTS)))
    every = hit.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(TEXT_PARTS - 1).cast("long"))))
    clean = keyed.join(every, ["k1", "k2", "part"], "left_anti")
    return clean.select(*common.restored(clean, docs, "text"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample that follows the target weights of sources, languages and length classes."""
    out = mixing.mixed(docs).where("kept")
    return out.select(*docs.columns, F.col("probability").alias("sample_probability"))


STAGES = [
    ("quality", drop_poor_documents),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]

#: SQL cannot express the classifier; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
