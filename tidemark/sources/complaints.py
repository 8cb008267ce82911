"""Reading a complaint corpus and preparing it for training and reporting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.functions import lexicon
from tidemark.functions.text import is_blank, with_clean_text
from tidemark.policy.labels import CATEGORY_BY_PRODUCT
from tidemark.session import stored

CSV_SCHEMA = T.StructType([
    T.StructField("product", T.StringType()),
    T.StructField("narrative", T.StringType()),
])

# Columns beside those of the file while it is parsed.
_RECORD, _FILE = "_record", "_file"


def read_csv(spark: SparkSession, path: str, schema: T.StructType = CSV_SCHEMA) -> DataFrame:
    """Complaint CSV with a header; quoted narratives may span lines.

    A missing path raises Spark's own ``PATH_NOT_FOUND``.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("enforceSchema", False)
        .csv(path)
    )


def read_all(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    header: bool = True,
    multi_line: bool = True,
    line_sep: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Every column of a CSV, and the records that do not fit: ``good`` and ``rejected``.

    ``good`` has the columns of ``schema``; ``rejected`` has ``file``, ``record`` (its text as it stands in the file) and
    ``reason``: "columns" for another number of fields, "values" for a field that is not of its type. Each record
    is in exactly one of them. A quoted empty field is an empty string, an unquoted one null; blank lines are no
    records; a quote that is never closed takes the rest of its file into one record. The parsed files are stored,
    so that they are read once, whatever is asked of the two tables. A file of records that span lines is read by
    one task; without such records set ``multi_line`` to False, and Spark splits files.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _RECORD, "quote": '"', "escape": '"',
               "nullValue": "\u0000", "header": header, "multiLine": multi_line}
    if line_sep is not None:
        options["lineSep"] = line_sep
    kept = T.StructType([*schema.fields, T.StructField(_RECORD, T.StringType())])
    rows = spark.read.schema(kept).options(**options).csv(path)
    rows = stored(rows.withColumn(_FILE, F.col("_metadata.file_path")), "parsed-csv")
    good = rows.filter(F.col(_RECORD).isNull()).drop(_RECORD, _FILE)
    # Fields of any type tell a wrong number of them from a wrong value.
    text = ", ".join(f"`{f.name}` string" for f in kept.fields)
    again = F.from_csv(_RECORD, text, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _RECORD, "quote": '"', "escape": '"'})
    wrong = F.when(again[_RECORD].isNotNull(), "columns").otherwise("values")
    rejected = rows.filter(F.col(_RECORD).isNotNull()).select(
        F.col(_FILE).alias("file"), F.col(_RECORD).alias("record"), wrong.alias("reason"))
    return good, rejected


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quote", '"').option(
        "escape", '"').option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(path)


def category_of(product: str = "product", mapping: dict = CATEGORY_BY_PRODUCT):
    """Category name of a product code; null for an unknown or missing code."""
    return F.try_element_at(lexicon.literal(mapping, "map<string,string>"), F.col(product))


def labelled(df: DataFrame, mapping: dict = CATEGORY_BY_PRODUCT) -> DataFrame:
    """Rows with a narrative and a known product; adds ``category``.

    This is the portfolio view: blank narratives stay.
    """
    return (
        df.dropna(subset=["narrative", "product"])
        .filter(F.col("product").isin(list(mapping)))
        .withColumn("category", category_of("product", mapping))
    )


def corpus(df: DataFrame, clean: bool = False, mapping: dict = CATEGORY_BY_PRODUCT) -> DataFrame:
    """Training corpus: ``text`` and ``category`` of labelled rows that are not blank."""
    out = (
        labelled(df, mapping)
        .withColumn("text", F.col("narrative").cast("string"))
        .filter(~is_blank("text"))
    )
    if clean:
        out = with_clean_text(out, "text", "text").filter(F.col("text") != "")
    return out.drop("narrative", "product")
