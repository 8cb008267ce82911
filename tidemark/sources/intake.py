"""Complaint corpora derived from the generic test tables.

``documents`` holds invented prose without any finance term, so a narrative is a
fixed opening phrase, chosen by the document's source, followed by the whole
document text. The phrase table has one row per source and is joined by
broadcast; a document of another source keeps its text alone. Two narratives
of their own, a brief and a blank one, stand beside the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Source -> (product code, opening phrase).
PHRASES = {
    "src0": ("retail_banking", "I noticed an unauthorized wire transfer of $7,500 from my checking account. My account is now frozen and my attorney will sue. Call 123-456-7890!!"),
    "src1": ("debt_collection", "A collection agency keeps calling about a debt I already paid, threatening wage garnishment under FDCPA. E-mail me at jane.roe@example.com."),
    "src2": ("credit_reporting", "The bureau failed to remove an inaccurate tradeline on XX/XX/XXXX after my dispute; still no response for months."),
    "src3": ("credit_card", "<p>My credit card 4111 2222 3333 4444 was charged twice, see https://bank.example.com/dispute for details</p>"),
    "src4": ("mortgages_and_loans", "My mortgage servicer misapplied the escrow payment and foreclosure was started. My SSN is 123-45-6789."),
    "src5": ("retail_banking", "Overdraft fee and monthly fee charged on my checking account statement by the branch."),
    "src6": ("credit_card", "The annual fee and late fee on the interest rate of my credit card are wrong."),
    "src7": ("credit_reporting", "Identity theft: fraudulent hard inquiry on my credit report, police report attached, urgent."),
    "src8": ("mortgages_and_loans", "I asked for a loan modification and refinance and my lender keeps asking for the same documents."),
    "src9": ("debt_collection", "Please send a validation letter with proof of debt from the original creditor."),
    "src10": ("credit_card", "The pizza was cold and the waiter forgot my meal order."),
    "src11": ("retail_banking", "My graphics card fan makes clicking noises and there is no refund on my account."),
    "src12": ("credit_card", "bad day"),
    "src13": ("credit_reporting", "   "),
    "src14": ("unknown_product", "My payday loan was refused by the lender without reason."),
    "src15": (None, "Wire transfer fee was charged by my bank on a savings account."),
    "src16": ("retail_banking", "I am locked out and cannot access my savings, this is an emergency and I sent multiple times the same form."),
    "src17": ("debt_collection", "Urgent: the collector ignored my cease and desist, threatened arrest and my retirement and life savings are gone through fraud, still not resolved."),
    "src18": ("mortgages_and_loans", "Repossession of my auto loan car after numerous identity-theft reports, thousands lost to a scam."),
    "src19": ("credit_reporting", "Equifax reporting shows a bankruptcy judgment that is not mine after several attempts to correct it."),
}

# Id, narrative and product code of the rows beside the documents.
SHORT = [(9_000_000_000_001, "bad day", "credit_card"), (9_000_000_000_002, "   ", "credit_reporting")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Spreads a scan that yields fewer tasks than there are cores.

    A small table sits in one row group, hence in one task. A large table has
    many and is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, narrative, product`` of every document and of the short rows."""
    phrases = spark.createDataFrame(
        [(s, p, t) for s, (p, t) in PHRASES.items()], "source string, product string, phrase string")
    short = spark.createDataFrame(SHORT, "doc_id bigint, narrative string, product string")
    return (
        spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
        .join(F.broadcast(phrases), "source", "left")
        .select("doc_id", F.concat_ws(" ", "phrase", "text").alias("narrative"), "product")
        .unionByName(short)
    )


def timed_complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complaints with the arrival time of the last of their ten events, where there are any."""
    arrivals = table(spark, sf_dir, "events").groupBy(
        F.expr("event_id div 10").alias("doc_id")).agg(F.max("ts").alias("ts"))
    return complaints(spark, sf_dir).join(arrivals, "doc_id", "left")
