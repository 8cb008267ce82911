"""Size checks for what is broadcast or brought to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BROADCAST_ROWS = 2_000_000
DRIVER_ROWS = 100_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hints a broadcast only after counting the rows; otherwise leaves the join to Spark,
    which shuffles it and splits skewed partitions at run time."""
    few = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if few else df


def collect_bounded(df: DataFrame, max_rows: int = DRIVER_ROWS) -> list:
    """Rows of a table that is small by construction; refuses anything larger."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows were about to be collected")
    return rows
