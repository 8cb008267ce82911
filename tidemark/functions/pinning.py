"""Computing costly columns once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def pin(df: DataFrame, *names: str) -> DataFrame:
    """The same rows; later filters on these columns read them instead of recomputing them.

    A filter moves below a projection by copying the projected expression into
    itself, which for a chain of text steps multiplies the work with every step.
    It does not move below a generator, and a generator over one struct is free.
    """
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, F.inline(F.array(F.struct(*names)))).select(*df.columns)


def unnest(df: DataFrame, keep: list, array, name: str) -> DataFrame:
    """One row per non-null array element.

    A plain ``explode`` makes the optimizer add a filter on the array's size, for
    which it computes the array a second time; the outer form does not.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())
