"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.session import stored


def components(links: DataFrame) -> DataFrame:
    """id, root (the smallest id reachable) of every id in ``links`` (a, b: long).

    Each round lets a node point to its smallest neighbour, shortens these pointers, and replaces both
    ends of every link by where they point. A star, however large, is done after one round, and the
    links shrink at least by half in each; the smallest id of a component never moves.
    """
    labels = None
    links = stored(links.select("a", "b").where("a <> b"), "links")
    while True:
        both = links.union(links.select("b", "a"))
        parent = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("up"))
        for _ in range(2):
            above = parent.select(F.col("id").alias("up"), F.col("up").alias("top"))
            parent = parent.join(above, "up", "left").select("id", F.coalesce("top", "up").alias("up"))
        parent = stored(parent, "parents")
        if labels is None:
            labels = parent.select("id", F.col("up").alias("root"))
        else:
            step = parent.select(F.col("id").alias("root"), "up")
            labels = labels.join(step, "root", "left").select("id", F.coalesce("up", "root").alias("root"))
            labels = stored(labels, "labels")
        ends = [parent.select(F.col("id").alias(c), F.col("up").alias(f"{c}_up")) for c in "ab"]
        moved = links.join(ends[0], "a").join(ends[1], "b").where("a_up <> b_up")
        links = stored(moved.select(F.col("a_up").alias("a"), F.col("b_up").alias("b")).distinct(), "links")
        if links.isEmpty():
            return labels
