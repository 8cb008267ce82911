"""The n most frequent rows of a stored table, by a cut-off that is counted and not sorted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Counts below this have a step of their own in the first histogram; larger ones share 512 steps per power of two.
STEPS = 1_024
#: Rows that one task may sort to settle the rest.
AT_ONCE = 100_000


def _border(rows: DataFrame, step: Column, need: int, descending: bool) -> tuple:
    """The step in which the ``need``-th row lies, how many are needed of it, and how many it has."""
    found = sorted(((r["step"], r["n"]) for r in rows.groupBy(step.alias("step")).agg(
        F.count("*").alias("n")).collect()), reverse=descending)
    for value, n in found:
        if need <= n:
            return value, need, n
        need -= n
    return None, need, 0


def most_frequent(rows: DataFrame, count: str, key: str, n: int, at_once: int = AT_ONCE) -> Column:
    """Condition that the n rows of highest ``count`` meet, ties by the smaller ``key``.

    ``rows`` should be a stored table, as it is passed over a few times, two narrow columns at most;
    ``count`` is not negative and ``key`` is a string that names one row, neither is null. Histograms of at most some
    30,000 steps find the border count; among rows of that count the border key is found letter by letter. No
    task gets more than ``at_once`` rows to sort, however many there are and however many tie. With n rows or
    fewer every row meets the condition, with n = 0 none.
    """
    if n <= 0:
        return F.lit(False)
    bits = F.length(F.bin(F.col(count)))
    shift = F.greatest(bits - 10, F.lit(0)).cast("int")
    step = shift.cast("long") * 2 * STEPS + F.call_function("shiftright", F.col(count).cast("long"), shift)
    border, need, size = _border(rows, step, n, descending=True)
    if border is None:
        return F.lit(True)
    # A step holds the counts from low on, width of them.
    width = 1 << (border // (2 * STEPS)) if border >= 2 * STEPS else 1
    low = border % (2 * STEPS) * width if width > 1 else border
    inside = F.col(count).between(low, low + width - 1)
    while size > at_once and width > 1:
        finer = max(1, width // STEPS)
        border, need, size = _border(
            rows.filter(inside), F.floor((F.col(count) - low) / finer), need, descending=True)
        low, width = low + border * finer, finer
        inside = F.col(count).between(low, low + width - 1)
    prefix = ""
    while size > at_once:
        start = F.substring(key, 1, len(prefix) + 1)
        longer, need, size = _border(rows.filter(inside), start, need, descending=False)
        inside = inside & (start == longer)
        if len(longer) == len(prefix):
            break  # The key ends here.
        prefix = longer
    last = rows.filter(inside).select(count, key).orderBy(F.desc(count), F.asc(key)).offset(need - 1).first()
    return (F.col(count) > last[0]) | ((F.col(count) == last[0]) & (F.col(key) <= last[1]))
