import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.cutoff import most_frequent
from tidemark.session import stored

RNG = random.Random(7)
# Counts of all sizes, many ties, and keys that are prefixes of each other, empty, or beyond ASCII.
ROWS = [("a" * i, 1) for i in range(40)] + [(f"k{i}", RNG.choice([1, 2, 3, 900, 1023, 1024, 1025])) for i in range(400)]
ROWS += [(f"big{i}", RNG.randrange(1 << 20, 1 << 21)) for i in range(200)] + [("é", 1), ("\U0001f600", 1), ("￮", 1)]
ROWS += [(f"huge{i}", (1 << 62) + RNG.randrange(4)) for i in range(20)] + [("zero", 0)]


def brute(rows, n):
    return sorted(rows, key=lambda r: (-r[1], r[0].encode()))[:n]


@pytest.fixture(scope="module")
def table(spark):
    return stored(spark.createDataFrame(ROWS, "term string, cf bigint"), "cutoff-test")


@pytest.mark.parametrize("n", [0, 1, 15, 21, 150, 300, 430, 600, len(ROWS) - 30, len(ROWS) - 1, len(ROWS), 9_999])
@pytest.mark.parametrize("at_once", [1, 30, 100_000])
def test_equal_to_a_sort(table, n, at_once):
    got = table.filter(most_frequent(table, "cf", "term", n, at_once)).collect()
    assert sorted(map(tuple, got)) == sorted(brute(ROWS, n))


def test_empty_table(table):
    none = table.filter(F.lit(False))
    assert none.filter(most_frequent(none, "cf", "term", 5)).count() == 0


def test_one_count_for_all(spark):
    rows = [(f"{i:05d}", 1) for i in range(3_000)]
    df = stored(spark.createDataFrame(rows, "term string, cf bigint"), "cutoff-ties")
    got = df.filter(most_frequent(df, "cf", "term", 1_234, at_once=50)).collect()
    assert sorted(map(tuple, got)) == rows[:1_234]
