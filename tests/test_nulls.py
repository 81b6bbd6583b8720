"""One test per line of the missing-value algebra."""

import pytest
from pyspark.sql import functions as F

from stratapanel.functions import nulls as N


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame([(1, None, 2), (None, None, None), (None, 4, None)], "a int, b int, c int")


def test_row_totals(cells, rows):
    out = cells.select("b", N.rowtotal(["a", "b", "c"]).alias("t"), N.rowtotal_missing(["a", "b", "c"]).alias("m"))
    assert rows(out, "t", "m") == [(0, None), (3, 3), (4, 4)]


def test_group_sums(spark, rows):
    df = spark.createDataFrame([("x", None), ("x", None), ("y", None), ("y", 4), ("z", 1), ("z", 4)], "g string, v int")
    out = df.groupBy("g").agg(N.sum0("v").alias("s0"), N.sum_na("v").alias("sna"), F.max("v").alias("m"))
    assert rows(out) == [("x", 0, None, None), ("y", 4, None, 4), ("z", 5, 5, 4)]
    by_column = df.groupBy("g").agg(N.sum0(F.col("v")).alias("s0"))
    assert rows(by_column) == [("x", 0), ("y", 4), ("z", 5)]


def test_sum_na_where(spark, rows):
    df = spark.createDataFrame([(1, "a", 3), (1, "a", 4), (1, "b", None), (1, "b", 2), (2, "a", 1)], "i int, k string, v int")
    out = df.groupBy("i").agg(N.sum_na_where("k", "a", "v").alias("a"), N.sum_na_where("k", "b", "v").alias("b"))
    assert rows(out) == [(1, 7, None), (2, 1, None)]


def test_membership(spark, rows):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert rows(df.filter(N.in_("x", ["a"]))) == [("a",)]
    assert rows(df.filter(N.not_in("x", ["a"]))) == [(None,), ("b",)]
    assert rows(df.filter(N.not_in("x", ["a", None]))) == [("b",)]
    assert rows(df.filter(N.in_("x", [None]))) == [(None,)]
    assert df.filter(N.not_in("x", [])).count() == 3


def test_conditions(spark, rows):
    df = spark.createDataFrame([(1, -1), (2, 5), (3, None)], "k int, x int")
    out = df.select(
        "k", N.if_else(F.col("x") < 0, F.lit("neg"), F.lit("pos")).alias("i"),
        N.below("x", 0).alias("b"), N.differs("x", 5).alias("d"),
    )
    assert rows(out) == [(1, "neg", True, True), (2, "pos", False, False), (3, None, False, True)]


def test_ratio(spark, rows):
    df = spark.createDataFrame([(1, 2), (1, 0), (0, 0), (None, 2)], "a int, b int")
    assert rows(df.select(N.ratio("a", "b").alias("r"))) == [(None,), (None,), (None,), (0.5,)]
