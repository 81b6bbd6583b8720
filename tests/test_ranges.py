"""Running totals over ranges: as many ranges as the values ask for, the same numbers at any of them."""

import pytest
from pyspark.sql import functions as F

from stratapanel.operators import columns as K
from stratapanel.operators import ranges, rollup


@pytest.mark.parametrize("each", [10**7, 70_000, 999])
def test_the_number_of_ranges_follows_from_the_rows(spark, monkeypatch, each):
    monkeypatch.setattr(ranges, "RANGE_ROWS", each)
    values = spark.range(0, 20_000).select((F.col("id") * 7919 % 20_011).alias("v"), (F.col("id") % 3 + 1).alias("n"))
    cut = ranges.ranged(values, "v")
    assert cut.select("_range").distinct().count() == min(-(-20_000 // each), 20_000)
    order = cut.groupBy("_range").agg(F.min("v").alias("low"), F.max("v").alias("high")).orderBy("_range").collect()
    assert all(a.high < b.low for a, b in zip(order, order[1:], strict=False))
    got = {r.v: (r.sum, r.all) for r in ranges.running(values, "v", "n", "sum", "all").collect()}
    total, want = 0, {}
    rows = sorted((r.v, r.n) for r in values.collect())
    for v, n in rows:
        total += n
        want[v] = total
    assert got == {v: (s, total) for v, s in want.items()}


def test_codes_of_a_million_texts(spark, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE_ROWS", 50_000)
    many = spark.range(0, 1_000_000).select("id", F.format_string("%07d", "id").alias("x"))
    coded = K.encode(many.repartition(7), "x", "code")
    assert coded.filter("code <> id + 1").count() == 0 and coded.count() == 1_000_000


def test_empty_and_single_values(spark):
    none = spark.createDataFrame([], "y int")
    assert rollup.tabulate(none, "y").collect() == []
    assert [tuple(r) for r in rollup.tabulate(spark.createDataFrame([(3,), (None,)], "y int"), "y").collect()] == [(3, 1, 100.0, 100.0)]
