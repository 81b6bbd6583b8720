"""Merges, roll-ups and reshapes against hand-computed results and general laws."""

import pytest
from pyspark.sql import functions as F

from stratapanel.operators import merge as G
from stratapanel.operators import quality, reshape, rollup
from stratapanel.plans import waves


def frame(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def test_left_value_wins(spark, rows):
    left = frame(spark, "k string, x int", ("k1", None))
    right = frame(spark, "k string, x int", ("k1", 5), ("k2", 6))
    assert rows(G.merge_one([left, right], ["k"], "_merge")) == [("k1", None, 3), ("k2", 6, 2)]
    assert rows(G.merge_one([left, right], ["k"], keep=["both"])) == [("k1", None)]
    assert rows(G.merge_one([left, right], ["k"], keep=["right"])) == [("k2", 6)]
    assert rows(G.merge_many(left, right, ["k"], "_merge")) == [("k1", None, 3), ("k2", 6, 2)]


def test_chain_equals_steps(spark, rows):
    a = frame(spark, "k int, x int", (1, None), (2, 20))
    b = frame(spark, "k int, x int, y int", (1, 11, 12), (3, 31, 32))
    c = frame(spark, "k int, y int, x int", (1, 99, 99), (2, 98, 97), (3, 96, 95), (4, 94, 93))
    stepwise = G.merge_one([G.merge_one([a, b], ["k"]), c], ["k"])
    at_once = G.merge_one([a, b, c], ["k"])
    assert rows(at_once, "k", "x", "y") == rows(stepwise, "k", "x", "y")
    assert rows(at_once, "k", "x", "y") == [(1, None, 12), (2, 20, None), (3, 31, 32), (4, 93, 94)]


def test_null_keys_match(spark, rows):
    left = frame(spark, "a string, b int, l int", (None, 1, 10), ("x", None, 20))
    right = frame(spark, "a string, b int, r int", (None, 1, 11), ("x", 2, 21))
    assert rows(G.merge_one([left, right], ["a", "b"]), "l", "r") == [(None, 21), (10, 11), (20, None)]
    assert rows(G.merge_many(left, right, ["a", "b"], keep=["both"]), "l", "r") == [(10, 11)]
    assert G.merge_many(left, right, ["a", "b"], null_keys_match=False, keep=["both"]).count() == 0


def test_repeated_keys_fail(spark):
    once = frame(spark, "k int, x int", (1, 1))
    twice = frame(spark, "k int, y int", (1, 1), (1, 2), (2, 3))
    with pytest.raises(Exception, match="not unique on k: 1"):
        G.merge_one([once, twice], ["k"]).collect()
    with pytest.raises(Exception, match="not unique on k: 1"):
        G.merge_one([twice, once], ["k"]).count()
    with pytest.raises(Exception, match="not unique on k: 1"):
        G.merge_many(once, twice, ["k"]).collect()
    assert G.merge_many(twice, once, ["k"], keep=["both"]).count() == 2


def test_merge_row_law(spark, rows):
    left = spark.range(0, 100, 3).withColumnRenamed("id", "k").withColumn("a", F.lit(1))
    right = spark.range(0, 100, 5).withColumnRenamed("id", "k").withColumn("b", F.lit(2))
    merged = G.merge_one([left, right], ["k"], "_merge")
    counts = dict(rows(G.merge_report(merged)))
    assert counts == {1: 27, 2: 13, 3: 7}
    assert merged.count() == 34 + 20 - 7
    many = G.merge_many(left.unionByName(left), right, ["k"], "_merge")
    assert dict(rows(G.merge_report(many))) == {1: 54, 2: 13, 3: 14}
    assert G.merge_many(left, right, ["k"], keep=["left"]).count() == 27
    assert G.merge_many(left, right, ["k"], keep=["right"]).columns == ["k", "a", "b"]


def test_merge_shuffles_each_table_once(spark):
    tables = [spark.range(1000).select((F.col("id") + i).alias("k"), F.lit(i).alias(f"v{i}")) for i in range(4)]
    plan = G.merge_one(tables, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_stack_panel(spark, rows):
    a = frame(spark, "k int, YEAR int, x int", (1, 2009, 5))
    b = frame(spark, "k int, YEAR int, y int", (1, 2009, 6), (2, 2009, 7))
    c = frame(spark, "k int, YEAR int, z int", (1, 2011, 8))
    panel = G.stack_panel({2009: [a, b], 2011: [c]}, ["k", "YEAR"])
    chained = G.merge_one([a, b, c], ["k", "YEAR"])
    assert rows(panel, "k", "YEAR", "x", "y", "z") == rows(chained, "k", "YEAR", "x", "y", "z")


def test_collapse(spark, rows):
    df = frame(spark, "g string, v int, y int", ("a", None, 2009), ("a", None, 2011), (None, 3, 2000), (None, 4, None))
    assert rows(rollup.collapse(df, ["g"], ["v"], ["y"])) == [(None, 7, 2000), ("a", 0, 2011)]


def test_two_steps_equal_one(spark, rows):
    df = spark.range(500).select((F.col("id") % 50).alias("school"), (F.col("id") % 5).alias("lea"), F.when(F.col("id") % 7 != 0, F.col("id")).alias("v"))
    two = rollup.collapse(rollup.collapse(df, ["school", "lea"], ["v"]), ["lea"], ["v"])
    assert rows(two) == rows(rollup.collapse(df, ["lea"], ["v"]))


def test_tabulate(spark):
    df = frame(spark, "y int", (2011,), (2011,), (2013,), (2015,), (None,))
    out = [tuple(r) for r in rollup.tabulate(df, "y").orderBy("y").collect()]
    assert out == [(2011, 2, 50.0, 50.0), (2013, 1, 25.0, 75.0), (2015, 1, 25.0, 100.0)]
    many = rollup.tabulate(spark.range(200_000).select((F.col("id") % 100_000).alias("y")), "y")
    checked = many.agg(F.count("*"), F.min("n"), F.max("n"), F.max(F.abs(F.col("cum_percent") - (F.col("y") + 1) / 1000)), F.max("cum_percent")).first()
    assert checked[:3] == (100_000, 2, 2) and checked[3] < 1e-9 and checked[4] == 100.0


def test_duplicates(spark, rows):
    df = frame(spark, "k string", *[(c,) for c in "aabccc"])
    assert rows(rollup.duplicates_report(df, ["k"])) == [(1, 1, 0), (2, 2, 1), (3, 3, 2)]
    assert rows(rollup.duplicate_keys(df, ["k"])) == [("a", 2), ("c", 3)]


def test_state_lookup(spark, rows):
    pairs = frame(spark, "FIPS string, STATE string", ("01", ""), ("01", "AL"), ("01", "AL"), ("02", "AK"), ("03", None), ("03", ""), ("03", "AZ"), ("03", "ZZ"))
    assert rows(rollup.dup_index(pairs, ["FIPS"], "STATE")) == [
        ("01", None, 1), ("01", "AL", 2), ("02", "AK", 0), ("03", None, 1), ("03", "AZ", 2), ("03", "ZZ", 3)]
    lookup = rollup.lookup_from(pairs, "FIPS", "STATE", "STATE_CODE")
    assert rows(lookup) == [("01", "AL"), ("02", "AK"), ("03", "AZ"), ("03", "ZZ")]
    with pytest.raises(Exception, match="not unique on FIPS: 03"):
        G.merge_many(pairs.select("FIPS"), lookup, ["FIPS"]).collect()


def test_reshape_long(spark, rows):
    wide = frame(spark, "YEAR int, ENR_AI int, ENR_BL int, CORP_AI int, CORP_BL int", (2011, 10, 20, 1, 4))
    assert rows(reshape.reshape_long(wide, ["ENR_", "CORP_"], "race")) == [(2011, "AI", 10, 1), (2011, "BL", 20, 4)]
    partial = reshape.reshape_long(wide.drop("CORP_BL"), ["ENR_", "CORP_"], "race")
    assert rows(partial) == [(2011, "AI", 10, 1), (2011, "BL", 20, None)]


def test_wide_long_wide(spark, rows):
    wide = frame(spark, "y int, V_a int, V_b int, W_a int, W_b int", (1, 1, 2, 3, 4), (2, 5, None, 7, 8))
    long = reshape.reshape_long(wide, ["V_", "W_"], "k").withColumnsRenamed({"V_": "V", "W_": "W"})
    back = reshape.pivot_wider(long, ["y"], "k", ["V", "W"], ["a", "b"])
    assert rows(back, *wide.columns) == rows(wide)
    with pytest.raises(Exception, match="unlisted name: b"):
        reshape.pivot_wider(long, ["y"], "k", ["V"], ["a"]).collect()
    assert rows(reshape.pivot_longer(wide.select("y", "V_a", "W_a"), ["W_a"])) == [(1, 1, "W_a", 3), (2, 5, "W_a", 7)]


def test_append(spark, rows):
    a, b = frame(spark, "x int", (1,), (1,)), frame(spark, "x int, y int", (1, None), (2, 3))
    assert rows(reshape.append(a, b)) == [(1, None), (1, None), (1, None), (2, 3)]
    assert rows(reshape.append_distinct(a, b)) == [(1, None), (2, 3)]


def test_quality(spark, rows):
    df = frame(spark, "k int, t5 int, t7 int, r int, s int", (1, 1, 1, 5, 5), (1, 0, 2, None, None), (2, 3, 0, None, 1))
    other = frame(spark, "k int", (2,), (9,))
    out = quality.report(
        quality.exclusive(df, F.col("t5") != 0, F.col("t7") != 0), quality.unique_key(df, ["k"]),
        quality.unmatched(df.select("k"), other, ["k"]), quality.covered(df, "r"), quality.totals_differ(df, "r", "s"),
    )
    assert dict(rows(out)) == {
        "both standards": 1, "repeated keys": 1, "left only": 1, "right only": 1, "matched": 1, "values covered": 1, "totals differ": 1}


def test_wide_rows_are_dealt_before_they_are_summed(spark, rows):
    school = spark.createDataFrame([("a", 1, 2), ("a", 1, 3), (None, None, 7), (None, 5, 1), ("b", None, None)], "LEAID string, YEAR int, x bigint")
    dealt = rollup.collapse(school, ["LEAID"], ["x"], ["YEAR"], dealt=True)
    assert rows(dealt) == rows(rollup.collapse(school, ["LEAID"], ["x"], ["YEAR"])) == [(None, 8, 5), ("a", 5, 1), ("b", 0, None)]
    plan = waves.to_lea(school)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_sum") < plan.index("REBALANCE_PARTITIONS_BY_COL")


def test_a_merged_row_carries_its_own_columns_only(spark, rows):
    one, two = (spark.createDataFrame([(1, i), (None, None), (i + 2, 9)], f"k int, `x'{i}.` int") for i in range(2))
    merged = G.merge_one([one, two, two.select("k")], ["k"])
    assert merged.columns == ["k", "x'0.", "x'1."]
    assert rows(merged) == [(None, None, None), (1, 0, 1), (2, 9, None), (3, None, 9)]
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_max(_t0") < plan.index("REPARTITION_BY_COL")
