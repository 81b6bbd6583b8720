import os
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from stratapanel.operators.merge import merge_buckets, merge_many, merge_one, stack_panel
from stratapanel.plans import panels
from stratapanel.sources import io


def test_materialize_builds_once(spark, rows):
    path = io.shared_dir(spark, "t")
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([(1, 2009), (2, 2011)], "x int, YEAR int")

    for _ in range(2):
        assert rows(io.materialize(spark, path, build, ["YEAR"]), "x", "YEAR") == [(1, 2009), (2, 2011)]
    assert len(calls) == 1


def test_shared_dir_follows_the_setting(spark):
    assert io.shared_dir(spark, "a").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert io.shared_dir(spark, "a") != io.shared_dir(spark, "a")


def test_forced_text(spark, tmp_path, rows):
    (tmp_path / "e.csv").write_text('lea,name,leaid,n\nAL,"a, b",0100005,3\nAK,NA,0200001,4\n')
    path = str(tmp_path / "e.csv")
    forced = io.read_forced(spark, path, [3])
    assert dict(forced.dtypes)["leaid"] == "string" and rows(forced, "leaid") == [("0100005",), ("0200001",)]
    assert rows(io.read_extract(spark, path)) == [("AK", "NA", "0200001", "4"), ("AL", "a, b", "0100005", "3")]
    inferred = io.read_csv(spark, path)
    assert rows(inferred, "name") == [(None,), ("a, b",)] and dict(inferred.dtypes)["n"] == "int"


def test_export_and_order(spark, rows):
    path = io.shared_dir(spark, "out")
    io.export_table(spark.createDataFrame([("01", None), ("02", 3)], "s string, n int"), path)
    assert rows(io.read_csv(spark, path, "s string, n int")) == [("01", None), ("02", 3)]
    df = spark.range(1000).select(F.format_string("%03d", F.col("id") * 7 % 100).alias("LEAID"), (F.col("id") % 9).alias("YEAR"))
    keys = [tuple(r) for r in io.sort_panel(df).collect()]
    assert keys == sorted(keys)


def test_dimension(spark, rows):
    df = spark.createDataFrame([("AL", "Alabama", 1), ("AL", "Alabama", 2)], "state string, state_name string, county int")
    assert rows(io.state_dimension(df, "state", "state_name")) == [("AL", "Alabama")]


def files_in(path):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_of_two_builders_the_first_copy_stays(spark, tmp_path):
    path = str(tmp_path / "t")
    built = []

    def build(value, wait):
        def run():
            built.append(value)
            time.sleep(wait)
            return spark.range(1000).select(F.lit(value).alias("v"))

        return run

    with ThreadPoolExecutor(2) as pool:
        slow = pool.submit(lambda: io.materialize(spark.newSession(), path, build("slow", 6)))
        time.sleep(1)
        quick = pool.submit(lambda: io.materialize(spark, path, build("quick", 0)))
        assert {r.v for r in quick.result().collect()} == {r.v for r in slow.result().collect()} == {"quick"}
    assert sorted(built) == ["quick", "slow"] and os.listdir(tmp_path) == ["t"]
    assert io.materialize(spark, path, lambda: 1 / 0).count() == 1000


def test_an_unfinished_table_is_built_again(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    os.remove(f"{path}/_SUCCESS")
    assert io.materialize(spark, path, lambda: spark.range(7)).count() == 7
    with pytest.raises(ZeroDivisionError):
        io.materialize(spark, str(tmp_path / "u"), lambda: 1 / 0)
    assert not os.path.exists(tmp_path / "u")


def test_a_wave_rewrites_its_year_only(spark, tmp_path):
    path = str(tmp_path / "panel")
    old = spark.createDataFrame([("a", 2011, 1), ("b", 2011, 2)], "k string, YEAR int, x int")
    new = spark.createDataFrame([("a", 2013, 5), ("c", 2013, None)], "k string, YEAR int, y int")
    panels.add_wave(spark, path, 2011, [old], ["k", "YEAR"])
    before = files_in(path)
    panels.add_wave(spark, path, 2013, [new.filter("y > 0")], ["k", "YEAR"])
    panel = panels.add_wave(spark, path, 2013, [new], ["k", "YEAR"])
    after = files_in(path)
    assert all(after[f] == t for f, t in before.items()) and len(after) > len(before)
    whole = stack_panel({2011: [old], 2013: [new]}, ["k", "YEAR"]).select("k", "YEAR", "x", "y")
    assert sorted(map(str, panel.select("k", "YEAR", "x", "y").collect())) == sorted(map(str, whole.collect()))
    for bad, match in ((new.union(new), "not unique"), (old, "a row of another year than 2013: 2011")):
        with pytest.raises(Exception, match=match):
            panels.add_wave(spark, path, 2013, [bad], ["k", "YEAR"])
    assert files_in(path) == after, "a refused wave leaves the panel as it was"


def test_bucketed_tables_merge_without_a_shuffle(spark, tmp_path):
    key = ["LEAID", "YEAR"]
    rows = spark.range(0, 5000).select((F.col("id") % 700).cast("string").alias("LEAID"), (F.col("id") / 700).cast("int").alias("YEAR"), "id", F.lit("a").alias("t"))
    other = rows.filter("id % 3 = 0 or id > 4000").select((F.col("LEAID").cast("int") + 1).cast("string").alias("LEAID"), "YEAR", F.col("id").alias("o"), F.lit("b").alias("t"))
    a, b = (io.write_bucketed(t, f"bucketed_{n}", key, 8, str(tmp_path / n)) for t, n in ((rows, "a"), (other, "b")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        merged = merge_buckets(a, b, key, "_merge")
        assert "Exchange" not in merged._jdf.queryExecution().executedPlan().toString()
        plain = merge_one([rows, other], key, "_merge").select(*merged.columns)
        assert merged.exceptAll(plain).count() == 0 and plain.exceptAll(merged).count() == 0
        assert {r["_merge"] for r in merged.select("_merge").distinct().collect()} == {1, 2, 3}
        looked = merge_many(a, b.select(*key, "o"), key, keep=["left", "both"], null_keys_match=False)
        assert "Exchange" not in looked._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in a.groupBy(*key).count()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len([n for n in os.listdir(tmp_path / "a") if n.endswith(".parquet")]) == 8
    for bad, match in ((rows.union(rows.limit(1)), "not unique on LEAID, YEAR"), (rows.withColumn("YEAR", F.nullif("YEAR", F.lit(3))), "a key is null in LEAID, YEAR")):
        with pytest.raises(Exception, match=match):
            merge_buckets(bad, other, key).count()
