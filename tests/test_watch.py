"""Checks counted on the way: the counts of the checks that are jobs of their own, and the rows as they were."""

from pyspark.sql import functions as F

from stratapanel.catalog import rollups
from stratapanel.operators import quality, watch
from stratapanel.sources import io

SCHEMA = "k int, y int, t5 int, t7 int, r int, s int"
DATA = [(1, 2009, 1, 1, 5, 5), (1, 2009, 0, 2, None, None), (2, 2009, 3, 0, None, 1), (None, 2011, 0, 0, 7, 7), (None, None, None, None, 1, 2)]


def checks(df, others):
    return watch.Watch(
        watch.exclusive(F.col("t5") != 0, F.col("t7") != 0), watch.unique_key(["k"]), watch.matched(others[0], ["k"]),
        watch.matched(others[1], ["k", "y"], ("l", "r", "b")), watch.covered("y"), watch.totals_differ("r", "s"),
    )


def test_counts_equal_separate_checks_and_rows_stay(spark, rows, tmp_path):
    df = spark.createDataFrame(DATA, SCHEMA)
    others = (spark.createDataFrame([(2,), (9,), (9,)], "k int"), spark.createDataFrame([(None, 2011), (1, 2009), (4, 4)], "k int, y int"))
    seen = checks(df, others)
    for parts in ((), ("y",)):
        seen = checks(df, others)
        path = str(tmp_path / f"t{len(parts)}")
        io.write_table(df, path, parts, watch=seen)
        got = dict(rows(seen.report(spark)))
        apart = quality.report(
            quality.exclusive(df, F.col("t5") != 0, F.col("t7") != 0), quality.unique_key(df, ["k"]), quality.unmatched(df, others[0], ["k"]),
            quality.covered(df, "y"), quality.totals_differ(df, "r", "s"),
        )
        second = dict(rows(quality.unmatched(df, others[1], ["k", "y"])))
        assert got == dict(rows(apart)) | {"l": second["left only"], "r": second["right only"], "b": second["matched"]}
        assert rows(spark.read.parquet(path), *df.columns) == rows(df)


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    seen = checks(df, (spark.createDataFrame([(2,)], "k int"), spark.createDataFrame([(1, 1)], "k int, y int")))
    io.write_table(df, str(tmp_path / "t"), watch=seen)
    got = {r.check: r.n for r in seen.report(spark).collect()}
    assert got == {"both standards": 0, "repeated keys": 0, "left only": 0, "right only": 1, "matched": 0, "l": 0, "r": 1, "b": 0, "values covered": 0, "totals differ": 0}


def test_report_reads_each_table_once(spark, monkeypatch):
    """One job writes the rows; its plan scans lineitem, orders and customer once each and counts after the last shuffle."""
    plans = []
    write = io.write_table

    def noted(df, path, partition_by=(), watch=None):
        plans.append(watch.count(watch.prepare(df))._jdf.queryExecution().executedPlan().toString())
        watch.__init__(*watch.checks)
        write(df, path, partition_by, watch)

    monkeypatch.setattr(io, "write_table", noted)
    assert rollups.quality_report(spark, "/root/testdata/sf0.001").count() == 7
    assert [plans[0].count(f"{t}.parquet") for t in ("lineitem", "orders", "customer")] == [1, 1, 1]
    assert plans[0].index("CollectMetrics") < plans[0].index("Exchange") and plans[0].count("CollectMetrics") == 1
