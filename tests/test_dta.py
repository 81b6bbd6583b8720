"""Stata files against pandas, which reads and writes them on its own; ranges, missing codes, labels and publishing."""

import datetime
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratapanel.operators import columns as K
from stratapanel.sources import dta, io, published

NUMBERS = [-100, -1, 0, 7, 100]


def frame():
    return pd.DataFrame(
        {
            "LEAID": ["01", "ü", ""] * 100, "n": np.arange(300, dtype=np.int32) - 150, "s": np.arange(300, dtype=np.int16), "f": np.linspace(-1, 1, 300).astype(np.float32),
            "d": [None if i % 7 == 0 else i / 3 for i in range(300)], "b": np.array([1, 2, -3] * 100, dtype=np.int8), "t": pd.date_range("1950-01-01", periods=300),
        }
    )


@pytest.mark.parametrize("release", [117, 118, 119])
def test_a_file_of_another_program_is_read_in_ranges(spark, tmp_path, release):
    path, given = str(tmp_path / "a.dta"), frame()
    given["LEAID"] = given["LEAID"].replace("ü", "x") if release == 117 else given["LEAID"]
    given.to_stata(path, version=release, write_index=False, variable_labels={"n": "a number"}, value_labels={"b": {1: "one", 2: "two"}})
    got = io.read_dta(spark, path, splitBytes=1000)
    assert got.rdd.getNumPartitions() > 5
    assert [t for _, t in got.dtypes] == ["string", "int", "smallint", "float", "double", "tinyint", "timestamp_ntz"]
    assert got.schema["n"].metadata["comment"] == "a number" and K.value_labels(got, "b") == {1: "one", 2: "two"}
    back = got.orderBy("n").toPandas()
    for c in ("n", "s", "f", "b"):
        assert back[c].tolist() == given[c].tolist()
    assert back["LEAID"].tolist() == [x or None for x in given["LEAID"]]
    assert back["t"].tolist() == given["t"].tolist()
    np.testing.assert_array_equal(back["d"], given["d"].astype(float))


def test_types_labels_and_missing_values_go_there_and_back(spark, tmp_path):
    day, moment = datetime.date(1955, 3, 4), datetime.datetime(1949, 1, 2, 3, 4, 5, 678000)
    schema = "k string, b byte, s short, i int, f float, x double, day date, at timestamp_ntz, flag boolean, _missing_i string, _missing_x string"
    rows = [("a", 5, -5, 7, 0.5, -1e300, day, moment, True, None, None), (None, None, None, None, None, None, None, None, None, ".", ".z"), ("c", 100, 32740, 2147483620, 1.5, 0.1, day, moment, False, None, None), ("d", 1, 1, None, 1.0, None, None, moment, None, ".c", None)]
    df = K.label_values(K.label(spark.createDataFrame(rows, schema), {"k": "key"}), "i", {7: "seven", -1: "none"})
    path = str(tmp_path / "t")
    io.write_dta(df.repartition(3), path)
    back = io.read_dta(spark, path)
    assert back.dtypes[:8] == df.dtypes[:8] and back.dtypes[8] == ("flag", "tinyint")
    assert back.schema["k"].metadata["comment"] == "key" and K.value_labels(back, "i") == {7: "seven", -1: "none"}
    got = {r[0]: tuple(r)[1:8] for r in back.collect()}
    assert got == {r[0]: r[1:8] for r in rows}
    coded = {r["k"]: (r["_missing_i"], r["_missing_x"]) for r in io.read_dta(spark, path, missingCodes="true").collect()}
    assert coded == {"a": (None, None), None: (".", ".z"), "c": (None, None), "d": (".c", ".")}
    parts = pd.concat(pd.read_stata(f"{path}/{n}", convert_categoricals=False) for n in sorted(os.listdir(path)) if n.endswith(".dta"))
    assert sorted(parts["x"].dropna()) == [-1e300, 0.1] and sorted(parts["i"].dropna()) == [7, 2147483620]
    assert pd.read_stata(next(f"{path}/{n}" for n in os.listdir(path) if n.endswith(".dta")), iterator=True).variable_labels()["k"] == "key"


def test_parts_are_bounded_and_published_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(0, 5000, numPartitions=2).select(F.col("id").cast("int").alias("n"))
    io.write_dta(df, path, partBytes=4000)
    assert len(os.listdir(path)) > 3 and "_SUCCESS" in os.listdir(path)
    assert io.read_dta(spark, path).agg(F.sum("n")).first()[0] == sum(range(5000))
    io.write_dta(df.limit(10), path, mode="append")
    assert io.read_dta(spark, path).count() == 5010
    with pytest.raises(Exception, match="out of the range"):
        io.write_dta(df.select((F.col("n") + 2147478622).cast("int").alias("n")), path)
    assert io.read_dta(spark, path).count() == 5010, "a failed job leaves the table as it was"
    io.write_dta(df.limit(7), path)
    assert io.read_dta(spark, path).count() == 7
    assert [n for n in os.listdir(tmp_path) if n != "t"] == []


def test_what_lost_attempts_left_is_not_published(tmp_path, spark):
    writer = dta.Writer(str(tmp_path / "t"), spark.range(1).schema, True, 1 << 20)
    os.makedirs(writer.beside)
    for name in ("part-00000-1-0000.dta", "part-00000-2-0000.dta"):
        open(f"{writer.beside}/{name}", "w").close()
    writer.commit([published.Written(["part-00000-2-0000.dta"]), None])
    assert sorted(os.listdir(tmp_path / "t")) == ["_SUCCESS", "part-00000-2-0000.dta"]


def test_empty_tables_and_what_is_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    io.write_dta(spark.createDataFrame([], "k string, n int"), path)
    back = io.read_dta(spark, path)
    assert back.count() == 0 and back.dtypes == [("k", "string"), ("n", "int")]
    for bad, match in (
        (spark.createDataFrame([("x" * 2046,)], "k string"), "2046 bytes"), (spark.createDataFrame([(1,)], "`a b` int"), "no name"),
        (spark.createDataFrame([([1],)], "k array<int>"), "no type"), (spark.createDataFrame([(2**53 + 1,)], "k bigint"), "out of the range"),
    ):
        with pytest.raises(Exception, match=match):
            io.write_dta(bad, str(tmp_path / "bad"))
    pd.DataFrame({"k": ["x" * 3000]}).to_stata(str(tmp_path / "long.dta"), version=118, write_index=False)
    with pytest.raises(Exception, match="strL"):
        io.read_dta(spark, str(tmp_path / "long.dta"))
    with open(tmp_path / "no.dta", "wb") as file:
        file.write(b"something else")
    with pytest.raises(Exception, match="no .dta file of release"):
        io.read_dta(spark, str(tmp_path / "no.dta"))


@pytest.mark.parametrize("code", list(dta.NUMBERS))
def test_missing_codes_of_each_type(code):
    kind = dta.NUMBERS[code]
    first, step = dta.MISSING[code]
    raw = np.array([first + step * i for i in range(27)], dta.BITS.get(code, kind)).view(kind)
    missing, which = dta.missing_at(raw, code)
    assert missing.all() and which.tolist() == list(range(27))
    assert not dta.missing_at(np.array(NUMBERS, kind), code)[0].any()


def test_value_labels_of_several_waves(spark):
    a = K.label_values(spark.createDataFrame([(1,), (3,), (None,)], "x int"), "x", {1: "No", 2: "Yes"})
    b = K.label_values(spark.createDataFrame([(2,)], "x int"), "x", {2: "Yes", 9: "Unknown"})
    assert [r[1] for r in K.decode(a, "x", "t").orderBy("x").collect()] == [None, "No", "3"]
    assert K.value_labels(K.merge_labels(a.union(b), "x", b), "x") == {1: "No", 2: "Yes", 9: "Unknown"}
    with pytest.raises(ValueError, match="code 2 of x"):
        K.merge_labels(a, "x", K.label_values(b, "x", {2: "Maybe"}))
    coded = K.encode(spark.createDataFrame([("b",), ("a",), (" ",)], "x string"), "x", "c", labelled=True)
    assert K.value_labels(coded, "c") == {1: "a", 2: "b"}
    with pytest.raises(ValueError, match="more than"):
        K.label_values(a, "x", dict.fromkeys(range(K.MOST_LABELS + 1), "t"))
