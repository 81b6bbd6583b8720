"""Every registered query against its SQL, value by value, on the smallest test tables."""

import os

import compare
import pytest

from stratapanel import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="test tables are not there")


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert compare.differences(spark, con, QUERIES[name], SQL[name], SF) == []


def test_sorted_outputs(spark):
    """Order, which the comparison ignores."""
    drawn = [(r["legend_text"], r["YEAR"]) for r in QUERIES["clip_series"](spark, SF).collect()]
    assert drawn == sorted(drawn)
    panel = [(r["LEAID"], r["YEAR"]) for r in QUERIES["sort_panel"](spark, SF).collect()]
    assert panel == sorted(panel)
