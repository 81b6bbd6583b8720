"""The grammar of source names against the crosswalks, which are made from the rules the other way round."""

import pytest

from stratapanel.catalog import expected as E
from stratapanel.functions import source_names as SN
from stratapanel.functions import vocabulary as V
from stratapanel.operators import crosswalk as X


def test_every_name_of_the_crosswalks_is_read_as_its_target():
    walks = [V.historic_crosswalk(t) for t in ("CP", "OSS")] + [V.table_crosswalk(m, d) for m in V.TABLE_MEASURES for d in (False, True)]
    walks += [V.modern_crosswalk(t, y, as_published=False) for t in ("CP", "OSS") for y in V.MODERN_YEARS]
    pairs = {(source, target) for walk in walks for source, target in walk.items()}
    assert len(pairs) > 400
    assert [(s, t, SN.read(s)) for s, t in pairs if SN.read(s) is None or SN.read(s).name_merge != t] == []
    for c in E.recent_suspensions(2020, as_published=False):
        assert SN.read(c.source.lower()).name_merge == c.target


def test_attributes():
    five, seven = SN.read("M_504_5_CORP_DIS"), SN.read("F_LEP_7_SINGLE_SUS_NO_DIS")
    assert five[1:] == ("CORP", "M", None, "504", 1, 0, 0, 1, 0, 0, 5)
    assert seven[1:] == ("SINGOSS", "F", None, "NODIS_LEP", 0, 1, 0, 0, 0, 1, 7)
    assert SN.read("SCH_PSCORPINSTANCES_IDEA")[1:] == ("CORPINST", None, None, "IDEA_PS", 1, 0, 1, 0, 1, 0, 7)
    assert SN.read("T_BLA_SUS")[1:] == ("OSS", None, "BL", None, 0, 0, 0, 0, 0, 1, 5)


@pytest.mark.parametrize("name", ["LEAID", "JJ", "M_BLA_6_CORP_DIS", "SCH_DISCWODIS_CORP_IDEA_BL_M", "SCH_DISCWDIS_CORP_BL_M", "TOT_PSDISC_CORP_504_F", "SCH_PSCORPINSTANCES_WODIS", "M_BLA_7_CORP_DIS_X", ""])
def test_other_names_are_not_read(name):
    assert SN.read(name) is None


def test_unread_columns_are_named(spark):
    df = spark.createDataFrame([("1", "2", "3", "x")], "LEAID string, m_bla_7_corp_dis string, note string, F_TOT_5_CORP_NO_DIS string")
    assert X.unread(df) == ["note"]
    rows = {r["name"]: r for r in X.column_dictionary(df).collect()}
    assert set(rows) == {"m_bla_7_corp_dis", "note", "F_TOT_5_CORP_NO_DIS"} and rows["note"]["measure"] is None
    assert (rows["F_TOT_5_CORP_NO_DIS"]["status"], rows["F_TOT_5_CORP_NO_DIS"]["races_reported"]) == ("NODIS", 5)
