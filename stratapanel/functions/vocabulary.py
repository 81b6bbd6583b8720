"""Target column names, and the rules that map each wave's source names onto them.

A target name is ``MEASURE[_GENDER][_RACE][_STATUS]``.  The crosswalks are generated from the
naming rule of each era; none is written out column by column.
"""

from __future__ import annotations

from typing import NamedTuple

# The code lists of the target vocabulary.
MEASURES = ["CORP", "CORPINST", "CORPIND", "SINGOSS", "MULTOSS", "ISS", "OSS", "OSSINSTANCES", "SUS_DAYSMISSED", "ENR"]
GENDERS = ["M", "F"]
RACES = ["AI", "AS", "HI", "BL", "WH", "HP", "MR"]
SUM_RACE = "sumrace"
STATUSES = ["NODIS", "DIS", "IDEA", "504", "PS", "LEP", "NODIS_LEP", "DIS_LEP", "LEP_PS", "IDEA_PS"]

# Source race codes per era.
HISTORIC_RACES = {"AI": "AME", "AS": "ASI", "HI": "HIS", "BL": "BLA", "WH": "WHI"}
STANDARD7_RACES = {**HISTORIC_RACES, "HP": "HI_PAC", "MR": "2_OR_MORE"}
MODERN_RACES = {"AI": "AM", "AS": "AS", "HI": "HI", "BL": "BL", "WH": "WH", "HP": "HP", "MR": "TR"}

# Source measure codes per era.
TABLE_MEASURES = {"CORP": "CORP", "SINGOSS": "SINGLE_SUS", "MULTOSS": "MULT_SUS", "ISS": "IN_SCH_SUS"}
MODERN_MEASURES = {"CORP": "CORP", "SINGOSS": "SINGOOS", "MULTOSS": "MULTOOS", "ISS": "ISS"}

MODERN_YEARS = [2013, 2015, 2017, 2020]

ID_COLUMNS = ["LEA_STATE", "LEA_STATE_NAME", "LEAID", "LEA_NAME", "SCHID", "SCH_NAME", "COMBOKEY"]
DISTRICT_KEY = ["LEAID", "YEAR"]
SCHOOL_KEY = ["COMBOKEY", "YEAR"]

TARGET_PATTERN = (
    r"^(CORPINST|CORPIND|CORP|SINGOSS|MULTOSS|ISS|OSSINSTANCES|OSS|SUS_DAYSMISSED|ENR)"
    r"(?:_(M|F))?"
    r"(?:_(AI|AS|HI|BL|WH|HP|MR|TR|sumrace))?"
    r"(?:_(NODIS_LEP|DIS_LEP|LEP_PS|IDEA_PS|NODIS|DIS|IDEA|504|PS|LEP))?$"
)


class Choice(NamedTuple):
    """Target column taken from one of two source columns, by the standard the row reports under."""

    target: str
    five: str | None
    seven: str


def name(measure: str, gender: str | None = None, race: str | None = None, status: str | None = None) -> str:
    """Target column name from its parts."""
    return "_".join(p for p in (measure, gender, race, status) if p)


def historic_crosswalk(topic: str) -> dict[str, str]:
    """District extracts of 1973-2006."""
    if topic == "CP":
        return {f"T_{src}_COR": name("CORP", race=race) for race, src in HISTORIC_RACES.items()}
    out = {}
    for code, gender in (("T", None), ("M", "M"), ("F", "F")):
        for race, src in HISTORIC_RACES.items():
            out[f"{code}_{src}_SUS"] = name("OSS", gender, race)
        out[f"{code}_TOT_SUS"] = name("OSS", gender)
        out[f"{code}_LEP_SUS"] = name("OSS", gender, status="LEP")
    return out


def table_choices(measure: str, disabled: bool) -> list[Choice]:
    """One 2009/2011 table: a measure for students with or without disabilities."""
    tail = f"{TABLE_MEASURES[measure]}_{'DIS' if disabled else 'NO_DIS'}"
    status = "IDEA" if disabled else "NODIS"
    out = []
    for g in GENDERS:
        for race, src in STANDARD7_RACES.items():
            five = f"{g}_{src}_5_{tail}" if race in HISTORIC_RACES else None
            out.append(Choice(name(measure, g, race, status), five, f"{g}_{src}_7_{tail}"))
        rest = [("TOT_IDEA" if disabled else "TOT", status)]
        rest += [("504", "504")] if disabled else []
        rest += [("LEP", "DIS_LEP" if disabled else "NODIS_LEP")]
        for code, suffix in rest:
            out.append(Choice(name(measure, g, status=suffix), f"{g}_{code}_5_{tail}", f"{g}_{code}_7_{tail}"))
    return out


def table_crosswalk(measure: str, disabled: bool) -> dict[str, str]:
    """The same table in 2011, when every school reports under the seven-category standard."""
    return {c.seven: c.target for c in table_choices(measure, disabled)}


def _without_disability(measure: str) -> dict[str, str]:
    src = f"DISCWODIS_{MODERN_MEASURES[measure]}"
    out = {}
    for g in GENDERS:
        out |= {f"SCH_{src}_{code}_{g}": name(measure, g, race, "NODIS") for race, code in MODERN_RACES.items()}
        out |= {f"TOT_{src}_{g}": name(measure, g, status="NODIS")}
        out |= {f"SCH_{src}_LEP_{g}": name(measure, g, status="NODIS_LEP")}
    return out


def _with_disability(measure: str) -> dict[str, str]:
    src = f"DISCWDIS_{MODERN_MEASURES[measure]}"
    out = {}
    for g in GENDERS:
        out |= {f"SCH_{src}_IDEA_{code}_{g}": name(measure, g, race, "IDEA") for race, code in MODERN_RACES.items()}
        out |= {f"TOT_{src}_IDEA_{g}": name(measure, g, status="IDEA")}
        out |= {f"SCH_{src}_504_{g}": name(measure, g, status="504")}
        out |= {f"SCH_{src}_LEP_{g}": name(measure, g, status="DIS_LEP")}
    return out


def _preschool(measure: str, code: str) -> dict[str, str]:
    src = f"PSDISC_{code}"
    out = {}
    for g in GENDERS:
        out |= {f"SCH_{src}_{rc}_{g}": name(measure, g, race, "PS") for race, rc in MODERN_RACES.items()}
        out |= {f"TOT_{src}_{g}": name(measure, g, status="PS")}
        out |= {f"SCH_{src}_LEP_{g}": name(measure, g, status="LEP_PS")}
        out |= {f"SCH_{src}_IDEA_{g}": name(measure, g, status="IDEA_PS")}
    return out


def _days_missed() -> dict[str, str]:
    out = {}
    for g in GENDERS:
        out |= {f"SCH_DAYSMISSED_{code}_{g}": name("SUS_DAYSMISSED", g, race) for race, code in MODERN_RACES.items()}
        out |= {f"TOT_DAYSMISSED_{g}": name("SUS_DAYSMISSED", g)}
        out |= {f"SCH_DAYSMISSED_{s}_{g}": name("SUS_DAYSMISSED", g, status=s) for s in ("LEP", "504", "IDEA")}
    return out


def modern_crosswalk(topic: str, year: int, as_published: bool = True) -> dict[str, str]:
    """School extracts of 2013-2020.

    The published panel has two oddities in the 2020 preschool suspension block: the multi-racial
    group keeps its source code, and the two IDEA columns are exchanged between the sexes.
    ``as_published=False`` gives the regular names instead.
    """
    if year not in MODERN_YEARS:
        raise ValueError(f"no such wave: {year}")
    out: dict[str, str] = {}
    if topic == "CP":
        if year >= 2015:
            out |= _preschool("CORP", "CORP")
            out |= {"SCH_CORPINSTANCES_WODIS": "CORPINST_NODIS", "SCH_CORPINSTANCES_WDIS": "CORPINST_DIS"}
            out |= {"SCH_PSCORPINSTANCES_ALL": "CORPINST_PS", "SCH_PSCORPINSTANCES_IDEA": "CORPINST_IDEA_PS"}
        return out | _without_disability("CORP") | _with_disability("CORP")
    if year == 2020:
        preschool = _preschool("OSS", "OOMOOS")
        if as_published:
            for g, other in (("M", "F"), ("F", "M")):
                preschool[f"SCH_PSDISC_OOMOOS_TR_{g}"] = f"OSS_{g}_TR_PS"
                preschool[f"SCH_PSDISC_OOMOOS_IDEA_{g}"] = f"OSS_{other}_IDEA_PS"
        out |= preschool
    else:
        out |= _preschool("SINGOSS", "SINGOOS") | _preschool("MULTOSS", "MULTOOS")
    for measure in ("ISS", "SINGOSS", "MULTOSS"):
        out |= _without_disability(measure)
    for measure in ("ISS", "SINGOSS", "MULTOSS"):
        out |= _with_disability(measure)
    if year >= 2015:
        out |= {
            "SCH_PSOOSINSTANCES_ALL": "OSSINSTANCES_PS",
            "SCH_PSOOSINSTANCES_IDEA": "OSSINSTANCES_IDEA_PS",
            "SCH_OOSINSTANCES_WODIS": "OSSINSTANCES_NODIS",
            "SCH_OOSINSTANCES_IDEA": "OSSINSTANCES_IDEA",
            "SCH_OOSINSTANCES_504": "OSSINSTANCES_504",
        }
        out |= _days_missed()
    return out


def total_cells(topic: str, race: str) -> list[str]:
    """Cells that make up a race total: both sexes, with and without disability.

    Preschool, 504 and LEP cells never enter a total.  Suspensions add single and multiple ones.
    """
    measures = ["CORP"] if topic == "CP" else ["SINGOSS", "MULTOSS"]
    return [name(m, g, race, s) for m in measures for g in GENDERS for s in ("NODIS", "IDEA")]


def outcome(topic: str) -> str:
    """Prefix of the panel's outcome columns."""
    return {"CP": "CORP", "OSS": "OSS"}[topic]
