"""Column names of the extracts and what each must be called, written out here and not taken from the library.

The catalog cuts its extracts by these names and its SQL expects these targets, so that a wrong entry of the library's crosswalk
turns a query red.
"""

from __future__ import annotations

from typing import NamedTuple


class Name(NamedTuple):
    target: str
    five: str | None
    source: str
    cell: str


# Code of a group until 2011, code after, and target code.
GROUP_CODES = (
    ("AME", "AM", "AI"), ("ASI", "AS", "AS"), ("HIS", "HI", "HI"), ("BLA", "BL", "BL"), ("WHI", "WH", "WH"), ("HI_PAC", "HP", "HP"), ("2_OR_MORE", "TR", "MR"),
)
SEVEN_ONLY = ("HI_PAC", "2_OR_MORE")
SOURCE_MEASURES = {"CORP": "CORP", "SINGOSS": "SINGLE_SUS", "MULTOSS": "MULT_SUS", "ISS": "IN_SCH_SUS"}


def older(measure: str, disabled: bool) -> list[Name]:
    """A table of 2009 or 2011."""
    tail = f"{SOURCE_MEASURES[measure]}_{'DIS' if disabled else 'NO_DIS'}"
    group, out = "IDEA" if disabled else "NODIS", []
    for sex in "MF":
        for code, _, race in GROUP_CODES:
            five = None if code in SEVEN_ONLY else f"{sex}_{code}_5_{tail}"
            out.append(Name(f"{measure}_{sex}_{race}_{group}", five, f"{sex}_{code}_7_{tail}", f"{sex}_{race}_{group}"))
        if disabled:
            others = (("IDEA", "TOT_IDEA", "IDEA"), ("504", "504", "LEP"), ("DIS_LEP", "LEP", "LEP"))
        else:
            others = (("NODIS", "TOT", "NODIS"), ("NODIS_LEP", "LEP", "LEP"))
        out += [Name(f"{measure}_{sex}_{t}", f"{sex}_{s}_5_{tail}", f"{sex}_{s}_7_{tail}", f"{sex}_{c}") for t, s, c in others]
    return out


def recent(year: int) -> list[Name]:
    """The corporal punishment columns of 2013 and later; preschool and instances from 2015 on."""
    pairs = []
    for sex in "MF":
        pairs += [(f"SCH_DISCWODIS_CORP_{code}_{sex}", f"{sex}_{race}_NODIS", f"{sex}_{race}_NODIS") for _, code, race in GROUP_CODES]
        pairs += [(f"TOT_DISCWODIS_CORP_{sex}", f"{sex}_NODIS", f"{sex}_NODIS"), (f"SCH_DISCWODIS_CORP_LEP_{sex}", f"{sex}_NODIS_LEP", f"{sex}_LEP")]
    for sex in "MF":
        pairs += [(f"SCH_DISCWDIS_CORP_IDEA_{code}_{sex}", f"{sex}_{race}_IDEA", f"{sex}_{race}_IDEA") for _, code, race in GROUP_CODES]
        pairs += [
            (f"TOT_DISCWDIS_CORP_IDEA_{sex}", f"{sex}_IDEA", f"{sex}_IDEA"), (f"SCH_DISCWDIS_CORP_504_{sex}", f"{sex}_504", f"{sex}_LEP"),
            (f"SCH_DISCWDIS_CORP_LEP_{sex}", f"{sex}_DIS_LEP", f"{sex}_LEP"),
        ]
    names = [Name(f"CORP_{target}", None, source, cell) for source, target, cell in pairs]
    if year < 2015:
        return names
    young = []
    for sex in "MF":
        young += [(f"SCH_PSDISC_CORP_{code}_{sex}", f"CORP_{sex}_{race}_PS", f"{sex}_{race}_IDEA") for _, code, race in GROUP_CODES]
        young += [
            (f"TOT_PSDISC_CORP_{sex}", f"CORP_{sex}_PS", f"{sex}_IDEA"), (f"SCH_PSDISC_CORP_LEP_{sex}", f"CORP_{sex}_LEP_PS", f"{sex}_LEP"),
            (f"SCH_PSDISC_CORP_IDEA_{sex}", f"CORP_{sex}_IDEA_PS", f"{sex}_IDEA"),
        ]
    young += [
        ("SCH_CORPINSTANCES_WODIS", "CORPINST_NODIS", "M_NODIS"), ("SCH_CORPINSTANCES_WDIS", "CORPINST_DIS", "M_IDEA"),
        ("SCH_PSCORPINSTANCES_ALL", "CORPINST_PS", "M_IDEA"), ("SCH_PSCORPINSTANCES_IDEA", "CORPINST_IDEA_PS", "M_IDEA"),
    ]
    return names + [Name(target, None, source, cell) for source, target, cell in young]


def recent_suspensions(year: int, as_published: bool = True) -> list[Name]:
    """The suspension columns of 2013 and later: three measures, preschool, and from 2015 on instances and days missed."""
    out = []

    def add(source: str, target: str, cell: str) -> None:
        out.append(Name(target, None, source, cell))

    for measure, code in (("ISS", "ISS"), ("SINGOSS", "SINGOOS"), ("MULTOSS", "MULTOOS")):
        for sex in "MF":
            for _, group, race in GROUP_CODES:
                add(f"SCH_DISCWODIS_{code}_{group}_{sex}", f"{measure}_{sex}_{race}_NODIS", f"{sex}_{race}_NODIS")
                add(f"SCH_DISCWDIS_{code}_IDEA_{group}_{sex}", f"{measure}_{sex}_{race}_IDEA", f"{sex}_{race}_IDEA")
            add(f"TOT_DISCWODIS_{code}_{sex}", f"{measure}_{sex}_NODIS", f"{sex}_NODIS")
            add(f"TOT_DISCWDIS_{code}_IDEA_{sex}", f"{measure}_{sex}_IDEA", f"{sex}_IDEA")
            add(f"SCH_DISCWODIS_{code}_LEP_{sex}", f"{measure}_{sex}_NODIS_LEP", f"{sex}_LEP")
            add(f"SCH_DISCWDIS_{code}_LEP_{sex}", f"{measure}_{sex}_DIS_LEP", f"{sex}_LEP")
            add(f"SCH_DISCWDIS_{code}_504_{sex}", f"{measure}_{sex}_504", f"{sex}_LEP")
    young = (("OSS", "OOMOOS"),) if year == 2020 else (("SINGOSS", "SINGOOS"), ("MULTOSS", "MULTOOS"))
    odd = year == 2020 and as_published
    for measure, code in young:
        for sex, other in ("MF", "FM"):
            for _, group, race in GROUP_CODES:
                add(f"SCH_PSDISC_{code}_{group}_{sex}", f"{measure}_{sex}_{'TR' if odd and race == 'MR' else race}_PS", f"{sex}_{race}_IDEA")
            add(f"TOT_PSDISC_{code}_{sex}", f"{measure}_{sex}_PS", f"{sex}_IDEA")
            add(f"SCH_PSDISC_{code}_LEP_{sex}", f"{measure}_{sex}_LEP_PS", f"{sex}_LEP")
            add(f"SCH_PSDISC_{code}_IDEA_{sex}", f"{measure}_{other if odd else sex}_IDEA_PS", f"{sex}_IDEA")
    if year >= 2015:
        for sex in "MF":
            for _, group, race in GROUP_CODES:
                add(f"SCH_DAYSMISSED_{group}_{sex}", f"SUS_DAYSMISSED_{sex}_{race}", f"{sex}_{race}_IDEA")
            add(f"TOT_DAYSMISSED_{sex}", f"SUS_DAYSMISSED_{sex}", f"{sex}_IDEA")
            for group in ("LEP", "504"):
                add(f"SCH_DAYSMISSED_{group}_{sex}", f"SUS_DAYSMISSED_{sex}_{group}", f"{sex}_LEP")
            add(f"SCH_DAYSMISSED_IDEA_{sex}", f"SUS_DAYSMISSED_{sex}_IDEA", f"{sex}_IDEA")
        for source, status, cell in (
            ("SCH_PSOOSINSTANCES_ALL", "PS", "M_IDEA"), ("SCH_PSOOSINSTANCES_IDEA", "IDEA_PS", "M_IDEA"), ("SCH_OOSINSTANCES_WODIS", "NODIS", "M_NODIS"),
            ("SCH_OOSINSTANCES_IDEA", "IDEA", "M_IDEA"), ("SCH_OOSINSTANCES_504", "504", "M_LEP"),
        ):
            add(source, f"OSSINSTANCES_{status}", cell)
    return out


def attributes(target: str) -> tuple[str, str | None, str | None, str | None]:
    """Measure, sex, group and status of a target name, by splitting it."""
    parts = target.removeprefix("SUS_").split("_")
    measure = ("SUS_" if target.startswith("SUS_") else "") + parts.pop(0)
    sex = parts.pop(0) if parts and parts[0] in ("M", "F") else None
    races = [race for _, _, race in GROUP_CODES] + ["TR"]
    race = parts.pop(0) if parts and parts[0] in races else None
    return measure, sex, race, "_".join(parts) or None
