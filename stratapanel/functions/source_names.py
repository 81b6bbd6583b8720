"""What the column names of the three eras say, read by one grammar for each.

The crosswalks of ``vocabulary`` go from rules to names; this goes from the names of a table that is there to their meaning, and tells
which names it cannot read.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from . import vocabulary as V

SEXES = {"M": "M", "F": "F", "T": None}
# Target codes by the codes of the sources.
TABLE_GROUPS = {code: race for race, code in V.STANDARD7_RACES.items()}
MODERN_GROUPS = {code: race for race, code in V.MODERN_RACES.items()}
TABLE_MEASURES = {code: measure for measure, code in V.TABLE_MEASURES.items()}
MODERN_MEASURES = {**{code: measure for measure, code in V.MODERN_MEASURES.items()}, "OOMOOS": "OSS"}
INSTANCES = {("", "WODIS"): "NODIS", ("", "WDIS"): "DIS", ("", "IDEA"): "IDEA", ("", "504"): "504", ("PS", "ALL"): "PS", ("PS", "IDEA"): "IDEA_PS"}


def _any(codes) -> str:
    return "|".join(sorted(codes, key=len, reverse=True))


HISTORIC = re.compile(f"(?P<sex>[TMF])_(?P<group>{_any(V.HISTORIC_RACES.values())}|TOT|LEP)_(?P<measure>COR|SUS)")
TABLE = re.compile(
    f"(?P<sex>[MF])_(?P<group>{_any(TABLE_GROUPS)}|TOT_IDEA|TOT|504|LEP)_(?P<standard>[57])_(?P<measure>{_any(TABLE_MEASURES)})_(?P<without>NO_)?DIS"
)
MODERN = re.compile(
    f"(?:SCH|TOT)_(?P<block>DISCWODIS|DISCWDIS|PSDISC)_(?P<measure>{_any(MODERN_MEASURES)})(?P<idea>_IDEA)?(?:_(?P<group>{_any(MODERN_GROUPS)}|LEP|504))?_(?P<sex>[MF])"
)
MISSED = re.compile(f"(?:SCH|TOT)_DAYSMISSED(?:_(?P<group>{_any(MODERN_GROUPS)}|LEP|504|IDEA))?_(?P<sex>[MF])")
COUNTED = re.compile("SCH_(?P<young>PS)?(?P<measure>CORP|OOS)INSTANCES_(?P<status>WODIS|WDIS|IDEA|504|ALL)")


class Meaning(NamedTuple):
    """Target name and attributes of a source column; the flags are 0 or 1.

    ``DSO`` marks students with disabilities who are served under Section 504 only; the standard is 5 or 7 racial groups.
    """

    name_merge: str
    measure: str
    gender: str | None
    race: str | None
    status: str | None
    DIS: int
    LEP: int
    PS: int
    DSO: int
    instances: int
    suspension: int
    races_reported: int


def meaning(measure: str, gender: str | None, race: str | None, status: str | None, standard: int) -> Meaning:
    held = set((status or "").split("_"))
    return Meaning(
        V.name(measure, gender, race, status), measure, gender, race, status, int(bool(held & {"DIS", "IDEA", "504"})), int("LEP" in held), int("PS" in held),
        int("504" in held), int(measure in ("CORPINST", "OSSINSTANCES")), int(measure in ("SINGOSS", "MULTOSS", "ISS", "OSS")), standard,
    )


def _historic(m: re.Match) -> Meaning:
    group = m["group"]
    race = {code: race for race, code in V.HISTORIC_RACES.items()}.get(group)
    return meaning({"COR": "CORP", "SUS": "OSS"}[m["measure"]], SEXES[m["sex"]], race, "LEP" if group == "LEP" else None, 5)


def _table(m: re.Match) -> Meaning:
    group, without = m["group"], bool(m["without"])
    plain = "NODIS" if without else "IDEA"
    status = {"504": "504", "LEP": "NODIS_LEP" if without else "DIS_LEP"}.get(group, plain)
    return meaning(TABLE_MEASURES[m["measure"]], m["sex"], TABLE_GROUPS.get(group), status, int(m["standard"]))


def _modern(m: re.Match) -> Meaning | None:
    group, block, idea = m["group"], m["block"], bool(m["idea"])
    if block == "DISCWODIS" and (idea or group == "504") or block == "DISCWDIS" and idea == (group in ("LEP", "504")) or block == "PSDISC" and (idea and group or group == "504"):
        return None
    status = {"DISCWODIS": "NODIS", "DISCWDIS": "IDEA", "PSDISC": "IDEA_PS" if idea else "PS"}[block]
    if group == "LEP":
        status = {"DISCWODIS": "NODIS_LEP", "DISCWDIS": "DIS_LEP", "PSDISC": "LEP_PS"}[block]
    return meaning(MODERN_MEASURES[m["measure"]], m["sex"], MODERN_GROUPS.get(group), "504" if group == "504" else status, 7)


def _missed(m: re.Match) -> Meaning:
    group = m["group"]
    return meaning("SUS_DAYSMISSED", m["sex"], MODERN_GROUPS.get(group), group if group in ("LEP", "504", "IDEA") else None, 7)


def _counted(m: re.Match) -> Meaning | None:
    status = INSTANCES.get((m["young"] or "", m["status"]))
    return status and meaning({"CORP": "CORPINST", "OOS": "OSSINSTANCES"}[m["measure"]], None, None, status, 7)


ERAS = ((HISTORIC, _historic), (TABLE, _table), (MODERN, _modern), (MISSED, _missed), (COUNTED, _counted))


def read(column: str) -> Meaning | None:
    """What a source column counts, whatever the case of its name; None if no era has such a name."""
    for pattern, told in ERAS:
        if m := pattern.fullmatch(column.upper()):
            return told(m) or None
    return None
