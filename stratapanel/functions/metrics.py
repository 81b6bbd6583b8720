"""Rates, risk ratios, risk differences, disclosure rounding and display labels."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import _col, not_in, quote, ratio

# Groups compared in the series, and the label texts shown for them.
COMPARED_GROUPS = ["BL", "HI", "WH", "AI", "AS"]
OTHER = "OTHER"

RISK_PAIRS = {
    "bl_wh": ("BL", "WH"),
    "bl_hi": ("BL", "HI"),
    "hi_wh": ("HI", "WH"),
    "ot_wh": ("OTHER", "WH"),
    "ai_wh": ("AI", "WH"),
    "as_wh": ("AS", "WH"),
}

GROUP_LABELS = {
    "AI": "American Indian / Alaskan Native",
    "AS": "Asian / Pacific Islander",
    "BL": "Black / African American",
    "HI": "Hispanic",
    "HP": "Native Hawaiian / Pacific Islander",
    "MR": "Multi-racial",
    "WH": "White",
}
ALL_STUDENTS = "All Students"

TYPE_LABELS = {
    "bl_wh_rr": "Black / White Risk Ratio",
    "hi_wh_rr": "Hispanic / White Risk Ratio",
    "bl_wh_rd": "Black / White Risk Difference",
    "hi_wh_rd": "Hispanic / White Risk Difference",
    "ai_wh_rr": "American Indian or Alaskan Native / White Risk Ratio",
    "ai_wh_rd": "American Indian or Alaskan Native / White Risk Difference",
    "as_wh_rr": "Asian or Pacific Islander / White Risk Ratio",
    "as_wh_rd": "Asian or Pacific Islander / White Risk Difference",
}

RISK_TYPES = [f"{p}_{kind}" for kind in ("rr", "rd") for p in RISK_PAIRS]
CHART_TYPES = ["bl_wh_rr", "hi_wh_rr", "ai_wh_rr", "as_wh_rr"]


def merge_group(c: Column | str, source: str = "HP", target: str = "AI") -> Column:
    """One category folded into another; nulls stay null."""
    c = _col(c)
    return F.when(c == source, F.lit(target)).otherwise(c)


def other_group(c: Column | str, kept=COMPARED_GROUPS, other: str = OTHER) -> Column:
    """Categories outside ``kept`` (a null among them) become ``other``."""
    c = _col(c)
    return F.when(not_in(c, kept), F.lit(other)).otherwise(c)


def map_labels(c: Column | str, labels: dict[str, str], default: str) -> Column:
    """Code to label through a literal map.  A null code has a null label, an unmapped one the default."""
    c = _col(c)
    table = F.create_map(*[F.lit(v) for v in chain.from_iterable(labels.items())])
    return F.when(c.isNotNull(), F.coalesce(F.try_element_at(table, c), F.lit(default)))


def group_label(c: Column | str, total_code: str) -> Column:
    """Display label of a racial group; ``check`` reveals codes outside the vocabulary."""
    return map_labels(c, {total_code: ALL_STUDENTS, **GROUP_LABELS}, "check")


def type_label(c: Column | str) -> Column:
    return map_labels(c, TYPE_LABELS, "other")


def series_class(c: Column | str, total_code: str) -> Column:
    """``all`` for the all-students line, ``not_all`` for the others."""
    c = _col(c)
    return F.when(c == total_code, "all").when(c != total_code, "not_all")


def risk_columns(count_prefix: str = "CORP_", base_prefix: str = "ENR_") -> dict[str, Column]:
    """Two group rates, then the risk ratio and risk difference of every pair."""

    def rate(group: str) -> str:
        return f"try_divide(CAST({quote(count_prefix + group)} AS DOUBLE), CAST({quote(base_prefix + group)} AS DOUBLE))"

    out = {"bl_rate": F.expr(rate("BL")), "wh_rate": F.expr(rate("WH"))}
    for name, (a, b) in RISK_PAIRS.items():
        out[f"{name}_rr"] = F.expr(f"try_divide({rate(a)}, {rate(b)})")
        out[f"{name}_rd"] = F.expr(f"{rate(a)} - {rate(b)}")
    return out


def round_to(c: Column | str, unit: int = 5) -> Column:
    """Whole count rounded to the nearest multiple of ``unit``."""
    return (F.round(_col(c) / unit) * unit).cast("bigint")


def percent_or_null(numerator: Column | str, denominator: Column | str) -> Column:
    """Percentage; exact zero becomes null, and so does a zero denominator."""
    return F.nullif(F.lit(100) * ratio(numerator, denominator), F.lit(0.0))

