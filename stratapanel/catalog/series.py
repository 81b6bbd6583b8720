"""Cohorts, rate series, risk series and what the charts show of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.nulls import in_
from ..plans import series as S
from . import base as B

UNIVERSE = [1996, 1998, 2000]
# The four comparisons that the charts show.
CHARTED = ("bl_wh_rr", "hi_wh_rr", "ai_wh_rr", "as_wh_rr")
LIMITS = (0.9, 1.1)
YEARS = (1996, 2000)
FIRST = 1995


def _case(column: str, labels: dict[str, str], default: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items())
    return f"CASE {column} {arms} ELSE '{default}' END"


GROUP_CASE = _case("race_fixed", {"sumrace": M.ALL_STUDENTS, **M.GROUP_LABELS}, "check")
TYPE_CASE = _case("type", M.TYPE_LABELS, "other")
KEPT = B.quoted(M.COMPARED_GROUPS)


def _rate_sql(where: str, cohort: str = "") -> str:
    head = f"{cohort}, " if cohort else ""
    return f"""SELECT {head}"YEAR", race_fixed, cp_sum, enr_sum, cp_sum / nullif(enr_sum, 0) AS cp_rate,
  {GROUP_CASE} AS legend_text, CASE WHEN race_fixed = 'sumrace' THEN 'all' ELSE 'not_all' END AS size
FROM (SELECT "YEAR", CASE WHEN race = 'HP' THEN 'AI' ELSE race END AS race_fixed,
        CAST(sum(CORP_) AS BIGINT) AS cp_sum, CAST(sum(ENR_) AS BIGINT) AS enr_sum
      FROM state_long WHERE "YEAR" <> {B.LAST_YEAR} AND {where} GROUP BY 1, 2)
WHERE "YEAR" >= 1975 AND race_fixed IN ({KEPT})"""


ALWAYS = f"STATE_CODE IN {B.ALLOWED}"
SOMETIME = f"STATE_CODE NOT IN {B.ALLOWED} AND STATE_CODE NOT IN {B.EXCLUDED}"


def _wide_sql(where: str, extra: str = "") -> str:
    groups = [*M.COMPARED_GROUPS, "OTHER"]
    sums = ", ".join(
        f"CAST(sum(CASE WHEN g = '{g}' THEN {v}_ END) AS BIGINT) AS {v}_{g}" for v in ("ENR", "CORP") for g in groups
    )
    rate = {g: f"(CORP_{g} / nullif(ENR_{g}, 0))" for g in groups}
    pairs = ", ".join(
        f"{rate[a]} / nullif({rate[b]}, 0) AS {n}_rr, {rate[a]} - {rate[b]} AS {n}_rd"
        for n, (a, b) in M.RISK_PAIRS.items()
    )
    return f"""wide AS (SELECT "YEAR", {sums}
  FROM (SELECT *, CASE WHEN race IN ({KEPT}) THEN race ELSE 'OTHER' END AS g FROM state_long
        WHERE race <> 'sumrace' AND "YEAR" > 1974 AND {where}) GROUP BY "YEAR"{extra}),
compared AS (SELECT *, {rate['BL']} AS bl_rate, {rate['WH']} AS wh_rate, {pairs} FROM wide)"""


def _risk_sql(where: str, types=M.RISK_TYPES, state=B.STATE) -> str:
    groups = [*M.COMPARED_GROUPS, "OTHER"]
    ids = ", ".join(['"YEAR"', *[f"{v}_{g}" for v in ("ENR", "CORP") for g in groups], "bl_rate", "wh_rate"])
    rows = "\n  UNION ALL ".join(f"SELECT {ids}, '{t}' AS type, {t} AS value FROM compared" for t in types)
    return f"{state},\n{_wide_sql(where)}\nSELECT DISTINCT *, {TYPE_CASE} AS legend_text FROM (\n  {rows})"


NOT_LAST = f'"YEAR" <> {B.LAST_YEAR}'


def _state(spark, sf):
    return S.without_year(B.state_long(spark, sf), B.LAST_YEAR)


def risk_series_all(spark, sf):
    return S.risk_series(_state(spark, sf))


def risk_series_cohort(cohort):
    def run(spark, sf):
        rows = S.in_cohort(_state(spark, sf), cohort, B.allowed_states(spark, sf), B.EXCLUDED_STATES)
        return S.risk_series(rows)

    return run


def rate_series(cohort):
    def run(spark, sf):
        rows = S.in_cohort(_state(spark, sf), cohort, B.allowed_states(spark, sf), B.EXCLUDED_STATES)
        return S.rate_series(rows)

    return run


def cohort_one_pass(spark, sf):
    tagged = S.tag_cohorts(_state(spark, sf), B.allowed_states(spark, sf), B.EXCLUDED_STATES)
    return S.rate_series(tagged, by=["cohort"])


def risk_universe_years(spark, sf):
    return S.universe(S.risk_series(_state(spark, sf)), UNIVERSE)


def rate_universe_years(spark, sf):
    return S.universe(S.rate_series(_state(spark, sf)), UNIVERSE)


def risk_series_keep_last_year(spark, sf):
    rows = S.in_cohort(B.state_long(spark, sf), "sometime", B.allowed_states(spark, sf), B.EXCLUDED_STATES)
    return S.risk_series(rows)


def clip_series(spark, sf):
    clipped = S.chart_ready(S.risk_series(_state(spark, sf)), limits=LIMITS, years=YEARS)
    return clipped.select("legend_text", "YEAR", "type", "value")


def _suspensions(spark, sf):
    """The suspension variant of the state table: total code, membership base, a state unknown, the
    last year read as the one before."""
    raw = B.state_long(spark, sf).select(
        "YEAR",
        F.when(F.col("STATE_CODE") != "NATION_7", F.col("STATE_CODE")).alias("STATE_CODE"),
        F.when(F.col("race") == "sumrace", "total").otherwise(F.col("race")).alias("race"),
        F.col("CORP_").alias("OSS_"),
        F.col("ENR_").alias("MEM_"),
    )
    return S.suspension_input(raw).withColumn("YEAR", S.rewrite_year("YEAR", B.LAST_YEAR, B.LAST_YEAR - 1))


def _published(spark, sf):
    """Suspensions as most charts show them: without the last year, as it reads once it is moved."""
    return S.without_year(_suspensions(spark, sf), B.LAST_YEAR - 1)


def oss_published(series, cohort):
    """Rate or risk series of suspensions without the last year."""

    def run(spark, sf):
        rows = S.in_cohort(_published(spark, sf), cohort, B.allowed_states(spark, sf), B.EXCLUDED_STATES)
        if series is S.rate_series:
            return series(rows, S.OSS, first_year=None, drop_null_state=True).drop("size")
        return series(rows, S.OSS, first_year=None)

    return run


def rate_with_last_year(spark, sf):
    """The rates of all states with the last year kept."""
    return S.rate_series(B.state_long(spark, sf))


def oss_since(series):
    """Suspensions with the last year and from a first year on."""

    def run(spark, sf):
        if series is S.rate_series:
            return series(_suspensions(spark, sf), S.OSS, first_year=FIRST, drop_null_state=True).drop("size")
        rows = S.in_cohort(_suspensions(spark, sf), "sometime", B.allowed_states(spark, sf), B.EXCLUDED_STATES)
        return series(rows, S.OSS, first_year=FIRST)

    return run


def chart(series, value, limits, types=CHARTED):
    """The points of a series that fall within a chart's axes."""

    def run(spark, sf):
        points = S.chart_ready(series(spark, sf), value, limits, YEARS, types)
        return points.select("legend_text", "YEAR", *(["type"] if types else []), value)

    return run


def oss_rate_series(spark, sf):
    return S.rate_series(_suspensions(spark, sf), S.OSS, first_year=None, drop_null_state=True).drop("size")


def oss_risk_series(spark, sf):
    """Risk series of the sometime cohort; the unknown state is in no list and stays."""
    rows = S.in_cohort(_suspensions(spark, sf), "sometime", B.allowed_states(spark, sf), B.EXCLUDED_STATES)
    return S.risk_series(rows, S.OSS, first_year=None)


def oss_rates(cohort):
    def run(spark, sf):
        rows = S.in_cohort(_suspensions(spark, sf), cohort, B.allowed_states(spark, sf), B.EXCLUDED_STATES)
        return S.rate_series(rows, S.OSS, first_year=None, drop_null_state=True).drop("size")

    return run


def oss_risks(cohort):
    def run(spark, sf):
        rows = S.in_cohort(_suspensions(spark, sf), cohort, B.allowed_states(spark, sf), B.EXCLUDED_STATES)
        return S.risk_series(rows, S.OSS, first_year=None)

    return run


def universe_of(series, *cohorts):
    """A series kept to the years in which every district was asked."""

    def run(spark, sf):
        return S.universe(series(*cohorts)(spark, sf), UNIVERSE)

    return run


def with_last_year(cohort):
    """Risk series of a cohort that keeps the last year."""

    def run(spark, sf):
        return S.risk_series(S.in_cohort(B.state_long(spark, sf), cohort, B.allowed_states(spark, sf), B.EXCLUDED_STATES))

    return run


OSS_RATE_SQL = f"""{B.STATE}
SELECT "YEAR", race_fixed, oss_sum, oss_mem, oss_sum / nullif(oss_mem, 0) AS oss_rate, {GROUP_CASE} AS legend_text
FROM (SELECT CASE WHEN "YEAR" = {B.LAST_YEAR} THEN {B.LAST_YEAR - 1} ELSE "YEAR" END AS "YEAR",
        CASE WHEN race = 'HP' THEN 'AI' ELSE race END AS race_fixed,
        CAST(sum(CORP_) AS BIGINT) AS oss_sum, CAST(sum(ENR_) AS BIGINT) AS oss_mem
      FROM state_long WHERE STATE_CODE <> 'NATION_7' GROUP BY 1, 2)
WHERE race_fixed IN ({KEPT})"""


OSS_STATE = f"""{B.STATE.replace('state_long AS', 'known AS')},
state_long AS (SELECT CASE WHEN "YEAR" = {B.LAST_YEAR} THEN {B.LAST_YEAR - 1} ELSE "YEAR" END AS "YEAR",
  nullif(STATE_CODE, 'NATION_7') AS STATE_CODE, race, CORP_, ENR_ FROM known)"""


def _oss_rate_sql(where: str) -> str:
    return OSS_RATE_SQL.replace("WHERE STATE_CODE <> 'NATION_7'", f"WHERE STATE_CODE <> 'NATION_7' AND {where}")


PUBLISHED = f'"YEAR" <> {B.LAST_YEAR - 1}'
WITH_LAST_SQL = f"""{B.STATE} {_rate_sql('TRUE').replace(f'"YEAR" <> {B.LAST_YEAR} AND ', '')}"""


def _oss_published_rate_sql(where: str) -> str:
    return f"SELECT * FROM ({_oss_rate_sql(where)}) WHERE {PUBLISHED}"


def _oss_published_risk_sql(where: str) -> str:
    return _risk_sql(f"{PUBLISHED} AND {where}", state=OSS_STATE)


def _chart_sql(sql: str, value: str, limits: tuple, typed: bool = True) -> str:
    columns = f'legend_text, "YEAR", type, {value}' if typed else f'legend_text, "YEAR", {value}'
    shown = f"type IN ({B.quoted(CHARTED)}) AND " if typed else ""
    return _cut(sql, columns, f'{shown}"YEAR" BETWEEN 1996 AND 2000 AND {value} BETWEEN {limits[0]} AND {limits[1]}')


IN_UNIVERSE = '"YEAR" IN (1996, 1998, 2000)'


def cohort_from_rules(spark, sf):
    """Districts per state of a cohort that a rule over law attributes defines."""
    nation = B.table(spark, sf, "nation")
    region = B.table(spark, sf, "region")
    laws = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("state"),
        F.when(F.col("r_name") == "ASIA", "Yes").when(F.col("r_name") == "EUROPE", "Not Mentioned").otherwise("No").alias("corporal_punishment"),
        F.nullif(F.lit(2010) + F.col("n_nationkey"), F.lit(2010) + 5 * F.col("n_regionkey")).alias("year_outlawed"),
    )
    customers = B.customer_states(spark, sf)
    states = customers.select(F.col("n_nationkey").cast("string").alias("state"), F.col("STATE_CODE").alias("state_name"))
    cohort = S.law_cohort(laws, states)
    coded = customers.select("c_custkey", F.col("n_nationkey").cast("string").alias("STATE_CODE"))
    return S.in_cohort(coded, "always", cohort).groupBy("STATE_CODE").agg(F.count(F.lit(1)).alias("districts"))


COHORT_SQL = """SELECT CAST(n_nationkey AS VARCHAR) AS STATE_CODE, count(*) AS districts
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' OR r_name = 'EUROPE' OR nullif(2010 + n_nationkey, 2010 + 5 * n_regionkey) > 2020
GROUP BY 1"""


def label_map(spark, sf):
    rows = B.state_long(spark, sf).withColumn("race", F.nullif(F.col("race"), F.lit("MR")))
    coded = rows.withColumn("race", F.when(F.col("race") == "HI", "??").otherwise(F.col("race")))
    return coded.withColumn("label", M.group_label("race", "sumrace")).select("YEAR", "STATE_CODE", "race", "label")


LABEL_SQL = f"""{B.STATE}
SELECT "YEAR", STATE_CODE, race, CASE WHEN race IS NOT NULL THEN {GROUP_CASE.replace('race_fixed', 'race')} END AS label
FROM (SELECT "YEAR", STATE_CODE, CASE race WHEN 'MR' THEN NULL WHEN 'HI' THEN '??' ELSE race END AS race FROM state_long)"""


def series_flag(spark, sf):
    flagged = B.state_long(spark, sf).withColumn("size", M.series_class("race", "sumrace"))
    return flagged.groupBy("YEAR", "size").agg(F.sum("ENR_").alias("enr"))


def hp_merge(spark, sf):
    merged = B.state_long(spark, sf).withColumn("race_fixed", M.merge_group("race"))
    return merged.groupBy("YEAR", "STATE_CODE", "race_fixed").agg(F.sum("ENR_").alias("enr"))


def collapse_other(spark, sf):
    rows = B.state_long(spark, sf).withColumn("race", F.nullif(F.col("race"), F.lit("BL")))
    return rows.withColumn("race_adjusted", M.other_group("race")).groupBy("YEAR", "race_adjusted").agg(
        F.sum("ENR_").alias("enr")
    )


def pct_zero_null(spark, sf):
    long = B.state_long(spark, sf)
    cut = long.withColumn("CORP_", F.when(F.col("CORP_") >= 400, F.col("CORP_")).otherwise(0))
    pct = cut.withColumn("pct_", M.percent_or_null("CORP_", "ENR_"))
    renamed = F.when(F.col("race") == "sumrace", "total").otherwise(F.col("race"))
    return pct.select("YEAR", "STATE_CODE", renamed.alias("race"), "pct_")


def series_groups(spark, sf):
    """Four chart types of the risk series, kept by membership."""
    chosen = S.risk_series(_state(spark, sf)).filter(in_("type", M.CHART_TYPES))
    return chosen.select("YEAR", "type", "value", "legend_text")


def _cut(sql: str, columns: str, where: str) -> str:
    return f"SELECT {columns} FROM ({sql}) WHERE {where}"


ONE_PASS_SQL = f"""{B.STATE}
{_rate_sql('TRUE', "'all' AS cohort")}
UNION ALL {_rate_sql(ALWAYS, "'always' AS cohort")}
UNION ALL {_rate_sql(SOMETIME, "'sometime' AS cohort")}"""

QUERIES = {
    "risk_series_all": (risk_series_all, _risk_sql(NOT_LAST)),
    "risk_series_always": (risk_series_cohort("always"), _risk_sql(f"{NOT_LAST} AND {ALWAYS}")),
    "risk_series_sometime": (risk_series_cohort("sometime"), _risk_sql(f"{NOT_LAST} AND {SOMETIME}")),
    "risk_series_keep_last_year": (risk_series_keep_last_year, _risk_sql(SOMETIME)),
    "risk_universe_years": (risk_universe_years, _cut(_risk_sql(NOT_LAST), "*", '"YEAR" IN (1996, 1998, 2000)')),
    "rate_universe_years": (rate_universe_years, _cut(f"{B.STATE} {_rate_sql('TRUE')}", "*", '"YEAR" IN (1996, 1998, 2000)')),
    "rate_series_all": (rate_series("all"), f"{B.STATE} {_rate_sql('TRUE')}"),
    "rate_series_always": (rate_series("always"), f"{B.STATE} {_rate_sql(ALWAYS)}"),
    "rate_series_sometime": (rate_series("sometime"), f"{B.STATE} {_rate_sql(SOMETIME)}"),
    "oss_rate_series": (oss_rate_series, OSS_RATE_SQL),
    "oss_risk_series": (
        oss_risk_series, _risk_sql(f"(STATE_CODE IS NULL OR {SOMETIME})", state=OSS_STATE),
    ),
    "cohort_one_pass": (cohort_one_pass, ONE_PASS_SQL),
    "cohort_from_rules": (cohort_from_rules, COHORT_SQL),
    "clip_series": (
        clip_series,
        _cut(
            _risk_sql(NOT_LAST), 'legend_text, "YEAR", type, value',
            f'type IN ({B.quoted(CHARTED)}) AND "YEAR" BETWEEN 1996 AND 2000 AND value BETWEEN 0.9 AND 1.1',
        ),
    ),
    "series_groups": (
        series_groups,
        _cut(_risk_sql(NOT_LAST), '"YEAR", type, value, legend_text', f"type IN ({B.quoted(CHARTED)})"),
    ),
    "label_map": (label_map, LABEL_SQL),
    "series_flag": (
        series_flag,
        f"""{B.STATE} SELECT "YEAR", CASE WHEN race = 'sumrace' THEN 'all' ELSE 'not_all' END AS size,
        CAST(sum(ENR_) AS BIGINT) AS enr FROM state_long GROUP BY 1, 2""",
    ),
    "hp_merge": (
        hp_merge,
        f"""{B.STATE} SELECT "YEAR", STATE_CODE, CASE WHEN race = 'HP' THEN 'AI' ELSE race END AS race_fixed,
        CAST(sum(ENR_) AS BIGINT) AS enr FROM state_long GROUP BY 1, 2, 3""",
    ),
    "collapse_other": (
        collapse_other,
        f"""{B.STATE} SELECT "YEAR", CASE WHEN race IN ('HI', 'WH', 'AI', 'AS') THEN race ELSE 'OTHER' END AS race_adjusted,
        CAST(sum(ENR_) AS BIGINT) AS enr FROM state_long GROUP BY 1, 2""",
    ),
    "pct_zero_null": (
        pct_zero_null,
        f"""{B.STATE} SELECT "YEAR", STATE_CODE, CASE WHEN race = 'sumrace' THEN 'total' ELSE race END AS race,
        nullif(100 * ((CASE WHEN CORP_ >= 400 THEN CORP_ ELSE 0 END) / nullif(ENR_, 0)), 0) AS pct_ FROM state_long""",
    ),
    "oss_rate_always": (oss_rates("always"), _oss_rate_sql(ALWAYS)),
    "oss_rate_sometime": (oss_rates("sometime"), _oss_rate_sql(SOMETIME)),
    "oss_risk_always": (oss_risks("always"), _risk_sql(ALWAYS, state=OSS_STATE)),
    "oss_risk_all": (oss_risks("all"), _risk_sql("TRUE", state=OSS_STATE)),
    "risk_universe_always": (universe_of(risk_series_cohort, "always"), _cut(_risk_sql(f"{NOT_LAST} AND {ALWAYS}"), "*", IN_UNIVERSE)),
    "risk_universe_sometime": (universe_of(risk_series_cohort, "sometime"), _cut(_risk_sql(f"{NOT_LAST} AND {SOMETIME}"), "*", IN_UNIVERSE)),
    "rate_universe_always": (universe_of(rate_series, "always"), _cut(f"{B.STATE} {_rate_sql(ALWAYS)}", "*", IN_UNIVERSE)),
    "rate_universe_sometime": (universe_of(rate_series, "sometime"), _cut(f"{B.STATE} {_rate_sql(SOMETIME)}", "*", IN_UNIVERSE)),
    "oss_rate_published_all": (oss_published(S.rate_series, "all"), _oss_published_rate_sql("TRUE")),
    "oss_rate_published_always": (oss_published(S.rate_series, "always"), _oss_published_rate_sql(ALWAYS)),
    "oss_rate_published_sometime": (oss_published(S.rate_series, "sometime"), _oss_published_rate_sql(SOMETIME)),
    "oss_risk_published_all": (oss_published(S.risk_series, "all"), _oss_published_risk_sql("TRUE")),
    "oss_risk_published_always": (oss_published(S.risk_series, "always"), _oss_published_risk_sql(ALWAYS)),
    "oss_risk_published_sometime": (oss_published(S.risk_series, "sometime"), _oss_published_risk_sql(f"(STATE_CODE IS NULL OR {SOMETIME})")),
    "oss_rate_universe_all": (universe_of(oss_published, S.rate_series, "all"), _cut(_oss_published_rate_sql("TRUE"), "*", IN_UNIVERSE)),
    "oss_risk_universe_all": (universe_of(oss_published, S.risk_series, "all"), _cut(_oss_published_risk_sql("TRUE"), "*", IN_UNIVERSE)),
    "rate_with_last_year": (rate_with_last_year, WITH_LAST_SQL),
    "oss_rate_with_last_year": (oss_since(S.rate_series), _cut(OSS_RATE_SQL, "*", f'"YEAR" >= {FIRST}')),
    "oss_risk_with_last_year": (oss_since(S.risk_series), _cut(_risk_sql(f"(STATE_CODE IS NULL OR {SOMETIME})", state=OSS_STATE), "*", f'"YEAR" >= {FIRST}')),
    "chart_cp_rate": (chart(rate_series("all"), "cp_rate", (0.2, 0.26), None), _chart_sql(f"{B.STATE} {_rate_sql('TRUE')}", "cp_rate", (0.2, 0.26), False)),
    "chart_oss_rate": (
        chart(oss_published(S.rate_series, "all"), "oss_rate", (0.0, 0.25), None), _chart_sql(_oss_published_rate_sql("TRUE"), "oss_rate", (0.0, 0.25), False),
    ),
    "chart_oss_risk": (chart(oss_published(S.risk_series, "all"), "value", (-0.05, 1.0)), _chart_sql(_oss_published_risk_sql("TRUE"), "value", (-0.05, 1.0))),
    "chart_oss_risk_with_last_year": (
        chart(oss_since(S.risk_series), "value", (0.95, 4.25)),
        _chart_sql(_risk_sql(f"(STATE_CODE IS NULL OR {SOMETIME})", state=OSS_STATE), "value", (0.95, 4.25)),
    ),
    "risk_keep_last_year_all": (with_last_year("all"), _risk_sql("TRUE")),
    "risk_keep_last_year_always": (with_last_year("always"), _risk_sql(ALWAYS)),
}
