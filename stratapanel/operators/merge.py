"""Validated merges.

``merge_one`` (1:1, two or more tables) is a union of the tables followed by one ``groupBy`` on the
key, not a chain of full outer joins.  Every table is shuffled once however many there are, each row
with the columns of its own table in one struct and none of the others'.  As keys do not repeat in a
table, rows are dealt as they are, without folding them before; and null keys meet null keys, as the
merge statement wants.

``merge_many`` (m:1) is a left or inner join to a right side made unique by an aggregate on the
key, so join and aggregate share one shuffle.  A hot key sits on the left only, where Spark's
adaptive skew join splits it; right-only rows are added by an anti join, because a full outer join
cannot be split that way.

``merge_buckets`` (1:1, two tables) is for panels that are kept in buckets by their key: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import quote
from .guards import guard

# The codes of the provenance column.
LEFT_ONLY, RIGHT_ONLY, BOTH = 1, 2, 3
SIDES = {"left": LEFT_ONLY, "right": RIGHT_ONLY, "both": BOTH}


def _key_text(on: Sequence[str]) -> Column:
    return F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in on])


def _text(name: str) -> str:
    """Name as text inside a SQL expression."""
    return "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"


def merge_one(
    tables: Sequence[DataFrame],
    on: Sequence[str],
    indicator: str | None = None,
    keep: Sequence[str] = ("left", "right", "both"),
) -> DataFrame:
    """1:1 merge of two or more tables on ``on``, left to right.

    Where a row already exists, its columns keep their values, null ones too; a later table only
    fills columns nobody had before it, or rows nobody had.  A key that occurs twice in one table
    fails the job.  ``indicator`` (two tables only) names the provenance column 1/2/3.
    """
    on = list(on)
    if len(tables) < 2:
        raise ValueError("a merge needs at least two tables")
    if len(tables) > 2 and (indicator or set(keep) != set(SIDES)):
        raise ValueError("provenance is defined for two tables")
    payload = [[c for c in t.columns if c not in on] for t in tables]
    tagged = [
        t.selectExpr(*map(quote, on), f"{i} AS _side", f"named_struct({', '.join(f'{_text(c)}, {quote(c)}' for c in names)}) AS _t{i}")
        if names
        else t.selectExpr(*map(quote, on), f"{i} AS _side")
        for i, (t, names) in enumerate(zip(tables, payload, strict=True))
    ]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    merged = stacked.repartition(*[F.col(quote(k)) for k in on]).groupBy(*on).agg(
        *[F.expr(f"count_if(_side = {i}) AS _n{i}") for i in range(len(tables))],
        *[F.expr(f"max(_t{i}) AS _t{i}") for i in range(len(tables)) if payload[i]],
    )
    counts = [F.col(f"_n{i}") for i in range(len(tables))]
    unique = reduce(lambda a, b: a & b, [n <= 1 for n in counts])
    merged = guard(merged, unique, F.concat(F.lit(f"not unique on {', '.join(on)}: "), _key_text(on)))
    wanted = {SIDES[k] for k in keep}
    if wanted != set(SIDES.values()):
        left, right = counts[0] > 0, counts[1] > 0
        tests = {LEFT_ONLY: left & ~right, RIGHT_ONLY: ~left & right, BOTH: left & right}
        merged = merged.filter(reduce(lambda a, b: a | b, [tests[w] for w in sorted(wanted)]))

    values: dict[str, str] = {}
    for i, names in enumerate(payload):
        seen = " OR ".join(f"_n{k} > 0" for k in range(i))
        for c in names:
            mine = f"_t{i}.{quote(c)}"
            values[c] = f"CASE WHEN {seen} THEN {values[c]} ELSE {mine} END" if c in values else mine
    out = [quote(k) for k in on] + [f"{v} AS {quote(c)}" for c, v in values.items()]
    if indicator:
        code = f"CASE WHEN _n0 > 0 AND _n1 > 0 THEN {BOTH} WHEN _n0 > 0 THEN {LEFT_ONLY} ELSE {RIGHT_ONLY} END"
        out.append(f"{code} AS {quote(indicator)}")
    return merged.selectExpr(*out)


def once(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """``df`` itself, or an error if a key is repeated or null.  Rows are numbered where they are: those dealt by the key, or by part of
    it, do not move, and nothing but the number is added to them."""
    number = F.row_number().over(Window.partitionBy(*on).orderBy(*on))
    whole = reduce(lambda a, b: a & b, [F.col(quote(k)).isNotNull() for k in on])
    checked = guard(df, whole, F.concat(F.lit(f"a key is null in {', '.join(on)}: "), _key_text(on)))
    numbered = guard(checked.withColumn("_number", number), F.col("_number") == 1, F.concat(F.lit(f"not unique on {', '.join(on)}: "), _key_text(on)))
    return numbered.drop("_number")


def merge_buckets(left: DataFrame, right: DataFrame, on: Sequence[str], indicator: str | None = None) -> DataFrame:
    """1:1 merge of two tables that lie in equally many buckets by ``on`` (``sources.io.write_bucketed``), without a shuffle.

    The rules are those of ``merge_one``, but keys are never null.  The result is no longer in buckets for Spark: write it as such again
    where a third table is to meet it, or give three tables to ``merge_one``.
    """
    on = list(on)
    renamed = {c: f"_r|{c}" for c in right.columns}
    ours = once(left, on).withColumn("_l", F.lit(True))
    theirs = once(right, on).withColumnsRenamed(renamed).withColumn("_r", F.lit(True))
    same = reduce(lambda a, b: a & b, [F.col(quote(k)) == F.col(quote(renamed[k])) for k in on])
    joined = ours.join(theirs, same, "full")
    out = [F.coalesce(F.col(quote(k)), F.col(quote(renamed[k]))).alias(k) for k in on]
    for c in [c for c in left.columns if c not in on]:
        own = F.col(quote(c))
        out.append((F.when(F.col("_l"), own).otherwise(F.col(quote(renamed[c]))) if c in renamed else own).alias(c))
    out += [F.col(quote(renamed[c])).alias(c) for c in right.columns if c not in left.columns]
    if indicator:
        both, mine = F.col("_l") & F.col("_r"), F.col("_l")
        out.append(F.when(both, BOTH).when(mine, LEFT_ONLY).otherwise(RIGHT_ONLY).alias(indicator))
    return joined.select(*out)


def unique_rows(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """``df`` with one row per key, or an error; leaves the rows partitioned on the key."""
    on = list(on)
    rest = [c for c in df.columns if c not in on]
    grouped = df.groupBy(*on).agg(
        F.count(F.lit(1)).alias("_n"), *[F.expr(f"max({quote(c)}) AS {quote(c)}") for c in rest]
    )
    message = F.concat(F.lit(f"not unique on {', '.join(on)}: "), _key_text(on))
    return guard(grouped, F.col("_n") == 1, message).select(*df.columns)


def checked(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """``df`` as it is, or an error if a key is repeated.

    Only the keys are counted, folded before they move; the rows meet one value, the number of repeated keys, and stay where they are.
    """
    on = list(on)
    repeated = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    found = repeated.agg(F.count(F.lit(1)).alias("_repeated"), F.min(_key_text(on)).alias("_example"))
    message = F.concat(F.lit(f"not unique on {', '.join(on)}: "), F.col("_example"))
    return guard(df.crossJoin(F.broadcast(found)), F.col("_repeated") == 0, message).select(*[F.col(quote(c)) for c in df.columns])


def merge_many(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    indicator: str | None = None,
    keep: Sequence[str] = ("left", "right", "both"),
    null_keys_match: bool = True,
) -> DataFrame:
    """m:1 merge: ``right`` must be unique on ``on``; overlapping columns keep the left value.

    ``null_keys_match=False`` declares that keys are never null, which lets the join reuse the
    partitioning of the uniqueness check.
    """
    on = list(on)
    wanted = {SIDES[k] for k in keep}
    extra = [c for c in right.columns if c not in on and c not in left.columns]
    lookup = unique_rows(right, on)
    marked = lookup.select(
        *[F.col(k).alias(f"_r|{k}") for k in on], F.lit(True).alias("_right"), *[F.col(f"`{c}`") for c in extra]
    )

    def same(k: str) -> Column:
        a, b = F.col(k), F.col(f"`_r|{k}`")
        return a.eqNullSafe(b) if null_keys_match else a == b

    matches = reduce(lambda a, b: a & b, [same(k) for k in on])
    columns = [F.col(f"`{c}`") for c in left.columns + extra]
    found = F.col("_right").isNotNull()
    parts = []
    if LEFT_ONLY in wanted:
        joined = left.join(marked, matches, "left")
        if BOTH not in wanted:
            joined = joined.filter(~found)
        code = F.when(found, BOTH).otherwise(LEFT_ONLY)
        parts.append(joined.select(*columns, *([code.alias(indicator)] if indicator else [])))
    elif BOTH in wanted:
        joined = left.join(marked, matches, "inner")
        parts.append(joined.select(*columns, *([F.lit(BOTH).alias(indicator)] if indicator else [])))
    if RIGHT_ONLY in wanted:
        keys = left.select(*on).distinct().select(*[F.col(k).alias(f"_r|{k}") for k in on])
        alone = lookup.join(keys, matches, "left_anti")
        filled = [
            F.col(f"`{c}`") if c in right.columns else F.lit(None).cast(left.schema[c].dataType).alias(c)
            for c in left.columns + extra
        ]
        parts.append(alone.select(*filled, *([F.lit(RIGHT_ONLY).alias(indicator)] if indicator else [])))
    return reduce(DataFrame.unionByName, parts)


def merge_report(df: DataFrame, indicator: str = "_merge") -> DataFrame:
    """Row counts per provenance code."""
    return df.groupBy(indicator).agg(F.count(F.lit(1)).alias("n"))


def stack_panel(
    by_year: dict[int, Sequence[DataFrame]], on: Sequence[str], merged: bool = True
) -> DataFrame:
    """Panel of many tables: those of one year are merged 1:1, years are put under one another.

    Replaces a chain of full outer merges whose inputs mostly hold different years.  A key that is
    twice in one table stops the job; ``merged=False`` says that keys are unique and the tables of a
    year disjoint, and costs no shuffle.
    """
    years = []
    for tables in by_year.values():
        tables = list(tables)
        if len(tables) > 1 and merged:
            years.append(merge_one(tables, on))
        elif merged:
            years += [checked(t, on) for t in tables]
        else:
            years += tables
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), years)
