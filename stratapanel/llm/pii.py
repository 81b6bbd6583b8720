"""Personal data in texts (operator 1), with DataFrame and SQL functions only.

Regular expressions propose spans, checksums (Luhn, modulo 97) and ranges confirm them, and words near a span adjust its
score. The kinds of the base stay whatever their score; the added kinds need at least `LEAST_SCORE`.

Places come from the pieces between matches: the n-th match starts after the first n pieces and n - 1 matches. The patterns are
written so that each place of a text is tried about once and no repetition nests in Java's matcher, so that long runs of letters
or digits neither take quadratic time nor exhaust the stack. Every row is worked on where it is; nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapanel.llm import store

LEAST_SCORE = 0.5
CONTEXT_SCORE = 0.2
CONTEXT_CHARS = 40
BLOCK = 256


@dataclass(frozen=True)
class Kind:
    name: str
    hint: str  # a cheap SQL test on `text` that every text with a match passes
    pattern: str
    valid: str  # SQL on the match `m`
    score: float
    context: str  # words that make the kind likelier
    base: bool = True


DIGITS = r"regexp_replace(m, '[^0-9]', '')"
PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?"
BARE = "replace(m, ' ', '')"
IBAN_MOD = (
    f"aggregate(split(concat(substring({BARE}, 5), left({BARE}, 4)), ''), 0, "
    "(r, c) -> case when c = '' then r when ascii(c) >= 65 then (r * 100 + ascii(c) - 55) % 97 else (r * 10 + ascii(c) - 48) % 97 end)"
)

KINDS = (
    Kind(
        "email", "contains(text, '@')",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true", 0.8, "e-?mails?|contact|write|address",
    ),
    Kind(
        "ip", r"text rlike '[0-9]\\.[0-9]'",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", f"m rlike '^{PART}(?:\\\\.{PART}){{3}}$'", 0.6, "ip|address|server|host|login",
    ),
    Kind(
        "card", r"text rlike '[0-9](?:[\\x20-]?[0-9]){11}'",
        r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])", f"luhn_check({DIGITS})", 0.7, "cards?|credit|debit|visa|payment|paid",
    ),
    Kind(
        "phone", "contains(text, '+')",
        r"\+[0-9][\x20().0-9-]+[0-9]", f"length({DIGITS}) between 9 and 15", 0.6, "phone|tel|call|mobile|fax|whatsapp",
    ),
    Kind(
        "iban", "text rlike '[A-Z]{2}[0-9]{2}'",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", f"{IBAN_MOD} = 1", 0.8,
        "iban|bank|account|transfer", base=False,
    ),
    Kind(
        "ssn", "text rlike '[0-9]-[0-9]{2}-[0-9]'",
        r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "true", 0.35, "ssn|social|security", base=False,
    ),
)


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def running(docs: DataFrame, values: str, fold: str, out: str) -> DataFrame:
    """Adds the fold (from 0) of each prefix of an array column, in blocks: the work for n values grows as n * BLOCK, not n * n."""
    blocks = f"transform(sequence(0, (size({values}) - 1) div {BLOCK}), b -> aggregate(slice({values}, b * {BLOCK} + 1, {BLOCK}), 0, {fold}))"
    before = "transform(sequence(0, size(__b) - 1), j -> aggregate(slice(__b, 1, j), 0, {0}))".format(fold)
    within = f"transform(sequence(0, size({values}) - 1), i -> aggregate(slice({values}, (i div {BLOCK}) * {BLOCK} + 1, i % {BLOCK} + 1), __c[i div {BLOCK}], {fold}))"
    none, empty = f"size({values}) = 0", "cast(array() as array<int>)"
    for name, value in (("__b", blocks), ("__c", before), (out, within)):
        docs = docs.withColumn(name, F.expr(f"case when {none} then {empty} else {value} end"))
    return docs.drop("__b", "__c")


def with_spans(docs: DataFrame) -> DataFrame:
    """`docs` has a column text without nulls; adds spans: struct(start, rank, end, kind, score), ordered."""
    none = "cast(array() as array<struct<start:int,rank:int,end:int,kind:string,score:double>>)"
    for k in KINDS:
        docs = docs.withColumn(f"m_{k.name}", F.expr(f"case when {k.hint} then regexp_extract_all(text, {quoted(k.pattern)}, 0) else array() end"))
    for k in KINDS:
        m = f"m_{k.name}"
        steps = (
            f"case when size({m}) = 0 then cast(array() as array<int>) else transform(slice(split(text, {quoted(k.pattern)}, -1), 1, size({m})), "
            f"(p, i) -> length(p) + case when i = 0 then 0 else length({m}[i - 1]) end) end"
        )
        docs = docs.withColumn(f"d_{k.name}", F.expr(steps))
    for k in KINDS:
        docs = running(docs, f"d_{k.name}", "(a, x) -> a + x", f"s_{k.name}")
    parts = []
    for rank, k in enumerate(KINDS):
        near = (
            f"lower(concat(substring(text, greatest(1, s + 1 - {CONTEXT_CHARS}), least(s, {CONTEXT_CHARS})), ' ', "
            f"substring(text, s + length(m) + 1, {CONTEXT_CHARS}))) rlike '\\\\b(?:{k.context})\\\\b'"
        )
        # score is worked out for confirmed spans only
        struct = (
            f"named_struct('start', s, 'rank', {rank}, 'end', s + length(m), 'kind', '{k.name}', "
            f"'score', least(1.0D, {k.score}D + case when {near} then {CONTEXT_SCORE}D else 0.0D end))"
        )
        span = f"zip_with(s_{k.name}, m_{k.name}, (s, m) -> case when {k.valid} then {struct} end)"
        test = "x is not null" if k.base else f"x.score >= {LEAST_SCORE}"
        parts.append(f"case when size(m_{k.name}) = 0 then {none} else filter({span}, x -> {test}) end")
    docs = docs.withColumn("spans", F.expr(f"sort_array(concat({', '.join(parts)}))"))
    return docs.drop(*[f"{p}_{k.name}" for k in KINDS for p in "mds"])


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, text (null becomes empty) and spans.

    spans: array of struct(start, rank, end, kind, score), by start and then by kind; code points, end exclusive; spans of one
    kind do not overlap. Null and empty texts have none. Repeated rows are searched each; other columns are ignored; an empty
    table gives an empty result.
    """
    return with_spans(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with every span of `text` replaced by its kind in brackets, overlapping spans by that of the first; all columns
    and rows stay, and a null text stays null."""
    inner = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = running(with_spans(inner).withColumn("ends", F.expr("transform(spans, x -> x.end)")), "ends", "(a, x) -> greatest(a, x)", "reach")
    # a span that starts before the end of those ahead of it joins them
    heads = "filter(transform(spans, (x, i) -> named_struct('i', i, 'x', x)), y -> y.i = 0 or y.x.start >= reach[y.i - 1])"
    found = found.withColumn("heads", F.expr(heads))
    piece = "substring(text, {0} + 1, y.x.start - {0})".format("case when k = 0 then 0 else reach[y.i - 1] end")
    body = f"array_join(transform(heads, (y, k) -> concat({piece}, '[', upper(y.x.kind), ']')), '')"
    clean = F.expr(f"case when size(spans) = 0 then row.`{text}` else concat({body}, substring(text, reach[size(reach) - 1] + 1)) end")
    return found.select(*[clean.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(store.table(spark, sf_dir, "documents"))
    base = [k.name for k in KINDS if k.base]

    def count(name: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == name)).cast("long").alias(f"n_{name}")

    of_base = F.filter("spans", lambda x: x["kind"].isin(base))
    return found.select("doc_id", *map(count, base), F.sha2(joined(of_base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


#: The base kinds by their patterns; spans of the added kinds, which need lookaround, are left to the tests.
ORACLE = r"""
with docs as (select doc_id, row_number() over () as r, coalesce(text, '') as t from documents),
found as (
    select r, 0 as rank, 'email' as kind, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') as ms,
        string_split_regex(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') as ps from docs
    union all select r, 1, 'ip', regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'),
        string_split_regex(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') from docs
    union all select r, 2, 'card', regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), string_split_regex(t, '[0-9]([\x20-]?[0-9])+') from docs
    union all select r, 3, 'phone', regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), string_split_regex(t, '\+[0-9][\x20().0-9-]+[0-9]') from docs
),
places as (
    select r, rank, kind, ms[k] as m, regexp_replace(ms[k], '[^0-9]', '', 'g') as digits,
        cast(list_sum(list_transform(ps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0) as bigint) as start
    from (select *, unnest(range(1, len(ms) + 1)) as k from found where len(ms) > 0)
),
fine as (
    select r, rank, kind, start, start + length(m) as stop from places
    where kind = 'email'
        or (kind = 'ip' and list_bool_and(list_transform(string_split(m, '.'), lambda x: coalesce(try_cast(x as bigint), 999) <= 255)))
        or (kind = 'phone' and length(digits) between 9 and 15)
        or (kind = 'card' and length(digits) between 12 and 19 and list_sum(list_transform(range(0, length(digits)), lambda i:
            cast(substring(digits, length(digits) - i, 1) as bigint) * (1 + i % 2)
            - case when cast(substring(digits, length(digits) - i, 1) as bigint) * (1 + i % 2) > 9 then 9 else 0 end)) % 10 = 0)
),
joined as (
    select r, string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) as spans, count_if(kind = 'email') as n_email,
        count_if(kind = 'ip') as n_ip, count_if(kind = 'card') as n_card, count_if(kind = 'phone') as n_phone from fine group by r
)
select d.doc_id, cast(coalesce(n_email, 0) as bigint) as n_email, cast(coalesce(n_ip, 0) as bigint) as n_ip, cast(coalesce(n_card, 0) as bigint) as n_card,
    cast(coalesce(n_phone, 0) as bigint) as n_phone, sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from docs d left join joined j on j.r = d.r
"""
