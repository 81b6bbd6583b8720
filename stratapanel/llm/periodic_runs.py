"""Runs of words that repeat with a period (operator 13), by an online sparse diagonal DP.

A run is a stretch of words in which words `q` apart are identical for its smallest such `q`, at least max(6, 4 q) words long, that
neither neighbour extends. In the table of all pairs of words a run is a diagonal: lag q, one match a word, `length - q` matches.
Going through a text, a word's earlier occurrences lengthen the diagonals of their lags by one; a diagonal that its next word does
not lengthen has ended, and is a run if it is long enough.

Common words would open a diagonal for nearly every pair, so only occurrences count that are preceded by the same words: lags up to
5 ask for 5 equal words, lags of 6 to 10 for 10, of 11 to 20 for 20, and so on, which a run's `length - q` matches always hold. Of these
occurrences the nearest suffices: within a run of smallest period q, a nearer one at q' of `width >= q` equal words would make
gcd(q, q') a period as well. Each width therefore has one active diagonal at a time, and a text of n words costs O(n log n) at any
content, one word repeated throughout included. Diagonals of all texts of a slab advance together, as numpy arrays.

Every text is looked at in one task, whole; nothing is shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapanel.llm import store
from stratapanel.llm.words import U64, Words, byte_column, mix, powers, slices

LEAST, TIMES = 6, 4
#: Equal words that every run holds at its lag, max(LEAST, TIMES q) - q, is 5 for a lag of 1 and 3 q beyond.
FIRST_WIDTH = LEAST - 1
BASE = 0xD1342543DE82EF95
Run = tuple[int, int, int]


def nearest(own: np.ndarray, text: np.ndarray, width: int) -> np.ndarray:
    """For each word, how far back the same `width` words last ended in its text; 0 where they did not."""
    lag = np.zeros(len(own), np.int64)
    if len(own) < width:
        return lag
    sums = np.zeros(len(own) + 1, U64)
    np.cumsum(own * powers(len(own), BASE), out=sums[1:])
    held = (sums[width:] - sums[:-width]) * powers(len(own) + 1, pow(BASE, -1, 2**64))[: len(own) - width + 1]
    end = np.flatnonzero(text[width - 1 :] == text[: len(text) - width + 1]) + width - 1
    key = mix(held[end - width + 1] + mix(text[end].astype(U64), 41), 43)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    lag[end[order[1:][same]]] = end[order[1:][same]] - end[order[:-1][same]]
    return lag


def ended(lag: np.ndarray, text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and lag of the diagonals of this width that end long enough."""
    wanted = (lag > (0 if width == FIRST_WIDTH else width // 2)) & (lag <= width)
    at = np.flatnonzero(wanted)
    if not len(at):
        return at, at, at
    opens = np.flatnonzero(np.concatenate(([True], (np.diff(at) > 1) | (np.diff(lag[at]) != 0) | (np.diff(text[at]) != 0))))
    closes = np.concatenate((opens[1:], [len(at)])) - 1
    period = lag[at[opens]]
    start = at[opens] - width + 1 - period
    length = at[closes] - start + 1
    long = length >= np.maximum(LEAST, TIMES * period)
    return start[long], length[long], period[long]


def runs_of(own: np.ndarray, first: np.ndarray) -> dict[int, list[Run]]:
    """Runs (start, length, period) by text, in order; `first` has each text's first word, and the number of words at its end."""
    found: dict[int, list[Run]] = defaultdict(list)
    size = np.diff(first)
    text = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(text)) - np.repeat(first[:-1], size)
    width = FIRST_WIDTH
    while len(own):
        lag = nearest(own, text, width)
        for start, length, period in zip(*(x.tolist() for x in ended(lag, text, width)), strict=True):
            found[int(text[start])].append((int(place[start]), length, period))
        # longer lags need `width` equal words as well, and TIMES lags of room
        stays = np.zeros(len(size), bool)
        stays[text[lag > 0]] = True
        stays &= size >= TIMES * (width + 1)
        keep = stays[text]
        own, text, place = own[keep], text[keep], place[keep]
        width *= 2
    return {i: sorted(runs) for i, runs in found.items()}


def collapsed(own: list[bytes], runs: list[Run]) -> bytes:
    """The words without what each run holds after its first period."""
    change = np.zeros(len(own) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([w for w, out in zip(own, np.cumsum(change[:-1]).tolist(), strict=True) if not out])


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, n_words, runs (start, length and period in words, by start, then period) and collapsed
    (the words joined by one space, without what lies in a run after its first period).

    Runs may overlap; a word goes if any of them drops it. Null, empty and wordless texts have no run and an empty collapsed text. Texts
    of any length are taken whole. Repeated rows are looked at each; rows without a doc_id like others; further columns are ignored,
    whatever their names; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_column(batch.column(1))
            for low, high in slices(texts):
                words = Words(texts[low:high])
                found = runs_of(words.hash, words.first)
                kept = [text.split() for text in texts[low:high]]
                kept = [collapsed(own, found[i]) if i in found else b" ".join(own) for i, own in enumerate(kept)]
                runs = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in found.get(i, ())] for i in range(high - low)]
                columns = [
                    batch.column(0).slice(low, high - low), pa.array(words.count, pa.int64()),
                    pa.array(runs, pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return base.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; a tenth of the texts, chosen by crc32 of doc_id, repeat a few of their own words from some word on."""
    h, words = "crc32(cast(doc_id as string))", r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)"
    rows = docs.select("doc_id", "text", F.expr(f"if({h} % 10 = 0, {words}, null)").alias("w"), F.expr(f"{h} div 10").alias("g"))
    rows = rows.withColumn("n", F.size("w").cast("long")).withColumn("a", F.expr("if(n > 0, cast(g % n as int), null)"))
    rows = rows.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    text = "concat_ws(' ', slice(w, 1, a), flatten(array_repeat(slice(w, a + 1, p), cast((n - a) div p as int))), slice(w, a + 1, cast((n - a) % p as int)))"
    return rows.select("doc_id", F.expr(f"if(n > 0, {text}, text)").alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(with_planted_runs(store.table(spark, sf_dir, "documents")))
    longest = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as before, -r.period as briefer)))")
    rows = found.withColumn("longest", longest)
    length, period = F.col("longest.length"), -F.col("longest.briefer")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.before")).alias("start"), length.alias("length"), period.alias("period"),
        F.expr("1000 * longest.length div -longest.briefer").alias("exponent_milli"),
        F.expr("sha2(array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), ''), 256)").alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: crc32 of a string of ASCII characters, bit by bit.
CRC32 = """xor(list_reduce(list_prepend(cast(4294967295 as ubigint), list_transform(string_split({}, ''), lambda x: cast(ord(x) as ubigint))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), cast(range(8) as ubigint[])),
        lambda d, k: case when d % 2 = 1 then xor(d // 2, cast(3988292384 as ubigint)) else d // 2 end)), cast(4294967295 as ubigint))"""

ORACLE = rf"""
with given as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w, cast({CRC32.format("cast(doc_id as varchar)")} as bigint) as h from documents
),
placed as (select *, len(w) as n, h // 10 as g, (h // 10) % greatest(len(w), 1) as a from given),
cut as (select *, 1 + (n - a) // (3 + g % 8) as p from placed),
docs as (
    select row_number() over () as r, doc_id, n,
        case when h % 10 = 0 and n > 0 then list_transform(range(n), lambda i: w[1 + case when i >= a then a + (i - a) % p else i end]) else w end as w
    from cut
),
grams as (select r, n, i, array_to_string(w[i + 1:i + 5], ' ') as k from (select r, n, w, unnest(range(0, n - 4)) as i from docs where n >= 5)),
matches as (select y.r, y.i, y.i - x.i as q from grams x join grams y on x.r = y.r and x.k = y.k and y.i > x.i and 4 * (y.i - x.i) <= y.n),
stretches as (
    select r, q, min(i) - q as start, max(i) + 5 as stop from (select *, i - row_number() over (partition by r, q order by i) as island from matches) group by r, q, island
),
long as (select * from stretches where stop - start >= greatest(6, 4 * q)),
runs as (
    select r, start, stop, q, stop - start as length from long x
    where not exists (select 1 from long y where y.r = x.r and y.q < x.q and y.start <= x.start and y.stop >= x.stop)
),
gone as (select distinct r, unnest(range(start + q, stop)) as i from runs),
every as (select r, unnest(range(0, n)) as i, unnest(w) as word from docs),
kept as (select e.r, string_agg(e.word, ' ' order by e.i) filter (where g.i is null) as text from every e left join gone g on g.r = e.r and g.i = e.i group by e.r),
found as (
    select r, count(*) as n_runs, string_agg(concat(start, ',', length, ',', q, chr(10)), '' order by start, q) as said,
        first(start order by length desc, start, q) as start, max(length) as length, first(q order by length desc, start, q) as period
    from runs group by r
)
select d.doc_id, cast(coalesce(f.n_runs, 0) as bigint) as n_runs, cast(f.start as bigint) as start, cast(f.length as bigint) as length, cast(f.period as bigint) as period,
    cast(1000 * f.length // f.period as bigint) as exponent_milli, sha256(coalesce(f.said, '')) as runs_sha256, sha256(coalesce(k.text, '')) as collapsed_sha256
from docs d left join found f on f.r = d.r left join kept k on k.r = d.r
"""
