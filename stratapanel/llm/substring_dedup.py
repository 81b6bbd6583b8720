"""Removal of passages that occur more than once (operator 9).

Every window of `window` consecutive words gets a Rabin-Karp hash. Documents are dealt into chunks; a chunk sends each of its
distinct hashes once to the hash's bucket, a bucket counts in how many chunks a hash occurs and answers the chunks that hold
a repeated one, and the chunk merges the repeated windows into maximal intervals and takes those words out. What moves is the
text once and eight bytes for a distinct window of a chunk, so a passage that fills a third of the table costs its bucket one
entry for a chunk and not one for a row. A hash has 64 bits; the bucket comes from a second, independent one, so two windows are
mixed up only if both agree.

Numbers of chunks and buckets follow from the bytes of text, so that each stays small at any size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapanel.llm import exchange, store
from stratapanel.llm.exchange import from_planes, to_planes
from stratapanel.llm.words import U64, Words, byte_column, slices

WINDOW = 35


def window_hashes(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and second hash of every window of some texts."""
    one, two = [], []
    for low, high in slices(texts):
        words = Words(texts[low:high])
        one.append(words.windows(window)[0])
        two.append(words.windows(window, salt=7)[0])
    return (np.concatenate(one), np.concatenate(two)) if one else (np.zeros(0, U64), np.zeros(0, U64))


def emitter(window: int, buckets: int):
    def emit(docs: pa.Table) -> pa.Table:
        one, two = window_hashes(byte_column(docs["text"]), window)
        one, first = np.unique(one, return_index=True)
        entries = exchange.by_bucket((two[first] % U64(buckets)).astype(np.int64))
        chunk = docs["chunk"][0].as_py()
        return pa.table(
            {
                "bucket": pa.array([b for b, _ in entries], pa.int32()),
                "chunk": pa.array([chunk] * len(entries), pa.int32()),
                "hashes": pa.array([to_planes(one[at]) for _, at in entries], pa.binary()),
            }
        )

    return emit


def repeated(entries: pa.Table) -> pa.Table:
    """Of one bucket: to each chunk, which of its hashes other chunks hold too."""
    held = [from_planes(x) for x in entries["hashes"].to_pylist()]
    every = np.concatenate(held)
    order = np.argsort(every, kind="stable")
    same = every[order[1:]] == every[order[:-1]]
    common = np.zeros(len(every), bool)
    common[order[1:][same]] = common[order[:-1][same]] = True
    chunks, answers, at = [], [], 0
    for chunk, own in zip(entries["chunk"].to_pylist(), held, strict=True):
        if len(found := own[common[at : at + len(own)]]):
            chunks.append(chunk)
            answers.append(to_planes(found))
        at += len(own)
    return pa.table({"chunk": pa.array(chunks, pa.int32()), "hashes": pa.array(answers, pa.binary())})


def remover(window: int):
    def remove(docs: pa.Table, answers: pa.Table) -> pa.Table:
        elsewhere = np.concatenate([np.zeros(0, U64), *(from_planes(x) for x in answers["hashes"].to_pylist())])
        texts = byte_column(docs["text"])
        parts = [Words(texts[low:high]) for low, high in slices(texts)]
        held = [words.windows(window) for words in parts]
        values, counts = np.unique(np.concatenate([np.zeros(0, U64), *(h for h, _ in held)]), return_counts=True)
        wanted = np.union1d(elsewhere, values[counts > 1])
        totals, removed, kept, intervals = [], [], [], []
        for words, (hashes, at) in zip(parts, held, strict=True):
            gone = words.covered(at[np.isin(hashes, wanted)], window)
            lost = words.per_text(gone)
            data = words.data.tobytes()
            for i, n in enumerate(words.count):
                own = data[words.begin[i] : words.begin[i + 1]].split()
                if lost[i]:
                    flags = gone[words.first[i] : words.first[i + 1]]
                    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False]))))
                    intervals.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
                    own = [w for w, out in zip(own, flags.tolist(), strict=True) if not out]
                else:
                    intervals.append([])
                kept.append(b" ".join(own))
                totals.append(int(n))
                removed.append(int(lost[i]))
        return pa.table(
            {
                "doc_id": docs["doc_id"],
                "n_words": pa.array(totals, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "kept": pa.array(kept, pa.binary()).cast(pa.string()),
                "removed": pa.array(intervals, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            }
        )

    return remove


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_words, n_removed, kept (the words left, joined by one space) and removed
    (word intervals, end exclusive).

    A word goes if it lies in a window of `window` words whose words also start anywhere else in the table, in the same text
    included; windows are judged on the table as given, so every copy of a passage goes. Null and empty texts, and texts
    shorter than a window, have no window and keep what they have. Repeated rows count as often as they occur and are dealt by their place
    in their file, so that any number of them spreads. Texts of any length are taken whole. Other columns are
    ignored, whatever their names. An empty table gives an empty result.
    """
    keyed, key = exchange.numbered(docs)
    base = keyed.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(key).alias("row_key"))
    chunks, buckets = exchange.sizes(store.text_bytes(base, "text"))
    dealt = base.withColumn("chunk", exchange.chunk_of(chunks, "row_key")).drop("row_key")
    answers = (
        dealt.groupBy("chunk").applyInArrow(emitter(window, buckets), "bucket int, chunk int, hashes binary")
        .groupBy("bucket").applyInArrow(repeated, "chunk int, hashes binary")
    )
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        remover(window), "doc_id long, n_words long, n_removed long, kept string, removed array<struct<start:long,end:long>>"
    )


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = remove_repeats(store.table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
with docs as (
    select doc_id, row_number() over () as r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
),
starts as (select r, w, unnest(range(1, len(w) - 33)) as i from docs where len(w) >= 35),
windows as (select r, i, array_to_string(w[i:i + 34], ' ') as k from starts),
common as (select k from windows group by k having count(*) > 1),
gone as (select distinct r, unnest(range(i, i + 35)) as i from windows where k in (select k from common)),
every as (select r, unnest(range(1, len(w) + 1)) as i, unnest(w) as word from docs),
kept as (
    select e.r, count(g.i) as n_removed, string_agg(e.word, ' ' order by e.i) filter (where g.i is null) as text
    from every e left join gone g on g.r = e.r and g.i = e.i group by e.r
)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(k.n_removed, 0) as bigint) as n_removed,
    sha256(coalesce(k.text, '')) as kept_sha256
from docs d left join kept k on k.r = d.r
"""
