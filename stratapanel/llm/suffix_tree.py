"""Scoring texts with a probabilistic suffix tree (operator 3).

A text is its words, A-Z lower-cased, each spelled in bytes and followed by a space, then an end mark. The tree predicts the
next symbol from the longest retained context before it. A context of up to `DEPTH` symbols is retained if it occurs at least
`LEAST_COUNT` times in training texts and its next-symbol distribution diverges from that of the context one symbol shorter: count times
Kullback-Leibler divergence (nats), half a chi-square under no divergence, beyond its quantile `BEYOND`. The suffixes of a retained
context that are longer than `SHORT` are retained too. Distributions are smoothed towards that of the next shorter retained context, the
empty context's towards the even one.

All training texts are counted, and more evidence admits more contexts. A chunk of rows sends each distinct context and symbol once,
with its count, to the bucket of the last `SHORT` + 1 symbols of the context. All longer contexts that end in these and all that follows
them meet there, so the bucket counts, tests and smooths its part of the tree and answers each chunk with probabilities. Counts after
`SHORT` symbols, no more than 256 ** 3 numbers at any size of table and some hundred thousand on text, are added up before and go to
all buckets. A word's count over the whole table, for the unigram base score, takes the same way. No model is ever in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapanel.llm import exchange, store
from stratapanel.llm.words import FOLD, U64, Words, byte_column, mix, slices

DEPTH, SHORT = 6, 2
LEAST_COUNT = 8
BEYOND = 3.09  # of the normal distribution: one in a thousand
WEIGHT = 10.0
END_WORD = U64(0xE0D)
FOLD_ROWS = 4_000_000
Counts = tuple[np.ndarray, np.ndarray]


def spelled(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of some texts in one array, each text after `depth` end marks, and where each text begins and ends in it."""
    bodies = [b" ".join([*t.lower().split(), b""]) + b"\n" for t in texts]
    pad = b"\n" * depth
    size = np.fromiter((len(b) for b in bodies), np.int64, len(bodies))
    ends = np.cumsum(size + depth)
    return np.frombuffer(b"".join([x for b in bodies for x in (pad, b)]), np.uint8), ends - size, ends


def inside(length: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    change = np.zeros(length + 1, np.int8)
    change[begin] += 1
    change[end] -= 1
    return np.cumsum(change[:-1], dtype=np.int8) > 0


def positions(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Every symbol with the `depth` before it (7 at most), packed into one number, text by text; and the symbols of each text."""
    symbols, begin, end = spelled(texts, depth)
    n = len(symbols) - depth
    data = symbols.tobytes() + bytes(15)
    code = np.empty(n + 7, np.int64)
    for k in range(8):  # each eighth window of 8 bytes
        own = code[k::8]
        own[:] = np.frombuffer(data, ">i8", len(own), k)
    code = (code[:n].view(U64) >> U64(8 * (7 - depth))).view(np.int64)
    return code[inside(len(symbols), begin, end)[depth:]], end - begin


def begins(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    change = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=change[1:])
    return np.flatnonzero(change)


def merged(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts of the same codes added up, codes in order; the codes' order before and where each distinct one begins in it. A stable sort
    merges what is in order already, which takes codes that come as some sorted runs a tenth of the time of other sorts."""
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = begins(codes)
    return codes[first], np.add.reduceat(n[order], first) if len(n) else n, order, first


def placed(order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each value sorted by `order`: which of the runs that begin at `first` has it."""
    place = np.empty(len(order), np.int64)
    place[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    return place


def folded(held: list[Counts]) -> Counts:
    """Counts of the same codes added up, codes in order."""
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return merged(np.concatenate([c for c, _ in held]), np.concatenate([n for _, n in held]))[:2]


def gram_counts(texts: list[bytes], train: np.ndarray, depth: int) -> Counts:
    """The distinct codes of some texts, and how often each occurs in the training ones (`depth` 6 at most)."""
    held = []
    for low, high in slices(texts):
        codes, size = positions(texts[low:high], depth)
        marked = codes << 1 | np.repeat(train[low:high], size)
        marked.sort()
        codes = marked >> 1
        first = begins(codes)
        held.append((codes[first], np.add.reduceat(marked & 1, first)))
    return folded(held)


def numbered(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct codes of some texts in order, their order among those first met, which of these each position has, and the positions of
    each text."""
    codes, size = positions(texts, depth)
    place, distinct = pd.factorize(codes)
    order = np.argsort(distinct)
    return distinct[order], order, place.astype(np.int32), size


def short_counts(docs: DataFrame) -> Counts:
    """How often each symbol follows each `SHORT` symbols in training texts (columns text, held_out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Counts] = []
        for batch in batches:
            texts = byte_column(batch.column(0))
            for low, high in slices(texts):
                codes = np.sort(positions(texts[low:high], SHORT)[0].astype(np.int32))
                first = begins(codes)
                held.append((codes[first].astype(np.int64), np.diff(np.append(first, len(codes)))))
                held = held if len(held) < 16 else [folded(held)]
        codes, n = folded(held)
        yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(n, pa.int64())], names=["code", "n"])

    found = docs.filter("not held_out").select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").toArrow()
    return found["code"].to_numpy(), found["n"].to_numpy()


def quantile(freedom: np.ndarray) -> np.ndarray:
    """Of chi-square, `BEYOND` deviations out (Wilson and Hilferty)."""
    part = 2 / 9 / freedom
    return freedom * (1 - part + BEYOND * np.sqrt(part)) ** 3


def divergent(n: np.ndarray, total: np.ndarray, first: np.ndarray, wider: tuple[np.ndarray, np.ndarray, np.ndarray], least_count: int) -> np.ndarray:
    """Which contexts are retained by their own test. Rows: a symbol's count after its context, the context's total, and the same after the
    context one symbol shorter with the number of symbols that follow that; `first` has each context's first row."""
    wider_n, wider_total, wider_kinds = wider
    seen, gain = n > 0, np.zeros(len(n))
    gain[seen] = n[seen] * np.log(n[seen] / total[seen] / (wider_n[seen] / wider_total[seen]))
    freedom = wider_kinds[first] - 1
    # where one symbol alone follows the shorter context, the longer one cannot diverge
    significant = (freedom > 0) & (2 * np.add.reduceat(gain, first) >= quantile(np.maximum(freedom, 1)))
    return (total[first] >= least_count) & significant


class ShortTree:
    """The tree's contexts of up to `SHORT` symbols."""

    def __init__(self, counts: Counts, least_count: int):
        held = [counts]
        for k in range(SHORT, 0, -1):
            held.insert(0, folded([(held[0][0] & ((1 << 8 * k) - 1), held[0][1])]))
        self.levels: list[dict[str, np.ndarray]] = []
        for k, (codes, n) in enumerate(held):
            context, first, place = np.unique(codes >> 8, return_index=True, return_inverse=True)
            totals = np.add.reduceat(n, first) if len(n) else n
            kept = np.ones(len(context), bool)  # the empty context is always retained
            if k and len(codes):
                kept = divergent(n, totals[place], first, self.at(k - 1, codes & ((1 << 8 * k) - 1))[:3], least_count)
            self.levels.append({"codes": codes, "n": n, "context": context, "total": totals, "kinds": np.diff(np.append(first, len(codes))), "kept": kept})

    def at(self, k: int, codes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of codes with k symbols of context: their count, that of their context, how many symbols follow that, and whether it is retained."""
        level = self.levels[k]
        if not len(level["codes"]):
            none = np.zeros(len(codes), np.int64)
            return none, none, none, none > 0
        own = np.minimum(np.searchsorted(level["codes"], codes), len(level["codes"]) - 1)
        its = np.minimum(np.searchsorted(level["context"], codes >> 8), len(level["context"]) - 1)
        there = level["context"][its] == codes >> 8
        n = np.where(level["codes"][own] == codes, level["n"][own], 0)
        return n, *(np.where(there, level[name][its], 0) for name in ("total", "kinds")), there & level["kept"][its]

    def probability(self, codes: np.ndarray) -> np.ndarray:
        """Of the last symbol of codes with `SHORT` symbols of context."""
        p = np.full(len(codes), 1 / 256)
        for k in range(SHORT + 1):
            n, total, _, kept = self.at(k, codes & ((1 << 8 * (k + 1)) - 1))
            p = np.where(kept, (n + WEIGHT * p) / (total + WEIGHT), p)
        return p


def smoothed(codes: np.ndarray, n: np.ndarray, tree: ShortTree, depth: int, least_count: int) -> np.ndarray:
    """log10 probability of the last symbol of each code, for codes that hold all that follows any context of theirs beyond `SHORT`.

    Codes are distinct, with `depth` symbols of context; a code of n = 0 is only asked about.
    """
    level, back = {depth: (codes, n)}, {}
    for k in range(depth - 1, SHORT, -1):
        *level[k], order, first = merged(level[k + 1][0] & ((1 << 8 * (k + 1)) - 1), level[k + 1][1])
        back[k] = placed(order, first)
    context, kept, place, total = {}, {}, {}, {}
    wider = tree.at(SHORT, level[SHORT + 1][0] & ((1 << 8 * (SHORT + 1)) - 1))[:3]
    for k in range(SHORT + 1, depth + 1):
        own, count = level[k]
        first = begins(own >> 8)
        context[k] = own[first] >> 8
        place[k] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(own))))
        total[k] = np.add.reduceat(count, first)[place[k]]
        kept[k] = divergent(count, total[k], first, wider, least_count)
        if k < depth:
            kinds = np.add.reduceat((count > 0).astype(np.int64), first)[place[k]]
            wider = count[back[k]], total[k][back[k]], kinds[back[k]]
    for k in range(depth - 1, SHORT, -1):
        kept[k][np.searchsorted(context[k], context[k + 1][kept[k + 1]] & ((1 << 8 * k) - 1))] = True
    p = tree.probability(level[SHORT + 1][0] & ((1 << 8 * (SHORT + 1)) - 1))
    for k in range(SHORT + 1, depth + 1):
        own, count = level[k]
        p = np.where(kept[k][place[k]], (count + WEIGHT * p) / (total[k] + WEIGHT), p)
        if k < depth:
            p = p[back[k]]
    return np.log10(p)


def word_counts(words: Words, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word hashes (the end mark's among them), their places, and their counts in training texts."""
    all_hashes = np.concatenate((words.hash, np.full(len(train), END_WORD)))
    weight = np.concatenate((np.repeat(train, words.count), train)).astype(float)
    met, distinct = pd.factorize(all_hashes)
    order = np.argsort(distinct)
    distinct = distinct[order]
    place = placed(order, np.arange(len(order)))[met]
    return distinct, place, np.bincount(place, weights=weight, minlength=len(distinct)).astype(np.int64)


def dealt_places(hashes: np.ndarray, buckets: int) -> dict[int, np.ndarray]:
    # numbers of two bytes are sorted by counting
    return dict(exchange.by_bucket((hashes % U64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)))


def word_buckets(distinct: np.ndarray, buckets: int) -> dict[int, np.ndarray]:
    return dealt_places(mix(distinct, 5), buckets)


def gram_buckets(codes: np.ndarray, buckets: int) -> dict[int, np.ndarray]:
    """By the last `SHORT` + 1 symbols of the context."""
    ends = ((codes >> 8) & ((1 << 8 * (SHORT + 1)) - 1)).astype(U64)
    return dealt_places(mix(ends, 9), buckets)


def asker(buckets: int, depth: int):
    def ask(docs: pa.Table) -> pa.Table:
        texts, train = byte_column(docs["text"]), ~docs["held_out"].to_numpy()
        distinct, _, counts = word_counts(Words(texts, fold=FOLD), train)
        of_words = word_buckets(distinct, buckets)
        codes, n = gram_counts(texts, train, depth)
        of_grams = gram_buckets(codes, buckets)
        used = sorted({*of_words, *of_grams})
        none = np.zeros(0, np.int64)
        chunk = docs["chunk"][0].as_py()
        return pa.table(
            {
                "bucket": pa.array(used, pa.int32()),
                "chunk": pa.array([chunk] * len(used), pa.int32()),
                "hashes": pa.array([exchange.to_planes(distinct[of_words.get(b, none)]) for b in used], pa.binary()),
                "counts": pa.array([counts[of_words.get(b, none)].astype("<u4").tobytes() for b in used], pa.binary()),
                "grams": pa.array([exchange.to_planes(codes[of_grams.get(b, none)]) for b in used], pa.binary()),
                "gram_counts": pa.array([n[of_grams.get(b, none)].astype("<u4").tobytes() for b in used], pa.binary()),
            }
        )

    return ask


def totals(entries: pa.Table, keys: str, counts: str) -> Counts:
    """Of one bucket: keys in order and their counts over all chunks, folded on the way."""
    held, waiting = [], 0
    for x, n in zip(entries[keys], entries[counts], strict=True):
        held.append((exchange.from_planes(x.as_py()).astype(np.int64), np.frombuffer(n.as_py(), "<u4").astype(np.int64)))
        waiting += len(held[-1][0])
        if waiting > FOLD_ROWS:
            held, waiting = [folded(held)], 0
    return folded(held)


def answerer(tree: ShortTree, depth: int, least_count: int):
    def answer(entries: pa.Table) -> pa.Table:
        """To each chunk, of what it asked about in its order: the counts of hashes over all training texts, and log10 probabilities."""
        words, counts = totals(entries, "hashes", "counts")
        codes, n = totals(entries, "grams", "gram_counts")
        log10 = smoothed(codes, n, tree, depth, least_count).astype("<f4") if len(codes) else np.zeros(0, "<f4")
        found = [counts[np.searchsorted(words, exchange.from_planes(x.as_py()).astype(np.int64))].astype("<i8").tobytes() for x in entries["hashes"]]
        logs = [log10[np.searchsorted(codes, exchange.from_planes(x.as_py()).astype(np.int64))].tobytes() for x in entries["grams"]]
        return pa.table({"chunk": entries["chunk"], "bucket": entries["bucket"], "counts": pa.array(found, pa.binary()), "log10": pa.array(logs, pa.binary())})

    return answer


def summary(entries: pa.Table) -> pa.Table:
    """Of one bucket: training tokens, and distinct ones."""
    _, counts = totals(entries, "hashes", "counts")
    return pa.table({"tokens": pa.array([int(counts.sum())], pa.int64()), "distinct": pa.array([int((counts > 0).sum())], pa.int64())})


def scorer(buckets: int, depth: int):
    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        texts = byte_column(docs["text"])
        words = Words(texts, fold=FOLD)
        n = len(texts)
        distinct, place, _ = word_counts(words, np.zeros(n, bool))
        counts = np.zeros(len(distinct), np.int64)
        own = word_buckets(distinct, buckets)
        parts = [numbered(texts[low:high], depth) for low, high in slices(texts)]
        codes = np.sort(np.concatenate([part[0] for part in parts]), kind="stable")
        codes = codes[begins(codes)]
        log10 = np.zeros(len(codes), np.float32)
        grams = gram_buckets(codes, buckets)
        none = np.zeros(0, np.int64)
        for bucket, of_words, of_grams in zip(*(answers[c].to_pylist() for c in ("bucket", "counts", "log10")), strict=True):
            counts[own.get(bucket, none)] = np.frombuffer(of_words, "<i8")
            log10[grams.get(bucket, none)] = np.frombuffer(of_grams, "<f4")
        owner = np.concatenate((words.owner(), np.arange(n)))
        logs = np.log10(counts + 0.5)
        scores = []
        for there, order, which, size in parts:
            own_log10 = np.empty(len(there))
            own_log10[order] = log10[np.searchsorted(codes, there)]
            sums = np.cumsum(np.concatenate(([0.0], own_log10[which])))
            ends = np.cumsum(size)
            scores.append(sums[ends] - sums[ends - size])
        return pa.table(
            {
                "doc_id": docs["doc_id"], "held_out": docs["held_out"],
                "n_tokens": pa.array(words.count + 1, pa.int64()),
                "n_known": pa.array(np.bincount(owner, weights=(counts > 0)[place], minlength=n).astype(np.int64)),
                "logs": pa.array(np.bincount(owner, weights=logs[place], minlength=n)),
                "score": pa.array(np.concatenate(scores)),
            }
        )

    return score


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", held_out: Column | None = None, depth: int = DEPTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """One row for each row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    `held_out` marks the rows not to learn from (default: crc32 of the doc_id as text, modulo 5, is 1; a null doc_id counts as an
    empty text). `depth` is at least `SHORT` + 1 and at most 6. Null and empty texts are the end mark alone; texts of any length are taken
    whole. Repeated rows are counted and scored each, and are dealt by their place in their file. Without any training text every symbol is
    equally likely. Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    if not SHORT < depth <= 6:
        raise ValueError(f"depth must be from {SHORT + 1} to 6, not {depth}")
    if held_out is None:
        held_out = F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(5)) == 1
    keyed, key = exchange.numbered(docs)
    base = keyed.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), held_out.alias("held_out"), F.col(key).alias("row_key"))
    tree = ShortTree(short_counts(base), least_count)
    size = store.text_bytes(base, "text")
    chunks, buckets = exchange.sizes(size)
    dealt = base.withColumn("chunk", exchange.chunk_of(chunks, "row_key")).drop("row_key")
    entries = dealt.groupBy("chunk").applyInArrow(asker(buckets, depth), "bucket int, chunk int, hashes binary, counts binary, grams binary, gram_counts binary")
    answers = entries.groupBy("bucket").applyInArrow(answerer(tree, depth, least_count), "chunk int, bucket int, counts binary, log10 binary")
    whole = entries.groupBy("bucket").applyInArrow(summary, "tokens long, distinct long").agg(
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("train_tokens"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("distinct")
    )
    scored = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        scorer(buckets, depth), "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double"
    )
    base_score = F.col("logs") - F.col("n_tokens") * F.log10(F.col("train_tokens") + 0.5 * (F.col("distinct") + 1))
    # `whole` is one row
    return scored.join(F.broadcast(whole), how="cross").select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", base_score.alias("base_score"), "score")


def op3_suffix_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(store.table(spark, sf_dir, "documents"))
