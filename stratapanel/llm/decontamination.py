"""Finding copies of benchmark items in documents (operator 10).

Words are runs of letters and digits, A-Z lower-cased. An item's seeds are its n-grams that are rare, judged by how often their
words occur in all documents: the product of the words' shares, so a passage that leaked into very many documents still has
rare seeds. Each item keeps at least its few rarest. Where a document has a seed, the passage around it is aligned with the
item by Smith-Waterman over words, which forgives replaced, added and missing words; the score is the share of the best possible.

Documents are never shuffled. The items go to every task, in blocks of bounded size: a larger benchmark takes more passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapanel.llm import store
from stratapanel.llm.words import FOLD, U64, Words, byte_column, slices

SEED = 4
RARE = 1e-8
RAREST = 4
BLOCK_WORDS = 500_000
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST_SCORE = 0.5
PLACES = 1 << 22

#: Everything but ASCII letters and digits and the bytes of longer characters separates words.
SEPARATOR = np.ones(256, dtype=bool)
SEPARATOR[48:58] = SEPARATOR[65:91] = SEPARATOR[97:123] = SEPARATOR[128:] = False


def words_of(texts: list[bytes]) -> Words:
    return Words(texts, SEPARATOR, FOLD)


class Lookup:
    """Places of hashes in a sorted array; a table of bits answers most absent ones."""

    def __init__(self, hashes: np.ndarray):
        self.values = np.unique(hashes)
        self.maybe = np.zeros(PLACES, bool)
        self.maybe[(self.values % U64(PLACES)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of `hashes` are there, and their places."""
        at = np.flatnonzero(self.maybe[(hashes % U64(PLACES)).astype(np.int64)])
        place = np.searchsorted(self.values, hashes[at])
        place[place == len(self.values)] = 0
        there = self.values[place] == hashes[at] if len(self.values) else np.zeros(len(at), bool)
        return at[there], place[there]


@dataclass
class Items:
    ids: list[int | None]
    words: list[np.ndarray]
    seeds: dict[int, tuple[Lookup, list[list[tuple[int, int]]]]]  # by n: seeds, and the (item, word) of each


def blocks_of(benchmark: DataFrame, item_id: str, text: str) -> Iterator[tuple[list[int | None], list[np.ndarray]]]:
    """Items with a word, in blocks of at most BLOCK_WORDS words (a longer item stands alone)."""
    ids, held, size = [], [], 0
    for row in benchmark.select(F.col(item_id).cast("long"), F.col(text)).toLocalIterator():
        own = words_of([(row[1] or "").encode()]).hash
        if not len(own):
            continue
        if size and size + len(own) > BLOCK_WORDS:
            yield ids, held
            ids, held, size = [], [], 0
        ids.append(row[0])
        held.append(own)
        size += len(own)
    if ids:
        yield ids, held


def word_shares(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """The share of each of the benchmark's words among all words of all documents."""
    lookup = docs.sparkSession.sparkContext.broadcast(Lookup(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(len(lookup.value.values), np.int64), 0
        for batch in batches:
            texts = byte_column(batch.column(0))
            for low, high in slices(texts):
                hashes = words_of(texts[low:high]).hash
                total += len(hashes)
                counts += np.bincount(lookup.value.find(hashes)[1], minlength=len(counts))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(counts[seen], total))], names=["place", "n"])

    found = docs.select("text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    counts, total = np.zeros(len(lookup.value.values), np.int64), 0
    for place, n in zip(found["place"].to_pylist(), found["n"].to_pylist(), strict=True):
        if place < 0:
            total = n
        else:
            counts[place] = n
    return (counts + 0.5) / (total + 1)


def seeded(docs: DataFrame, ids: list[int | None], words: list[np.ndarray]) -> Items:
    vocabulary = np.unique(np.concatenate(words))
    rarity = np.log(word_shares(docs, vocabulary))
    found: dict[int, dict[int, list[tuple[int, int]]]] = {}
    for item, own in enumerate(words):
        n = min(SEED, len(own))
        logs = np.convolve(rarity[np.searchsorted(vocabulary, own)], np.ones(n), "valid")
        chosen = set(np.flatnonzero(logs <= np.log(RARE))) | set(np.argsort(logs, kind="stable")[:RAREST])
        held = Words([])
        held.hash, held.first, held.count = own, np.array([0, len(own)]), np.array([len(own)])
        grams, at = held.windows(n)
        for gram, place in zip(grams, at, strict=True):
            if place in chosen:
                found.setdefault(n, {}).setdefault(int(gram), []).append((item, int(place)))
    seeds = {}
    for n, grams in found.items():
        lookup = Lookup(np.array(list(grams), U64))
        seeds[n] = (lookup, [grams[int(v)] for v in lookup.values])
    return Items(ids, words, seeds)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman: best local score, and where it ends in the passage (exclusive)."""
    n = len(passage)
    slope = np.arange(n + 1) * -GAP
    row, best, end = np.zeros(n + 1, np.int64), 0, 0
    for word in item:
        now = np.zeros(n + 1, np.int64)
        np.maximum(row[:-1] + np.where(passage == word, MATCH, MISMATCH), row[1:] + GAP, out=now[1:])
        now = np.maximum(np.maximum.accumulate(now + slope) - slope, 0)
        if (top := int(now.max())) > best:
            best, end = top, int(now.argmax())
        row = now
    return best, end


def hits_in(texts: list[bytes], items: Items, known: dict) -> list[tuple[int, int, float, int, int]]:
    """(text, item, score, first word, end word) of the best passage for each text and item that share a seed."""
    words = words_of(texts)
    owner = words.owner()
    spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for n, (lookup, where) in items.seeds.items():
        grams, at = words.windows(n)
        hit, place = lookup.find(grams)
        for start, p in zip(at[hit].tolist(), place.tolist(), strict=True):
            text = int(owner[start])
            first, last = int(words.first[text]), int(words.first[text + 1])
            for item, offset in where[p]:
                size = len(items.words[item])
                margin = 8 + size // 4
                low = max(first, start - offset - margin)
                spans.setdefault((text, item), []).append((low, min(last, start - offset + size + margin)))
    out = []
    for (text, item), found in sorted(spans.items()):
        own, best = items.words[item], (-1.0, 0, 0)
        low, high = None, None
        for a, b in [*sorted(found), (None, None)]:
            if low is not None and a is not None and a <= high and b - low <= 4 * len(own) + 64:
                high = max(high, b)
                continue
            if low is not None:
                passage = words.hash[low:high]
                key = (item, passage.tobytes())
                if key not in known:
                    if len(known) > 20_000:
                        known.clear()
                    score, end = align(own, passage)
                    back, length = align(own[::-1], passage[:end][::-1])
                    known[key] = (score / (MATCH * len(own)), end - length, end)
                score, start, end = known[key]
                if score > best[0]:
                    best = (score, low + start - int(words.first[text]), low + end - int(words.first[text]))
            low, high = a, b
        out.append((text, item, *best))
    return out


def in_batch(column: pa.Array, items: Items, known: dict, least: float) -> Iterator[tuple[int, int, float, int, int]]:
    texts = byte_column(column)
    for low, high in slices(texts):
        for text, item, *rest in hits_in(texts[low:high], items, known):
            if rest[0] >= least:
                yield (low + text, item, *rest)


def prepared(docs: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str) -> list[Broadcast]:
    spark, plain = docs.sparkSession, docs.select(F.col(text).alias("text"))
    return [spark.sparkContext.broadcast(seeded(plain, ids, words)) for ids, words in blocks_of(benchmark, item_id, item_text)]


def matches(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = LEAST_SCORE
) -> DataFrame:
    """A row for each document and item whose best passage scores at least `least`: doc_id, item_id, score, first_word, end_word.

    Null and empty texts and items without a word match nothing; ties between passages go to the first. Repeated documents
    and items are reported each. Other columns are ignored; empty tables give an empty result.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, item_id long, score double, first_word long, end_word long"
    found = docs.sparkSession.createDataFrame([], schema)
    for items in prepared(docs, benchmark, text, item_id, item_text):

        def run(batches: Iterator[pa.RecordBatch], items: Broadcast = items) -> Iterator[pa.RecordBatch]:
            known: dict = {}
            for batch in batches:
                rows = list(in_batch(batch.column(1), items.value, known, least))
                ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                columns = [pa.array([items.value.ids[r[1]] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())]
                columns += [pa.array([r[k] for r in rows], pa.int64()) for k in (3, 4)]
                yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "item_id", "score", "first_word", "end_word"])

        found = found.union(base.mapInArrow(run, schema))
    return found


def keep(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = LEAST_SCORE
) -> DataFrame:
    """The rows of `docs` without a match, with all their columns."""
    at, schema = docs.columns.index(text), docs.schema
    for items in prepared(docs, benchmark, text, item_id, item_text):

        def run(batches: Iterator[pa.RecordBatch], items: Broadcast = items) -> Iterator[pa.RecordBatch]:
            known: dict = {}
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[r[0] for r in in_batch(batch.column(at), items.value, known, least)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, schema)
    return docs


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(store.table(spark, sf_dir, "documents"), store.table(spark, sf_dir, "benchmark"))
