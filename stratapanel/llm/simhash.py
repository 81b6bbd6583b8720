"""Near-duplicates by SimHash and BK-trees (operator 11).

A bit of a text's fingerprint is 1 if it is set in over half the XXH64 hashes of the text's 3-word shingles, repeats included. Texts
are linked if their fingerprints differ in 3 bits or fewer; a component is what links join.

Only distinct fingerprints are compared. They are dealt into shards: of four blocks of bits at least one is equal in two
fingerprints that differ in three, so each fingerprint goes to the shard of each of its blocks. A shard that is still too large is
dealt again by four blocks of its remaining bits, level by level, until its size is bounded by the bits left (2**16 at most). Each
shard is a BK-tree: children are keyed by their Hamming distance to the parent, and a search with radius 3 at distance d of a node
follows only the edges d - 3 to d + 3. A shard's tree is built where its fingerprints meet, and not broadcast from the driver, which
would have to collect the fingerprints of all texts for that. Of a shard's links only those are returned that join something new,
so the links of a shard are fewer than its members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapanel.llm import store
from stratapanel.llm.components import components
from stratapanel.llm.words import U64, byte_column, slices

SHINGLE, SEED, BITS, RADIUS = 3, 42, 64, 3
BLOCKS = RADIUS + 1
#: Members of a shard beyond which it is dealt again, and how often at most: 64, 48, 36, 27, 21, 16 bits are left.
MOST, LEVELS = 4096, 5
#: Mean rows of a task that holds many shards.
TASK_ROWS = 50_000
PIECE = 1 << 18
LANES = U64(0x0101010101010101)


def shingle_hashes(text: bytes) -> Iterator[np.ndarray]:
    """XXH64 of each shingle of the words, lower-cased and joined by one space; of all words if there are fewer than a shingle has."""
    plain = b" ".join(text.lower().split())
    if not plain:
        return
    space = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)
    start, end = np.concatenate(([0], space + 1)), np.concatenate((space, [len(plain)]))
    start, end = (start[: 1 - SHINGLE], end[SHINGLE - 1 :]) if len(start) > SHINGLE else (start[:1], end[-1:])
    digest = xxhash.xxh64_intdigest
    for low in range(0, len(start), PIECE):
        a, b = start[low : low + PIECE].tolist(), end[low : low + PIECE].tolist()
        yield np.fromiter((digest(plain[i:j], SEED) for i, j in zip(a, b, strict=True)), U64, len(a))


def bit_counts(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many hashes have each bit, for each group; `first` has where groups start, none of them empty. Eight bits, 8 apart, are
    added at a time in the bytes of one number, 255 numbers at most."""
    size = np.diff(np.concatenate((first, [len(hashes)])))
    steps = -(-size // 255)
    step = np.arange(int(steps.sum())) - np.repeat(np.cumsum(steps) - steps, steps)
    cuts = np.repeat(first, steps) + 255 * step
    owners = np.cumsum(steps) - steps
    counts = np.zeros((len(first), BITS), np.int64)
    for shift in range(8):
        lanes = np.add.reduceat((hashes >> U64(shift)) & LANES, cuts)
        counts[:, shift::8] = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), owners, axis=0)
    return counts


def fingerprints_of(texts: list[bytes]) -> np.ndarray:
    """64-bit fingerprints; 0 for a text without words."""
    parts, owner, size = [], [], np.zeros(len(texts), np.int64)
    counts = np.zeros((len(texts), BITS), np.int64)
    for i, text in enumerate(texts):
        for hashes in shingle_hashes(text):
            size[i] += len(hashes)
            if len(hashes) == PIECE:
                counts[i] += bit_counts(hashes, np.array([0]))[0]
            else:
                parts.append(hashes)
                owner.append(i)
    if parts:
        first = np.cumsum([0] + [len(p) for p in parts[:-1]])
        counts[owner] += bit_counts(np.concatenate(parts), first)
    bits = (2 * counts > size[:, None]).astype(U64) << np.arange(BITS, dtype=U64)
    return np.bitwise_or.reduce(bits, axis=1)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fingerprint (64 bits as a long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_column(batch.column(1))
            found = [fingerprints_of(texts[low:high]) for low, high in slices(texts)]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found).view(np.int64))], names=["doc_id", "fingerprint"])

    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return base.mapInArrow(run, "doc_id long, fingerprint long")


class Tree:
    """A BK-tree of 64-bit values."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, value: int, radius: int = RADIUS) -> list[int]:
        """Places of the values within the radius."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                found.append(at)
            children = self.children[at]
            if len(children) > 2 * radius:
                todo += [children[d] for d in range(distance - radius, distance + radius + 1) if d in children]
            else:
                todo += [child for d, child in children.items() if abs(d - distance) <= radius]
        return found

    def add(self, value: int) -> int:
        """Place of the value, which is not yet in the tree."""
        new = len(self.values)
        at = 0
        while new:
            distance = (self.values[at] ^ value).bit_count()
            if distance not in self.children[at]:
                self.children[at][distance] = new
                break
            at = self.children[at][distance]
        self.values.append(value)
        self.children.append({})
        return new


def linked(values: list[int]) -> list[tuple[int, int]]:
    """Links between distinct values that join them as all pairs within the radius do; fewer than values."""
    tree, parent, links = Tree(), [], []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for value in values:
        near = tree.near(value)
        new = tree.add(value)
        parent.append(new)
        for other in near:
            if (a := root(other)) != (b := root(new)):
                parent[a] = b
                links.append((value, values[other]))
    return links


def shard_links(members: pa.Table) -> pa.Table:
    """Links within the shards of one task. Members: key (of the shard), fingerprint."""
    keys, values = members["key"].to_numpy(), members["fingerprint"].to_numpy().view(U64)
    order = np.lexsort((values, keys))
    keys, values = keys[order], values[order]
    new = np.concatenate(([True], (np.diff(keys) != 0) | (np.diff(values.view(np.int64)) != 0)))
    keys, values = keys[new], values[new]
    cuts = np.flatnonzero(np.concatenate(([True], np.diff(keys) != 0, [True])))
    found = []
    for n in np.flatnonzero(np.diff(cuts) > 1).tolist():
        found += linked(values[cuts[n] : cuts[n + 1]].tolist())
    pairs = np.array(found, U64).reshape(-1, 2).view(np.int64)
    return pa.table({"u": pa.array(pairs[:, 0]), "v": pa.array(pairs[:, 1])})


def dealt(rows: DataFrame, width: int) -> tuple[DataFrame, int]:
    """Rows (key, fingerprint, rest: the `width` bits that key does not fix) dealt by each block of their rest, and the least width left."""
    cuts = [width * b // BLOCKS for b in range(BLOCKS + 1)]
    places = []
    for b, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
        value = f"shiftrightunsigned(rest, {low}) & {2 ** (high - low) - 1}L"
        above = f"shiftleft(shiftrightunsigned(rest, {high}), {low})" if high < BITS else "0L"
        places.append(f"struct(xxhash64(key, {b}, {value}) as key, {above} | (rest & {2**low - 1}L) as rest)")
    placed = rows.select("fingerprint", F.explode(F.array(*map(F.expr, places))).alias("at"))
    return placed.select("at.key", "fingerprint", "at.rest"), width - min(b - a for a, b in zip(cuts, cuts[1:], strict=False))


def links(distinct: DataFrame) -> DataFrame:
    """Links (u, v) between fingerprints that hold the same components as all pairs within the radius."""
    rows, width = distinct.select(F.lit(0).cast("long").alias("key"), "fingerprint", F.col("fingerprint").alias("rest")), BITS
    found = None
    for level in range(LEVELS):
        rows, width = dealt(rows, width)
        large = store.written(rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > MOST).select("key"), "shards")
        last = level == LEVELS - 1 or large.isEmpty()
        task = F.pmod(F.xxhash64("key", F.lit(level)), F.lit(store.parts(rows.count(), TASK_ROWS, least=1))).alias("task")
        own = (rows if last else rows.join(large, "key", "left_anti")).select(task, "key", "fingerprint")
        own = own.groupBy("task").applyInArrow(shard_links, "u long, v long")
        found = own if found is None else found.union(own)
        if last:
            return found
        rows = store.written(rows.join(large, "key", "left_semi"), "large-shards")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, fingerprint (16 hexadecimal digits) and component_id, the smallest doc_id reachable.

    Null, empty and wordless texts have fingerprint zero and are linked like others; so are texts of fewer than three words, whose one
    shingle is all of them. Texts of any length are taken whole. Repeated rows share a component; rows without a doc_id take part, and a
    component of only such rows has a null component_id. Other columns are ignored, whatever their names; an empty table gives an
    empty result.
    """
    features = store.written(fingerprints(docs, doc_id, text), "fingerprints")
    classes = store.written(features.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "fingerprint-classes")
    joined = components(links(classes))
    tied = classes.join(joined, classes["fingerprint"] == joined["node"], "left").select("fingerprint", "first", F.coalesce("least", "fingerprint").alias("least"))
    smallest = tied.groupBy("least").agg(F.min("first").alias("component_id"))
    named = tied.join(smallest, "least").select("fingerprint", "component_id")
    found = features.join(named, "fingerprint", "left")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(store.table(spark, sf_dir, "documents"))
