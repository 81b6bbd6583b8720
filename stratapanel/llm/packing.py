"""Packing documents into sequences of a fixed length (operator 6), best-two-fit.

Documents become token ids and an end id; those longer than a sequence are cut. A sequence is filled greedily with the longest
pieces that fit; if a gap stays, its smallest piece is put back when two unpacked pieces fill the widened gap more tightly.

Tokenising happens where the rows are. Only pieces (lengths and keys, no text) are dealt at random into groups of a fixed
mean size, each packed in one task; a group leaves at most a few sequences part full, so the loss stays below a
thousandth at any size.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapanel.llm import store
from stratapanel.llm.words import byte_column

SIZE = 2048
END_ID = 0
GROUP = 40_000
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
#: White space so long that the faster library's pattern would need a deep stack, and letters (from U+20000 on) of which the two
#: libraries may know different ones.
LONG_SPACE = re.compile(r"\s{500}")
FAR_LETTERS = re.compile("[\U00020000-\U0010ffff]")


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: itself if it prints, else one of those from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def ranks(model: dict) -> dict[bytes, int] | None:
    """Ids by bytes, if a lower id is also an earlier merge, so that merging by id gives the same ids; else None."""
    letters = byte_letters()
    merges = [m if isinstance(m, str) else "".join(m) for m in model["merges"]]
    order = [model["vocab"][m.replace(" ", "")] for m in merges]
    if any(a >= b for a, b in zip(order, order[1:], strict=False)) or any(c not in letters for word in model["vocab"] for c in word):
        return None
    return {bytes(letters[c] for c in word): i for word, i in model["vocab"].items()}


class Encoder:
    """Token ids as packed little-endian 32-bit numbers, those of the tokenizers library and its file.

    A byte-level vocabulary whose ids follow its merges is read by tiktoken too, in half the time and with the same ids (compared for every
    character below U+20000). Texts that the two might read differently go through the tokenizers library: names of added tokens, long
    white space, characters further up, and all texts if the file is of another kind.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        added = "|".join(re.escape(t["content"]) for t in held["added_tokens"])
        self.added = re.compile(added) if added else None
        plain = held["normalizer"] is None and held["pre_tokenizer"] == BYTE_LEVEL and held["model"]["type"] == "BPE"
        known = ranks(held["model"]) if plain else None
        self.fast = known and tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})

    def __call__(self, body: bytes) -> bytes:
        text = body.decode()
        rare = not self.fast or (self.added and self.added.search(text)) or LONG_SPACE.search(text) or not text.isascii() and FAR_LETTERS.search(text)
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids if rare else self.fast.encode_ordinary(text)).tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(total: int, size: int) -> list[tuple[int, int]]:
    """Start and length of a document's pieces; only the first may be shorter."""
    if total <= size:
        return [(0, total)]
    head = total % size
    return ([(0, head)] if head else []) + [(at, size) for at in range(head, total, size)]


def tokenised(docs: DataFrame, doc_id: str, text: str, path: str, size: int, end_id: int, with_ids: bool) -> DataFrame:
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            rows = []
            for key, body in zip(batch.column(0).to_pylist(), byte_column(batch.column(1)), strict=True):
                ids = encode(body) + end
                for k, (at, length) in enumerate(cut(len(ids) // 4, size)):
                    own = ids[4 * at : 4 * (at + length)]
                    rows.append((key, k, at, length, zlib.crc32(own), own if with_ids else b""))
            if rows:
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                n = len(kinds) if with_ids else len(kinds) - 1
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:n], kinds[:n], strict=True)], names=names[:n])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def best_two_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, no piece being longer than `size`."""
    order = np.argsort(lengths, kind="stable")
    left = np.bincount(lengths, minlength=size + 1)
    top = np.cumsum(left)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    below = list(range(size + 1))  # below[l]: a length at most l that may still be there
    count = left.tolist()

    def longest(limit: int) -> int:
        found = limit
        while found and not count[found]:
            found = below[found] if below[found] < found else found - 1
        while limit > found:
            step = below[limit]
            below[limit] = found
            limit = step if step < limit else limit - 1
        return found

    used = [0] * (size + 1)
    remaining, now = len(lengths), 0
    while remaining:
        chosen, gap = [], size
        while gap and (take := longest(gap)):
            chosen.append(take)
            count[take] -= 1
            gap -= take
        if gap and len(chosen) > 1:
            smallest = chosen[-1]
            room = gap + smallest
            there = np.array(count[: room + 1])
            there[0] = 0
            free = np.flatnonzero(there)
            partner = np.maximum.accumulate(np.where(there > 0, np.arange(room + 1), 0))[room - free] if len(free) else free
            alone = (partner == free) & (there[free] < 2)
            sums = np.where((partner > 0) & ~alone, free + partner, 0)
            if len(sums) and (best := int(sums.argmax())) >= 0 and sums[best] > smallest:
                chosen.pop()
                count[smallest] += 1
                for k in range(smallest, min(size, room) + 1):
                    below[k] = k
                for take in (int(free[best]), int(partner[best])):
                    chosen.append(take)
                    count[take] -= 1
        at = 0
        for take in chosen:
            row = order[top[take] - 1 - used[take]]
            used[take] += 1
            bins[row], offsets[row] = now, at
            at += take
        remaining -= len(chosen)
        now += 1
    return bins, offsets


def placer(size: int) -> Callable[[pa.Table], pa.Table]:
    def place(pieces: pa.Table) -> pa.Table:
        bins, offsets = best_two_fit(pieces["length"].to_numpy(), size)
        group = pieces["group"][0].as_py()
        pieces = pieces.drop_columns(["group"])
        return pieces.append_column("sequence_id", pa.array((group << 32) + bins, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    return place


def pack(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, size: int = SIZE, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset.

    `path` is a byte-level BPE file of the tokenizers library. A null or empty text is its end id alone; repeated rows and rows
    without a doc_id are packed like any other; ties between pieces of one length do not matter to the fill. Other columns are
    ignored; an empty table gives an empty result. Sequence ids are unique, not dense. `with_ids` carries the ids along, packed
    as little-endian 32-bit numbers, so that a sequence is its pieces' ids in order of offset.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    pieces = store.written(tokenised(docs, doc_id, text, path, size, end_id, with_ids), "pieces")
    groups = store.parts(pieces.count(), GROUP, least=1)
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(placer(size), f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in pieces.schema)}, sequence_id long, offset long")


def op6_pack_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(store.table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
