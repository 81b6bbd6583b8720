"""Words of many texts at once: spans and 64-bit hashes, by numpy inside a task.

A word is a run of bytes other than ASCII white space (space and 0x09 to 0x0D), which is the same as
`[^\\x20\\x09-\\x0D]+` on the text. Hashes are polynomials modulo 2**64 over one random 64-bit value per byte, taken
from prefix sums, then mixed; they depend on nothing but the word, so every task and every run agrees on them.
Texts come as UTF-8 bytes; a null text is handed in as b"".
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

SLAB = 1 << 20
BASE = 0x9E3779B97F4A7C55
U64 = np.uint64
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x + U64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


VALUES = mix(np.arange(1, 257, dtype=U64))
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLAB + 1), base % 2**64, dtype=U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 4 * SLAB:
            _powers[base] = have
    return have[:n]


def spans(space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs where `space` is false."""
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True]))))
    return edge[::2], edge[1::2]


def hashed(data: np.ndarray, space: np.ndarray = SPACE, fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word of a byte array, worked through in slabs; a word may span many slabs."""
    values = VALUES if fold is None else VALUES[fold]
    inverse = pow(BASE, -1, 2**64)
    all_starts, all_ends, all_raw = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, U64)]
    for low in range(0, len(data), SLAB):
        part = data[low : low + SLAB]
        starts, ends = spans(space[part])
        sums = np.zeros(len(part) + 1, dtype=U64)
        np.cumsum(values[part] * powers(len(part)), out=sums[1:])
        raw = (sums[ends] - sums[starts]) * powers(len(part) + 1, inverse)[starts]
        if len(starts) and starts[0] == 0 and len(all_ends[-1]) and all_ends[-1][-1] == low:
            before = int(all_ends[-1][-1] - all_starts[-1][-1])
            all_raw[-1][-1:] += raw[:1] * np.array([pow(BASE, before, 2**64)], dtype=U64)
            all_ends[-1][-1] = low + ends[0]
            starts, ends, raw = starts[1:], ends[1:], raw[1:]
        if len(starts):
            all_starts.append(starts + low)
            all_ends.append(ends + low)
            all_raw.append(raw)
    return np.concatenate(all_starts), np.concatenate(all_ends), mix(np.concatenate(all_raw), 1)


class Words:
    """The words of some texts. `first[i]` to `first[i + 1]` are the words of text i."""

    def __init__(self, texts: Sequence[bytes], space: np.ndarray = SPACE, fold: np.ndarray | None = None):
        self.size = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
        self.begin = np.concatenate(([0], np.cumsum(self.size + 1)))
        self.start, self.end, self.hash = hashed(self.data, space, fold)
        self.first = np.searchsorted(self.start, self.begin)
        self.count = np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def windows(self, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Rabin-Karp hashes of every k consecutive words of one text, and the word at which each starts."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        own = mix(self.hash, salt) if salt else self.hash
        sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(own * powers(n), out=sums[1:])
        roll = (sums[k:] - sums[:-k]) * powers(n + 1, pow(BASE, -1, 2**64))[: n - k + 1]
        at = np.flatnonzero(self.end_of_words()[: n - k + 1] >= np.arange(k, n + 1))
        return mix(roll[at], salt + 2), at

    def end_of_words(self) -> np.ndarray:
        """For each word, where the words of its text end."""
        return np.repeat(self.first[1:], self.count)

    def covered(self, at: np.ndarray, k: int) -> np.ndarray:
        """Which words lie in a window of k words that starts at one of `at`."""
        change = np.zeros(len(self.hash) + 1, dtype=np.int64)
        np.add.at(change, at, 1)
        np.subtract.at(change, at + k, 1)
        return np.cumsum(change[:-1]) > 0

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many of each text's words carry the flag."""
        sums = np.concatenate(([0], np.cumsum(flags.astype(np.int64))))
        return sums[self.first[1:]] - sums[self.first[:-1]]


def byte_column(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8, nulls as b""."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def slices(texts: Sequence[bytes], limit: int = 4 * SLAB) -> Iterator[tuple[int, int]]:
    """Runs of texts that hold about `limit` bytes together; a longer text stands alone."""
    low = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text) > limit:
            yield low, i
            low, total = i, 0
        total += len(text)
    if low < len(texts):
        yield low, len(texts)
