"""Batches of texts as arrays: words, segment sums, hashed features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: int = 1, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts whose texts have a few MB together (one text at least), so that memory stays bounded."""
    texts = batch.column(column)
    if not len(texts):
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = int(ends[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


@dataclass
class Tokens:
    """The words of some texts: ``codes`` into ``words``; text i has ``starts[i]:starts[i + 1]``."""

    codes: np.ndarray
    words: pa.Array
    starts: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    @property
    def owner(self) -> np.ndarray:
        """For each word the number of its text."""
        return np.repeat(np.arange(len(self.starts) - 1), self.counts)


def tokens(texts: pa.Array, lower: bool = False) -> Tokens:
    """Words between spaces, tabs and line ends (U+0020, U+0009 to U+000D); null texts have none."""
    whole = pc.fill_null(texts, "")
    split = pc.ascii_split_whitespace(pc.ascii_lower(whole) if lower else whole)
    flat, offsets = split.values, split.offsets.to_numpy().astype(np.int64)
    some = pc.greater(pc.binary_length(flat), 0)
    seen = np.concatenate(([0], np.cumsum(some.to_numpy(zero_copy_only=False))))
    coded = flat.filter(some).dictionary_encode()
    return Tokens(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, seen[offsets].astype(np.int64))


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sum of ``values[starts[i]:starts[i + 1]]`` for each i; segments may be empty."""
    total = np.concatenate((np.zeros(1, dtype=values.dtype), np.cumsum(values)))
    return total[starts[1:]] - total[starts[:-1]]


def mixed(values: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit words of integers (the finaliser of a 64-bit multiply-shift generator)."""
    x = values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def digests(strings: list[str], seed: int) -> np.ndarray:
    """64-bit digests of strings."""
    return np.fromiter((xxhash.xxh3_64_intdigest(s, seed) for s in strings), dtype=np.uint64, count=len(strings))


def distinct_pairs(owner: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different (owner, code) pairs, in order."""
    both = np.unique((owner.astype(np.int64) << 32) | codes)
    return both >> 32, both & 0xFFFFFFFF
