"""Words and hashes of whole Arrow string columns in numpy, without a Python object per word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64

#: A-Z to a-z, all other bytes as they are: UTF-8 sequences are untouched.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: all but 0x20 and 0x09-0x0D.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes of words after lower-casing: 0-9, a-z and everything from 0x80 on; A-Z is included as it is lower-cased.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

#: MASKS[n] keeps the first n bytes of a little-endian word.
MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=U64)
MIX1, MIX2, GOLD = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser; works in place on a fresh uint64 array."""
    t = x >> U64(30)
    x ^= t
    x *= MIX1
    np.right_shift(x, U64(27), out=t)
    x ^= t
    x *= MIX2
    np.right_shift(x, U64(31), out=t)
    x ^= t
    return x


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and the n+1 offsets of its values; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """All words of a column: word i is low[starts[i]:ends[i]]; document d has words first[d]:first[d+1]."""

    low: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, from eight bytes at a time."""
        padded = np.zeros(len(self.low) + 8, np.uint8)
        padded[: len(self.low)] = self.low
        eight = np.ndarray((len(self.low) + 1,), "<u8", padded, strides=(1,))
        length = self.ends - self.starts
        out = eight[self.starts] & MASKS[np.minimum(length, 8)]
        out += length.astype(U64) * GOLD
        mix(out)
        more = np.flatnonzero(length > 8)
        at = 8
        while len(more):
            h = out[more]
            h ^= eight[self.starts[more] + at] & MASKS[np.minimum(length[more] - at, 8)]
            h *= GOLD
            out[more] = mix(h)
            at += 8
            more = more[length[more] > at]
        return out


def words(column: pa.Array, kind: np.ndarray) -> Words:
    """Lower-cases A-Z and finds the runs of the bytes that `kind` allows; no word crosses a document's end."""
    data, offsets = string_bytes(column)
    inside = kind[data]
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(offsets), np.int64))
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    begins[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(last) + 1
    return Words(LOWER[data], starts, ends, np.searchsorted(starts, offsets))


#: Odd multipliers that keep the order of words in a sequence hash.
STEP = U64(0xD6E8FEB86659FD93)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n word hashes; entry i is of words i to i+n-1."""
    if len(hashes) < n:
        return np.zeros(0, U64)
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out *= STEP
        out += hashes[k : len(hashes) - n + 1 + k]
    return mix(out)


def parts(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """Slices of a batch with about `most` bytes of text each, to bound memory and stay in cache."""
    sizes = np.diff(string_bytes(batch.column(batch.schema.get_field_index(column)))[1])
    if len(sizes) == 0:
        return
    group = (np.cumsum(sizes) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(sizes)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)
