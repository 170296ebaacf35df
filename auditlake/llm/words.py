"""Vectorised word and n-gram hashing over Arrow string columns.

A word is a maximal run of bytes other than space and 0x09-0x0D, so the rule
``[^\\x20\\x09-\\x0D]+`` holds for any UTF-8 text.  Everything works on whole
texts; batches are cut at document borders so that memory stays bounded by
``MAX_BYTES`` plus the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MAX_BYTES = 1 << 20
LONG = 64
U64 = np.uint64
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers, the same in every process."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scramble (the splitmix finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@dataclass
class Words:
    """Words of a run of documents, in order."""

    data: np.ndarray  # the bytes
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # one past its last byte
    first: np.ndarray  # documents + 1: index of each document's first word

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The document, by position in the run, of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, seed: int = 0, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes: eight bytes a step for all words, and for those over LONG bytes all steps at once."""
        data = ASCII_LOWER[self.data] if lower else self.data
        data = np.concatenate([data, np.zeros(8, np.uint8)])
        left, at = self.end - self.start, self.start
        h = mix(left.astype(U64) + U64(seed * 2 + 1))
        todo = np.flatnonzero(left <= LONG)
        for i in np.flatnonzero(left > LONG).tolist():
            n = int(left[i])
            raw = np.zeros(-(-n // 8) * 8, np.uint8)
            raw[:n] = data[at[i] : at[i] + n]
            parts = raw.view(U64)
            with np.errstate(over="ignore"):
                h[i] = mix(h[i : i + 1] + mix(parts ^ mix(np.arange(len(parts), dtype=U64) + h[i])).sum(dtype=U64))[0]
        at, left = at[todo], left[todo]
        while len(todo):
            part = data[at[:, None] + np.arange(8)].view(U64).ravel()
            short = left < 8
            if short.any():
                keep = (U64(1) << (np.where(short, left, 0).astype(U64) * U64(8))) - U64(1)
                part = np.where(short, part & keep, part)
            h[todo] = mix(h[todo] ^ part)
            more = np.flatnonzero(left > 8)
            todo, at, left = todo[more], at[more] + 8, left[more] - 8
        return h


def find_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """offsets: documents + 1 positions in data, from 0."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(offsets), np.int64))
    solid = ~IS_SPACE[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] |= solid[inner]
    ends[inner - 1] |= solid[inner - 1]
    start = np.flatnonzero(begins)
    return Words(data, start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets))


def ngrams(h: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """Hashes of all runs of n consecutive words, borders of documents ignored."""
    m = max(0, len(h) - n + 1)
    out = np.zeros(m, U64)
    with np.errstate(over="ignore"):
        for k, c in enumerate(constants(n, seed)):
            out += h[k : k + m] * c
    return mix(out)


def inside(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which word positions start a run of n words within one document."""
    counts = np.diff(first)
    room = np.repeat(first[1:], counts) - np.arange(total)
    return (room >= n)[: max(0, total - n + 1)]


def string_parts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def runs(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = MAX_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts record batches at document borders into runs of about ``most`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = string_parts(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            to = min(to, batch.num_rows)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to
