"""Best-fit packing with swap-based local search.

Texts become token ids (their path names the vocabulary file) and an end id;
what is longer than a sequence is cut into pieces of its length.  Pieces are
dealt by a hash to groups of about GROUP pieces.  In each group best-fit
decreasing gives a first packing; then a local search moves one piece, exchanges
one for one or two for one between underfull bins, raising the sum of squared
fills, and drops bins that get empty, until no step is left or the bins are as
few as the lengths allow.  Pieces of bins with more than SLACK free meet in
fewer, again bounded groups, and are packed once more; in the last of them
every bin with any room takes part.

Cases.  Null and empty texts are the end id alone, a piece of length 1.
Repeated rows and ids give a piece row each; null ids stay null.  Other columns
are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from ..store import cut
from .wordcache import WordTokenizer

CAPACITY, END, GROUP = 2048, 0, 20_000
#: Bins with more free room than this are packed again.
SLACK = 16
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row for each piece; ids_crc32 is of its ids as little-endian 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = WordTokenizer(tokenizer), np.array([end], "<u4").tobytes()
        for sub, data, offsets in words.runs(batches):
            out = ([], [], [], [], [])
            for i, ids in zip(sub.column(0).to_pylist(), encode(data, offsets), strict=True):
                ids += last
                for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a : a + 4 * capacity]
                    for column, x in zip(out, (i, k, a // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [c.split()[0] for c in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indices, each piece in the fullest bin that has room for it, in the order in which they come."""
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free room
    open_rooms: list[int] = []
    bins: list[list[int]] = []
    for i, n in enumerate(lengths.tolist()):
        at = bisect_left(open_rooms, n)
        if at < len(open_rooms):
            room = open_rooms[at]
            b = free[room].pop()
            if not free[room]:
                del open_rooms[at]
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if left := room - n:
            if not free[left]:
                insort(open_rooms, left)
            free[left].append(b)
    return bins


class Search:
    """Local search among bins with more free room than ``slack``.

    A step takes a bin, the emptiest first, and looks for the best of its moves:
    a piece to another bin, a piece for a smaller one of another bin, or two
    pieces for one that is smaller than both together; each fits, and each makes
    the other bin fuller than both bins were, so the sum of squared fills rises.
    For a given difference partners are found by bisection among all pieces of
    bins with room, so none is left out.  Steps go on until no bin has one, or
    until the bins are as few as the sum of lengths allows."""

    def __init__(self, lengths: np.ndarray, bins: list[list[int]], capacity: int, slack: int = 0):
        self.size, self.capacity, self.full = lengths.tolist(), capacity, capacity - slack
        self.bins = [list(b) for b in bins]
        self.fill = [sum(self.size[i] for i in b) for b in self.bins]
        done = [f for f in self.fill if f >= self.full]
        self.least = len(done) + -(-(sum(self.fill) - sum(done)) // capacity)
        self.where = {i: b for b, inside in enumerate(self.bins) for i in inside}
        open_bins = [b for b, f in enumerate(self.fill) if 0 < f < self.full]
        self.rooms = sorted((capacity - self.fill[b], b) for b in open_bins)
        self.items = sorted((self.size[i], i) for b in open_bins for i in self.bins[b])

    def put(self, moves: list[tuple[int, int]]) -> set[int]:
        """Moves pieces to bins; gives the bins that changed."""
        touched = {self.where[i] for i, _ in moves} | {b for _, b in moves}
        for b in touched:
            self.listed(b, False)
        for i, b in moves:
            a = self.where[i]
            self.bins[a].remove(i)
            self.bins[b].append(i)
            self.fill[a] -= self.size[i]
            self.fill[b] += self.size[i]
            self.where[i] = b
        for b in touched:
            self.listed(b, True)
        return touched

    def listed(self, b: int, there: bool) -> None:
        """Adds a bin with room, and its pieces, to the sorted lists, or takes them out."""
        if not 0 < self.fill[b] < self.full:
            return
        rows = [(self.rooms, (self.capacity - self.fill[b], b))] + [(self.items, (self.size[i], i)) for i in self.bins[b]]
        for table, row in rows:
            if there:
                insort(table, row)
            else:
                del table[bisect_left(table, row)]

    def step(self, a: int) -> list[tuple[int, int]] | None:
        """The move out of bin a that fills its partner most."""
        best, fullest = None, self.fill[a]
        own = sorted(self.bins[a], key=lambda i: (-self.size[i], i))
        for n, i in self.distinct(own):
            at = bisect_left(self.rooms, (n, -1))
            at += at < len(self.rooms) and self.rooms[at][1] == a
            if at < len(self.rooms) and (f := self.capacity - self.rooms[at][0] + n) > fullest:
                best, fullest = [(i, self.rooms[at][1])], f
                if f == self.capacity:
                    return best
        pairs = [(n, (i,)) for n, i in self.distinct(own)]
        sizes = self.distinct(own)
        for x, (n, i) in enumerate(sizes):
            for m, j in sizes[x + 1 :]:
                pairs.append((n + m, (i, j)))
            twin = next((j for j in own if j != i and self.size[j] == n), None)
            if twin is not None:
                pairs.append((2 * n, (i, twin)))
        for total, out in pairs:
            # each partner's piece s gives fill + total - s, at most the capacity: look from the largest room down
            at = bisect_left(self.items, (total, -1)) - 1
            while at >= 0:
                s, j = self.items[at]
                at -= 1
                if total - s > self.rooms[-1][0]:
                    break  # no bin has so much room
                b = self.where[j]
                f = self.fill[b] + total - s
                if b != a and fullest < f <= self.capacity and f > self.fill[b]:
                    best, fullest = [*((i, b) for i in out), (j, a)], f
                    if f == self.capacity:
                        return best
        return best

    def distinct(self, own: list[int]) -> list[tuple[int, int]]:
        """One piece of each length."""
        out: dict[int, int] = {}
        for i in own:
            out.setdefault(self.size[i], i)
        return list(out.items())

    def run(self) -> list[list[int]]:
        used, changed = sum(f > 0 for f in self.fill), True
        while changed and used > self.least:
            changed = False
            todo = [(f, b) for b, f in enumerate(self.fill) if 0 < f < self.full]
            heapify(todo)
            while todo and used > self.least:
                f, a = heappop(todo)
                if f != self.fill[a] or not 0 < f < self.full:
                    continue
                if move := self.step(a):
                    changed = True
                    for b in self.put(move):
                        used -= self.fill[b] == 0
                        heappush(todo, (self.fill[b], b))
        return [b for b in self.bins if b]


def search(lengths: np.ndarray, bins: list[list[int]], capacity: int, slack: int = 0) -> list[list[int]]:
    return Search(lengths, bins, capacity, slack).run()


def pack_group(lengths: np.ndarray, capacity: int = CAPACITY, slack: int = 0) -> list[list[int]]:
    """Best fit by falling length, then local search."""
    order = np.argsort(-lengths, kind="stable")
    return search(lengths, [order[b].tolist() for b in best_fit(lengths[order], capacity)], capacity, slack)


def pack(found: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """found (pieces) with sequence_id and offset.

    A sequence's number is level << 60 | group << 24 | bin.  Groups are hashed
    by the whole row and a running number within a task, so that repeated rows
    spread over groups as others do."""
    columns = found.columns

    def packer(level: int, keep_all: bool):
        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
            seq, off = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64)
            size = rows["length"].to_numpy()
            for k, b in enumerate(pack_group(size, capacity, 0 if keep_all else SLACK)):
                if keep_all or size[b].sum() >= capacity - SLACK:
                    seq[b] = (level << 60) | (int(key[0]) << 24) | k
                    off[b] = np.cumsum([0, *size[b][:-1]])
            return rows[columns].assign(sequence_id=seq, offset=off)

        return run

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema) + ", sequence_id long, offset long"
    whole = F.col("length") == capacity
    n = found.where(~whole).count()
    full = found.where(whole).withColumn("sequence_id", F.lit(-(1 << 62)) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    rest, done, level = found.where(~whole), full, 1
    while True:
        groups = max(1, -(-n // group))
        last = groups == 1
        salt = F.pmod(F.xxhash64(*columns, F.monotonically_increasing_id(), F.lit(level)), F.lit(groups))
        packed = rest.withColumn("__g", salt).groupBy("__g").applyInPandas(packer(level, last), schema)
        if last:
            return done.unionByName(packed)
        packed = cut(packed, "packed")
        done, rest = done.unionByName(packed.where("sequence_id >= 0")), packed.where("sequence_id < 0").select(columns)
        before, n, level = n, rest.count(), level + 1
        if n > 0.7 * before:  # a last round in groups: nothing more to win by meeting again
            return done.unionByName(rest.withColumn("__g", F.pmod(F.xxhash64(*columns, F.monotonically_increasing_id(), F.lit(level)), F.lit(max(1, -(-n // group))))).groupBy("__g").applyInPandas(packer(level, True), schema))
