"""Whitening of embeddings by their principal components.

Entries become whole numbers (x = floor(1024 c) + 100000), so that sums and
deviations are exact.  The covariance is gathered in one pass: in each partition
Welford's streaming rank-one updates, row by row, then the parallel update formula
merges the partitions' states over a tree of FAN a node; no task and not the
driver ever holds more than FAN states of d * d numbers.  The driver solves the one
d * d matrix that is left by the symmetric QR algorithm: Householder reflections to
a tridiagonal matrix, then implicit QR steps with Wilkinson's shift.

A second pass projects the rows and measures their covariance in the same way, a
third returns them; nothing is shuffled but the states.

Cases.  Vectors that are null, empty or hold null or non-finite entries are
dropped; so are those with an entry of 2 ** 30 or more, which can't be quantised
exactly, and those of another length than the most common one (of equally common
ones the longest).  Repeated rows each count and are each returned; null ids are
kept.  A component without variance has no whitened value (null) and is left out of
identity_error; where all rows are equal, explained is null too.  With fewer than
the components asked for, there are as many as dimensions.  Other columns are
ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import cut, forget

COMPONENTS, FAN = 8, 8
SCALE, SHIFT, LIMIT = 1024, 100_000, 2.0**30
STATE = "part long, n long, s array<string>, mean array<double>, m array<double>"


@dataclass
class State:
    """Of some rows: their number, exact sums where rows are whole numbers, means, and centred sums of products."""

    n: int
    s: list[int]
    mean: np.ndarray
    m: np.ndarray

    @classmethod
    def empty(cls, d: int) -> State:
        return cls(0, [0] * d, np.zeros(d), np.zeros((d, d)))

    def add(self, rows: np.ndarray) -> None:
        """Welford's rank-one update for each row."""
        mean, m, n = self.mean, self.m, self.n
        for x in rows:
            n += 1
            delta = x - mean
            mean += delta / n
            m += delta[:, None] * (x - mean)
        self.n = n

    def merge(self, other: State) -> State:
        """The parallel update formula."""
        if not self.n or not other.n:
            return self if self.n else other
        n, delta = self.n + other.n, other.mean - self.mean
        m = self.m + other.m + delta[:, None] * delta * (self.n * (other.n / n))
        return State(n, [a + b for a, b in zip(self.s, other.s, strict=True)], self.mean + delta * (other.n / n), (m + m.T) / 2)

    def batch(self, part: int) -> pa.RecordBatch:
        columns = [pa.array([part]), pa.array([self.n]), pa.array([[str(x) for x in self.s]], pa.list_(pa.string())), pa.array([self.mean.tolist()], pa.list_(pa.float64())), pa.array([self.m.ravel().tolist()], pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, ["part", "n", "s", "mean", "m"])

    @classmethod
    def of(cls, n: int, s: list[str], mean: list[float], m: list[float]) -> State:
        return cls(n, [int(x) for x in s], np.array(mean, float), np.array(m, float).reshape(len(mean), len(mean)))


def quantised(batch: pa.RecordBatch, d: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and whole-number rows of the usable vectors of a batch (id, vector)."""
    ids, vectors = batch.column(0), batch.column(1)
    right = pc.fill_null(pc.equal(pc.list_value_length(vectors), d), False)
    ids, vectors = ids.filter(right), vectors.filter(right)
    flat = pc.list_flatten(vectors)
    c = pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
    with np.errstate(invalid="ignore"):
        good = (np.abs(c) < LIMIT).all(axis=1)
    return ids.filter(pa.array(good)), np.floor(SCALE * c[good]).astype(np.int64) + SHIFT


def gathered(rows: DataFrame, d: int, rows_of) -> State:
    """The state of all rows: rows_of(batch) gives a batch's rows as an array, whole numbers or not."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state = State.empty(d)
        for batch in batches:
            x = rows_of(batch)
            if x.dtype == np.int64:  # entries are below 2 ** 41: sums of a batch fit
                state.s = [a + b for a, b in zip(state.s, x.sum(axis=0).tolist(), strict=True)]
            state.add(x.astype(float))
        if state.n:
            yield state.batch(TaskContext.get().partitionId())

    def merge(table: pa.Table) -> pa.Table:
        whole = State.empty(d)
        for r in table.sort_by("part").to_pylist():
            whole = whole.merge(State.of(r["n"], r["s"], r["mean"], r["m"]))
        return pa.Table.from_batches([whole.batch(table.column("part")[0].as_py() // FAN)])

    states = cut(rows.mapInArrow(fit, STATE), "states")
    while states.count() > FAN:
        # a node takes states by their order, so that each level has an FANth of the rows of the one below
        merged = cut(states.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(merge, STATE), "states")
        forget(states)
        states = merged
    whole = State.empty(d)
    for r in sorted(states.collect(), key=lambda r: r.part):
        whole = whole.merge(State.of(r.n, r.s, r.mean, r.m))
    forget(states)
    whole.m = (whole.m + whole.m.T) / 2
    return whole


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal, and the rows q with q a q' tridiagonal, by Householder reflections."""
    a, d = a.copy(), len(a)
    q = np.eye(d)
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if not size:
            continue
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :] -= 2 * v[:, None] * (v @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * (a[:, k + 1 :] @ v)[:, None] * v
        q[k + 1 :] -= 2 * v[:, None] * (v @ q[k + 1 :])
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues of a symmetric matrix and, row by row, its unit eigenvectors: the symmetric QR algorithm."""
    d, e, q = tridiagonal(a)
    hi, eps = len(d) - 1, np.finfo(float).eps
    while hi > 0:
        small = np.abs(e[:hi]) <= eps * (np.abs(d[:hi]) + np.abs(d[1 : hi + 1]))
        e[:hi][small] = 0
        if not e[hi - 1]:
            hi -= 1
            continue
        cuts = np.flatnonzero(e[: hi - 1] == 0)
        lo = int(cuts[-1]) + 1 if len(cuts) else 0
        half, off = (d[hi - 1] - d[hi]) / 2, e[hi - 1]
        x, z = d[lo] - (d[hi] - off * off / (half + np.copysign(np.hypot(half, off), half))), e[lo]
        for k in range(lo, hi):  # chase the bulge
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            first, second, off = d[k], d[k + 1], e[k]
            d[k] = c * c * first + 2 * c * s * off + s * s * second
            d[k + 1] = s * s * first - 2 * c * s * off + c * c * second
            e[k] = c * s * (second - first) + (c * c - s * s) * off
            if k < hi - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            q[k], q[k + 1] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
    order = np.argsort(-d, kind="stable")
    return d[order], q[order]


def deviations(x: np.ndarray, n: int, s: list[int]) -> list[int]:
    """Of each row the exact sum over dimensions of (n x - s) ** 2."""
    if not len(x):
        return []
    most = max(max(abs(n * int(x[:, j].max()) - s[j]), abs(n * int(x[:, j].min()) - s[j])) for j in range(x.shape[1]))
    if n * int(np.abs(x).max()) < 2**62 and max(map(abs, s)) < 2**62 and most * most * x.shape[1] < 2**63:
        away = n * x - np.array(s, np.int64)
        return (away * away).sum(axis=1).tolist()
    away = n * x.astype(object) - np.array(s, object)
    return (away * away).sum(axis=1).tolist()


def whiten(table: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation decimal(38,0), whitened, explained, identity_error of each usable row and component."""
    rows = table.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    common = rows.where("size(v) > 0").groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).head()
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    empty = table.sparkSession.createDataFrame([], schema)
    if common is None:
        return empty
    d = common.d
    whole = gathered(rows, d, lambda batch: quantised(batch, d)[1])
    if not whole.n:
        return empty
    n, sums = whole.n, whole.s
    center = np.array([a // n for a in sums], np.int64)  # taken off as a whole number, exactly; the rest is below 1
    rest = np.array([(a % n) / n for a in sums])
    value, axes = eigen(whole.m / n)
    value, axes = value[:components], axes[:components]
    trace = float(np.trace(whole.m)) / n
    live = value > max(trace, 0.0) * d * np.finfo(float).eps
    explained = [float(v) / trace if trace > 0 else None for v in value]
    scale = np.where(live, 1 / np.sqrt(np.where(live, value, 1.0)), 0.0)
    k = len(value)

    def projected(x: np.ndarray) -> np.ndarray:
        return ((x - center) - rest) @ axes.T * scale

    after = gathered(rows, k, lambda batch: projected(quantised(batch, d)[1]))
    error = np.abs(after.m / n - np.eye(k))[np.ix_(live, live)]
    worst = float(error.max()) if error.size else 0.0

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = quantised(batch, d)
            m = len(x)
            w = pa.array(projected(x).ravel(), mask=np.tile(~live, m))
            columns = [
                ids.take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array(deviations(x, n, sums), pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(m), k))),
                w, pa.array(explained * m, pa.float64()), pa.array(np.full(m * k, worst)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

    return rows.mapInArrow(put, schema)
