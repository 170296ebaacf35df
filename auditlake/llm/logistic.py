"""Logistic regression over sparse hashed features, calibrated by Platt's curve or by a rising step function."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Values handled at once.
BLOCK = 1 << 18


@dataclass
class Linear:
    """p = sigmoid(slope * (x . weights + bias) + shift)."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * (raw + self.bias) + self.shift)


@dataclass
class Stepped(Linear):
    """p by straight lines through (log-odds by the curve, share of positives), which rise; a hundredth of the curve keeps scores apart on level parts."""

    knots: np.ndarray | None = None
    shares: np.ndarray | None = None

    def probability(self, raw: np.ndarray) -> np.ndarray:
        odds = self.slope * (raw + self.bias) + self.shift
        return 0.99 * np.interp(odds, self.knots, self.shares) + 0.01 * sigmoid(odds)


def give_back() -> None:
    """Freed memory goes back to the system: the C library keeps it for the process, which is the driver and lives on after training.  Other C libraries than glibc have no such call."""
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def dot(rows: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray) -> np.ndarray:
    return np.array([float(v.astype(float) @ weights[i]) for i, v in rows])


def blocks(rows: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows with about BLOCK values: which rows, indices, values, and how many values each row has."""
    ends = np.cumsum([len(i) for i, _ in rows])
    a = 0
    while a < len(rows):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BLOCK, "right")))
        run = rows[a:z]
        yield slice(a, z), np.concatenate([i for i, _ in run]), np.concatenate([v for _, v in run]).astype(np.float32), np.array([len(i) for i, _ in run])
        a = z


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, width: int, l2: float = 1e-3, steps: int = 80, rate: float = 0.05) -> Linear:
    """rows: indices and values of each row.  Every fifth row is held out and
    only used to calibrate.  Full-batch Adam on features scaled to unit RMS;
    gradients are summed block by block, so that temporaries stay small."""
    held = np.arange(len(rows)) % 5 == 4
    if len(set(y[~held])) < 2:
        return Linear(np.zeros(width, np.float32), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    parts = list(blocks([r for r, h in zip(rows, held, strict=True) if not h]))
    target = y[~held].astype(float)
    scale = np.sqrt(sum(np.bincount(idx, val.astype(float) ** 2, width) for _, idx, val, _ in parts) / len(target))
    inv = 1 / (scale + (np.median(scale[scale > 0]) if (scale > 0).any() else 1.0))
    for _, idx, val, _ in parts:
        val *= inv[idx]
    share = target.mean()
    cost = np.where(target > 0, 0.5 / share, 0.5 / (1 - share)) ** 0.5
    w, b, m, v, mb, vb = np.zeros(width), 0.0, np.zeros(width), np.zeros(width), 0.0, 0.0
    for t in range(1, steps + 1):
        g, gb = l2 * w, 0.0
        for of, idx, val, counts in parts:
            row = np.repeat(np.arange(len(counts)), counts)
            p = sigmoid(np.bincount(row, val * w[idx], len(counts)) + b)
            err = (p - target[of]) * cost[of] / len(target)
            g += np.bincount(idx, val * err[row], width)
            gb += err.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a = rate * (1 - t / (steps + 1))
        w -= a * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        b -= a * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-9)
    out = Linear((w * inv).astype(np.float32), float(b))
    slope, shift = platt(dot([r for r, h in zip(rows, held, strict=True) if h], out.weights) + out.bias, y[held])
    return Linear(out.weights, out.bias, slope, shift)


def platt(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps on standardised scores, with Platt's smoothed targets."""
    good, bad = int(y.sum()), int(len(y) - y.sum())
    if not good or not bad:
        return 1.0, 0.0
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    mid, spread = raw.mean(), raw.std() or 1.0
    raw = (raw - mid) / spread
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * raw + b)
        g = np.array([((p - target) * raw).sum(), (p - target).sum()])
        q = p * (1 - p) + 1e-9
        h = np.array([[(q * raw * raw).sum() + 1e-6, (q * raw).sum()], [(q * raw).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2 / (np.abs(step).max() + 1e-12))
        a, b = a - step[0], b - step[1]
    return (float(a / spread), float(b - a * mid / spread)) if a > 0 else (1.0, 0.0)


def rising(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Borders of the blocks in which y has the best non-falling fit along x, and y's smoothed mean in each."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for at, label in zip(x[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([at, at, float(label), 1.0])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            last = blocks.pop()
            blocks[-1][1] = last[1]
            blocks[-1][2] += last[2]
            blocks[-1][3] += last[3]
    share = np.maximum.accumulate([(s + 0.5) / (n + 1) for _, _, s, n in blocks])
    return np.array([[a, z] for a, z, _, _ in blocks]).ravel(), np.repeat(share, 2)


def train_in_turn(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, width: int, folds: int = 5, **options) -> Stepped:
    """A model of all rows, calibrated on scores that each row gets from a model trained without its fold."""
    final, fold = train(rows, y, width, **options), np.arange(len(rows)) % folds
    odds = np.zeros(len(rows))
    for f in range(folds):
        apart = [r for r, g in zip(rows, fold, strict=True) if g == f]
        m = train([r for r, g in zip(rows, fold, strict=True) if g != f], y[fold != f], width, **options)
        odds[fold == f] = m.slope * (dot(apart, m.weights) + m.bias) + m.shift
    return Stepped(final.weights, final.bias, final.slope, final.shift, *rising(odds, y))
