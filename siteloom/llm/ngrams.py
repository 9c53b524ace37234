"""Hashed n-grams of the bytes or characters of many texts at once."""

from __future__ import annotations

import numpy as np

_MIX = np.uint32(0x9E3779B1)


class Batch:
    """Texts joined in one array of units (bytes, or characters as 4 bytes each), each between `pad` blanks, so no n-gram holds units of two texts."""

    def __init__(self, texts: list[bytes], pad: int, unit: str = "<u1"):
        kind = np.dtype(unit)
        fill = np.full(pad, 32, kind).tobytes()
        self.data = np.frombuffer(fill + (fill + fill).join(texts) + fill, kind)
        sizes = np.array([len(t) // kind.itemsize + 2 * pad for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.sizes = sizes

    def hashed(self, n: int, bits: int) -> np.ndarray:
        """A bucket of 2**bits for the n-gram at each place (fewer than n units before the end: as if blanks followed)."""
        data = np.concatenate([self.data, np.full(n - 1, 32, self.data.dtype)]) if n > 1 else self.data
        size, h = len(self.data), np.zeros(len(self.data), np.uint32)
        for k in range(n):
            h *= np.uint32(16777619)
            h += data[k : k + size]
        h ^= h >> np.uint32(15)
        h *= _MIX
        return h >> np.uint32(32 - bits)

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts)

    def of(self, k: int) -> slice:
        return slice(self.starts[k], self.starts[k] + self.sizes[k])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept of a penalised logistic regression on soft labels y, by accelerated gradient steps."""
    n, d = x.shape
    with_one = np.ones((n, d + 1), np.float32)  # all in single precision: else each product copies x
    with_one[:, :d] = x
    x = with_one
    y, weight = y.astype(np.float32), weight.astype(np.float32)
    v = np.ones(d + 1, np.float32) / np.float32(np.sqrt(d + 1))
    for _ in range(20):  # the largest eigenvalue of the curvature
        v = x.T @ (weight * (x @ v))
        top = np.linalg.norm(v)
        v /= top or 1
    total = weight.sum()
    step = np.float32(1 / (0.25 * top / total + penalty))
    w = prev = np.zeros(d + 1, np.float32)
    for k in range(rounds):
        at = w + np.float32(k / (k + 3)) * (w - prev)
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        grad = x.T @ (weight * (p - y)) / total
        grad[:-1] += np.float32(penalty) * at[:-1]
        prev, w = w, at - step * grad
    return w[:-1], float(w[-1])
