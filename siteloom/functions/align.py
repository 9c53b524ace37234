"""Alignments of short sequences, on arrays of reads at once or one by one."""

from __future__ import annotations

import numpy as np


def encoded(seqs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the sequences, one row each, padded with zeros, and their lengths."""
    n = np.array([len(s) for s in seqs], np.int64)
    out = np.zeros((len(seqs), int(n.max(initial=0))), np.uint8)
    for k, s in enumerate(seqs):
        out[k, : len(s)] = np.frombuffer(s.encode("ascii", "replace"), np.uint8)
    return out, n


def _find_equal(seqs: list[str], adapter: str, least: int, leftmost: bool) -> np.ndarray:
    """find_adapter where no error is allowed: the whole adapter, else the longest beginning of it, of `least` bases or more, with which the read ends."""
    ends = [adapter[:k] for k in range(len(adapter) - 1, least - 1, -1)]
    best = np.full((len(seqs), 3), -1, np.int64)
    for k, s in enumerate(seqs):
        at, n = s.find(adapter) if leftmost else s.rfind(adapter), len(adapter)
        if at < 0:
            n = next((len(e) for e in ends if s.endswith(e)), 0)
            at = len(s) - n
        if n:
            best[k] = 0, at, at + n
    return best


def find_adapter(seqs: list[str], adapter: str, error_rate: float, *, three_prime: bool = False, min_overlap: int | None = None, leftmost: bool = False, max_errors: int | None = None, indels: bool = True) -> np.ndarray:
    """(errors, start, end) of the adapter in each read, errors -1 without a match.

    Semi-global: the adapter lies anywhere in the read; with three_prime its beginning may also hang over
    the read's end by all but min_overlap bases. An adapter N matches all. Of all places with at most
    floor(aligned adapter length * error_rate) errors (or max_errors), the one with the longest aligned adapter, fewest
    errors and then the rightmost end counts (leftmost: the smallest).
    """
    none = max_errors == 0 if max_errors is not None else int(len(adapter) * error_rate + 1e-9) == 0
    if none and adapter and not set(adapter) & set("N?"):
        return _find_equal(seqs, adapter, (min_overlap or 1) if three_prime else len(adapter), leftmost)
    text, n = encoded(seqs)
    rows, width, m = len(seqs), text.shape[1], len(adapter)
    text = np.ascontiguousarray(text.T)  # a column of the table, all reads at one place, is one stretch of memory
    big = 10_000
    cost, start = np.zeros((width + 1, rows), np.int16), np.repeat(np.arange(width + 1, dtype=np.int32)[:, None], rows, 1)
    best = np.full((rows, 3), -1, np.int64)
    score = np.full(rows, np.iinfo(np.int64).min)
    cols = np.arange(width + 1)[:, None]
    every = np.arange(rows)

    def offer(aligned: int, ends: np.ndarray):
        limit = max_errors if max_errors is not None else int(aligned * error_rate + 1e-9)
        ok = ends & (cost <= limit)
        place = np.where(ok, (aligned * 64 - np.minimum(cost, 63).astype(np.int64)) * (2 * width + 2) + (-cols if leftmost else cols), np.iinfo(np.int64).min)
        at = place.argmax(0)
        top = place[at, every]
        new = top > score
        score[new] = top[new]
        best[new] = np.stack([cost[at, every], start[at, every], at], 1)[new]

    inside = cols <= n[None, :]
    for i, letter in enumerate(adapter.encode(), 1):
        off = np.zeros_like(text, np.int16) if letter == 78 else (text != letter).astype(np.int16)
        new, begun = np.empty_like(cost), np.empty_like(start)
        new[0], begun[0] = i if indels else big, 0
        diagonal = cost[:-1] + off
        if indels:
            up = cost + np.int16(1)
            for j in range(1, width + 1):
                d, u = diagonal[j - 1], up[j]
                c = np.minimum(np.minimum(d, u), new[j - 1] + np.int16(1))
                new[j] = c
                begun[j] = np.where(d == c, start[j - 1], np.where(u == c, start[j], begun[j - 1]))
        else:
            new[1:], begun[1:] = np.minimum(diagonal, big), np.where(diagonal <= big, start[:-1], start[1:])
        cost, start = new, begun
        if three_prime and (min_overlap or 1) <= i < m:
            offer(i, cols == n[None, :])
    offer(m, inside)
    return best


def local_alignments(query: str, seqs: list[str], match: int = 5, mismatch: int = -4, gap_open: int = 10, gap_extend: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, same, inserted) of the best local alignment of the query with each sequence, gaps affine.

    same[k, i]: letter i of the query stands opposite an equal letter; inserted[k, i]: letters of sequence k that stand opposite no letter, right before letter i.
    All sequences go through the table together, row by row, and back together step by step. Of equally good ends the first in the query, then in the sequence, counts;
    a letter pair goes before a gap in the query, that before one in the sequence.
    """
    text, _ = encoded(seqs)
    rows, width, n = len(seqs), text.shape[1], len(query)
    low = -(10**6)
    h, e, f = np.zeros((n + 1, rows, width + 1), np.int32), np.full((n + 1, rows, width + 1), low, np.int32), np.full((n + 1, rows, width + 1), low, np.int32)
    cols = np.arange(width + 1, dtype=np.int32) * gap_extend
    for i, letter in enumerate(query.encode(), 1):
        f[i] = np.maximum(f[i - 1] - gap_extend, h[i - 1] - gap_open)
        f[i][:, 0] = low
        best = np.maximum(f[i], 0)
        best[:, 1:] = np.maximum(best[:, 1:], h[i - 1][:, :-1] + np.where(text == letter, match, mismatch))
        # a gap opened at any column before, each further one costs gap_extend; one that follows a gap of the same kind only extends it
        e[i][:, 1:] = np.maximum.accumulate(best + cols, axis=1)[:, :-1] - cols[1:] + (gap_extend - gap_open)
        h[i] = np.maximum(best, e[i])
    flat = h.transpose(1, 0, 2).reshape(rows, -1)
    end = flat.argmax(1)
    score, every = flat[np.arange(rows), end], np.arange(rows)
    i, j = end // (width + 1), end % (width + 1)
    same, inserted = np.zeros((rows, n), bool), np.zeros((rows, n + 1), np.int32)
    letters, state = np.frombuffer(query.encode(), np.uint8), np.zeros(rows, np.int8)  # 0: at a pair, 1: in a gap of the query, 2: in one of the sequence
    open_ = score > 0
    while open_.any():
        k = every[open_]
        a, b, s = i[k], j[k], state[k]
        here = text[k, b - 1] == letters[a - 1]
        pair = (s == 0) & (h[a, k, b] == h[a - 1, k, b - 1] + np.where(here, match, mismatch))
        s = np.where((s == 0) & ~pair, np.where(h[a, k, b] == e[a, k, b], 1, 2), s)
        across, down = s == 1, s == 2
        same[k[pair], a[pair] - 1] = here[pair]
        np.add.at(inserted, (k[across], a[across]), 1)
        last = np.where(across, e[a, k, b] == h[a, k, b - 1] - gap_open, f[a, k, b] == h[a - 1, k, b] - gap_open)
        state[k] = np.where(pair | last, 0, s)
        i[k], j[k] = a - (pair | down), b - (pair | across)
        open_[k] = (i[k] > 0) & (j[k] > 0) & ((state[k] != 0) | (h[i[k], k, j[k]] > 0))
    return score, same, inserted


def levenshtein(a: str, b: str) -> int:
    if not a or not b:
        return len(a) + len(b)
    x, y = np.frombuffer(a.encode("utf-32-le"), np.uint32), np.frombuffer(b.encode("utf-32-le"), np.uint32)
    row, steps = np.arange(len(y) + 1), np.arange(len(y) + 1)
    for i, c in enumerate(x, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (y != c))
        row = np.minimum.accumulate(np.concatenate([[i], new]) - steps) + steps
    return int(row[-1])


def edits_within(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Levenshtein distances of sequences of one length, a line each, most + 1 where there are more. Of the table only the diagonals within `most` are made."""
    pairs, n = a.shape
    most = min(most, n)
    width = 2 * most + 1
    over = most + 1
    slope = np.arange(width, dtype=np.int32)
    padded = np.zeros((pairs, n + 2 * most), b.dtype)  # column j of b stands at j + most
    padded[:, most : most + n] = b
    cost = np.broadcast_to(np.abs(slope - most).astype(np.int32), (pairs, width)).copy()
    for i in range(n):
        inside = (slope + i - most >= 0) & (slope + i - most < n)  # the diagonals that have a letter of b here
        step = np.where(inside, cost + (padded[:, i : i + width] != a[:, i : i + 1]), over + n)
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
        edge = most - i - 1
        if edge >= 0:
            step[:, edge] = i + 1  # nothing of b so far
        cost = np.minimum.accumulate(step - slope, axis=1) + slope
    return np.minimum(cost[:, most], over)


def similar(a: str, b: str) -> float:
    return 1.0 if not a and not b else 1 - levenshtein(a, b) / max(len(a), len(b))
