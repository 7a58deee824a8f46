"""Cutting stock over a histogram of lengths: column generation and rounding.

Works on counts per length only, so its size is bounded by the capacity and not
by the number of documents.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np


def price(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: for each exact fill the best total value and the length put in last (-1: unreachable)."""
    best = np.full(capacity + 1, -np.inf)
    last = np.full(capacity + 1, -1, np.int64)
    best[0] = 0.0
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(int(lengths[0]), capacity + 1):
        k = upto[c]
        got = values[:k] + best[c - lengths[:k]]
        i = int(got.argmax())
        best[c], last[c] = got[i], i
    last[~np.isfinite(best)] = -1
    return best, last


def _pattern(last: np.ndarray, lengths: np.ndarray, fill: int) -> np.ndarray:
    a = np.zeros(len(lengths))
    while fill > 0:
        a[last[fill]] += 1
        fill -= lengths[last[fill]]
    return a


def _greedy(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Patterns of a largest-first fill of the whole histogram, as first columns for the simplex."""
    left, made = counts.astype(float).copy(), []
    while left.max() > 1e-9:
        room, a = capacity, np.zeros(len(lengths))
        for i in range(len(lengths) - 1, -1, -1):
            if left[i] > 1e-9 and lengths[i] <= room:
                a[i] = min(room // lengths[i], np.ceil(left[i]))
                room -= int(a[i] * lengths[i])
        on = a > 0
        left[on] -= a[on] * (left[on] / a[on]).min()
        made.append(a)
    return made


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int, gap: float = 2e-4, rounds: int = 4000):
    """Patterns and their fractional use: columns priced by the knapsack enter a revised simplex.

    Starts from one pattern per length, takes in the greedy patterns, then prices.
    Each pricing offers the best fill around every length. Stops when no pattern
    prices out, when the number of sequences is within ``gap`` of the tokens they
    must hold, or after ``rounds`` pivots; every basis on the way packs all pieces.
    """
    m = len(lengths)
    copies = capacity // lengths
    patterns = [np.where(np.arange(m) == i, copies, 0).astype(float) for i in range(m)]
    inverse = np.diag(1.0 / copies)
    use = counts / copies
    floor = float((lengths * counts).sum()) / capacity
    pool = np.array(_greedy(lengths, counts, capacity)).T
    for _ in range(rounds):
        if use.sum() <= floor * (1 + gap):
            break
        dual = inverse.sum(axis=0)
        gain = dual @ pool - 1.0
        j = int(gain.argmax())
        if gain[j] <= 1e-9:
            best, last = price(dual, lengths, capacity)
            fills = [int(np.nanargmax(np.where(np.isfinite(best[: capacity - n + 1]), best[: capacity - n + 1], -np.inf))) for n in lengths]
            fresh = np.array([_pattern(last, lengths, f) for f in fills]).T
            fresh[np.arange(m), np.arange(m)] += 1
            fresh = fresh[:, dual @ fresh - 1.0 > 1e-9]
            if not fresh.shape[1]:
                break
            pool = np.unique(fresh, axis=1)
            continue
        column = pool[:, j]
        step = inverse @ column
        up = step > 1e-9
        ratio = np.where(up, use / np.where(up, step, 1.0), np.inf)
        leave = int(ratio.argmin())
        theta = ratio[leave]
        use = np.maximum(use - theta * step, 0.0)
        use[leave] = theta
        inverse[leave] /= step[leave]
        rest = step.copy()
        rest[leave] = 0.0
        inverse -= np.outer(rest, inverse[leave])
        patterns[leave] = column
    return patterns, use


def best_fit(items: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing for the few pieces that rounding leaves."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []
    for x in sorted(items, reverse=True):
        at = bisect_left(room, (x, -1))
        if at == len(room):
            bins.append([x])
            left, b = capacity - x, len(bins) - 1
        else:
            left, b = room.pop(at)
            bins[b].append(x)
            left -= x
        if left:
            insort(room, (left, b))
    return bins


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Which sequence the pieces of each length go to, by rank.

    Returns rows ``(length, first_rank, end_rank, first_sequence, copies, place)``
    and the number of sequences. The piece of rank ``r`` in such a row lies in
    sequence ``first_sequence + (r - first_rank) // copies``, where pieces are
    ordered by ``place`` and rank.
    """
    lengths = np.array(sorted(histogram), np.int64)
    if not len(lengths):
        return [], 0
    counts = np.array([histogram[int(x)] for x in lengths], np.int64)
    patterns, use = solve(lengths, counts.astype(float), capacity)
    left, done = counts.copy(), np.zeros(len(lengths), np.int64)
    rows: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0

    def put(amounts: dict[int, int], times: int) -> None:
        nonlocal sequences
        for place, (i, a) in enumerate(sorted(amounts.items(), reverse=True)):
            rows.append((int(lengths[i]), int(done[i]), int(done[i] + a * times), sequences, a, place))
            done[i] += a * times
            left[i] -= a * times
        sequences += times

    for j in np.argsort(-use, kind="stable"):
        amounts = {int(i): int(patterns[j][i]) for i in np.flatnonzero(patterns[j])}
        times = min(int(np.floor(use[j] + 1e-6)), *[int(left[i] // a) for i, a in amounts.items()])
        if times > 0:
            put(amounts, times)
    index = {int(x): i for i, x in enumerate(lengths)}
    for b in best_fit([int(x) for x, n in zip(lengths, left) for _ in range(n)], capacity):
        put({index[x]: b.count(x) for x in set(b)}, 1)
    return rows, sequences
