"""Columns of the packing program: whole, and near the bound on broad and on awkward histograms."""

import random

import numpy as np
import pytest

from sparkmem.llm.packing import ROUNDS, best_column, best_fit, columns_for, fill_up, fullest, linear_program

SIZE = 2048


def histogram(counts):
    left = np.zeros(SIZE + 1, np.int64)
    for n, k in counts.items():
        left[n] = k
    return left


def whole(columns, counts):
    """How many sequences; every piece once, none too full."""
    held = {}
    for column, times in columns:
        assert times > 0 and sum(n * k for n, k in column.items()) <= SIZE
        for n, k in column.items():
            held[n] = held.get(n, 0) + k * times
    assert held == {n: k for n, k in counts.items() if k}
    return sum(times for _, times in columns)


def lower_bound(counts):
    """For each bound on what is small: pieces that can't share, and the volume that the rooms beside the others don't take."""
    best = 0
    for small in range(SIZE // 2 + 1):
        alone = sum(k for n, k in counts.items() if n > SIZE - small)
        halves = [(n, k) for n, k in counts.items() if SIZE // 2 < n <= SIZE - small]
        room = sum((SIZE - n) * k for n, k in halves)
        rest = sum(n * k for n, k in counts.items() if small <= n <= SIZE // 2)
        best = max(best, alone + sum(k for _, k in halves) + max(0, -(-(rest - room) // SIZE)))
    return best


@pytest.mark.parametrize(("lengths", "most"), [(1500, 49), (500, 49), (200, 300)])
def test_broad_histograms(lengths, most):
    draw = random.Random(lengths)
    counts = {n: draw.randint(1, most) for n in draw.sample(range(1, SIZE), lengths)}
    used = whole(columns_for(counts, SIZE), counts)
    assert used <= whole(best_fit(histogram(counts), SIZE), counts)
    assert used <= 1.01 * lower_bound(counts)


def test_where_best_fit_fails():
    counts = {700: 3000, 683: 1500, 665: 1500, 400: 500}
    used = whole(columns_for(counts, SIZE), counts)
    _, dual = linear_program(histogram(counts).astype(float), SIZE, ROUNDS)
    assert used <= 1.01 * dual < whole(best_fit(histogram(counts), SIZE), counts) * 0.95


def test_odd_histograms():
    for counts in ({}, {SIZE: 5}, {1: 10_000_000}, {1: 1}, {SIZE: 2, SIZE - 1: 3, 1: 3}, {1024: 7, 1025: 7, 1023: 6}):
        assert whole(columns_for(counts, SIZE), counts) >= -(-sum(n * k for n, k in counts.items()) // SIZE)
    assert whole(columns_for({1: 10_000_000}, SIZE), {1: 10_000_000}) == -(-10_000_000 // SIZE)


def test_programs_against_all_sets():
    draw = random.Random(3)
    for _ in range(30):
        lengths = draw.sample(range(1, 30), 5)
        value = np.zeros(41)
        value[lengths] = [draw.random() * n for n in lengths]
        best = [0.0] * 41
        for room in range(1, 41):
            best[room] = max([best[room - 1], *(best[room - n] + value[n] for n in lengths if n <= room)])
        column = best_column(value, 40)
        assert sum(n * k for n, k in column.items()) <= 40 and abs(sum(value[n] * k for n, k in column.items()) - best[40]) < 1e-9
        left = np.zeros(41, np.int64)
        left[lengths] = [draw.randint(1, 3) for _ in lengths]
        sums = {0}
        for n in lengths:
            sums = {s + n * k for s in sums for k in range(left[n] + 1)}
        column = fullest(left, 40)
        assert all(k <= left[n] for n, k in column.items()) and sum(n * k for n, k in column.items()) == max(s for s in sums if s <= 40)
    counts = {n: 3 for n in range(100, 1100, 90)}
    assert whole(fill_up(histogram(counts), SIZE), counts) <= 12
