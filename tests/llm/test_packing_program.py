"""The configuration program is solved, and its columns are used, also where best fit would do."""

import numpy as np

from sparkmem.llm import packing

SIZE = 2048


def test_program_always_decides(monkeypatch):
    solved = []
    kept = packing.linear_program

    def program(demand, size, rounds):
        solved.append(demand.copy())
        return kept(demand, size, rounds)

    monkeypatch.setattr(packing, "linear_program", program)
    counts = {1024: 400, 512: 800, 300: 90, 1748: 90}  # best fit fills every sequence
    columns = packing.columns_for(counts, SIZE)
    assert len(solved) == 1 and sum(t for _, t in columns) == sum(n * k for n, k in counts.items()) // SIZE
    assert {n: int(k) for n, k in enumerate(solved[0]) if k} == counts
    held = {}
    for column, times in columns:
        assert sum(n * k for n, k in column.items()) == SIZE
        for n, k in column.items():
            held[n] = held.get(n, 0) + k * times
    assert held == counts


def test_program_columns_kept_on_ties(monkeypatch):
    monkeypatch.setattr(packing, "linear_program", lambda demand, size, rounds: ({((1000, 1), (400, 2)): 5.0}, 5.0))
    assert packing.columns_for({1000: 5, 400: 10}, SIZE) == [({1000: 1, 400: 2}, 5)]
    assert np.sum([t for _, t in packing.columns_for({2048: 3, 1000: 5, 400: 10}, SIZE)]) == 8
