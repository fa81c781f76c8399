"""Every window of every learning document trains the model, once."""

import numpy as np

from sparkmem.llm import attention, lm


def test_each_window_in_one_round():
    rng = np.random.default_rng(4)
    bounds = np.concatenate(([0], np.cumsum(rng.integers(1, 400, 300))))
    starts, shape = attention.windows(bounds, attention.WINDOW)
    draws = rng.integers(-(1 << 62), 1 << 62, 300)
    taken = np.array([lm.drawn(draws, number, starts, bounds) for number in range(len(lm.RATES))])
    assert (taken.sum(axis=0) == 1).all() and (taken.sum(axis=1) > 0).all()
    at, scored = attention.gathered(starts, shape, np.ones(bounds[-1], bool))
    assert sorted(at[scored].tolist()) == list(range(bounds[-1]))


def test_marks_round_trip():
    rng = np.random.default_rng(5)
    bounds = np.concatenate(([0], np.cumsum(rng.integers(1, 40, 50))))
    flat, opens = rng.integers(0, lm.IDS, bounds[-1]).astype(np.uint16), rng.random(bounds[-1]) < 0.3
    batch = lm.pa.RecordBatch.from_arrays([lm._binaries(flat, 2 * bounds), lm._packed(opens, bounds)], names=["ids", "opens"])
    for x, y in zip(lm._unpacked(batch.slice(0, 50)), (flat, opens, bounds), strict=True):
        assert (x == y).all()
    assert (lm._unpacked(batch.slice(7, 5))[0] == flat[bounds[7] : bounds[12]]).all()


def test_classes_by_neighbours():
    """Ids that stand beside the same frequent ids share a class, however rare the documents that hold them."""
    counts = np.array([0, 900, 800, *[100] * 40], float)
    beside = np.zeros((43, 4))
    beside[3:23, 0], beside[23:, 1] = 100, 100
    unit = attention.unit_map(counts, beside, 0, 2)
    assert not set(unit[3:23].tolist()) & set(unit[23:].tolist())
