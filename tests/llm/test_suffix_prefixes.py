"""Common prefixes, eight bytes at a time, against loops; and how many passes they take."""

import numpy as np

from sparkmem.llm import suffix


def test_prefixes_by_loops():
    rng = np.random.default_rng(1)
    for _ in range(100):
        text = np.append(rng.integers(1, 3, int(rng.integers(2, 400))), 0).astype(np.uint8)
        a, b = rng.integers(0, len(text), (2, int(rng.integers(1, 40))))
        depth = int(rng.integers(1, 70))
        want = []
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            k = 0
            while k < depth and max(x, y) + k < len(text) and text[x + k] == text[y + k]:
                k += 1
            want.append(k)
        assert suffix.common_prefix(text, a, b, depth).tolist() == want


def test_eights_are_in_text_order():
    text = np.append(np.random.default_rng(2).integers(1, 256, 500), 0).astype(np.uint8)
    eights = suffix._eights(text, 20)
    raw = text.tobytes() + bytes(8)
    assert [int(eights[i]) for i in range(len(text))] == [int.from_bytes(raw[i : i + 8], "big") for i in range(len(text))]
