"""What op3_lm saves changes no result."""

import numpy as np

from sparkmem.llm import attention, lm
from sparkmem.llm.catalogue import PACKING_VOCABULARY, vocabulary

VOCABULARY = vocabulary(PACKING_VOCABULARY)


def test_words_side_by_side(monkeypatch):
    """Words that the table lacks cost one call a batch, not one each; only those with white space inside go alone."""
    model, calls = lm.encoder(VOCABULARY), []
    words = ["the", "xyzzy's", "'s", "　", "a ", " b", "x\x1cy", "été", "<|endoftext|>", "1,5%", "中文"] + [f"w{i}q" for i in range(500)]
    want = [model.encode_ordinary(" " + w) for w in words]
    table = lm.Table(["the"], np.array([7]), 8, 2, 1, VOCABULARY).ready()
    monkeypatch.setattr(type(model), "encode_ordinary", lambda self, text: calls.append(text) or self.plain.encode_ordinary(text))
    flat, bounds, begin, number, _, rare_at, rare = table.ids_of([" ".join(words).encode(), b""])
    assert len(calls) <= 4
    assert flat.tolist() == [*(i for x in want for i in x), lm.END_ID, lm.END_ID] and bounds.tolist() == [0, len(flat) - 1, len(flat)]
    assert begin.tolist() == np.cumsum([0, *map(len, want)])[:-1].tolist() and [w.decode() for w in rare] == words[1:]
    for some in ([], ["　"], ["　", "a"], ["a", "　"]):
        ids, sizes = lm._encode([w.encode() for w in some], VOCABULARY)
        alone = [model.plain.encode_ordinary(" " + w) for w in some]
        assert ids.tolist() == [i for x in alone for i in x] and sizes.tolist() == [len(x) for x in alone]


def test_step_is_adam():
    """A step over keys is Adam over all weights, the own vectors that a batch lacks included."""
    rng = np.random.default_rng(8)
    unit, own = rng.integers(0, attention.UNITS, 40).astype(np.uint8), np.where(np.arange(40) % 3, 1 + np.arange(40), 0)
    key, kinds = attention.keyed(unit, own)
    assert (kinds[0][key] == own).all() and (kinds[1][key] == unit).all()
    trainer, p = attention.Trainer(attention.initial(), 0.01, kinds), {k: v.astype(np.float64) for k, v in attention.initial().items()}
    m, s = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, 5):
        ids = rng.integers(0, 40 // step, (6, attention.WINDOW))
        goal, scored = rng.integers(0, attention.UNITS, ids.shape), rng.random(ids.shape) < 0.4
        trainer.step(key[ids], goal, scored)
        g = attention.gradients(p, unit[ids], own[ids], goal, scored)
        for k in p:
            m[k] += 0.1 * (g[k] - m[k])
            s[k] += 0.01 * (g[k] ** 2 - s[k])
            p[k] -= 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
    for k in p:
        near = np.isclose(trainer.p[k], p[k], atol=2e-3)
        assert near.mean() > 0.999, k  # gradients near 0 have a sign by rounding


def test_no_row_gets_lost():
    a = np.array([[400, 399, -1e9], [0, 1, -1e9], [-300, -1e9, -300]], np.float32)
    e, sums, top = attention._exps(a)
    want = a.astype(float) - a.max(axis=1, keepdims=True)
    want = want - np.log(np.exp(want).sum(axis=1, keepdims=True))
    assert np.allclose(e / sums[:, None], np.exp(want), atol=1e-6) and np.allclose(a - (top + np.log(sums))[:, None], want, rtol=1e-5, atol=1e-5)


def test_counts():
    texts = ["", "  A\x1cb\x0bc\x0c d\x85 ", None, "É é　x\xa0y\tZ\r\n", "a a\nb"]
    rows = lm.pa.record_batch([lm.pa.array(texts, lm.pa.string())], names=["text"])
    got = {w: c for r in lm._counts([rows]) for w, c in zip(r.column("word").to_pylist(), r.column("c").to_pylist(), strict=True)}
    assert got == {"a\x1cb": 1, "c": 1, "d\x85": 1, "É": 1, "é　x\xa0y": 1, "z": 1, "a": 2, "b": 1}
    assert not list(lm._counts([rows.slice(0, 1), rows.slice(2, 1)]))
