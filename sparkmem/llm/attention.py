"""A small causal self-attention language model in numpy over subword ids.

An id enters as the sum of a vector of its class and, if it is frequent, one of its own. One head of masked attention over a
window of ids, a residual path and a table for the class before give the probabilities of the class of the next word's
first id; classes are made of ids by the frequent ids beside them, the most frequent ids being classes of their own.
What stands within a class follows the corpus counts (see lm.py). Only the scored positions ask; all others answer."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

UNITS, WIDTH, WINDOW, STRIDE = 64, 16, 32, 24
#: Frequent ids with a vector of their own.
OWN = 8192
#: Frequent ids whose neighbourhood to an id tells its class.
BESIDE = 64
BATCH = 256
_MASK = np.triu(np.full((WINDOW, WINDOW), np.float32(-1e9)), 1)


def unit_map(counts: np.ndarray, beside: np.ndarray, end_id: int, alone: int, seed: int = 1) -> np.ndarray:
    """The unit of each id: 0 for the end, the most frequent ids alone, classes by neighbours for the others.

    beside: of each id, how often each of some frequent ids stands beside it."""
    rng = np.random.default_rng(seed)
    size, topics = len(counts), UNITS - 1 - alone
    share = np.sqrt(beside / np.maximum(beside.sum(axis=1, keepdims=True), 1), dtype=np.float32)
    busy = np.argsort(-counts, kind="stable")[: min(size, 4000)]
    basis = np.linalg.svd(share[busy], full_matrices=False)[2][:16]
    place = share @ basis.T
    weight = np.sqrt(counts + 1.0)
    centre = place[rng.choice(busy, topics, replace=len(busy) < topics)].astype(np.float64)
    for _ in range(25):
        near = ((place[busy, None, :] - centre[None]) ** 2).sum(-1).argmin(axis=1)
        for t in range(topics):
            if (near == t).any():
                centre[t] = np.average(place[busy[near == t]], axis=0, weights=weight[busy[near == t]])
    topic = np.concatenate([((place[a : a + 4096, None, :] - centre[None]) ** 2).sum(-1).argmin(axis=1) for a in range(0, size, 4096)])
    unit = 1 + alone + topic
    first = [i for i in busy.tolist() if i != end_id][:alone]
    unit[first] = 1 + np.arange(len(first))
    unit[end_id] = 0
    return unit.astype(np.uint8)


def own_rows(counts: np.ndarray) -> np.ndarray:
    """The row of each id's own vector; 0, which stays 0, for ids that have none."""
    out = np.zeros(len(counts), np.int32)
    busy = np.argsort(-counts, kind="stable")[:OWN]
    busy = busy[counts[busy] > 0]
    out[busy] = 1 + np.arange(len(busy))
    return out


def initial(seed: int = 2) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    zeros = lambda *shape: np.zeros(shape, np.float32)
    return {"embed": draw(UNITS, WIDTH), "own": zeros(OWN + 1, WIDTH), "place": draw(WINDOW, WIDTH), "q": draw(WIDTH, WIDTH), "k": draw(WIDTH, WIDTH), "v": draw(WIDTH, WIDTH), "o": draw(WIDTH, WIDTH), "out": draw(WIDTH, UNITS), "pair": zeros(UNITS, UNITS)}


def windows(bounds: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Start in the flat ids, and size and number of scored positions (the last ones), of each window over each document.

    Each id is scored once: the first window of a document scores all it holds, later ones their new ids."""
    n = np.diff(bounds)
    k = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // stride)), 0)
    doc = np.repeat(np.arange(len(n)), k)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
    ends = np.minimum(WINDOW + stride * nth, n[doc])
    begins = np.maximum(ends - WINDOW, 0)
    before = np.where(nth > 0, np.minimum(WINDOW + stride * (nth - 1), n[doc]), 0)
    return bounds[:-1][doc] + begins, np.stack((ends - begins, ends - before), axis=1)


def gathered(starts: np.ndarray, shape: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat positions of windows, padded to WINDOW, and which of them are scored: new ones at which a word or end begins."""
    at = starts[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < shape[:, :1]
    at = np.where(inside, at, starts[:, None])
    return at, inside & (np.arange(WINDOW) >= (shape[:, 0] - shape[:, 1])[:, None]) & opens[at]


def _attend(q, k, v, mask=_MASK):
    a = q @ k.transpose(0, 2, 1)
    a *= np.float32(WIDTH**-0.5)
    a += mask
    a -= a.max(axis=2, keepdims=True)
    np.exp(a, out=a)
    a /= (a @ np.ones(a.shape[2], a.dtype))[..., None]
    return a, a @ v


def _forward(p, x, own):
    h = p["embed"][x] + p["own"][own] + p["place"]
    q, k, v = h @ p["q"], h @ p["k"], h @ p["v"]
    a, z = _attend(q, k, v)
    return h, q, k, v, a, z, h + z @ p["o"]


def prepared(p, unit: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The vector of each id."""
    return np.take(p["embed"], unit, axis=0) + np.take(p["own"], own, axis=0)


def keyed(unit: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """A key of each id, the same for ids that enter the same, and of each key the row of its own vector and its unit."""
    key = np.where(own > 0, own, OWN + 1 + unit.astype(np.int64))
    units = np.concatenate((np.zeros(OWN + 1), np.arange(UNITS))).astype(np.uint8)
    units[key] = unit
    return key.astype(np.uint16), (np.concatenate((np.arange(OWN + 1), np.zeros(UNITS, np.int64))), units)


def _flat(t: np.ndarray) -> np.ndarray:
    return t.reshape(-1, t.shape[-1])


def _asked(scored: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The scored places of each window side by side (the last place fills up), and of the scored ones the flat slots there and the flat positions."""
    at = np.flatnonzero(scored)
    row = at // WINDOW
    counts = np.bincount(row, minlength=len(scored))
    most = max(1, int(counts.max(initial=0)))
    slot = np.arange(len(at)) + np.repeat(most * np.arange(len(scored)) - (np.cumsum(counts) - counts), counts)
    places = np.full(len(scored) * most, WINDOW - 1)
    places[slot] = at - row * WINDOW
    return places.reshape(len(scored), most), slot, at


def _exps(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exponentials of the rows less a shift, their sums, and the shift: one for all, as long as no row gets lost beside it."""
    ones, top = np.ones(a.shape[1], a.dtype), a.max()
    e = a - top
    np.exp(e, out=e)
    sums = e @ ones
    if not sums.min() > 1e-30:
        top = a.max(axis=1)
        e = np.exp(a - top[:, None])
        sums = e @ ones
    return e, sums, top


def _products(p) -> tuple[np.ndarray, np.ndarray]:
    """What turns an asking vector into one that meets the vectors of the window themselves, and their mean into the answer."""
    return (p["q"] @ p["k"].T) * np.float32(WIDTH**-0.5), p["v"] @ p["o"]


def _answers(p, h: np.ndarray, places: np.ndarray):
    """Flat positions that ask, their vectors, what they ask for, attention, means and results; only the places that ask cost a query, and keys and values never exist."""
    into, outof = _products(p)
    asks = (WINDOW * np.arange(len(h))[:, None] + places).ravel()
    asked = np.take(_flat(h), asks, axis=0)
    sought = (asked @ into).reshape(*places.shape, WIDTH)
    a = sought @ h.transpose(0, 2, 1)
    a += np.take(_MASK, places, axis=0)
    a, sums, _ = _exps(_flat(a))
    a /= sums[:, None]
    a = a.reshape(*places.shape, WINDOW)
    mean = _flat(a @ h)
    return asks, asked, sought, a, mean, asked + mean @ outof


def log_probs(p, table: np.ndarray, units: tuple, before: np.ndarray, flat: np.ndarray, opens: np.ndarray, bounds: np.ndarray, chunk: int = 256) -> np.ndarray:
    """Natural log probability, at each flat position where a word or end begins, of the unit there (0 elsewhere).

    table: the vectors of ids; units: of each id as input and as output. Only these positions ask; windows with like numbers of them go together."""
    out = np.zeros(len(before), np.float32)
    starts, shape = windows(bounds)
    at_all, scored_all = gathered(starts, shape, opens)
    by_size = np.argsort(scored_all.sum(axis=1).astype(np.uint8), kind="stable")
    for low in range(0, len(starts), chunk):
        pick = by_size[low : low + chunk]
        at, scored = np.take(at_all, pick, axis=0), np.take(scored_all, pick, axis=0)
        places, slot, place = _asked(scored)
        h = np.take(table, np.take(before, at), axis=0)
        h += p["place"]
        logits = np.take(_answers(p, h, places)[-1], slot, axis=0) @ p["out"]
        if not len(logits):
            continue
        where = np.take(at, place)
        logits += np.take(p["pair"], np.take(units[0], before[where]), axis=0)
        found = logits[np.arange(len(logits)), np.take(units[1], flat[where])]
        _, sums, top = _exps(logits)
        out[where] = found - top - np.log(sums)
    return out


class Trainer:
    """Adam on the mean log loss of the scored positions.

    kinds: of each key that windows are made of, the row of its own vector and its unit; but for 0, a row has one key."""

    def __init__(self, p: dict[str, np.ndarray], rate: float, kinds: tuple[np.ndarray, np.ndarray]):
        self.rate, self.kinds, self.steps = rate, kinds, 0
        self.names = [k for k in p if k != "own"]
        rest = np.concatenate([p[k].ravel() for k in self.names])
        parts = np.split(rest, np.cumsum([p[k].size for k in self.names])[:-1])  # of the same memory
        self.both = rest, p["own"].copy()
        self.p = {k: x.reshape(p[k].shape) for k, x in zip(self.names, parts, strict=True)} | {"own": self.both[1]}
        self.state = [tuple(np.zeros_like(x) for _ in range(3)) for x in self.both]

    def step(self, key, goal, scored) -> None:
        self.steps += 1
        rows, sums, g = _gradients(self.p, key, self.kinds, goal, scored)
        own = self.kinds[0][rows]
        fade, wane = 1 - 0.9**self.steps, (1 - 0.99**self.steps) ** 0.5
        found = ((slice(None), np.concatenate([g[k].ravel() for k in self.names])), (own[own > 0], sums[own > 0]))  # own vectors that a batch lacks have no gradient
        for p, (m, s, change), (at, slope) in zip(self.both, self.state, found, strict=True):
            m *= 0.9
            s *= 0.99
            m[at] += 0.1 * slope
            s[at] += 0.01 * slope**2
            np.sqrt(s, out=change)
            change += 1e-8 * wane
            np.divide(m, change, out=change)
            change *= self.rate * wane / fade
            p -= change


def _summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows in order, and the sums of their values."""
    order = np.argsort(rows, kind="stable")
    held = rows[order]
    begins = np.flatnonzero(np.concatenate((np.ones(min(1, len(held)), bool), held[1:] != held[:-1])))
    if not len(held):
        return held, values
    pairs = np.take(values, order, axis=0).view(np.result_type(values, np.complex64))  # two columns are added at once
    return held[begins], np.add.reduceat(pairs, begins, axis=0).view(values.dtype)


def _spread(size: int, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros((size, values.shape[1]), values.dtype)
    rows, values = _summed(rows, values)
    out[rows] = values
    return out


def gradients(p, x, own, goal, scored):
    """Gradients of the mean log loss of the scored positions, which alone ask."""
    both, key = np.unique(own.astype(np.int64) * UNITS + x, return_inverse=True)
    kinds = both // UNITS, both % UNITS
    rows, sums, g = _gradients(p, key.reshape(x.shape), kinds, goal, scored)
    g["own"] = _spread(OWN + 1, kinds[0][rows], sums)
    g["own"][0] = 0
    return g


def _gradients(p, key, kinds, goal, scored):
    """The keys that occur with the gradients of their vectors, and those of all weights but the own vectors."""
    places, slot, at = _asked(scored)
    into, outof = _products(p)
    h = np.take(prepared(p, kinds[1], kinds[0]), key, axis=0)
    h += p["place"]
    asks, asked, sought, a, mean, top = _answers(p, h, places)
    unit = np.take(kinds[1], np.take(key, asks))
    d = top @ p["out"]
    d += np.take(p["pair"], unit, axis=0)
    d, sums, _ = _exps(d)
    share = np.zeros_like(sums)
    share[slot] = 1 / max(1, len(slot))
    d *= (share / sums)[:, None]
    d[slot, np.take(goal, at)] -= 1 / max(1, len(slot))
    g = {"out": top.T @ d, "pair": _spread(UNITS, unit, d)}
    dtop = d @ p["out"].T
    doutof = mean.T @ dtop
    g["v"], g["o"] = doutof @ p["o"].T, p["v"].T @ doutof
    dmean = (dtop @ outof.T).reshape(*places.shape, WIDTH)
    da = dmean @ h.transpose(0, 2, 1)
    da -= (_flat(a * da) @ np.ones(WINDOW, a.dtype)).reshape(*places.shape, 1)
    da *= a
    dsought = _flat(da @ h)
    dinto = (asked.T @ dsought) * np.float32(WIDTH**-0.5)
    g["q"], g["k"] = dinto @ p["k"], dinto.T @ p["q"]
    dh = np.concatenate((a, da), axis=1).transpose(0, 2, 1) @ np.concatenate((dmean, sought), axis=1)
    dtop += dsought @ into.T
    flat = _flat(dh)
    flat[at] += np.take(dtop, slot, axis=0)
    g["place"] = (np.ones(len(dh), dh.dtype) @ dh.reshape(len(dh), -1)).reshape(WINDOW, WIDTH)
    rows, sums = _summed(key.ravel(), flat)
    g["embed"] = _spread(UNITS, kinds[1][rows], sums)
    return rows, sums, g
