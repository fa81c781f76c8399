"""Ranked search over bit slices against sums by loops."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkmem.llm.bitsliced import add_slices, index, places_of, ranked_search, search, terms_of, to_slices, top_slices

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return PATTERN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    N, L = sum(n > 0 for _, _, n in held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in held:
            m = 75 + 25 * n * N // L if L else 0
            score = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, math.inf if i is None else i, i))
        found.sort(key=lambda x: x[:2])
        out += [(item, rank, i, -score) for rank, (score, _, i) in enumerate(found[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def text(draw, words, most):
    return draw.choice([" ", ", ", "-", "\n"]).join(words[min(int(draw.expovariate(0.08)), len(words) - 1)] for _ in range(draw.randint(0, most)))


WORDS = [f"{a}{b}{c}" for a in ("x", "É", "ß7", "漢") for b in ("A", "b", "9") for c in ("", "q", "Zz", "é")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_loops(spark, seed):
    draw = random.Random(seed)
    docs = [(i, text(draw, WORDS, 60)) for i in range(400)] + [(1000 + i, "copy of xAq and É9 é") for i in range(90)]
    draw.shuffle(docs)
    items = [(i, text(draw, WORDS, 25)) for i in range(12)] + [(50, "copy " * 9 + "xAq"), (51, "nowhere")]
    got = search(index(spark.createDataFrame(docs, DOCS).repartition(3), block_docs=70), spark.createDataFrame(items, ITEMS), sent_bytes=300 if seed == 1 else 1 << 20)
    assert rows(got) == brute(docs, items)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "-- ,;"), (None, "Alpha beta"), (4, "alpha beta"), (4, "ALPHA beta"), (5, "x" * 50_000), (6, "alpha " * 20_000 + "gamma"), (7, "\x00alpha\x1cbeta"), (8, "<|alpha|>")]
    items = [(1, None), (2, ""), (3, "alpha"), (3, "alpha alpha BETA"), (None, "beta"), (4, "x" * 50_000), (5, "gamma delta")]
    a, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert rows(ranked_search(a, b)) == brute(docs, items)
    clash = a.withColumns({"segment": F.lit(1), "lengths": F.lit("x"), "score": F.lit(2), "id": F.lit(3)})
    assert rows(ranked_search(clash, b.withColumns({"id": F.lit(1), "terms": F.lit("y"), "rank": F.lit(9)}))) == brute(docs, items)
    assert rows(ranked_search(a.limit(0), b)) == [] == rows(ranked_search(a, b.limit(0)))
    assert rows(ranked_search(spark.createDataFrame([(1, None), (2, "!")], DOCS), b)) == []


def test_terms():
    where, found = terms_of([b"", "Ab-é9 \x7f".encode(), b"", b"x", b"y\nz"])
    assert (where.tolist(), [t.decode() for t in found.to_pylist()]) == ([1, 1, 3, 4, 4], ["ab", "é9", "x", "y", "z"])


def test_slices():
    draw = np.random.default_rng(4)
    for _ in range(60):
        words = int(draw.integers(1, 5))
        n = int(draw.integers(1, 6))
        total, given = np.zeros(64 * words, np.int64), []
        for _ in range(n):
            places = np.sort(draw.choice(64 * words, int(draw.integers(1, 64 * words)), replace=False))
            values, times = draw.integers(0, 1 << int(draw.integers(1, 30)), len(places)), int(draw.integers(1, 9))
            given.append((to_slices(places, values, words), times))
            total[places] += values * times
        bits = sum(t << len(x) for x, t in given).bit_length()
        made = add_slices(given, bits, words)
        assert (sum(np.unpackbits(row.view(np.uint8), bitorder="little").astype(np.int64) << b for b, row in enumerate(made)) == total).all()
        ids, k = draw.permutation(64 * words), int(draw.integers(1, 30))
        want = sorted((-s, i) for s, i in zip(total.tolist(), ids.tolist(), strict=True) if s > 0)[:k]
        where, score = top_slices(made, k, ids)
        assert list(zip((-score).tolist(), ids[where].tolist(), strict=True)) == want
    assert places_of(np.array([5, 1 << 63], np.uint64)).tolist() == [0, 2, 127]
