"""The Jaccard join against brute force."""

import random
import re

import pytest

from sparkmem.llm.components import with_roots
from sparkmem.llm.jaccard import jaccard_groups


def brute(rows, n, percent):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(sets[i]), low.get(find(i)) if d is not None else None) for i, (d, _) in enumerate(rows)), key=str)


def mixture(seed):
    """Near copies in a large group, a chain of drifting copies, common passages, tiny, empty, null and repeated rows."""
    rng = random.Random(seed)
    words = lambda k: [f"w{rng.randrange(3000)}" for _ in range(k)]
    base, passage = words(200), words(60)
    texts = []
    for _ in range(40):
        copy = list(base)
        for _ in range(rng.randrange(0, 6)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    drift = words(150)
    for _ in range(25):
        drift = list(drift)
        drift[rng.randrange(150)] = f"y{rng.randrange(10**6)}"
        texts.append("  ".join(drift))
    texts += [" ".join(words(rng.randrange(5, 80)) + passage + words(rng.randrange(5, 80))) for _ in range(60)]
    texts += [" ".join(words(rng.randrange(1, 9))) for _ in range(40)] + ["a b", "A  b", "a", "", None, "\n \t", "ä ö ü ß", "Ä ö ü ß"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    return rows + [rows[3], rows[5], (None, texts[0])]


@pytest.mark.parametrize(("n", "percent", "seed"), [(4, 85, 1), (5, 80, 2), (1, 60, 3), (2, 95, 4)])
def test_groups(spark, n, percent, seed):
    rows = mixture(seed)
    df = spark.createDataFrame([(d, t, "other", 7) for d, t in rows], "doc_id long, text string, node string, row int").repartition(6)
    got = jaccard_groups(df, n=n, percent=percent).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, n, percent)


def test_empty(spark):
    assert jaccard_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 201), (199, 201)]
    got = {r.node: r.root for r in with_roots(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100, 199: 199, 200: 199, 201: 199}
