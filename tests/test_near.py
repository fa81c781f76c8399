"""Near duplicates against all pairs: both ways, copies, crowded centres, and how few blocks are compared."""

import numpy as np
from pyspark.sql import functions as F

from sparkmem.operators import vector

SCHEMA = "id long, embedding array<float>"


def brute(rows, threshold):
    ids = np.array([i for i, v in rows])
    m = np.array([v for _, v in rows], np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    out = {}
    for k in range(len(ids)):
        best = sorted((-round(min(s[k, j], 1.0), 9), ids[j]) for j in range(len(ids)) if ids[j] != ids[k] and s[k, j] >= threshold)
        if best:
            out[int(ids[k])] = (int(best[0][1]), -best[0][0])
    return out


def fixture(clusters, each, spread, dims=16):
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(clusters, dims))
    rows = [(i, (centres[i % clusters] * draw.uniform(0.5, 2) + spread * draw.normal(size=dims)).astype(np.float32).tolist()) for i in range(clusters * each)]
    crowd = [(10_000 + i, (centres[0] + 0.3 * spread * draw.normal(size=dims)).astype(np.float32).tolist()) for i in range(len(rows) // 2)]
    return rows + crowd


def test_equals_all_pairs_and_prunes(spark):
    rows = fixture(30, 12, 0.12)
    rows += [(20_000 + i, rows[7][1]) for i in range(40)] + [(30_000, rows[9][1])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.id: (r.duplicate_of, r.confidence) for r in vector.near_duplicates(df, 0.95, block=16).collect()}
    want = brute(rows, 0.95)
    assert set(got) == set(want) and len(want) > 300
    assert all(abs(got[i][1] - want[i][1]) < 1e-6 for i in want)
    assert got[7] == (20_000, 1.0) and got[20_005] == (7, 1.0) and got[9] == (30_000, 1.0)
    assert sum(got[i][0] != want[i][0] for i in want) == 0
    _, tested = vector.near_pairs(df.dropDuplicates(["embedding"]), 0.95, block=16)
    n = df.dropDuplicates(["embedding"]).count()
    done = tested.agg(F.sum(F.col("a") * F.col("b")).alias("s"), F.max("a").alias("a"), F.max("b").alias("b")).first()
    assert done.s < n * n / 2.5 and max(done.a, done.b) <= 48  # the crowd is a third of all rows, and must be compared with itself


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, 0.0, 0.0]), (7, [0.0, -1.0]), (None, [1.0, 0.0]), (8, [1.0, None])]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"centre": F.lit(1), "ring": F.lit("x")})
    assert sorted((r.id, r.duplicate_of, round(r.confidence, 6)) for r in vector.near_duplicates(df).collect()) == [(1, 2, 1.0), (2, 1, 1.0)]
    assert vector.near_duplicates(df.limit(0)).count() == 0
    assert vector.near_duplicates(df, -1.0).where("id = 7").first().confidence in (0.0, -0.0)


def test_shelves_hold_all_pairs(spark):
    rows = fixture(30, 12, 0.12)
    df = spark.createDataFrame(rows, SCHEMA)
    ids, m = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = {(int(ids[i]), int(ids[j])) for i, j in zip(*np.nonzero(m @ m.T >= 0.95), strict=True) if i != j}
    for shelf in (40, 200, 10_000):
        pairs, tested = vector.near_pairs(df, 0.95, block=16, shelf=shelf)
        found = [(r.id, r.near) for r in pairs.collect()]
        assert len(found) == len(set(found)) and set(found) == want
    best = {r.id for r in vector.near_pairs(df, 0.95, block=16, shelf=40, best=True)[0].collect()}
    assert best == {a for a, _ in want}


def test_vectors_that_do_not_cluster_move_little(spark):
    """Far vectors can't be pruned; each moves once a shelf, not once for every ring of every centre."""
    draw = np.random.default_rng(3)
    df = spark.createDataFrame([(i, draw.normal(size=24).tolist()) for i in range(3000)], "id long, embedding array<double>")
    pairs, tested = vector.near_pairs(df, 0.95, block=64, shelf=1000, best=True)
    moved = tested.select("x", "y").distinct().count() * 2 * 1000
    assert moved <= 3000 * 8 and pairs.count() == 0
    done = tested.agg(F.sum(F.col("a") * F.col("b"))).first()[0]
    assert done <= 3000 * 3000 * 0.6
