"""Label containment, as-of joins for many times and strongly connected components against loops."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from sparkmem.operators import containment, graph, temporal


@pytest.mark.parametrize("most", [10_000, 3])
def test_contained(spark, monkeypatch, most):
    monkeypatch.setattr(containment, "MOST_LITERALS", most)
    draw = random.Random(1)
    texts = [(i, "".join(draw.choice("abCdÉ é\n") for _ in range(draw.randrange(60)))) for i in range(150)] + [(500, None), (501, ""), (502, "a"), (503, "x" * 40_000 + "needle")]
    labels = [(i, "".join(draw.choice("abcdé ") for _ in range(draw.randrange(1, 5)))) for i in range(60)] + [(90, ""), (91, None), (92, "NEEDLE"), (93, "CdÉ"), (94, "zz")]
    got = {(r.id, r.label_id) for r in containment.contained(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(labels, "label_id int, label string")).collect()}
    assert got == {(i, k) for i, t in texts for k, x in labels if t and x and x.lower() in t.lower()} and (503, 92) in got
    none = spark.createDataFrame([], "label_id int, label string")
    assert containment.contained(spark.createDataFrame(texts, "id int, text string"), none).count() == 0


def test_as_of_many(spark):
    draw = random.Random(2)
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=n)
    maybe = lambda n: None if draw.random() < 0.2 else day(n)
    facts = [(i, maybe(a := draw.randrange(3000)), maybe(a + draw.choice([0, 1, 5, 700, 2900])), maybe(b := draw.randrange(3000)), maybe(b + draw.randrange(900))) for i in range(300)]
    asks = [(q, day(draw.randrange(-50, 3200)), day(draw.randrange(3200))) for q in range(60)] + [(90, None, day(1)), (91, day(1), None), (92, day(500), day(500)), (92, day(500), day(500))]
    df = spark.createDataFrame(facts, "id int, valid_from timestamp, valid_until timestamp, tx_from timestamp, tx_until timestamp")
    asked = spark.createDataFrame(asks, "qid int, valid timestamp, system timestamp")
    inside = lambda a, b, t: t is not None and (a is None or a <= t) and (b is None or t < b)
    want = sorted((q, f[0]) for q, v, s in asks for f in facts if inside(f[1], f[2], v) and inside(f[3], f[4], s))
    found = temporal.as_of_many(df, asked)
    assert sorted((r.qid, r.id) for r in found.collect()) == want and len(want) > 500
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    one = next(a for a in asks if a[0] == 7)
    assert sorted(r.id for r in temporal.as_of(df, F.lit(one[1]), F.lit(one[2])).collect()) == [i for q, i in want if q == 7]
    assert temporal.as_of_many(df, asked.limit(0)).count() == 0 == temporal.as_of_many(df.limit(0), asked).count()


@pytest.mark.parametrize("minutes", [1440, 60, 7])
def test_as_of_totals(spark, minutes):
    draw = random.Random(minutes)
    at = lambda n: datetime.datetime(2024, 1, 1, 3) + datetime.timedelta(minutes=minutes * n)
    off = lambda n: at(n) + datetime.timedelta(seconds=draw.choice([0, 0, 1]))
    maybe = lambda n: None if draw.random() < 0.2 else off(n)
    facts = [(i - 150, maybe(a := draw.randrange(-20, 300)), maybe(a + draw.choice([0, -3, 1, 5, 70, 290])), maybe(b := draw.randrange(300)), maybe(b + draw.randrange(90))) for i in range(300)] + [(None, None, None, None, None)]
    asks = [(q, at(draw.randrange(-50, 320)), at(draw.randrange(320))) for q in range(90)] + [(90, None, at(1)), (91, at(1), None), (92, at(50), at(50)), (92, at(50), at(50))]
    df = spark.createDataFrame(facts, "id long, valid_from timestamp, valid_until timestamp, tx_from timestamp, tx_until timestamp")
    asked = spark.createDataFrame(asks, "qid int, valid timestamp, system timestamp")
    inside = lambda a, b, t: (a is None or a <= t) and (b is None or t < b)
    met = [(q, [f[0] for f in facts if inside(f[1], f[2], v) and inside(f[3], f[4], s)]) for q, v, s in asks if v and s]
    want = sorted((q, len(ids), sum(i or 0 for i in ids)) for q, ids in met if ids)
    found = temporal.as_of_totals(df, asked)
    assert sorted((r.qid, r.n, r.total) for r in found.collect()) == want and len(want) > 50
    assert temporal.as_of_totals(df, asked.limit(0)).count() == 0 == temporal.as_of_totals(df.limit(0), asked).count()


def test_as_of_totals_makes_no_pairs(spark):
    """4,000 open facts and as many asked times have 8 million pairs; facts don't reach a join but as sums by bucket."""
    day = F.timestamp_micros(F.col("id") * 86_400_000_000)
    none = F.lit(None).cast("timestamp")
    facts = spark.range(4000).select("id", day.alias("valid_from"), none.alias("valid_until"), day.alias("tx_from"), none.alias("tx_until"))
    asks = spark.range(4000).select(F.col("id").alias("qid"), day.alias("valid"), day.alias("system"))
    found = temporal.as_of_totals(facts, asks)
    assert found.agg(F.sum("n")).first()[0] == 4000 * 4001 // 2
    assert found.where("total != qid * (qid + 1) / 2").count() == 0
    below = found._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[1]
    assert below.count("Aggregate") >= 4 and "Range" in below


def brute_components(steps):
    nodes = {x for s in steps for x in s}
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in steps:
            reach[a] |= reach[b]
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes if any(m != n and m in reach[n] and n in reach[m] for m in nodes)}


@pytest.mark.parametrize("seed", [1, 2])
def test_strong_components(spark, seed):
    draw = random.Random(seed)
    steps = {(draw.randrange(26), draw.randrange(26)) for _ in range(32)} | {(30, 31), (31, 32), (32, 30), (32, 40), (40, 41), (41, 40), (50, 50)}
    got = {r.id: r.component for r in graph.strong_components(spark.createDataFrame(sorted(steps), "source int, target int")).collect()}
    assert got == brute_components(steps)


def test_cycles_stop_early(spark):
    ring = [(i, (i + 1) % 6) for i in range(6)] + [(0, 10), (10, 0), (20, 21)]
    df = spark.createDataFrame(ring, "source int, target int")
    assert sorted(tuple(r.cycle) for r in graph.cycles(df).collect()) == [(0, 1, 2, 3, 4, 5), (0, 10)]
    assert [tuple(r.cycle) for r in graph.cycles(df, enough=lambda found: found.count() >= 1).collect()] == [(0, 10)]
    assert graph.cycles(df.limit(0)).count() == 0


def test_labels_met_in_a_batch():
    import pandas as pd

    batch = pd.DataFrame({"id": [1, 2, 3], "text": ["a needle 😀b", "nee dle", "zz"]})
    labels = [(0, "needle", "eed"), (1, "zz", "zz"), (2, "😀b", "😀b"), (3, "need", "nee")]
    got = {tuple(r) for part in containment._met(labels)([batch]) for r in part.itertuples(index=False)}
    assert got == {(1, 0), (1, 2), (1, 3), (3, 1)}
