"""Top k by chunks against all scores, and metrics of a truth by classes against its pairs."""

import numpy as np
from pyspark.sql import functions as F

from sparkmem.operators import evaluation, vector


def test_leading_of_chunks():
    draw = np.random.default_rng(1)
    scores = draw.integers(0, 6, (5, 400)).astype(float)
    scores[draw.random(scores.shape) < 0.3] = -np.inf
    scores[4, 3:] = -np.inf
    ids = draw.permutation(400)
    chunks = [(np.arange(5), ids[i : i + 37], scores[:, i : i + 37], -scores[:, i : i + 37]) for i in range(0, 400, 37)]
    at, found, best, beside = vector._leading(5, chunks, 30)
    got = [[(b, i) for a, i, b in zip(at, found, best, strict=True) if a == q] for q in range(5)]
    assert got == [[(-s, i) for s, i in sorted((-s, i) for s, i in zip(scores[q], ids, strict=True) if s > -np.inf)[:30]] for q in range(5)]
    assert (beside == -best).all()


def test_many_queries_leave_few_rows_a_block(spark, monkeypatch):
    """More queries than are broadcast, over several blocks and chunks: lists as of all at once."""
    draw = np.random.default_rng(2)
    rows = [(i, draw.integers(-3, 4, 6).astype(float).tolist()) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    asked = df.where("id % 5 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("vector"))
    lists = lambda: (sorted(map(tuple, vector.exact_topk(df, asked, 7, metric="ip", exclude_self=True).collect())), sorted(map(tuple, vector.quantised_topk(df.select("id", vector.quantised("embedding").alias("q")), asked, 7, least=20, factor=2).collect())))
    want = lists()
    for name, value in (("MOST_QUERIES", 40), ("BLOCK_ROWS", 200), ("CHUNK", 33)):
        monkeypatch.setattr(vector, name, value)
    assert lists() == want and len(want[0]) == 700


def test_class_metrics(spark):
    held = spark.createDataFrame([(i, None if i % 11 == 0 else i * i % 5) for i in range(60)], "id long, label int")
    queries = held.where("id % 3 = 0").select(F.col("id").alias("qid"), F.col("label").alias("wanted")).unionByName(spark.createDataFrame([(200, 1), (201, 77)], "qid long, wanted int"))
    results = queries.where("qid != 9").select("qid", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("position")).select("qid", "position", ((F.col("qid") * 7 + F.col("position") * 3) % 60).alias("id"))
    truth = held.join(queries, F.col("label") == F.col("wanted")).where("id != qid").select("qid", "id", F.lit(1.0).alias("gain"))
    want = evaluation.recall_precision_mrr(results, truth, 10).join(evaluation.ndcg_at(results, truth, 10), "qid")
    rounded = lambda df: sorted((r.qid, *(round(x, 9) for x in r[1:])) for r in df.collect())
    assert rounded(evaluation.class_metrics(results, queries, held, 10)) == rounded(want) != []
