"""Retrieval and answer metrics. Results: (qid, id, position); truth: (qid, id, gain)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _hits(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    return results.where(F.col("position") <= k).join(truth.select("qid", "id", "gain"), ["qid", "id"])


def recall_precision_mrr(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """qid, recall, precision (over k), mrr; repeated results occupy places but count once."""
    met = _hits(results, truth.where("gain > 0"), k).groupBy("qid", "id").agg(F.min("position").alias("position")).groupBy("qid").agg(F.count("*").alias("met"), F.min("position").alias("first"))
    wanted = truth.where("gain > 0").groupBy("qid").agg(F.count_distinct("id").alias("n"))
    zero = F.coalesce("met", F.lit(0))
    return wanted.join(met, "qid", "left").select("qid", (zero / F.col("n")).alias("recall"), (zero / k).alias("precision"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"))


def ndcg_at(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """qid, ndcg with gain 2^g - 1 and discount log2(position + 1)."""
    value = lambda g, p: (F.pow(F.lit(2.0), g) - 1) / F.log2(p + 1)
    got = _hits(results, truth, k).groupBy("qid").agg(F.sum(value(F.col("gain"), F.col("position"))).alias("dcg"))
    placed = truth.where("gain > 0").withColumn("p", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("gain"), "id"))).where(F.col("p") <= k)
    ideal = placed.groupBy("qid").agg(F.sum(value(F.col("gain"), F.col("p"))).alias("ideal"))
    return ideal.join(got, "qid", "left").select("qid", F.coalesce(F.col("dcg") / F.col("ideal"), F.lit(0.0)).alias("ndcg"))


def class_metrics(results: DataFrame, queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """qid, recall, precision, mrr, ndcg where the truth of a query (qid, wanted) is every other row (id, label) of the label,
    each with gain 1: what recall_precision_mrr() and ndcg_at() say of that truth, without making its pairs. Queries without any are left out."""
    held = rows.select("id", "label").where("label is not null").distinct()
    sizes = held.groupBy(F.col("label").alias("wanted")).agg(F.count("*").alias("size"))
    own = queries.select("qid", "wanted").join(held.select(F.col("id").alias("qid"), F.col("label").alias("wanted"), F.lit(1).alias("own")), ["qid", "wanted"], "left")
    n = own.join(sizes, "wanted").select("qid", "wanted", (F.col("size") - F.coalesce("own", F.lit(0))).alias("n")).where("n > 0")
    places = results.where((F.col("position") <= k) & (F.col("id") != F.col("qid"))).select("qid", "id", "position")
    met = places.join(n.select("qid", "wanted"), "qid").join(held, "id").where("label = wanted")
    gain = 1 / F.log2(F.col("position") + 1)
    once = met.groupBy("qid", "id").agg(F.min("position").alias("position"), F.sum(gain).alias("dcg"))
    per = once.groupBy("qid").agg(F.count("*").alias("met"), F.min("position").alias("first"), F.sum("dcg").alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, p: s + 1 / F.log2(p + 1))
    zero = F.coalesce("met", F.lit(0))
    return n.join(per, "qid", "left").select("qid", (zero / F.col("n")).alias("recall"), (zero / k).alias("precision"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg"))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two token arrays as multisets."""
    shared = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, t: s + F.least(F.size(F.filter(a, lambda x: x == t)), F.size(F.filter(b, lambda x: x == t))))
    return F.when((F.size(a) == 0) | (F.size(b) == 0) | (shared == 0), 0.0).otherwise(2 * shared / (F.size(a) + F.size(b)))


def lcs(a: list[str], b: list[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@F.pandas_udf(T.DoubleType())
def rouge_l(answer: pd.Series, truth: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(answer, truth, strict=True):
        a, b = (x or "").lower().split(), (y or "").lower().split()
        n = lcs(a, b) if a and b else 0
        out.append(2 * n / (len(a) + len(b)) if n else 0.0)
    return pd.Series(out, dtype="float64")


def evidence_recall(expected: Column, got: Column) -> Column:
    return F.when(F.size(expected) == 0, 1.0).otherwise(F.size(F.array_intersect(expected, got)) / F.size(expected))


def isolation_violations(results: DataFrame, excluded: DataFrame) -> DataFrame:
    return results.join(excluded, ["qid", "id"], "left_semi").groupBy("qid").agg(F.count("*").alias("violations"))


def no_answer_correct(expected: Column, returned: Column) -> Column:
    return expected == (returned == 0)


def benchmark_summary(scores: DataFrame, by: str = "type") -> DataFrame:
    return scores.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg("score"), 3).alias("mean"), F.min("score").alias("least"), F.max("score").alias("most"), F.round(F.stddev_samp("score"), 6).alias("deviation"))


def gate(report: dict[str, float], least: dict[str, float]) -> list[str]:
    """Metrics below their bounds."""
    return [f"{k}: {report.get(k, 0.0):.4f} < {v:.4f}" for k, v in least.items() if report.get(k, 0.0) < v]
