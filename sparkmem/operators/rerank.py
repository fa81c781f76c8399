"""Late interaction: token similarity, weighted MaxSim, notes and budgets."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import COMMON_WORDS, sentences


def tokens_of(text: str) -> list[str]:
    return [t for t in re.findall(r"\w+", text.lower()) if len(t.encode()) > 1]


def similarity(a: str, b: str) -> float:
    """1 for equal tokens, the share of the shorter in the longer that holds it, else Dice over byte pairs (those of a as a set, of b as a multiset)."""
    if a == b:
        return 1.0
    x, y = a.encode(), b.encode()
    short, long_ = (x, y) if len(x) <= len(y) else (y, x)
    if short in long_:
        return len(short) / len(long_)
    own = {x[i : i + 2] for i in range(len(x) - 1)}
    theirs = [y[i : i + 2] for i in range(len(y) - 1)]
    return 2 * sum(g in own for g in theirs) / (len(own) + len(theirs)) if own and theirs else 0.0


def weight(token: str) -> float:
    if token in COMMON_WORDS:
        return 0.35
    if re.search(r"[0-9_]", token):
        return 2.2
    n = len(token.encode())
    return 1.6 if n >= 8 else 0.6 if n <= 2 else 1.0


def maxsim_of(query: list[str], passage: list[str]) -> float:
    if not query or not passage:
        return 0.0
    held, total, gained = set(passage), 0.0, 0.0
    for q in query:
        w = weight(q)
        best = 1.0 if q in held else max(similarity(q, p) for p in held)
        total += w
        gained += w * best
    return gained / total


@F.pandas_udf(T.DoubleType())
def maxsim(query: pd.Series, passage: pd.Series) -> pd.Series:
    """Weighted mean over the query's tokens of the best similarity in the passage."""
    return pd.Series([maxsim_of(tokens_of(q or ""), tokens_of(p or "")) for q, p in zip(query, passage, strict=True)], dtype="float64")


def late_interaction(ranked: DataFrame, queries: DataFrame, texts: DataFrame) -> DataFrame:
    """0.6 x rank score + 0.4 x 2 MaxSim, ties to the larger id; lists of one row and queries without tokens keep their order."""
    n = F.count("*").over(Window.partitionBy("qid"))
    joined = ranked.join(queries.select("qid", "text"), "qid").join(texts.select("id", F.concat_ws(" ", "title", "content").alias("passage")), "id").withColumn("n", n)
    blend = F.when((F.col("n") <= 1) | ~F.col("text").rlike(r"\w\w"), F.col("score")).otherwise(0.6 * F.col("score") + 0.8 * maxsim("text", "passage"))
    scored = joined.select("qid", "id", blend.alias("score"))
    return scored.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("id"))))


def notes(passages: DataFrame, queries: DataFrame, bearing: float = 0.5) -> DataFrame:
    """qid, id, note, relevance, answers: the best sentence of each passage, the first on ties."""
    cut = passages.select("qid", "id", F.posexplode(sentences(F.col("content"))).alias("n", "sentence")).join(queries.select("qid", "text"), "qid")
    scored = cut.withColumn("s", maxsim("text", "sentence"))
    best = scored.groupBy("qid", "id").agg(F.max_by("sentence", F.struct("s", -F.col("n"))).alias("note"), F.max("s").alias("relevance"))
    return best.withColumn("answers", F.col("relevance") >= bearing).withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("relevance"), F.asc("id"))))


def budgeted(evidence: DataFrame, most_bytes: int, most_items: int) -> DataFrame:
    """Items in order of score, title and path that still fit the bytes; one that doesn't is passed over."""

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        left, keep = most_bytes, []
        for i, n in enumerate(group.sort_values(["score", "title", "path"], ascending=[False, True, True])["text"].map(lambda t: len(t.encode()))):
            if n <= left and len(keep) < most_items:
                keep.append(i)
                left -= n
        return group.sort_values(["score", "title", "path"], ascending=[False, True, True]).iloc[keep]

    return evidence.groupBy("qid").applyInPandas(pick, evidence.schema)
