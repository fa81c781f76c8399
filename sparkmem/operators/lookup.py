"""Prompt, payload and entity lookup, search feedback, corpus fingerprints, cover-density rank."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import entities, head_lines, token_estimate
from . import lexical

EXTERNAL_BYTES = 100 * 1024


def prompt_search(prompts: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """qid, id, score, position of prompts that hold all terms."""
    return lexical.ranked(lexical.bm25(lexical.build(prompts, {"content": 1.0}), queries), limit)


def payload_search(payloads: DataFrame, queries: DataFrame, payload_id: object | None = None, limit: int = 10) -> DataFrame:
    """Search within one payload or all of them."""
    own = payloads if payload_id is None else payloads.where(F.col("id") == F.lit(payload_id))
    return prompt_search(own, queries, limit)


def externalised(payloads: DataFrame) -> DataFrame:
    """Payloads from 100 KiB on with a head of 20 lines, their size and the tokens that are saved."""
    snippet = head_lines(F.col("content"))
    return payloads.where(F.octet_length("content") >= EXTERNAL_BYTES).select("id", F.octet_length("content").alias("bytes"), snippet.alias("snippet"), F.greatest(token_estimate(F.col("content")) - token_estimate(snippet), F.lit(0)).alias("tokens_saved"))


def entity_links(obs: DataFrame) -> DataFrame:
    """id, kind, value, key of the distinct entities of each row."""
    found = obs.select("id", F.explode(entities(F.concat_ws("\n", "title", "content"))).alias("e"))
    return found.select("id", "e.kind", "e.value", F.concat_ws(":", "e.kind", F.regexp_replace(F.lower("e.value"), r"[^\p{L}\p{Nd}/:@.\-_]", "")).alias("key")).dropDuplicates(["id", "key"])


def find_entities(links: DataFrame, *, kind: str | None = None, key: str | None = None, pattern: str | None = None) -> DataFrame:
    out = links if kind is None else links.where(F.col("kind") == kind)
    out = out if key is None else out.where(F.col("key") == key)
    return out if pattern is None else out.where(F.col("key").like(pattern))


def feedback_stats(clicks: DataFrame) -> DataFrame:
    """total, queries, mean_position of recorded clicks (query, observation_id, rank_position)."""
    return clicks.agg(F.count("*").alias("total"), F.count_distinct("query").alias("queries"), F.round(F.avg("rank_position"), 6).alias("mean_position"))


def fingerprint(df: DataFrame, id_col: str = "id", stamp: Column | None = None) -> DataFrame:
    """A digest that stays the same while ids and stamps do, whatever their order: counts and sums of hashes, so that nothing is gathered."""
    h = F.xxhash64(id_col, *([stamp] if stamp is not None else [])).cast("decimal(38,0)")
    return df.agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), F.coalesce(F.sum(h), F.lit(0)).cast("string")), 256).alias("digest"))


def cover_density_of(positions: list[list[int]]) -> float:
    """The sum over minimal covers of all terms of one over their length."""
    if not positions or any(not p for p in positions):
        return 0.0
    events = sorted((p, t) for t, own in enumerate(positions) for p in own)
    last: dict[int, int] = {}
    total, before = 0.0, -1
    for p, t in events:
        last[t] = p
        if len(last) == len(positions) and (start := min(last.values())) > before:
            total += 1.0 / (p - start + 1)
            before = start
    return total


@F.pandas_udf(T.DoubleType())
def cover_density(positions: pd.Series) -> pd.Series:
    return positions.map(lambda x: cover_density_of([list(p) for p in x]) if x is not None else 0.0).astype("float64")


def cover_ranked(df: DataFrame, queries: DataFrame, tokens: Column, limit: int = 10) -> DataFrame:
    """qid, id, score, position by cover density of the query's terms, newest first on ties. df: id, created_at; queries: qid, terms."""
    each = df.select("id", "created_at", F.posexplode(tokens).alias("p", "term"))
    asked = queries.select("qid", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    met = each.join(asked, "term").groupBy("qid", "id", "created_at", "n", "term").agg(F.collect_list("p").alias("at")).groupBy("qid", "id", "created_at", "n").agg(F.collect_list("at").alias("positions"))
    scored = met.where(F.size("positions") == F.col("n")).withColumn("score", cover_density("positions"))
    return scored.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("created_at"), F.asc("id")))).where(F.col("position") <= limit).select("qid", "id", "score", "position")
