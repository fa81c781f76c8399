"""Adaptive search: route each query by tier, retrieve, fuse, re-rank and grade; all queries run as one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import query_tier, search_terms, speculative
from ..operators import fusion, graph, lexical, rerank, vector

BOOSTED = ("community_summary", "pattern", "decision")
PAGERANK_BOOST = 2.0


def queries(df: DataFrame) -> DataFrame:
    """qid, text, terms, tier, speculative of the asked texts (qid, text); a query without terms is dropped."""
    out = df.select("qid", "text", search_terms(F.col("text")).alias("terms"), query_tier(F.col("text")).alias("tier"), speculative(F.col("text")).alias("speculative"))
    return out.where(F.size("terms") > 0)


def keyword_search(index: lexical.Index | lexical.Scanned, facts: tuple[lexical.Index | lexical.Scanned, DataFrame | None], obs: DataFrame, edges: DataFrame, asked: DataFrame, scores: DataFrame, now: Column, limit: int = 10) -> DataFrame:
    """The routed lexical search: keys or expansion, feedback, graph and sentence lists, fused and re-ranked; loose terms only where all lists are empty."""
    pool = 3 * limit
    strict = graph.cut(lexical.ranked(lexical.bm25(index, asked), pool))  # at most pool rows a query
    lists = [("keyword", strict), ("topic_exact", lexical.topic_exact(obs, asked.where(F.col("text").contains("/"))))]
    free = asked.where(~F.col("text").contains("/"))
    near = lexical.ranked(lexical.neighbours(strict, edges).join(obs.select("id", "updated_at"), "id").withColumn("score", F.lit(0.0)), pool, F.desc("updated_at"), F.asc("id"))
    lists += [("topic", lexical.topic_expansion(obs, free)), ("feedback", lexical.with_feedback(index, obs, free, limit, strict)), ("graph", near), ("facts", lexical.fact_hits(*facts, asked, limit))]
    every = None
    for name, found in lists:
        own = found.where(F.col("position") <= pool).select("qid", F.lit(name).alias("list"), "position", "id")
        every = own if every is None else every.unionByName(own)
    every = graph.cut(every)  # at most pool rows a list
    empty = asked.join(every.select("qid").distinct(), "qid", "left_anti")
    rescued = lexical.relaxed(index, empty, pool).select("qid", F.lit("rescue").alias("list"), "position", "id")
    fused = fusion.rrf(every.unionByName(rescued), pool=pool)
    return fusion.recency_importance(fused, obs, scores, now).where(F.col("position") <= limit)


def adaptive_search(lexical_hits: DataFrame, vectors: DataFrame, query_vectors: DataFrame, obs: DataFrame, nodes: DataFrame, edges: DataFrame, asked: DataFrame, limit: int = 10, *, dynamic: bool = False) -> DataFrame:
    """qid, id, score, position, tier, confidence: what each query's tier makes of its lexical hits (qid, id, score,
    position; twice the limit are used).

    Direct queries keep the list. Global ones keep twice the limit, summaries, patterns and decisions raised. Semantic ones
    without a hit take the dense list, if one of its passages bears an answer. Multi-hop ones add the rank that their
    passages and the concepts they name give to hits in the graph, keep what is recognised, and fuse it with the dense list
    and the order of the notes read from both (from the recognised alone for speculative queries). Scores below the floor
    go, and the rest is graded."""
    tiers = asked.select("qid", "text", "tier", "speculative")
    hits = lexical_hits.select("qid", "id", "score", "position").join(tiers, "qid")
    texts = obs.select("id", F.concat_ws(" ", "title", "topic_key", "content").alias("content"))
    columns = ["qid", "id", "score", "position"]
    direct = hits.where((F.col("tier").isin("direct_factual", "semantic_hybrid")) & (F.col("position") <= limit)).select(*columns)
    raised = F.col("score") + F.when(F.col("type").isin(*BOOSTED), 2.5).otherwise(0.0)
    wide = hits.where((F.col("tier") == "architectural_global") & (F.col("position") <= 2 * limit)).join(obs.select("id", "type"), "id").select("qid", "id", raised.alias("score"), "position")
    dense = vector.exact_topk(vectors, query_vectors, 2 * limit)
    without = tiers.where("tier = 'semantic_hybrid' AND NOT speculative").join(hits.select("qid").distinct(), "qid", "left_anti")
    offered = dense.where(F.col("position") <= limit).join(without.select("qid"), "qid", "left_semi")
    bearing = rerank.notes(offered.select("qid", "id").join(texts, "id"), asked).where("answers").select("qid").distinct()
    fallback = offered.join(bearing, "qid", "left_semi").select(*columns)
    every = direct.unionByName(wide).unionByName(fallback)
    multi = hits.where((F.col("tier") == "multi_hop_graph") & (F.col("position") <= 2 * limit))
    deep = tiers.where("tier = 'multi_hop_graph'")
    if not deep.isEmpty():
        near = dense.join(deep.select("qid"), "qid", "left_semi")
        seeds = graph.hippo_seeds(near, multi).join(nodes.select("id"), "id", "left_semi").select("qid", "id", "weight")
        seeds = seeds.unionByName(graph.concepts_named(deep, nodes)).groupBy("qid", "id").agg(F.sum("weight").alias("weight"))
        ranks = graph.pagerank_each(edges, seeds).select("qid", F.regexp_extract("id", r"(\d+)$", 1).cast("long").alias("id"), F.col("score").alias("ppr"))
        ranks = ranks.groupBy("qid", "id").agg(F.max("ppr").alias("ppr"))
        boosted = multi.join(ranks, ["qid", "id"], "left").select("qid", "id", (F.col("score") + PAGERANK_BOOST * F.coalesce("ppr", F.lit(0.0))).alias("score"))
        kept = fusion.recognised(boosted, limit).select("qid", "id", "position")
        read = kept.select("qid", "id").unionByName(near.join(deep.where("NOT speculative").select("qid"), "qid", "left_semi").select("qid", "id")).distinct()
        noted = rerank.notes(read.join(texts, "id"), asked)
        lists = [kept.withColumn("list", F.lit("lexical")), near.withColumn("list", F.lit("vector")), noted.withColumn("list", F.lit("notes"))]
        lists = [x.select("qid", "list", "position", "id", F.lit(1.0).alias("weight")) for x in lists]
        every = every.unionByName(fusion.weighted_rrf(lists[0].unionByName(lists[1]).unionByName(lists[2]), pool=limit).select(*columns))
    grades = fusion.dynamic_grade(every).select("qid", F.col("grade").alias("confidence")) if dynamic else fusion.grade(every).select("qid", F.col("grade").alias("confidence"))
    placed = lexical.ranked(every.where(F.col("score") >= fusion.FLOOR), None, F.asc("position"), F.asc("id"))
    return placed.join(tiers.select("qid", "tier"), "qid").join(grades, "qid")


def graph_stage(hits: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each query's incoming order fused with the PageRank order that it seeds; ids in the graph are those of the hits as strings."""
    seeds = hits.select("qid", F.col("id").cast("string").alias("id"), (1.0 / (60 + F.col("position"))).alias("weight")).join(nodes.select("id"), "id", "left_semi")
    ranks = graph.pagerank_each(edges, seeds).select("qid", F.col("id").alias("key"), F.col("score").alias("ppr"))
    placed = lexical.ranked(hits.withColumn("key", F.col("id").cast("string")).join(ranks, ["qid", "key"]).select("qid", "id", F.col("ppr").alias("score")))
    return fusion.rrf(hits.select("qid", "id", "position").unionByName(placed.select("qid", "id", "position")))


def with_retry(search, asked: DataFrame, refine) -> DataFrame:
    """Search once more, with refined texts, the queries whose first results grade low; refine takes and returns (qid, text)."""
    first = search(asked)
    low = fusion.grade(first).where("refine").select("qid")
    again = search(queries(refine(asked.join(low, "qid", "left_semi").select("qid", "text"))))
    return first.join(low, "qid", "left_anti").unionByName(again.select(*first.columns))


def refined_text(text: str, evidence: list[str], most_words: int = 40, most_chars: int = 320) -> str:
    """The query with unseen words of the evidence, within bounds."""
    words = text.split()
    seen = {w.lower() for w in words}
    for passage in evidence:
        for w in passage.split():
            if w.lower() not in seen and len(words) - len(text.split()) < most_words and len(" ".join([*words, w])) <= most_chars:
                seen.add(w.lower())
                words.append(w)
    return " ".join(words)
