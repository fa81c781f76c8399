"""Fusion of ranked lists, re-ranking and confidence.

Lists are rows (qid, list, position, id) with an optional weight; the raw score never enters a fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timerange import decay as time_decay
from ..functions.timerange import recency

RRF_K = 60


def rrf(lists: DataFrame, k: int = RRF_K, pool: int | None = None) -> DataFrame:
    """qid, id, score: the sum of 1 / (k + position); ties go to the smaller id."""
    out = lists.groupBy("qid", "id").agg(F.sum(1.0 / (k + F.col("position"))).alias("score"))
    return _place(out, pool, F.asc("id"))


def weighted_rrf(lists: DataFrame, *, k: int = RRF_K, overwrite: tuple[str, ...] = ("lexical",), times: DataFrame | None = None, now: Column | None = None, half_life_days: float = 0, pool: int | None = None) -> DataFrame:
    """As rrf with a weight by list; lists to overwrite count an id's last position only, others all. Optional decay by age; ties go to the larger id."""
    weight = F.when(F.coalesce("weight", F.lit(1.0)) <= 0, 1.0).otherwise(F.coalesce("weight", F.lit(1.0)))
    once = lists.where(F.col("list").isin(*overwrite)).groupBy("qid", "list", "id").agg(F.max("position").alias("position"), F.max_by("weight", "position").alias("weight"))
    rest = lists.where(~F.col("list").isin(*overwrite)).select(*once.columns)
    out = once.unionByName(rest).groupBy("qid", "id").agg(F.sum(weight / (k + F.col("position"))).alias("score"))
    if times is not None and half_life_days > 0:
        out = out.join(times.select("id", "created_at"), "id", "left").select("qid", "id", (F.col("score") * F.coalesce(time_decay(F.col("created_at"), now, half_life_days), F.lit(1.0))).alias("score"))
    return _place(out, pool, F.desc("id"))


def _place(scored: DataFrame, pool: int | None, tie: Column) -> DataFrame:
    out = scored.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), tie)))
    return out if pool is None else out.where(F.col("position") <= pool)


def recency_importance(fused: DataFrame, obs: DataFrame, scores: DataFrame, now: Column) -> DataFrame:
    """Fusion score times recency times 1 + importance (1 where there is none or it is 0)."""
    joined = fused.join(obs.select("id", "updated_at"), "id").join(scores.select(F.col("observation_id").alias("id"), F.col("score").alias("importance")), "id", "left")
    factor = F.when(F.coalesce("importance", F.lit(0.0)) > 0, 1 + F.col("importance")).otherwise(1.0)
    return _place(joined.select("qid", "id", (F.col("score") * recency(F.col("updated_at"), now) * factor).alias("score")), None, F.asc("id"))


def minmax(df: DataFrame, col: str, by: str = "qid") -> Column:
    """The column scaled to 0..1 within a query; 0.5 where all are equal."""
    w = Window.partitionBy(by)
    low, high = F.min(col).over(w), F.max(col).over(w)
    return F.when(high > low, (F.col(col) - low) / (high - low)).otherwise(F.when(F.col(col).isNotNull(), 0.5))


def convex(lexical: DataFrame, dense: DataFrame, alpha: float = 0.5) -> DataFrame:
    """alpha x lexical + (1 - alpha) x dense, each scaled; what a list lacks counts 0."""
    a = lexical.select("qid", "id", minmax(lexical, "score").alias("lex"))
    b = dense.select("qid", "id", minmax(dense, "score").alias("vec"))
    both = a.join(b, ["qid", "id"], "full")
    return _place(both.select("qid", "id", (alpha * F.coalesce("lex", F.lit(0.0)) + (1 - alpha) * F.coalesce("vec", F.lit(0.0))).alias("score")), None, F.asc("id"))


def calibrated_alpha(lexical: DataFrame, dense: DataFrame, truth: DataFrame, k: int = 10, step: float = 0.05) -> DataFrame:
    """alpha, ndcg of every grid point, best first and nearest to 0.5 on ties."""
    from .evaluation import ndcg_at

    n = round(1 / step)
    a = lexical.select("qid", "id", minmax(lexical, "score").alias("lex"))
    b = dense.select("qid", "id", minmax(dense, "score").alias("vec"))
    grid = a.join(b, ["qid", "id"], "full").withColumn("alpha", F.explode(F.array(*(F.lit(i / n) for i in range(n + 1)))))
    score = F.col("alpha") * F.coalesce("lex", F.lit(0.0)) + (1 - F.col("alpha")) * F.coalesce("vec", F.lit(0.0))
    placed = grid.withColumn("position", F.row_number().over(Window.partitionBy("alpha", "qid").orderBy(score.desc(), "id"))).where(F.col("position") <= k)
    keyed = placed.select(F.concat_ws("|", "alpha", "qid").alias("qid"), "id", "position")
    wanted = truth.withColumn("alpha", F.explode(F.array(*(F.lit(i / n) for i in range(n + 1))))).select(F.concat_ws("|", "alpha", "qid").alias("qid"), "id", "gain")
    each = ndcg_at(keyed, wanted, k).select(F.split("qid", r"\|")[0].cast("double").alias("alpha"), "ndcg")
    return each.groupBy("alpha").agg(F.round(F.avg("ndcg"), 6).alias("ndcg")).orderBy(F.desc("ndcg"), F.abs(F.col("alpha") - 0.5), "alpha")


# Bounds of the confidence grades.
HIGH, LOW, FLOOR = 0.65, 0.30, 0.005


def grade(results: DataFrame, *, high: float = HIGH, low: float = LOW, floor: float = FLOOR) -> DataFrame:
    """qid, best, kept, grade: high, medium or low by the best score among those over the floor; low asks for refinement."""
    per = results.groupBy("qid").agg(F.max(F.when(F.col("score") >= floor, F.col("score"))).alias("best"), F.count_if(F.col("score") >= floor).alias("kept"))
    name = F.when(F.col("best") >= high, "high").when(F.col("best") >= low, "medium").otherwise("low")
    return per.select("qid", F.coalesce("best", F.lit(0.0)).alias("best"), "kept", name.alias("grade"), (name == "low").alias("refine"))


def dynamic_grade(results: DataFrame, *, ratio: float = 1.4, floor: float = FLOOR) -> DataFrame:
    """qid, grade by how far the first score stands over the mean of the others; a single result must reach twice the floor."""
    per = results.where(F.col("score") >= floor).groupBy("qid").agg(F.max("score").alias("best"), F.count("*").alias("n"), F.sum("score").alias("sum"))
    tail = (F.col("sum") - F.col("best")) / (F.col("n") - 1)
    return per.select("qid", F.when(F.col("n") == 1, F.when(F.col("best") >= 2 * floor, "high").otherwise("low")).when(F.col("best") >= ratio * tail, "high").otherwise("medium").alias("grade"))


def recognised(results: DataFrame, top_k: int, *, absolute: float = 0.005, relative: float = 0.05) -> DataFrame:
    """Results near enough to the best of their query, filled up with the strongest others to top_k."""
    best = F.max("score").over(Window.partitionBy("qid"))
    ok = F.col("score") >= F.greatest(F.lit(absolute), relative * best)
    marked = results.withColumn("recognised", ok)
    placed = marked.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("recognised"), F.desc("score"), F.desc("id"))))
    return placed.where(F.col("position") <= top_k)


def fusion_shape(results: DataFrame) -> DataFrame:
    """qid, skew (of the population), margin of the first over the second, route: capped, escalated or kept."""
    mean = F.avg("score").over(Window.partitionBy("qid"))
    dev = results.withColumn("d", F.col("score") - mean).withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("id"))))
    n = F.count("*")
    m2, m3 = F.sum(F.col("d") * F.col("d")) / n, F.sum(F.col("d") * F.col("d") * F.col("d")) / n
    per = dev.groupBy("qid").agg(F.when(m2 > 0, m3 / F.pow(m2, 1.5)).otherwise(0.0).alias("skew"), F.max(F.when(F.col("nth") == 1, F.col("score"))).alias("s1"), F.max(F.when(F.col("nth") == 2, F.col("score"))).alias("s2"))
    margin = F.when(F.col("s1") > 0, (F.col("s1") - F.coalesce("s2", F.lit(0.0))) / F.col("s1")).otherwise(0.0)
    route = F.when((F.col("skew") >= 1) & (F.col("margin") >= 0.5), "capped").when((F.col("skew") <= 0.5) & (F.col("margin") <= 0.2), "escalated").otherwise("kept")
    return per.select("qid", F.round("skew", 6).alias("skew"), F.round(margin, 6).alias("margin")).withColumn("route", route)


def normalised(kind: Column, score: Column) -> Column:
    """Branch scores in 0..1: lexical ones saturate, others are capped; negative and not-a-number ones are null."""
    ok = score.isNotNull() & ~F.isnan(score) & (score >= 0)
    return F.when(ok, F.when(kind == "lexical", 1 - 1 / (1 + score)).otherwise(F.least(score, F.lit(1.0))))


def hybrid_seeds(branches: DataFrame) -> DataFrame:
    """qid, id, score: scores of each branch divided by their sum, then added."""
    share = F.col("score") / F.sum("score").over(Window.partitionBy("qid", "branch"))
    return branches.withColumn("share", share).groupBy("qid", "id").agg(F.sum("share").alias("score"))


def interleaved(base: DataFrame, expanded: DataFrame, limit: int) -> DataFrame:
    """The first base item, the expansion, the other base items; repeated ones once."""
    order = base.select("qid", "id", F.when(F.col("position") == 1, 0).otherwise(2).alias("part"), "position").unionByName(expanded.select("qid", "id", F.lit(1).alias("part"), "position"))
    first = order.groupBy("qid", "id").agg(F.min(F.struct("part", "position")).alias("at"))
    return first.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy("at", "id"))).where(F.col("position") <= limit).drop("at")


def evidence_fusion(lexical: DataFrame, dense: DataFrame, late: DataFrame, times: DataFrame, now: Column) -> DataFrame:
    """Rank fusion scaled to 1 for two first places (or one, if alone), blended with late interaction and up to 0.05 for the last 30 days; ties to the smaller id."""
    lists = lexical.select("qid", "id", "position").unionByName(dense.select("qid", "id", "position"))
    fused = lists.groupBy("qid", "id").agg((F.sum(61.0 / (60 + F.col("position"))) / 2).alias("r"), F.count("*").alias("branches"))
    fused = fused.select("qid", "id", F.least(F.col("r") * F.when(F.col("branches") == 1, 2).otherwise(1), F.lit(1.0)).alias("r"))
    joined = fused.join(late.select("qid", "id", F.col("score").alias("m")), ["qid", "id"], "left").join(times.select("id", "updated_at"), "id", "left")
    age = (F.unix_micros(now) - F.unix_micros("updated_at")) / F.lit(86400e6)
    fresh = F.when((age >= 0) & (age < 30), 0.05 * (1 - age / 30)).otherwise(0.0)
    return _place(joined.select("qid", "id", (0.6 * F.col("r") + 0.4 * F.coalesce("m", F.lit(0.0)) + F.coalesce(fresh, F.lit(0.0))).alias("score")), None, F.asc("id"))


def answer_confidence(score: Column) -> DataFrame:
    kept = F.when(score.isNull() | F.isnan(score) | (score <= 0) | (F.abs(score) == float("inf")), 0.5).otherwise(F.least(score, F.lit(1.0)))
    return F.struct(kept.alias("value"), F.when(kept >= 0.75, "high").when(kept >= 0.45, "medium").otherwise("low").alias("label"))


def same_set_or(fused: DataFrame, reranked: DataFrame) -> DataFrame:
    """The re-ranked order where it holds exactly the fused ids of a query, else the fused order."""
    a = fused.groupBy("qid").agg(F.sort_array(F.collect_list("id")).alias("x"))
    b = reranked.groupBy("qid").agg(F.sort_array(F.collect_list("id")).alias("y"))
    good = a.join(b, "qid").where("x = y").select("qid")
    return reranked.join(good, "qid", "left_semi").unionByName(fused.join(good, "qid", "left_anti"), allowMissingColumns=True)


def merged_flags(lists: DataFrame) -> DataFrame:
    """qid, id and the lists that named it."""
    return lists.groupBy("qid", "id").agg(F.sort_array(F.collect_set("list")).alias("lists"), F.min("position").alias("best"))


def remote_matches(local: DataFrame, remote: DataFrame) -> DataFrame:
    """qid, local_id, remote_id: same public id, id, project and topic, or project and title without case; the first local in list order."""
    joins = []
    for nth, keys in enumerate((["public_id"], ["id"], ["project", "topic_key"], ["project", "folded"])):
        a = local.withColumn("folded", F.lower("title")).select("qid", *(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col("id").alias("local_id"), F.col("position").alias("at"))
        b = remote.withColumn("folded", F.lower("title")).select("qid", *(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col("id").alias("remote_id"))
        joins.append(a.join(b, ["qid", *(f"k{i}" for i in range(len(keys)))]).select("qid", "local_id", "remote_id", "at", F.lit(nth).alias("rule")))
    out = joins[0]
    for j in joins[1:]:
        out = out.unionByName(j)
    return out.groupBy("qid", "remote_id").agg(F.min_by("local_id", F.struct("at", "rule")).alias("local_id"))
