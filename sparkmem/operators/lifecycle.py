"""Importance scores, decay, archival and save semantics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a type adds to the importance.
TYPE_BONUS = {"decision": 0.5, "architecture": 0.5, "bugfix": 0.3, "pattern": 0.2, "discovery": 0.15, "config": 0.1, "learning": 0.1}
MOST_IMPORTANT = 5.0
DECAY = 0.95


def hours_between(earlier: Column, later: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(3.6e9)


def importance_score(type_: Column, created: Column, accesses: Column, last_accessed: Column, incoming: Column, now: Column) -> Column:
    bonus = F.coalesce(*(F.when(type_ == k, v) for k, v in TYPE_BONUS.items()), F.lit(0.0))
    recent = F.when(last_accessed.isNotNull() & (hours_between(last_accessed, now) <= 24), 0.5).otherwise(0.0)
    age = F.least(hours_between(created, now) / 24 * 0.01, F.lit(0.5))
    raw = 0.5 + F.least(F.coalesce(accesses, F.lit(0)) * 0.1, F.lit(1.0)) + recent + F.least(F.coalesce(incoming, F.lit(0)) * 0.2, F.lit(1.0)) + bonus - age
    return F.greatest(F.lit(0.0), F.least(raw, F.lit(MOST_IMPORTANT)))


def importance(obs: DataFrame, access: DataFrame, edges: DataFrame, now: Column) -> DataFrame:
    """id, score of every observation."""
    arriving = edges.groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("incoming"))
    joined = obs.join(access.withColumnRenamed("observation_id", "id").select("id", "access_count", "last_accessed"), "id", "left").join(arriving, "id", "left")
    return joined.select("id", F.round(importance_score(F.col("type"), F.col("created_at"), F.col("access_count"), F.col("last_accessed"), F.col("incoming"), now), 6).alias("score"))


def decay(scores: DataFrame, factor: float = DECAY) -> DataFrame:
    return scores.withColumn("score", F.greatest(F.col("score") * factor, F.lit(0.0)))


def accessed(scores: DataFrame, accesses: DataFrame) -> DataFrame:
    """Scores with the accesses of a batch (observation_id, at) counted in."""
    own = accesses.groupBy("observation_id").agg(F.count("*").alias("more"), F.max("at").alias("at"))
    joined = scores.join(own, "observation_id", "full")
    return joined.select("observation_id", F.coalesce("score", F.lit(0.0)).alias("score"), (F.coalesce("access_count", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("access_count"), F.greatest("last_accessed", "at").alias("last_accessed"))


def archivable(obs: DataFrame, scores: DataFrame, cutoff: str, least: float, limit: int = 500) -> DataFrame:
    """Old live observations whose score is missing or low, oldest first."""
    joined = obs.where(F.col("deleted_at").isNull() & (F.col("created_at") < F.lit(cutoff).cast("timestamp"))).join(scores.withColumnRenamed("observation_id", "id").select("id", "score"), "id", "left")
    return joined.where(F.col("score").isNull() | (F.col("score") < least)).orderBy("created_at", "id").limit(limit)


def stale(obs: DataFrame, scores: DataFrame, least: float, days: int, now: Column, limit: int = 20) -> DataFrame:
    """Important observations that nothing has accessed for some days."""
    joined = obs.where(F.col("deleted_at").isNull()).join(scores.withColumnRenamed("observation_id", "id").select("id", "score", "last_accessed"), "id")
    return joined.where((F.col("score") >= least) & (F.col("last_accessed") < now - F.make_dt_interval(F.lit(days)))).orderBy(F.desc("score"), "id").limit(limit)


def soft_delete(obs: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    marked = obs.join(ids.select("id").distinct().withColumn("__gone", F.lit(True)), "id", "left")
    return marked.withColumn("deleted_at", F.when(F.col("__gone") & F.col("deleted_at").isNull(), now).otherwise(F.col("deleted_at"))).drop("__gone")


def restore(obs: DataFrame, ids: DataFrame) -> DataFrame:
    marked = obs.join(ids.select("id").distinct().withColumn("__back", F.lit(True)), "id", "left")
    return marked.withColumn("deleted_at", F.when(F.col("__back"), None).otherwise(F.col("deleted_at"))).drop("__back")


def normalised_hash(text: Column) -> Column:
    return F.sha2(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), 256)


def save(store: DataFrame, batch: DataFrame, minutes: int = 15) -> DataFrame:
    """Outcome of saving a batch in order of seq: which row each one becomes, and created, updated or replayed.

    Rows with a topic key update the live row of that project, scope and key; explicit manual rows replay one of the same
    content saved within the minutes before; the others are inserted. A row's target is its own seq (negative) if new."""
    keyed = batch.where(F.coalesce("topic_key", F.lit("")) != "")
    known = store.where(F.col("deleted_at").isNull() & (F.coalesce("topic_key", F.lit("")) != "")).groupBy("project", "scope", "topic_key").agg(F.max("id").alias("held"))
    place = Window.partitionBy("project", "scope", "topic_key").orderBy("seq")
    topics = keyed.join(known, ["project", "scope", "topic_key"], "left").withColumn("first", F.first("seq").over(place)).withColumn("nth", F.row_number().over(place))
    topics = topics.select("seq", F.coalesce("held", -F.col("first")).alias("target"), F.when(F.col("held").isNull() & (F.col("nth") == 1), "created").otherwise("updated").alias("status"), "nth")
    plain = batch.where(F.coalesce("topic_key", F.lit("")) == "").withColumn("hash", normalised_hash(F.col("content")))
    before = store.where(F.col("deleted_at").isNull()).select(F.col("id").alias("held"), normalised_hash(F.col("content")).alias("hash"), "project", "scope", F.col("created_at").alias("at"))
    cond = [plain[x] == before[x] for x in ("hash", "project", "scope")] + [(plain.type == "manual"), before["at"] > plain["created_at"] - F.make_dt_interval(mins=F.lit(minutes)), before["at"] <= plain["created_at"]]
    met = plain.join(before, cond, "left").groupBy("seq").agg(F.max("held").alias("held"))
    twin = Window.partitionBy("hash", "project", "scope").orderBy("seq")
    within_batch = plain.withColumn("earlier", F.when(F.col("type") == "manual", F.lag(F.struct("seq", "created_at")).over(twin)))
    close = F.col("earlier.created_at") > F.col("created_at") - F.make_dt_interval(mins=F.lit(minutes))
    rest = within_batch.join(met, "seq").select("seq", F.coalesce("held", F.when(close, -F.col("earlier.seq")), -F.col("seq")).alias("target"), F.when(F.col("held").isNotNull() | close, "replayed").otherwise("created").alias("status"), F.lit(1).alias("nth"))
    return topics.unionByName(rest)
