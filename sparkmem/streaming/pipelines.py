"""Continuous features as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import sentences, terms
from ..operators.lifecycle import normalised_hash

# Fixed values of the delivery queue: attempts, first and longest delay in seconds, backlog that is still taken.
ATTEMPTS, BASE_DELAY, LONGEST_DELAY, MOST_BACKLOG = 5, 0.5, 30.0, 1000


def backoff(attempt: Column) -> Column:
    """Seconds until the next try."""
    return F.least(BASE_DELAY * F.pow(F.lit(2.0), attempt), F.lit(LONGEST_DELAY))


def deduplicated(saves: DataFrame, minutes: int = 15, at: str = "created_at") -> DataFrame:
    """Explicit saves without those whose content was saved within the minutes before."""
    keyed = saves.withColumn("content_hash", normalised_hash(F.col("content"))).withWatermark(at, f"{minutes} minutes")
    return keyed.dropDuplicatesWithinWatermark(["project", "scope", "content_hash"])


def rolling_metrics(metrics: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes", at: str = "timestamp") -> DataFrame:
    w = F.window(at, window, slide) if slide else F.window(at, window)
    out = metrics.withWatermark(at, late).groupBy(w.alias("w"), "operation_type").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("total"), F.count_if(~F.col("success")).alias("failed"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "operation_type", "n", "total", "failed")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", at: str = "timestamp") -> DataFrame:
    out = events.withWatermark(at, late).groupBy("session_id", F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deliveries(attempts: DataFrame) -> DataFrame:
    """State of each intent (id, ok, at): delivered, retry with its delay, or dead after the last attempt."""

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tries, done = state.get if state.exists else (0, False)
        rows = pd.concat(list(batches)).sort_values("at")
        for ok in rows["ok"]:
            if done or tries >= ATTEMPTS:
                break
            tries, done = tries + 1, bool(ok)
        state.update((tries, done))
        status = "delivered" if done else "dead" if tries >= ATTEMPTS else "retry"
        yield pd.DataFrame({"id": [key[0]], "status": [status], "attempts": [tries], "delay": [0.0 if status != "retry" else min(BASE_DELAY * 2**tries, LONGEST_DELAY)]})

    return attempts.groupBy("id").applyInPandasWithState(follow, "id long, status string, attempts int, delay double", "tries int, done boolean", "update", GroupStateTimeout.NoTimeout)


def saturated(pending: DataFrame, most: int = MOST_BACKLOG) -> bool:
    """Whether the backlog is too long to take more."""
    return pending.limit(most + 1).count() > most


def leased(intents: DataFrame, now: Column, limit: int = 1) -> DataFrame:
    """The queue (id, status, attempts, max_attempts, next_retry_at, leased_at) with the first due intents taken; each lease counts as a try."""
    due = intents.where((F.col("status") == "pending") & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now))).orderBy("id").limit(max(1, limit)).select("id", F.lit(True).alias("due"))
    taken = F.coalesce("due", F.lit(False))
    out = intents.join(due, "id", "left").withColumns({"status": F.when(taken, "leased").otherwise(F.col("status")), "leased_at": F.when(taken, now).otherwise(F.col("leased_at")), "attempts": F.col("attempts") + taken.cast("int")})
    return out.select(*intents.columns)


def finished(intents: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """The queue after leased intents ended (outcomes: id, ok): complete, pending again behind a delay, or dead after the last try."""
    ended = intents.join(outcomes.select("id", "ok"), "id", "left")
    mine = F.col("ok").isNotNull() & (F.col("status") == "leased")
    last = F.col("attempts") >= F.col("max_attempts")
    status = F.when(mine & F.col("ok"), "complete").when(mine & last, "dead_letter").when(mine, "pending").otherwise(F.col("status"))
    again = F.when(mine & ~F.col("ok") & ~last, F.timestamp_micros((F.unix_micros(now) + backoff(F.col("attempts")) * 1_000_000).cast("long"))).otherwise(F.col("next_retry_at"))
    return ended.withColumns({"status": status, "next_retry_at": again}).select(*intents.columns)


def recovered(intents: DataFrame) -> DataFrame:
    """The queue with leases of workers that died given back."""
    return intents.withColumn("status", F.when(F.col("status") == "leased", "pending").otherwise(F.col("status")))


def postings_of(batch: DataFrame) -> DataFrame:
    return batch.select("id", F.explode(terms(F.col("content"))).alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))


def facts_of(batch: DataFrame) -> DataFrame:
    return batch.select("id", "updated_at", F.posexplode(sentences(F.col("content"))).alias("n", "fact"))


def reconcile(path: str, make: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps derived rows of changed ids: each batch has its own folder (a retry overwrites it), readers take an id's last batch.

    Rows with a deleted_at leave none."""

    def sink(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("id").agg(F.max_by(F.struct("*"), "updated_at").alias("r")).select("r.*")
        held = latest.where("deleted_at is null") if "deleted_at" in latest.columns else latest
        make(held).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        latest.select("id").write.mode("overwrite").parquet(f"{path}/ids/batch={number}")

    return sink


def reconciled(spark: SparkSession, path: str) -> DataFrame:
    """The derived rows of each id's last batch."""
    last = spark.read.parquet(f"{path}/ids").groupBy("id").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{path}/rows").join(last, ["id", "batch"], "left_semi").drop("batch")


def changed_files(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """New and rewritten files of a folder, as a stream."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", per_trigger).load(path)


def change_feed(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """The change feed from where the query's checkpoint stands."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


def applied(feed: DataFrame) -> DataFrame:
    """Rows that are left of a batch of changes: the last one of each key, tombstones taken out."""
    last = feed.groupBy("entity_type", "sync_id").agg(F.max_by(F.struct("*"), "sequence").alias("r")).select("r.*")
    return last.where(~F.col("deleted"))
