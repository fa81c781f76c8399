"""Profiles, context packs and exchange between stores."""

from __future__ import annotations

import hashlib
import json
import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import first_line
from .relational import live, rule_like

# Sections of a project profile in their order, as type, heading, most items, whether they show a score and a first line.
PROFILE = [("decision", "Key Decisions", 10, True, True), ("pattern", "Patterns & Conventions", 10, False, True), ("config", "Configuration & Stack", 8, False, False), ("bugfix", "Known Gotchas", 8, True, True), ("discovery", "Discoveries", 5, False, False)]
BASE_SCORE, PROFILED = 0.5, 500


def profile(obs: DataFrame, scores: DataFrame) -> DataFrame:
    """project, profile: Markdown of the best rows of each type (score, then creation, then id, all falling) among a project's newest 500."""
    newest = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("created_at"), F.desc("id")))
    own = live(obs).select("project", "type", "id", "created_at").withColumn("nth", newest).where(F.col("nth") <= PROFILED).drop("nth")
    own = own.join(scores.select(F.col("observation_id").alias("id"), "score"), "id", "left").withColumn("score", F.coalesce("score", F.lit(BASE_SCORE)))
    place = F.row_number().over(Window.partitionBy("project", "type").orderBy(F.desc("score"), F.desc("created_at"), F.desc("id")))
    pick = lambda k: F.coalesce(*(F.when(F.col("type") == row[0], row[k]) for row in PROFILE))
    kept = own.withColumn("place", place).where(F.col("place") <= pick(2)).join(obs.select("id", "title", "content"), "id")
    first = first_line(F.coalesce("content", F.lit("")))
    head = F.when(pick(4), F.concat(F.lit("- **"), F.coalesce("title", F.lit("")), F.lit("**"))).otherwise(F.concat(F.lit("- "), F.coalesce("title", F.lit(""))))
    line = F.concat(head, F.when(pick(3), F.format_string(" (score: %.1f)", "score")).otherwise(""), F.when(pick(4) & (first != ""), F.concat(F.lit("\n  "), first)).otherwise(""))
    items = kept.withColumn("line", line).groupBy("project", "type").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("lines"))  # ten rows at most
    order = F.coalesce(*(F.when(F.col("type") == row[0], i) for i, row in enumerate(PROFILE)))
    sections = items.groupBy("project").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("at"), F.concat(F.lit("## "), pick(1), F.lit("\n\n"), "lines", F.lit("\n\n")).alias("text")))), lambda x: x["text"]), "").alias("sections"))
    counts = own.groupBy("project", "type").agg(F.count("*").alias("n")).groupBy("project").agg(F.sum("n").alias("n"), F.array_join(F.sort_array(F.collect_list(F.concat("type", F.lit(": "), F.col("n").cast("string")))), ", ").alias("types"))
    n = F.col("n").cast("string")
    text = F.concat(F.lit("# Project DNA: "), "project", F.lit("\n\nAuto-generated from "), n, F.lit(" observations.\n\n"), F.coalesce("sections", F.lit("")), F.lit("---\n\n**Stats:** "), n, F.lit(" observations ("), "types", F.lit(")\n"))
    return counts.join(sections, "project", "left").select("project", text.alias("profile"))


def context_pack(obs: DataFrame, scores: DataFrame, budget_tokens: int = 2000) -> DataFrame:
    """project, part, id, line: rules, then decisions, then bug fixes, each best first, while the running size fits the project's budget."""
    o = live(obs).join(scores.select(F.col("observation_id").alias("id"), "score"), "id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    rules = rule_like(o).select("project", "id", "score", F.lit(0).alias("part"), "title")
    others = o.where(F.col("type").isin("decision", "bugfix")).select("project", "id", "score", F.when(F.col("type") == "decision", 1).otherwise(2).alias("part"), "title")
    lines = rules.unionByName(others.join(rules.select("id"), "id", "left_anti")).withColumn("line", F.concat(F.lit("- "), first_line(F.col("title"), 200)))
    order = Window.partitionBy("project").orderBy("part", F.desc("score"), "id").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("used", F.sum(F.greatest(F.floor(F.octet_length("line") / 4), F.lit(1))).over(order)).where(F.col("used") <= budget_tokens).select("project", "part", "id", "line")


def resolved_artifacts(artifacts: DataFrame, most: int = 100) -> DataFrame:
    """One active artifact for each kind and key: a project's before the workspace's, then higher precedence, then smaller id."""
    rank = F.row_number().over(Window.partitionBy("kind", "key").orderBy(F.when(F.col("scope") == "project", 0).otherwise(1), F.desc("precedence"), "id"))
    kept = artifacts.where("status = 'active'").withColumn("nth", rank).where("nth = 1").drop("nth")
    return kept.orderBy(F.desc("precedence"), "id").limit(most)


def changed_since(obs: DataFrame, sessions: DataFrame, project: str, cutoff: str) -> DataFrame:
    """Rows of a project, or of a session of that project, newer than a time."""
    own = sessions.where(F.col("project") == project).select(F.col("id").alias("session_id"))
    direct = obs.where((F.col("project") == project) & (F.col("updated_at") > F.lit(cutoff).cast("timestamp")))
    via = obs.where((F.coalesce("project", F.lit("")) != project) & (F.col("updated_at") > F.lit(cutoff).cast("timestamp"))).join(own, "session_id", "left_semi")
    return direct.unionByName(via.select(*direct.columns))


def canonical(value: object, depth: int = 16) -> str:
    """JSON with sorted keys and no spaces; deeper values and non-finite numbers are refused."""
    if depth < 0:
        raise ValueError("nested too deeply")
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k], depth - 1)}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(canonical(x, depth - 1) for x in value) + "]"
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError("not a finite number")
    return json.dumps(value, ensure_ascii=False)


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("error", T.StringType())]))
def canonical_json(raw: pd.Series) -> pd.DataFrame:
    rows = []
    for r in raw:
        try:
            text = canonical(json.loads(r))
            rows.append((text, hashlib.sha256(text.encode()).hexdigest(), None))
        except (ValueError, TypeError) as fault:
            rows.append((None, None, str(fault)))
    return pd.DataFrame(rows, columns=["text", "digest", "error"])
