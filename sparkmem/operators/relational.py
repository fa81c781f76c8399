"""Filters, joins, aggregates, windows and set operators over the store's tables."""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_LIMIT, MOST = 20, 100


def clamp_limit(limit: int | None, default: int = 10, most: int = MOST) -> int:
    return default if not limit or limit <= 0 else min(limit, most)


def live(df: DataFrame, include_archived: bool = False) -> DataFrame:
    return df if include_archived else df.where(F.col("deleted_at").isNull())


def matching(df: DataFrame, filters: dict[str, object], known: Iterable[str] = ("project", "scope", "type", "source")) -> DataFrame:
    """Equality filters; empty values and unknown keys are ignored."""
    for key in known:
        if filters.get(key) not in (None, ""):
            df = df.where(F.col(key) == F.lit(filters[key]))
    return df


def in_tenant(df: DataFrame, *, tenant: str, workspace: str | None = None, projects: Iterable[str] | None = None, visibility: Iterable[str] | None = None) -> DataFrame:
    """The mandatory scope predicate of shared stores."""
    out = df.where(F.col("tenant") == tenant)
    if workspace is not None:
        out = out.where(F.col("workspace") == workspace)
    if projects is not None:
        out = out.where(F.col("project").isin(*projects))
    return out if visibility is None else out.where(F.col("visibility").isin(*visibility))


def list_observations(
    df: DataFrame, *, project: str | None = None, scope: str | None = None, type: str | None = None, source: str | None = None, session_id: int | None = None, min_confidence: float | None = None, tags: Iterable[str] = (),
    after: datetime | str | None = None, before: datetime | str | None = None, ascending: bool = False, limit: int = DEFAULT_LIMIT, offset: int = 0, include_archived: bool = False,
) -> DataFrame:
    """Multi-criteria list, newest first unless ascending, ties by id in the same direction."""
    out = matching(live(df, include_archived), {"project": project, "scope": scope, "type": type, "source": source})
    if session_id is not None:
        out = out.where(F.col("session_id") == session_id)
    if min_confidence:
        out = out.where(F.col("confidence") >= min_confidence)
    for tag in tags:
        out = out.where(F.array_contains("tags", tag))
    if after is not None:
        out = out.where(F.col("created_at") > F.lit(after).cast("timestamp"))
    if before is not None:
        out = out.where(F.col("created_at") < F.lit(before).cast("timestamp"))
    order = [F.col("created_at").asc(), F.col("id").asc()] if ascending else [F.col("created_at").desc(), F.col("id").desc()]
    return out.orderBy(*order).offset(offset).limit(limit)


def by_topic(df: DataFrame, topic_key: str) -> DataFrame:
    """The latest live row of a topic."""
    return live(df).where(F.col("topic_key") == topic_key).orderBy(F.desc("updated_at"), F.asc("id")).limit(1)


def hydrate(candidates: DataFrame, payload: DataFrame, *, id_col: str = "id", order: str = "position") -> DataFrame:
    """Payload of ranked ids in their order; ids without payload are dropped, repeated ones kept."""
    return candidates.join(payload, id_col).orderBy(order)


def revalidate(candidates: DataFrame, store: DataFrame, id_col: str = "id") -> DataFrame:
    """Candidates that still exist and are live."""
    return candidates.join(live(store).select(id_col), id_col, "left_semi")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge touches."""
    touched = edges.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    return nodes.join(touched, "id", "left_anti")


def both_ways(edges: DataFrame, a: str = "from_id", b: str = "to_id") -> DataFrame:
    """Every edge seen from each of its ends; a self loop once."""
    seen = edges.withColumn("node", F.col(a)).withColumn("other", F.col(b))
    return seen.unionByName(edges.where(F.col(a) != F.col(b)).withColumn("node", F.col(b)).withColumn("other", F.col(a)))


def edge_counts(edges: DataFrame, a: str = "from_id", b: str = "to_id") -> DataFrame:
    """id, n: edges at each node, self loops once."""
    ends = edges.select(F.explode(F.when(F.col(a) == F.col(b), F.array(a)).otherwise(F.array(a, b))).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("n"))


def degrees(edges: DataFrame, a: str = "source", b: str = "target") -> DataFrame:
    """id, incoming, outgoing, total."""
    ends = edges.select(F.explode(F.array(F.struct(F.col(a).alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col(b).alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.i").alias("incoming"), F.sum("e.o").alias("outgoing"), F.count("*").alias("total"))


def session_counts(sessions: DataFrame, obs: DataFrame) -> DataFrame:
    """Sessions with the number of their live observations and their last activity."""
    own = live(obs).groupBy("session_id").agg(F.count("*").alias("observations"), F.max("created_at").alias("last_at"))
    return sessions.join(own, sessions.id == own.session_id, "left").select(sessions.id, F.coalesce("observations", F.lit(0)).alias("observations"), F.coalesce("last_at", "started_at").alias("last_at"))


def consolidation_groups(obs: DataFrame, least: int = 3) -> DataFrame:
    """Topics with enough live observations to consolidate."""
    return live(obs).groupBy("topic_key").agg(F.count("*").alias("n"), F.max("created_at").alias("latest")).where(F.col("n") >= least)


def projects_by_activity(obs: DataFrame) -> DataFrame:
    return live(obs).groupBy("project").agg(F.count("*").alias("n"), F.max("created_at").alias("last_at"))


def case_variants(df: DataFrame, col: str = "project") -> DataFrame:
    """Spellings that differ in case only: the most frequent one, all of them, and the number of rows."""
    per = df.groupBy(F.lower(col).alias("folded"), F.col(col).alias("variant")).agg(F.count("*").alias("n"))
    grouped = per.groupBy("folded").agg(F.max(F.struct("n", "variant"))["variant"].alias("canonical"), F.sort_array(F.collect_set("variant")).alias("variants"), F.sum("n").alias("n"))
    return grouped.where(F.size("variants") > 1)


def project_union(*frames: DataFrame) -> DataFrame:
    """Distinct projects of several tables, without regard to case."""
    out = None
    for f in frames:
        own = f.select(F.lower("project").alias("project"))
        out = own if out is None else out.union(own)
    return out.where(F.col("project").isNotNull() & (F.col("project") != "")).distinct()


def manifest_diff(old: DataFrame, new: DataFrame, key: str = "path", stamp: str = "stamp") -> DataFrame:
    """path, change: added, changed or deleted."""
    both = old.select(key, F.col(stamp).alias("was")).join(new.select(key, F.col(stamp).alias("now")), key, "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "changed")
    return both.select(key, change.alias("change")).where(F.col("change").isNotNull())


def keep_latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    n = "__nth"
    return df.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(n) == 1).drop(n)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or replace by key; of new rows with one key the last written (largest seq) counts."""
    fresh = keep_latest(new, keys, [F.col("seq").desc()]).drop("seq")
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def delete_touching(relations: DataFrame, symbols: DataFrame, file: str) -> DataFrame:
    """Relations without those that start or end at a symbol of the file."""
    gone = symbols.where(F.col("file") == file).select("id")
    return relations.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti")


def top_per(df: DataFrame, by: str, limits: dict[str, int], order: list[Column]) -> DataFrame:
    """The first rows of each kind, as many as its limit says."""
    wanted = F.coalesce(*(F.when(F.col(by) == k, n) for k, n in limits.items()), F.lit(0))
    ranked = df.where(F.col(by).isin(*limits)).withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.where(F.col("position") <= wanted)


def first_seen(df: DataFrame, keys: list[str], position: str = "position") -> DataFrame:
    return keep_latest(df, keys, [F.col(position).asc()])


def timeline(df: DataFrame, focus_id: int, before: int, after: int) -> DataFrame:
    """The rows around one row of its session in order of creation; offset 0 is the row itself."""
    own = df.join(df.where(F.col("id") == focus_id).select("session_id"), "session_id", "left_semi")
    ranked = own.withColumn("nth", F.row_number().over(Window.partitionBy("session_id").orderBy("created_at", "id")))
    at = ranked.where(F.col("id") == focus_id).select(F.col("nth").alias("focus"), "session_id")
    return ranked.join(at, "session_id").withColumn("offset", F.col("nth") - F.col("focus")).where(F.col("offset").between(-before, after)).drop("nth", "focus")


def context_hash(query: str, filters: dict) -> str:
    return hashlib.sha256(json.dumps([query, filters], sort_keys=True).encode()).hexdigest()[:16]


def cursor(query: str, filters: dict, last_id: int) -> str:
    return base64.urlsafe_b64encode(json.dumps({"c": context_hash(query, filters), "id": last_id}).encode()).decode()


def page(ranked: DataFrame, token: str | None, query: str, filters: dict, limit: int, position: str = "position") -> DataFrame:
    """The rows strictly after the cursor's id; a cursor of another query starts anew, one past the end gives nothing."""
    held = {}
    if token:
        try:
            held = json.loads(base64.urlsafe_b64decode(token))
        except ValueError:
            held = {}
    if held.get("c") == context_hash(query, filters):
        at = ranked.where(F.col("id") == held["id"]).select(F.col(position).alias("at"))
        ranked = ranked.crossJoin(F.broadcast(at)).where(F.col(position) > F.col("at")).drop("at")  # one row
    return ranked.orderBy(position).limit(limit)


def rule_like(df: DataFrame) -> DataFrame:
    """Rules and directives, by type, key prefix or tag."""
    key = F.coalesce("topic_key", F.lit(""))
    return df.where(F.col("type").isin("pattern", "config") | key.startswith("rules/") | key.startswith("directive/") | F.arrays_overlap("tags", F.array(F.lit("rule"), F.lit("directive"))))


def within(df: DataFrame, low: object, high: object, stamp: str = "created_at") -> DataFrame:
    """Rows inside a time range, both ends included; missing times stay, an inverted range is ignored."""
    if low is not None and high is not None and low > high:
        return df
    t, out = F.col(stamp), F.lit(True)
    if low is not None:
        out &= t >= F.lit(low).cast("timestamp")
    if high is not None:
        out &= t <= F.lit(high).cast("timestamp")
    return df.where(t.isNull() | out)


def merge_projects(df: DataFrame, sources: list[str], canonical: str) -> DataFrame:
    """Rows of the named projects (in any case) under one name, which is written in lower case."""
    name, named = _merged(sources, canonical)
    return df.withColumn("project", F.when(F.lower("project").isin(*named), name).otherwise(F.col("project"))) if named else df


def _merged(sources: list[str], canonical: str) -> tuple[str, dict[str, str]]:
    """The name to merge under, and the sources by their name in lower case, each once."""
    name = canonical.strip().lower()
    if not name:
        raise ValueError("the canonical project must have a name")
    named: dict[str, str] = {}
    for s in (s.strip() for s in sources):
        if s and s != name:
            named.setdefault(s.lower(), s)
    return name, named


def merge_report(obs: DataFrame, sessions: DataFrame, sources: list[str], canonical: str) -> DataFrame:
    """source, observations, sessions, matched: what merging each source would rename; sources without a row don't match."""
    name, named = _merged(sources, canonical)
    asked = obs.sparkSession.createDataFrame(list(named.items()), "folded string, source string")
    rows = lambda df, n: df.where(F.col("project") != name).groupBy(F.lower("project").alias("folded")).agg(F.count("*").alias(n))
    out = asked.join(rows(obs, "observations"), "folded", "left").join(rows(sessions, "sessions"), "folded", "left")
    o, s = F.coalesce("observations", F.lit(0)), F.coalesce("sessions", F.lit(0))
    return out.select("source", o.alias("observations"), s.alias("sessions"), (o + s > 0).alias("matched"))


def metrics_rollup(metrics: DataFrame, *groups: str) -> DataFrame:
    return metrics.groupBy(*groups).agg(
        F.count("*").alias("n"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"), F.round(F.avg("duration_ms"), 6).alias("avg_ms"), F.round(F.sum("duration_ms"), 4).alias("sum_ms"), F.round(F.avg("result_count"), 6).alias("avg_results"), F.count_if(F.col("duration_ms") > 50).alias("slow")
    )


def quality(metrics: DataFrame, edges: DataFrame, observations: DataFrame, snapshots: DataFrame, *, search: str = "search", save: str = "save", related: str = "get_related") -> DataFrame:
    """Relevance, completeness, consistency, temporal accuracy and the weighted whole. snapshots: (root, edge_count)."""
    share = lambda part, whole: part / F.nullif(whole, F.lit(0))
    kind = lambda name: F.col("operation_type") == name
    total = observations.agg(F.count("*").alias("total"))
    m = metrics.agg(share(F.count_if(kind(search) & F.col("success") & (F.col("result_count") > 0)), F.count_if(kind(search))).alias("relevance"), F.sum(F.when(kind(related), F.col("result_count"))).alias("found"), F.count_if(kind(save)).alias("saves"))
    e = edges.agg((1 - share(F.count_if(F.col("relation") == "contradicts"), F.count("*"))).alias("consistency"))
    now = edge_counts(edges).withColumnsRenamed({"id": "root"})
    t = snapshots.join(now, "root", "left").agg(F.avg(F.when(F.col("edge_count") > 0, F.coalesce("n", F.lit(0)) / F.col("edge_count")).otherwise(0.0)).alias("temporal_accuracy"))
    both = m.crossJoin(total).crossJoin(e).crossJoin(t).withColumn("completeness", share(share(F.col("found"), F.col("total")), F.col("saves")))  # one row each
    both = both.select(*(F.round(F.coalesce(x, F.lit(0.0)), 6).alias(x) for x in ("relevance", "completeness", "consistency", "temporal_accuracy")))
    return both.withColumn("overall", F.round(0.3 * F.col("relevance") + 0.25 * F.col("completeness") + 0.25 * F.col("consistency") + 0.2 * F.col("temporal_accuracy"), 6))


def health(metrics: DataFrame, slow_ms: float = 5000, failed_share: float = 0.1, slow_share: float = 0.3) -> DataFrame:
    n = F.nullif(F.count("*"), F.lit(0))
    shares = metrics.agg(F.count("*").alias("n"), F.round(F.count_if(~F.col("success")) / n, 6).alias("failed"), F.round(F.count_if(F.col("duration_ms") > slow_ms) / n, 6).alias("slow"))
    return shares.withColumn("status", F.when((F.col("failed") > failed_share) | (F.col("slow") > slow_share), "degraded").otherwise("healthy"))


def set_scores(a: Column, b: Column) -> dict[str, Column]:
    """Set equality and counts of an expected and a returned id list."""
    return {"hits": F.size(F.array_intersect(a, b)), "missing": F.size(F.array_except(a, b)), "extra": F.size(F.array_except(b, a)), "exact": (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)}


def tags_of(json_text: Column) -> Column:
    """The tags of a JSON array; none if it is empty or no such array."""
    return F.coalesce(F.from_json(json_text, "array<string>"), F.array().cast("array<string>"))


def tags_json(tags: Column) -> Column:
    """Tags as a JSON array; an empty text without tags."""
    return F.when(F.coalesce(F.size(tags), F.lit(0)) > 0, F.to_json(tags)).otherwise("")


def type_counts(obs: DataFrame) -> DataFrame:
    return live(obs).groupBy("type").agg(F.count("*").alias("n"))


def store_counts(obs: DataFrame, sessions: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: live observations, sessions, active and ended ones (ended_at), edges, distinct projects."""
    o = live(obs).agg(F.count("*").alias("observations"), F.count_distinct("project").alias("projects"))
    s = sessions.agg(F.count("*").alias("sessions"), F.count_if(F.col("ended_at").isNull()).alias("active"), F.count("ended_at").alias("ended"))
    return o.crossJoin(s).crossJoin(edges.agg(F.count("*").alias("edges")))  # one row each


def index_coverage(obs: DataFrame, states: DataFrame) -> DataFrame:
    """One row: live observations, indexed, pending, failed ones, and the indexed per cent. states: (id, state); without one, pending."""
    state = F.coalesce("state", F.lit("pending"))
    n = live(obs).select("id").join(states, "id", "left").agg(F.count("*").alias("total"), F.count_if(state == "indexed").alias("indexed"), F.count_if(state == "failed").alias("failed"))
    pct = F.when(F.col("total") > 0, F.round(100 * F.col("indexed") / F.col("total"), 6)).otherwise(0.0)
    return n.select("total", "indexed", (F.col("total") - F.col("indexed") - F.col("failed")).alias("pending"), "failed", pct.alias("pct"))


def system_metrics(metrics: DataFrame, low: Column | None = None, high: Column | None = None) -> DataFrame:
    """One row a session: operations, succeeded and failed ones, mean duration, over a time range with both ends."""
    for end, rule in ((low, lambda t: t >= low), (high, lambda t: t <= high)):
        metrics = metrics if end is None else metrics.where(rule(F.col("timestamp")))
    total = [F.sum(c).alias(f"total_{c}") for c in ("memory_usage", "observation_count", "edge_count") if c in metrics.columns]
    mean = [F.round(F.avg(F.coalesce(c, F.lit(0.0))), 6).alias(f"avg_{c}") for c in ("query_complexity", "confidence_score") if c in metrics.columns]
    good = F.coalesce("success", F.lit(False))
    return metrics.groupBy("session_id").agg(F.count("*").alias("n"), F.count_if(good).alias("succeeded"), F.count_if(~good).alias("failed"), F.round(F.avg("duration_ms"), 6).alias("avg_ms"), *total, *mean)
