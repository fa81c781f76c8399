"""Bi-temporal facts: as-of reads, supersession, contradiction, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEAD = ("deprecated", "superseded")


def _covers(low: str, high: str, at: Column) -> Column:
    return (F.col(low).isNull() | (F.col(low) <= at)) & (F.col(high).isNull() | (at < F.col(high)))


def as_of(facts: DataFrame, valid: Column, system: Column) -> DataFrame:
    """Facts that held at one time and were known at another; open ends are null."""
    return facts.where(_covers("valid_from", "valid_until", valid) & _covers("tx_from", "tx_until", system))


def as_of_many(facts: DataFrame, asks: DataFrame) -> DataFrame:
    """qid and the facts of as_of() for each of many times (qid, valid, system), as one join by equal keys.

    Valid time is cut into buckets of every power of two. A fact lies in the one or two buckets of the width of its own
    interval; an asked time lies in one bucket of each width. Facts outside all asked times don't take part."""
    low, high = asks.agg(F.min(F.unix_micros("valid")), F.max(F.unix_micros("valid"))).first()
    if low is None:
        low, high = 0, 0
    start = F.greatest(F.coalesce(F.unix_micros("valid_from"), F.lit(low)), F.lit(low)) - low
    stop = F.least(F.coalesce(F.unix_micros("valid_until"), F.lit(high + 1)), F.lit(high + 1)) - low
    widest = (high - low + 1).bit_length()
    cut_off = facts.withColumns({"__a": start, "__b": stop}).where("__a < __b").withColumn("__level", F.least(F.ceil(F.log2(F.col("__b") - F.col("__a"))), F.lit(widest)).cast("int"))
    bucket = lambda x: F.call_function("shiftright", x, F.col("__level"))
    held = cut_off.withColumn("__bucket", F.explode(F.array_distinct(F.array(bucket(F.col("__a")), bucket(F.col("__b") - 1)))))
    at = asks.where("valid is not null and system is not null").withColumn("__level", F.explode(F.sequence(F.lit(0), F.lit(widest))))
    at = at.withColumn("__bucket", bucket(F.unix_micros("valid") - low)).select("qid", F.col("valid").alias("__valid"), F.col("system").alias("__system"), "__level", "__bucket")
    met = held.join(at, ["__level", "__bucket"]).where(_covers("valid_from", "valid_until", F.col("__valid")) & _covers("tx_from", "tx_until", F.col("__system")))
    return met.select("qid", *facts.columns)


#: Microseconds of a day, an hour, a minute, a second, a millisecond and one.
TICKS = (86_400_000_000, 3_600_000_000, 60_000_000, 1_000_000, 1000, 1)


def as_of_totals(facts: DataFrame, asks: DataFrame, value: str = "id") -> DataFrame:
    """The columns of asks (qid, valid, system), n and total (of a long column of the facts) of as_of_many(), without its pairs.

    A fact is a rectangle of valid and system time. What covers a point is a sum over corners that don't exceed it, with
    signs, and that is a sum over buckets of powers of two, of which a point's past has one a level and axis at most.
    Corners meet asks only there, summed up by bucket, so the cost is that of the corners times the levels (the bits of the
    asked range in the largest unit, of a day to a microsecond, that all asked times are multiples of), not of the pairs."""
    axes = {"valid": ("valid_from", "valid_until"), "system": ("tx_from", "tx_until")}
    asks = asks.where("valid is not null and system is not null")
    bounds = asks.agg(*(f(F.unix_micros(c)) for c in axes for f in (F.min, F.max)), *(F.max(F.pmod(F.unix_micros(c), F.lit(t))).alias(f"{c}_{t}") for c in axes for t in TICKS)).first()
    grid = {}
    for c, (low, high) in zip(axes, (bounds[0:2], bounds[2:4]), strict=True):
        tick = next(t for t in TICKS if not bounds[f"{c}_{t}"])
        low, high = low or 0, high or 0
        grid[c] = low, tick, (high - low) // tick
    kept = facts.where("(valid_from is null or valid_until is null or valid_from < valid_until) and (tx_from is null or tx_until is null or tx_from < tx_until)")

    def place(c: str, edge: str) -> Column:
        """The first tick at or behind a time, from 0; ticks behind the last asked one are beyond all."""
        low, tick, _ = grid[c]
        behind = F.ceil((F.unix_micros(edge) - low).cast("decimal(20,0)") / F.lit(tick).cast("decimal(20,0)")).cast("long")
        return F.when(F.col(edge).isNotNull(), F.greatest(behind, F.lit(0)))

    def ends(c: str) -> Column:
        start, stop = axes[c]
        at = lambda p, sign: F.struct(p.alias("at"), F.lit(sign).alias("sign"))
        return F.filter(F.array(at(F.coalesce(place(c, start), F.lit(0)), 1), at(place(c, stop), -1)), lambda x: x["at"] <= grid[c][2])

    corners = kept.select(F.col(value).cast("long").alias("v"), ends("valid").alias("x"), F.explode(ends("system")).alias("y")).select("v", F.explode("x").alias("x"), "y")
    sign = F.col("x.sign") * F.col("y.sign")
    sums = lambda rows, *by: rows.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    cells = sums(corners.select(F.col("x.at").alias("valid"), F.col("y.at").alias("system"), sign.alias("n"), (sign * F.col("v").cast("decimal(38,0)")).cast("decimal(38,0)").alias("total")), "valid", "system")
    right = lambda x, level: F.call_function("shiftright", x, level)

    def buckets(c: str, past: bool) -> Column:
        """(level, bucket) of a tick: those that can be of a past, or those that make up its past."""
        x = F.col(c) + 1 if past else F.col(c)
        levels = F.sequence(F.lit(0), F.lit((grid[c][2] + 1).bit_length()))
        found = F.transform(levels, lambda i: F.struct(i.alias(f"{c}_level"), (right(x, i) - 1 if past else right(x, i)).alias(f"{c}_bucket")))
        return F.explode(F.filter(found, lambda b: b[f"{c}_bucket"] % 2 == 0))  # the bit of the past's end is set

    on = []
    for c in axes:
        split = [*on, *(x for x in axes if x != c and f"{x}_level" not in on)]
        cells = sums(cells.select(*split, "n", "total", buckets(c, False).alias("b")).select(*split, "n", "total", "b.*"), *split, f"{c}_level", f"{c}_bucket")
        on += [f"{c}_level", f"{c}_bucket"]
    times = asks.select("valid", "system").distinct()
    tick = lambda c: F.expr(f"(unix_micros({c}) - {grid[c][0]}L) div {grid[c][1]}L").alias(c)
    past = times.select(F.col("valid").alias("v"), F.col("system").alias("s"), tick("valid"), tick("system"))
    for c in axes:
        past = past.withColumn("b", buckets(c, True)).select("*", "b.*").drop("b")
    met = past.join(cells, on).groupBy(F.col("v").alias("valid"), F.col("s").alias("system")).agg(F.sum("n").alias("n"), F.sum("total").cast("long").alias("total")).where("n > 0")
    return asks.join(met, ["valid", "system"]).select(*asks.columns, "n", "total")


def valid_at(facts: DataFrame, at: Column, *, end_included: bool = False) -> DataFrame:
    end = F.col("invalid_at") >= at if end_included else F.col("invalid_at") > at
    return facts.where((F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("invalid_at").isNull() | end))


def current(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("valid_until").isNull() & ~F.col("fact_state").isin(*DEAD))


def state_map(facts: DataFrame) -> DataFrame:
    """key (relation_to), state of the latest fact."""
    key = F.concat_ws("_", "relation", F.col("to_id").cast("string"))
    return facts.groupBy("from_id", key.alias("key")).agg(F.max(F.struct("valid_from", "id", "fact_state"))["fact_state"].alias("state"))


def supersede(facts: DataFrame, incoming: DataFrame, now: Column, keys: tuple[str, ...] = ("from_id", "to_id", "relation")) -> DataFrame:
    """The facts with open ones of the incoming keys closed and the incoming ones added."""
    marked = facts.join(incoming.select(*keys).distinct().withColumn("__hit", F.lit(True)), list(keys), "left")
    hit = F.col("__hit") & F.col("valid_until").isNull()
    closed = marked.withColumn("fact_state", F.when(hit, "superseded").otherwise(F.col("fact_state"))).withColumn("valid_until", F.when(hit, now).otherwise(F.col("valid_until")))
    if "tx_until" in facts.columns:
        closed = closed.withColumn("tx_until", F.when(hit, now).otherwise(F.col("tx_until")))
    return closed.drop("__hit").unionByName(incoming, allowMissingColumns=True)


def resolve_contradictions(facts: DataFrame) -> DataFrame:
    """Of contradicting facts about one thing the newest stays, the others are superseded by it."""
    w = Window.partitionBy("from_id", "to_id").orderBy(F.desc("created_at"), F.desc("id"))
    ranked = facts.where(F.col("relation") == "contradicts").withColumn("winner", F.first("id").over(w)).withColumn("nth", F.row_number().over(w))
    return ranked.where("nth > 1").select("id", F.col("winner").alias("superseded_by"))


def evolution(facts: DataFrame) -> DataFrame:
    """Versions of facts with the same ends and evolution id, by creation, with the time the next one begins; facts without an evolution id have no versions."""
    w = Window.partitionBy("from_id", "to_id", "evolution_id").orderBy("created_at", "id")
    return facts.where("evolution_id is not null").select("id", "from_id", "to_id", "valid_from", F.row_number().over(w).alias("version"), F.lead("created_at").over(w).alias("next_from"))


def snapshot(facts: DataFrame, root: object, at: Column) -> DataFrame:
    """nodes and edges that the root reaches over facts valid at a time."""
    from .graph import khop

    now = valid_at(facts, at)
    roots = facts.sparkSession.createDataFrame([(root,)], f"root {facts.schema['from_id'].dataType.simpleString()}")
    steps = now.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).where("a != b").distinct()
    reached = khop(steps, roots, 1000).select(F.col("id"))
    inside = now.join(reached.withColumnRenamed("id", "from_id"), "from_id", "left_semi")
    return reached.agg(F.count("*").alias("nodes")).crossJoin(inside.agg(F.count("*").alias("edges")))  # one row each


def relevant(facts: DataFrame, roots: DataFrame, at: Column, depth: int) -> DataFrame:
    """root, id, hop over facts valid at a time, forwards."""
    from .graph import khop

    steps = valid_at(facts, at).select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).where("a != b").distinct()
    return khop(steps, roots, depth).where("hop > 0")


def revisions(snapshots: DataFrame, limit: int = 20) -> DataFrame:
    """Revision payloads (JSON in description) of each observation, newest first."""
    p = F.from_json("description", "observation_id long, revision int, title string, content string")
    rows = snapshots.withColumn("p", p).where("p.observation_id is not null").select("p.*", "timestamp")
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("observation_id").orderBy(F.desc("revision"), F.desc("timestamp")))).where(F.col("nth") <= limit)


def one_current(facts: DataFrame, keys: tuple[str, ...] = ("to_id", "relation")) -> DataFrame:
    """Keys with more than one current fact; tenants and workspaces, where facts have them, are kept apart."""
    keys = (*keys, *(c for c in ("tenant", "workspace") if c in facts.columns and c not in keys))
    return current(facts).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def usable(facts: DataFrame, at: Column | None = None) -> DataFrame:
    """Edges that a traversal may take: the open, live ones, or those that were valid and known at a time."""
    end = lambda c: F.col(c) if c in facts.columns else F.lit(None).cast("timestamp")
    if at is None:
        return facts.where(end("valid_until").isNull() & end("invalid_at").isNull() & ~F.col("fact_state").isin(*DEAD))
    known = (end("tx_from").isNull() | (end("tx_from") <= at)) & (end("tx_until").isNull() | (at < end("tx_until")))
    return valid_at(facts, at).where(known)


def scoped_related(facts: DataFrame, obs: DataFrame, roots: DataFrame, depth: int = 1, *, at: Column | None = None, tenant: str = "", workspace: str = "", project: str = "", most: int = 1000) -> DataFrame:
    """root, id, hop of live observations within 1 to 10 steps, both ways, nearest first and then newest, at most so many a root.

    Both ends of each edge taken, and the edge itself where it has the column, are of the tenant, workspace and project; empty names don't restrict."""
    from .graph import adjacency, khop

    inside = obs
    for column, value in (("tenant", tenant), ("workspace", workspace), ("project", project)):
        if value:
            inside = inside.where(F.col(column) == value)
            if column != "project" and column in facts.columns:
                facts = facts.where(F.col(column) == value)
    own = usable(facts, at)
    for end in ("from_id", "to_id"):
        own = own.join(inside.select(F.col("id").alias(end)), end, "left_semi")
    near = khop(adjacency(own, "from_id", "to_id"), roots, max(1, min(depth, 10))).where("hop > 0")
    found = near.join(inside.where("deleted_at is null").select("id", "created_at"), "id")
    nth = F.row_number().over(Window.partitionBy("root").orderBy("hop", F.desc("created_at"), "id"))
    return found.withColumn("nth", nth).where(F.col("nth") <= max(1, min(most, 10_000))).select("root", "id", "hop")


def snapshots(df: DataFrame, *, low: Column | None = None, high: Column | None = None, key: str | None = None, root: object = None) -> DataFrame:
    """Snapshots in a time range (both ends included), of a key, or of a root, newest first."""
    if low is not None:
        df = df.where(F.col("timestamp") >= low)
    if high is not None:
        df = df.where(F.col("timestamp") <= high)
    if key is not None:
        df = df.where(F.col("snapshot_key") == key)
    if root is not None:
        df = df.where(F.col("root_observation_id") == root)
    return df.orderBy(F.desc("timestamp"), F.desc("id"))


def contradictions_between(facts: DataFrame, low: Column, high: Column) -> DataFrame:
    """Contradicting facts created in a time range, both ends included, newest first."""
    return facts.where((F.col("relation") == "contradicts") & F.col("created_at").between(low, high)).orderBy(F.desc("created_at"), F.desc("id"))
