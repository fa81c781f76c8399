"""Traversal, paths, PageRank, components, hubs, cycles and blast radius over edge tables.

Loops run on the driver, one join a round; state stays distributed and lineage is cut by checkpoints."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .containment import contained

# Labels that are no hubs.
NOISE = ["string", "int", "bool", "error", "any", "Context", "context.Context", "fmt", "errors", "map", "slice", "nil", "struct"]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local session may do without one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="sparkmem-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def adjacency(edges: DataFrame, a: str = "source", b: str = "target", directed: bool = False) -> DataFrame:
    """Distinct (a, b) steps, both ways unless directed."""
    own = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    return (own if directed else own.unionByName(own.select(F.col("b").alias("a"), F.col("a").alias("b")))).where("a != b").distinct()


def khop(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """root, id, hop of everything within depth steps, roots themselves at 0. edges as from adjacency(); roots: (root)."""
    steps = cut(edges)
    seen = cut(roots.select("root", F.col("root").alias("id"), F.lit(0).alias("hop")).distinct())
    front = seen
    for hop in range(1, depth + 1):
        front = cut(front.join(steps, front["id"] == steps["a"]).select("root", F.col("b").alias("id")).distinct().join(seen.select("root", "id"), ["root", "id"], "left_anti").withColumn("hop", F.lit(hop)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def bounded_traversal(edges: DataFrame, root: object, depth: int = 5, most_visited: int = 1000, most_results: int = 100) -> tuple[DataFrame, DataFrame]:
    """(id, hop, parent) in order of hop and id within the budgets, and a row of reasons for leaving something out."""
    spark = edges.sparkSession
    steps = cut(edges)
    kind = steps.schema["a"].dataType.simpleString()
    seen = cut(spark.createDataFrame([(root, 0, None)], f"id {kind}, hop int, parent {kind}"))
    front, visited, reasons = seen, 1, []
    for hop in range(1, depth + 1):
        near = front.join(steps, front["id"] == steps["a"]).groupBy(F.col("b").alias("id")).agg(F.min(front["id"]).alias("parent")).join(seen.select("id"), "id", "left_anti")
        room = most_visited - visited
        near = cut(near.orderBy("parent", "id").limit(room + 1))
        n = near.count()
        if n > room:
            reasons.append("visited")
            near = cut(near.orderBy("parent", "id").limit(room))
            n = room
        front = near.select("id", F.lit(hop).alias("hop"), "parent")
        seen, visited = seen.unionByName(front), visited + n
        if not n or reasons:
            break
    else:
        if not front.join(steps, front["id"] == steps["a"]).select(F.col("b").alias("id")).join(seen, "id", "left_anti").isEmpty():
            reasons.append("depth")
    out = seen.where("hop > 0").orderBy("hop", "id")
    if visited - 1 > most_results:
        reasons.append("results")
    return out.limit(most_results), spark.createDataFrame([(bool(reasons), reasons)], "truncated boolean, reasons array<string>")


def shortest_path(edges: DataFrame, source: object, target: object, depth: int = 5, most_visited: int = 1000) -> tuple[str, list]:
    """("found", ids) with the smallest ids among the shortest paths, ("none", []), or ("truncated", []) if the budget ends first."""
    if source == target:
        return "found", [source]
    steps = cut(edges)
    spark, kind = edges.sparkSession, edges.schema["a"].dataType.simpleString()
    levels = [cut(spark.createDataFrame([(source,)], f"id {kind}"))]
    seen, visited = levels[0], 1
    for _ in range(depth):
        near = cut(levels[-1].join(steps, levels[-1]["id"] == steps["a"]).select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti"))
        n = near.count()
        if not n:
            return "none", []
        levels.append(near)
        if not near.where(F.col("id") == F.lit(target)).isEmpty():
            break
        visited += n
        if visited > most_visited:
            return "truncated", []
        seen = seen.unionByName(near)
    else:
        return "none", []
    marked = [cut(levels[-1].where(F.col("id") == F.lit(target)))]
    for level in levels[-2::-1]:
        back = steps.join(marked[-1].withColumnRenamed("id", "b"), "b", "left_semi").select(F.col("a").alias("id")).distinct()
        marked.append(cut(level.join(back, "id", "left_semi")))
    path = [source]
    for level in marked[-2::-1]:
        path.append(level.join(steps.where(F.col("a") == F.lit(path[-1])), level["id"] == steps["b"]).agg(F.min("id")).first()[0])  # one id a hop
    return "found", path


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component: the smallest id that steps lead to. Alternating stars; no part of the graph is collected."""
    now = cut(edges.select(F.greatest("source", "target").alias("u"), F.least("source", "target").alias("v")).where("u != v").distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = small.select(F.col("u"), F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
        now = cut(small.where("u != v").distinct())
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            return nodes.select("id").join(now.withColumnsRenamed({"u": "id", "v": "component"}), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
        before = state


def communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """component, size, edges, hub (largest degree, smaller id first), cohesion (edges over possible edges; 1 for a single node)."""
    of = components(nodes, edges)
    degree = edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    per = of.join(degree, "id", "left").groupBy("component").agg(F.count("*").alias("size"), F.min(F.struct((-F.coalesce("degree", F.lit(0))).alias("d"), "id"))["id"].alias("hub"))
    inside = edges.join(of, edges["source"] == of["id"]).groupBy("component").agg(F.count("*").alias("edges"))
    joined = per.join(inside, "component", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    return joined.withColumn("cohesion", F.when(F.col("size") == 1, 1.0).otherwise(F.round(F.col("edges") / (F.col("size") * (F.col("size") - 1) / 2), 6)))


def hubs(nodes: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    """The nodes of largest degree but for noise names."""
    degree = edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.where(~F.col("label").isin(*NOISE) & ~F.startswith("label", F.lit("."))).join(degree, "id").orderBy(F.desc("degree"), "id").limit(limit)


def surprising(nodes: DataFrame, edges: DataFrame, limit: int = 5) -> DataFrame:
    """Edges across source files, between a loose and a busy node, or of contradiction, by score."""
    degree = cut(edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree")))
    side = lambda x: nodes.select(F.col("id").alias(x), F.col("source_file").alias(f"{x}_file")).join(degree.select(F.col("id").alias(x), F.col("degree").alias(f"{x}_degree")), x)
    joined = edges.where(~F.col("type").isin("imports", "defines")).join(side("source"), "source").join(side("target"), "target")
    loose = F.least("source_degree", "target_degree") <= 2
    busy = F.greatest("source_degree", "target_degree") >= 6
    file = lambda x: F.nullif(F.col(x), F.lit(""))
    score = F.when(file("source_file") != file("target_file"), 2).otherwise(0) + F.when(loose & busy, 3).otherwise(0) + F.when(F.col("type").isin("contradicts", "supersedes"), 3).otherwise(0)
    return joined.select("source", "target", "type", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "source", "target").limit(limit)


def pagerank(edges: DataFrame, seeds: DataFrame, *, damping: float = 0.85, rounds: int = 20, tolerance: float = 1e-6, directed: bool = False, nodes: DataFrame | None = None) -> DataFrame:
    """id, score: personalised PageRank; weights of 0 or less count 1, mass of dead ends returns to the seeds. seeds: (id, weight)."""
    w = F.when(F.coalesce("weight", F.lit(1.0)) <= 0, 1.0).otherwise(F.coalesce("weight", F.lit(1.0)))
    own = edges.select(F.col("source").alias("a"), F.col("target").alias("b"), w.alias("w"))
    if not directed:
        own = own.unionByName(own.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    sums = own.groupBy("a").agg(F.sum("w").alias("sum"))
    steps = cut(own.join(sums, "a").groupBy("a", "b").agg(F.sum(F.col("w") / F.col("sum")).alias("share")))
    every = own.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    every = every if nodes is None else every.unionByName(nodes.select("id")).distinct()
    known = seeds.join(every, "id", "left_semi")
    total = known.agg(F.sum("weight")).first()[0]
    start = every.join(known.groupBy("id").agg(F.sum("weight").alias("weight")), "id", "left").select("id", (F.coalesce("weight", F.lit(0.0)) / F.lit(total)).alias("s")) if total else every.withColumn("s", F.lit(1.0) / F.lit(max(1, every.count())))
    base = cut(start.join(sums.select(F.col("a").alias("id"), F.lit(True).alias("out")), "id", "left").select("id", "s", F.coalesce("out", F.lit(False)).alias("out")))
    now = base.select("id", "s", "out", F.col("s").alias("p"))
    for turn in range(1, rounds + 1):
        got = now.join(steps, now["id"] == steps["a"]).groupBy(F.col("b").alias("id")).agg(F.sum(F.col("p") * F.col("share")).alias("c"))
        dead = now.agg(F.coalesce(F.sum(F.when(~F.col("out"), F.col("p"))), F.lit(0.0)).alias("dead"))
        new = base.join(got, "id", "left").crossJoin(F.broadcast(dead)).select("id", "s", "out", ((1 - damping) * F.col("s") + damping * (F.coalesce("c", F.lit(0.0)) + F.col("dead") * F.col("s"))).alias("p"))  # dead: one row
        if turn % 5 == 0 or turn == rounds:
            new = cut(new)
            if tolerance and new.join(now.select("id", F.col("p").alias("q")), "id").agg(F.sum(F.abs(F.col("p") - F.col("q")))).first()[0] < tolerance:
                return new.select("id", F.col("p").alias("score"))
        now = new
    return now.select("id", F.col("p").alias("score"))


def pagerank_each(edges: DataFrame, seeds: DataFrame, *, damping: float = 0.85, rounds: int = 20, tolerance: float = 1e-6, directed: bool = False) -> DataFrame:
    """qid, id, score: a PageRank of its own for each query's seeds (qid, id, weight), which must be nodes of the graph.

    Only nodes with rank are kept, so a query costs what it reaches; a query stops by itself once its ranks settle, so
    its result doesn't depend on the others. Nodes that no seed reaches have no row (rank 0)."""
    w = F.when(F.coalesce("weight", F.lit(1.0)) <= 0, 1.0).otherwise(F.coalesce("weight", F.lit(1.0)))
    own = edges.select(F.col("source").alias("a"), F.col("target").alias("b"), w.alias("w"))
    if not directed:
        own = own.unionByName(own.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    sums = own.groupBy("a").agg(F.sum("w").alias("sum"))
    steps = cut(own.join(sums, "a").groupBy("a", "b").agg(F.sum(F.col("w") / F.col("sum")).alias("share")))
    weighed = seeds.groupBy("qid", "id").agg(F.sum("weight").alias("weight")).where("weight > 0")
    total = weighed.groupBy("qid").agg(F.sum("weight").alias("total"))
    base = cut(weighed.join(total, "qid").select("qid", "id", (F.col("weight") / F.col("total")).alias("s")))
    now, done = base.withColumnRenamed("s", "p"), None
    for turn in range(1, rounds + 1):
        met = now.join(steps.withColumnRenamed("a", "id"), "id", "left")
        got = met.where("b is not null").groupBy("qid", F.col("b").alias("id")).agg(F.sum(F.col("p") * F.col("share")).alias("c"))
        dead = met.where("b is null").groupBy("qid").agg(F.sum("p").alias("dead"))
        live = base.join(now.select("qid").distinct(), "qid", "left_semi").join(dead, "qid", "left").select("qid", "id", "s", F.coalesce("dead", F.lit(0.0)).alias("dead"))
        s, c = F.coalesce("s", F.lit(0.0)), F.coalesce("c", F.lit(0.0))
        new = cut(live.join(got, ["qid", "id"], "full").select("qid", "id", ((1 - damping) * s + damping * (c + F.coalesce("dead", F.lit(0.0)) * s)).alias("p")))
        if turn == rounds:
            settled, moving = new, None
        else:
            change = new.join(now.withColumnRenamed("p", "q"), ["qid", "id"], "full").groupBy("qid").agg(F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))).alias("d"))
            change = cut(change)
            settled = new.join(change.where(F.col("d") < tolerance), "qid", "left_semi")
            moving = new.join(change.where(F.col("d") >= tolerance), "qid", "left_semi")
            if change.where(F.col("d") >= tolerance).isEmpty():
                moving = None
        done = settled if done is None else done.unionByName(settled)
        if moving is None:
            break
        now = moving
    return done.select("qid", "id", F.col("p").alias("score"))


def hippo_seeds(dense: DataFrame, lexical: DataFrame) -> DataFrame:
    """Each query's seeds: its passages under all names they may have in a graph, weighing the positive parts of both scores."""
    w = dense.select("qid", "id", F.greatest("score", F.lit(0.0)).alias("w")).unionByName(lexical.select("qid", "id", F.greatest("score", F.lit(0.0)).alias("w"))).groupBy("qid", "id").agg(F.sum("w").alias("weight"))
    key = F.col("id").cast("string")
    return w.select("qid", F.explode(F.array(key, F.concat(F.lit("obs:"), key), F.concat(F.lit("passage:"), key), F.concat(F.lit("sym:"), key))).alias("id"), "weight").where("weight > 0")


def link_passages(nodes: DataFrame, edges: DataFrame, passages: DataFrame, weight: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """The graph with a node for each passage and a mentions edge to each concept (passages: id, concepts array) it names."""
    key = F.concat(F.lit("passage:"), F.col("id").cast("string"))
    new = passages.select(key.alias("id"), key.alias("label"), F.lit("passage").alias("kind")).join(nodes.select("id"), "id", "left_anti")
    named = passages.select(key.alias("source"), F.explode("concepts").alias("target"), F.lit("mentions").alias("type"), F.lit(weight).alias("weight")).dropDuplicates(["source", "target"])
    return nodes.select("id", "label", "kind").unionByName(new), edges.select("source", "target", "type", "weight").unionByName(named)


def concepts_named(queries: DataFrame, nodes: DataFrame, least: int = 3) -> DataFrame:
    """qid, id, weight 1 of the nodes whose label or id a query (qid, text) holds."""
    names = nodes.select("id", F.explode(F.array("label", "id")).alias("label")).where(F.char_length("label") >= least)
    labels = names.select(F.struct("id", "label").alias("label_id"), "label")
    met = contained(queries.select(F.col("qid").alias("id"), "text"), labels)
    return met.select(F.col("id").alias("qid"), F.col("label_id.id").alias("id")).distinct().withColumn("weight", F.lit(1.0))


def concept_seeds(query: str, nodes: DataFrame, least: int = 3) -> DataFrame:
    """Nodes whose label the query holds."""
    return nodes.where((F.char_length("label") >= least) & F.contains(F.lit(query.lower()), F.lower("label")))


def blast_radius(nodes: DataFrame, edges: DataFrame, targets: DataFrame, hops: int = 3) -> DataFrame:
    """root, id, hop of what reaches a target over edges; hop 1 is direct. targets: (root)."""
    return khop(adjacency(edges, "target", "source", directed=True), targets, hops).where("hop > 0")


def _trimmed(steps: DataFrame) -> DataFrame:
    """Steps (a, b) between nodes that have both a way in and a way out, until no node lacks one."""
    size = None
    while size != (n := steps.count()) and n:
        size = n
        steps = cut(steps.join(steps.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(steps.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
    return steps


def strong_components(edges: DataFrame) -> DataFrame:
    """id, component of nodes on a directed cycle (edges: source, target): the smallest id that they reach and that reaches them.

    Each round trims nodes without a way in or out, hands the largest id forward until it stays, and walks back from its
    owners among nodes that got the same: what they meet is a component each. The rest goes on, by steps within one colour."""
    steps = cut(edges.select(F.col("source").alias("a"), F.col("target").alias("b")).where("a != b").distinct())
    done = None
    while True:
        steps = _trimmed(steps)
        if steps.isEmpty():
            break
        colour = cut(steps.select(F.col("a").alias("id"), F.col("a").alias("c")).distinct())  # after trimming, every node has a way out
        while True:
            got = steps.join(colour.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.max("c").alias("got"))
            new = cut(colour.join(got, "id", "left").select("id", F.greatest("c", "got").alias("c"), (F.col("got") > F.col("c")).alias("moved")))
            colour = new.select("id", "c")
            if new.where("moved").isEmpty():
                break
        ends = lambda x: colour.withColumnsRenamed({"id": x, "c": f"c{x}"})
        steps = cut(steps.join(ends("a"), "a").join(ends("b"), "b").where("ca = cb").select("a", "b", F.col("ca").alias("c")))
        met = front = cut(colour.where("id = c"))
        while not front.isEmpty():
            front = cut(steps.join(front.select(F.col("id").alias("b"), "c"), ["b", "c"]).select(F.col("a").alias("id"), "c").distinct().join(met, ["id", "c"], "left_anti"))
            met = cut(met.unionByName(front))
        done = met if done is None else done.unionByName(met)
        steps = steps.join(met.select(F.col("id").alias("a")), "a", "left_anti").join(met.select(F.col("id").alias("b")), "b", "left_anti").select("a", "b")
        steps = cut(steps)
    if done is None:
        return edges.select(F.col("source").alias("id"), F.col("source").alias("component")).limit(0)
    groups = done.groupBy("c").agg(F.min("id").alias("component"), F.count("*").alias("n")).where("n > 1")
    return done.join(groups, "c").select("id", "component")


def cycles(edges: DataFrame, longest: int = 8, types: tuple[str, ...] = ("imports", "calls", "uses"), enough: Callable[[DataFrame], bool] | None = None) -> DataFrame:
    """Simple directed cycles of at most so many edges, each from its smallest id on, as arrays.

    Paths grow only within strongly connected components, a length at a time; enough(cycles found so far) ends it early,
    so that a report of the shortest few doesn't walk through all of them."""
    steps = edges.where(F.col("type").isin(*types)) if "type" in edges.columns else edges
    steps = steps.select("source", "target").where("source != target").distinct()
    of = cut(strong_components(steps))
    ends = lambda x: of.withColumnsRenamed({"id": x, "component": f"of_{x}"})
    steps = cut(steps.join(ends("source"), "source").join(ends("target"), "target").where("of_source = of_target").select(F.col("source").alias("a"), F.col("target").alias("b")))
    paths = steps.where("a < b").select(F.array("a", "b").alias("path"))
    found = None
    for _ in range(2, longest + 1):
        end = F.element_at("path", -1)
        closed = cut(paths.join(steps, (end == F.col("a")) & (F.element_at("path", 1) == F.col("b"))).select("path"))
        found = closed if found is None else found.unionByName(closed)
        if enough is not None and enough(found.select(F.col("path").alias("cycle"), F.size("path").alias("length"))):
            break
        paths = cut(paths.join(steps, (end == F.col("a")) & (F.col("b") > F.element_at("path", 1)) & ~F.array_contains("path", F.col("b"))).select(F.concat("path", F.array("b")).alias("path")))
        if paths.isEmpty():
            break
    return found.select(F.col("path").alias("cycle"), F.size("path").alias("length"))


def community_summaries(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """component, summary: its size, the first ten labels and the first eight nodes outside that it points to."""
    of = cut(components(nodes, edges))
    labels = nodes.join(of, "id").groupBy("component").agg(F.count("*").alias("n"), F.slice(F.sort_array(F.collect_set("label")), 1, 10).alias("labels"))
    ends = edges.join(of.withColumnsRenamed({"id": "source", "component": "c"}), "source").join(of.withColumnsRenamed({"id": "target", "component": "d"}), "target").where("c != d")
    out = ends.groupBy(F.col("c").alias("component")).agg(F.slice(F.sort_array(F.collect_set("target")), 1, 8).alias("outside"))
    text = F.concat_ws("\n", F.concat(F.lit("## "), "component"), F.concat(F.lit("- size: "), F.col("n").cast("string")), F.concat(F.lit("- members: "), F.array_join("labels", ", ")), F.concat(F.lit("- depends on: "), F.array_join(F.coalesce("outside", F.array().cast("array<string>")), ", ")))
    return labels.join(out, "component", "left").select("component", text.alias("summary"))


def report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes, edges, components, density."""
    n, e = nodes.agg(F.count("*").alias("nodes")), edges.agg(F.count("*").alias("edges"))
    c = components(nodes, edges).agg(F.count_distinct("component").alias("components"))
    return n.crossJoin(e).crossJoin(c).withColumn("density", F.when(F.col("nodes") > 1, F.round(F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)), 6)).otherwise(0.0))  # one row each


RELATION_TYPES = ["references", "relates_to", "follows", "supersedes", "contradicts"]  # fixed values


def checked_edges(new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid edges with default weight, and the others with a reason."""
    w = F.coalesce("weight", F.lit(1.0))
    fault = F.when(F.col("from_id") == F.col("to_id"), "self edge").when(F.col("from_id").isNull() | F.col("to_id").isNull(), "missing end").when(~F.col("relation").isin(*RELATION_TYPES), "unknown relation").when((w < 0) | (w > 10), "weight out of range")
    marked = new.withColumn("weight", F.when(w == 0, 1.0).otherwise(w)).withColumn("reason", fault)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def conflicts(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("relation").isin("contradicts", "supersedes"))


def subgraph(edges: DataFrame, roots: DataFrame, depth: int = 2, most_nodes: int = 200) -> tuple[DataFrame, DataFrame]:
    """Nodes around some roots within a budget, hop by hop in order of id, and the edges between them."""
    near = khop(adjacency(edges), roots, depth).groupBy("id").agg(F.min("hop").alias("hop"))
    kept = cut(near.orderBy("hop", "id").limit(most_nodes))
    inside = edges.join(kept.select(F.col("id").alias("source")), "source", "left_semi").join(kept.select(F.col("id").alias("target")), "target", "left_semi")
    return kept, inside


def typed_subgraph(related: DataFrame, obs: DataFrame, edges: DataFrame, entities: DataFrame, most_nodes: int = 100) -> tuple[DataFrame, DataFrame]:
    """The typed nodes around many roots, at most so many for each, and the edges between them.

    related: (root, id, hop) with the root itself at 0; entities: (id, kind, key, value) of observations. Observations come
    first, by hop and id, then entities by kind and key, then who made them, their sessions and projects, by observation.
    What is beyond the budget is left out with its edges. nodes: root, node, kind, subtype, label, hop, place; edges: root,
    source, target, type."""
    most_nodes = most_nodes if 0 < most_nodes <= 200 else 100
    rank = lambda *order: F.row_number().over(Window.partitionBy("root").orderBy(*order))
    held = related.groupBy("root", "id").agg(F.least(F.min("hop"), F.lit(1)).alias("hop"), F.min("hop").alias("far")).join(obs, "id")
    held = held.withColumn("place", rank("far", "id")).where(F.col("place") <= most_nodes)
    held = cut(held.select("root", "id", "hop", "place", "type", "title", "project", F.col("session_id").cast("string").alias("session"), (F.col("created_by") if "created_by" in obs.columns else F.lit(None)).cast("string").alias("actor")))
    name = lambda kind, x: F.concat(F.lit(kind + ":"), F.col(x).cast("string"))
    seen = held.select("root", name("observation", "id").alias("node"), F.lit("observation").alias("kind"), F.col("type").alias("subtype"), F.col("title").alias("label"), "hop", F.struct(F.lit(0).alias("stage"), F.col("place").alias("at"), F.lit("").alias("a"), F.lit("").alias("b")).alias("order"))
    named = held.select("root", "id", "hop", "place").join(entities.select("id", F.col("kind").alias("subtype"), "key", F.col("value").alias("label")), "id")
    named = named.select("root", "id", F.concat_ws(":", F.lit("entity"), "key").alias("node"), "subtype", "label", (F.col("hop") + 1).alias("hop"), F.struct(F.lit(1).alias("stage"), F.lit(0).alias("at"), F.col("subtype").alias("a"), F.col("key").alias("b")).alias("order"))
    parts = (("actor", "actor", "created_by", 1), ("session", "session", "produced_in", 2), ("project", "project", "belongs_to", 3))
    made = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), F.nullif(F.col(x), F.lit("")).alias("value"), F.lit(how).alias("type"), F.lit(n).alias("n")) for kind, x, how, n in parts)))
    made = held.select("root", "id", "place", made.alias("m")).where("m.value is not null")
    made = made.select("root", "id", F.concat_ws(":", "m.kind", "m.value").alias("node"), F.col("m.kind").alias("kind"), F.col("m.value").alias("label"), F.col("m.type").alias("type"), F.struct(F.lit(2).alias("stage"), (F.col("place") * 4 + F.col("m.n")).alias("at"), F.lit("").alias("a"), F.lit("").alias("b")).alias("order"))
    first = lambda df, kind, subtype, label, hop: df.groupBy("root", "node").agg(F.min(F.struct("order", kind.alias("kind"), subtype.alias("subtype"), label.alias("label"), hop.alias("hop"))).alias("f")).select("root", "node", "f.kind", "f.subtype", "f.label", "f.hop", "f.order")
    none = F.lit(None).cast("string")
    every = seen.unionByName(first(named, F.lit("entity"), F.col("subtype"), F.col("label"), F.col("hop")))
    every = every.unionByName(first(made, F.col("kind"), none, F.col("label"), F.lit(None).cast("int")))
    kept = cut(every.withColumn("place", rank("order.stage", "order.at", "order.a", "order.b")).where(F.col("place") <= most_nodes))
    nodes = kept.select("root", "node")
    semantic = edges.join(held.select("root", F.col("id").alias("from_id")), "from_id").join(held.select("root", F.col("id").alias("to_id")), ["root", "to_id"])
    links = semantic.select("root", name("observation", "from_id").alias("source"), name("observation", "to_id").alias("target"), F.col("relation").alias("type"))
    links = links.unionByName(named.select("root", name("observation", "id").alias("source"), F.col("node").alias("target"), F.lit("mentions").alias("type")))
    links = links.unionByName(made.select("root", name("observation", "id").alias("source"), F.col("node").alias("target"), "type"))
    return kept.drop("order"), links.join(nodes.withColumnRenamed("node", "target"), ["root", "target"], "left_semi").select("root", "source", "target", "type")


def project_graph(seeds: DataFrame, obs: DataFrame, edges: DataFrame, project: str | None = None, depth: int = 2, most_nodes: int = 100) -> tuple[DataFrame, DataFrame, bool]:
    """Nodes (id, hop, place) and edges (id, from_id, to_id) of a walk from seeds (id, place) level by level, and whether the budget ended it.

    A level meets the edges of its nodes in the order of the nodes and of the edges' ids; a neighbour of another project
    is passed over with its edge. The first neighbour beyond the budget ends the walk, and no edge from there on is taken."""
    depth, most_nodes = (2 if depth < 1 else min(depth, 10)), (100 if most_nodes < 1 else min(most_nodes, 200))
    own = obs.select("id") if project is None else obs.where(F.col("project") == project).select("id")
    both = edges.select("id", "from_id", "to_id", F.col("from_id").alias("a"), F.col("to_id").alias("b")).unionByName(edges.select("id", "from_id", "to_id", F.col("to_id").alias("a"), F.col("from_id").alias("b"))).where("a != b")
    front = cut(seeds.groupBy("id").agg(F.min("place").alias("place")).orderBy("place").limit(most_nodes + 1).withColumn("hop", F.lit(0)))
    ended = front.count() > most_nodes
    front = cut(front.orderBy("place").limit(most_nodes)) if ended else front
    known, taken = front, None
    for level in range(1, depth + 1):
        if ended or front.isEmpty():
            break
        met = both.join(front.select(F.col("id").alias("a"), F.col("place").alias("at")), "a").join(own.withColumnRenamed("id", "b"), "b", "left_semi")
        met = cut(met.select("id", "from_id", "to_id", "b", F.struct("at", F.col("id").cast("string").alias("edge")).alias("order")))
        new = met.join(known.select(F.col("id").alias("b")), "b", "left_anti").groupBy("b").agg(F.min("order").alias("order"))
        n = known.count()
        new = cut(new.orderBy("order").limit(most_nodes - n + 1).withColumn("place", F.row_number().over(Window.orderBy("order")) + n))  # the budget's rows
        over = new.where(F.col("place") > most_nodes).select("order").first()
        ended = over is not None
        if ended:
            end = F.struct(F.lit(over["order"]["at"]).alias("at"), F.lit(over["order"]["edge"]).alias("edge"))
            met, new = met.where(F.col("order") < end), new.where(F.col("place") <= most_nodes)
        taken = met.select("id", "from_id", "to_id") if taken is None else taken.unionByName(met.select("id", "from_id", "to_id"))
        front = cut(new.select(F.col("b").alias("id"), F.col("place").cast(known.schema["place"].dataType).alias("place"), F.lit(level).alias("hop")))
        known = cut(known.unionByName(front))
    none = edges.select("id", "from_id", "to_id").limit(0)
    return known.select("id", "hop", "place"), (none if taken is None else taken.distinct()), ended
