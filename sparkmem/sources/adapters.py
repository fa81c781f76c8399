"""The driver's tables as the logical tables of a memory store.

Every rule here has the same meaning in DuckDB SQL (see plans/sql.py)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed clock of all checked queries.
NOW = "2025-01-01 00:00:00"
# Observation types, by id modulo their number.
TYPES = ["manual", "tool_use", "decision", "bugfix", "pattern", "config", "discovery", "learning"]


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def days_after(start: str, days: Column) -> Column:
    """A day so many days after a date, as a timestamp at midnight."""
    return F.date_add(F.lit(start).cast("date"), days.cast("int")).cast("timestamp")


def observations(spark: SparkSession, sf_dir: str, *, live: bool = False) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    kind = reduce(lambda out, k: F.when(i % len(TYPES) == k, TYPES[k]).otherwise(out), range(len(TYPES)), F.lit(None).cast("string"))
    created = days_after("2024-01-01", i % 365)
    out = d.select(
        i.alias("id"), F.substring("text", 1, 60).alias("title"), F.col("text").alias("content"), kind.alias("type"), F.col("source").alias("project"), F.when(i % 5 == 0, "personal").otherwise("project").alias("scope"),
        F.concat_ws("/", "lang", "source").alias("topic_key"), (i % 100).alias("session_id"), ((i % 10 + 1) / 10).alias("confidence"), created.alias("created_at"), F.date_add(created.cast("date"), (i % 30).cast("int")).cast("timestamp").alias("updated_at"),
        F.when(i % 50 == 0, days_after("2024-12-31", F.lit(0))).alias("deleted_at"), F.when(kind == "tool_use", F.col("lang")).alias("tool_name"), F.array_compact(F.array(F.when(i % 2 == 0, "even"), F.when(i % 3 == 0, "third"), F.when(i % 7 == 0, "seventh"))).alias("tags"),
    )
    return out.where(F.col("deleted_at").isNull()) if live else out


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("operation_type"), F.col("value").alias("duration_ms"), F.col("user_id").alias("session_id"), (F.col("event_type") != "error").alias("success"), (F.col("event_id") % 11).alias("result_count"), F.col("ts").cast("timestamp").alias("timestamp")
    )


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("session_id"), F.col("text").alias("content"))


def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for each part that lines refer to, standing for observations of the same number."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("access_count"), F.max("l_shipdate").cast("timestamp").alias("last_accessed"))
    return l.select(F.col("l_partkey").alias("observation_id"), (F.col("access_count") % 50 / 10).alias("score"), "access_count", "last_accessed")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temporal edges from customers to parts."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    relation = F.element_at(F.array(*(F.lit(x) for x in RELATIONS)), (F.col("l_linenumber") % 5 + 1).cast("int"))
    ended = F.when(F.col("l_shipdate") > F.col("o_orderdate"), F.col("l_shipdate").cast("timestamp"))
    return l.join(o, l.l_orderkey == o.o_orderkey).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("o_custkey").alias("from_id"), F.col("l_partkey").alias("to_id"), relation.alias("relation"), F.least(F.greatest(F.col("l_quantity") / 5, F.lit(0.0)), F.lit(10.0)).alias("weight"),
        F.date_add(F.col("o_orderdate").cast("date"), (F.col("l_linenumber") * 7 % 5).cast("int")).cast("timestamp").alias("created_at"), F.when(F.col("l_linenumber") < 6, F.col("l_linenumber") % 2).cast("long").alias("evolution_id"),
        F.col("o_orderdate").cast("timestamp").alias("valid_from"), ended.alias("invalid_at"), F.when(F.col("l_returnflag") == "R", ended).alias("valid_until"), F.when(F.col("l_returnflag") == "R", "superseded").when(F.col("l_returnflag") == "A", "deprecated").otherwise("current").alias("fact_state"),
    )


# Relation types, by line number modulo their number.
RELATIONS = ["references", "relates_to", "follows", "supersedes", "contradicts"]


def document_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a sparse graph: nation of each supplier and region of each nation, and neighbours by number."""
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    c = table(spark, sf_dir, "customer")
    key = lambda p, x: F.concat(F.lit(p + ":"), F.col(x).cast("string"))
    nodes = (
        r.select(key("r", "r_regionkey").alias("id"), F.col("r_name").alias("label"), F.lit("region").alias("kind"))
        .unionByName(n.select(key("n", "n_nationkey").alias("id"), F.col("n_name").alias("label"), F.lit("nation").alias("kind")))
        .unionByName(s.select(key("s", "s_suppkey").alias("id"), F.col("s_name").alias("label"), F.lit("supplier").alias("kind")))
        .unionByName(c.select(key("c", "c_custkey").alias("id"), F.col("c_name").alias("label"), F.lit("customer").alias("kind")))
    )
    links = (
        n.select(key("n", "n_nationkey").alias("source"), key("r", "n_regionkey").alias("target"), F.lit("belongs").alias("type"), F.lit(1.0).alias("weight"))
        .unionByName(s.select(key("s", "s_suppkey").alias("source"), key("n", "s_nationkey").alias("target"), F.lit("uses").alias("type"), F.lit(2.0).alias("weight")))
        .unionByName(c.select(key("c", "c_custkey").alias("source"), key("n", "c_nationkey").alias("target"), F.lit("calls").alias("type"), F.lit(1.0).alias("weight")))
    )
    return nodes.withColumn("source_file", F.concat("kind", F.lit(".tbl"))), links


def code_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of Go sources: a file for each supplier, a package for each nation, a folder for each region."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    regions = n.select(F.col("n_nationkey").alias("next"), F.col("n_regionkey").alias("next_region"))
    own = s.join(n, s.s_nationkey == n.n_nationkey).withColumn("next", ((F.col("s_nationkey") + 1) % 25).cast("int")).join(regions, "next")
    path = F.format_string("r%d/n%d/s%d.go", "n_regionkey", "s_nationkey", "s_suppkey")
    text = F.format_string(
        'package n%d // func hidden%d() {\n\nimport (\n\t"fmt"\n\tother "example.com/tree/r%d/n%d"\n)\n\ntype T%d struct { id int }\n\n'
        "func (t *T%d) Get%d(a int) int { if a > 0 && a < 9 { fmt.Println(\"if {\"); return Do%d(a) }; return 0 }\n\nfunc Do%d(a int) int {\n\tfor a > 0 {\n\t\ta--\n\t}\n\tother.Shared(a)\n\treturn Do%d(a)\n}\n",
        "s_nationkey", "s_suppkey", "next_region", "next", "s_suppkey", "s_suppkey", "s_suppkey", "s_suppkey", "s_suppkey", F.col("s_suppkey") + 1,
    )
    shared = F.when(F.col("s_suppkey") % 7 == 0, F.lit("\nfunc Shared(a int) int { return a }\n")).otherwise("")
    return own.select(path.alias("path"), F.lit("go").alias("language"), F.concat(text, shared).alias("content"))
