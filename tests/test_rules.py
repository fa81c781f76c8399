"""Rules whose expected rows are written by hand, not taken from the engine."""

from functools import partial

import pytest
from pyspark.sql import functions as F

from sparkmem.functions import text
from sparkmem.operators import graph
from sparkmem.plans import adaptive


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("query", "tier"), [
    ("", "direct_factual"), ("main.go", "direct_factual"), ("#42", "direct_factual"), ("func Save", "direct_factual"), ("ParseToken()", "direct_factual"), ("explain the dependency overview", "multi_hop_graph"),
    ("flow of data through cache", "multi_hop_graph"), ("list modules please now", "architectural_global"), ("all users", "semantic_hybrid"), ("¿Por qué falla?", "multi_hop_graph"), ("resumen general del sistema", "architectural_global"), ("how to store a token", "semantic_hybrid"),
])
def test_tier(spark, query, tier):
    assert one(spark, text.query_tier(F.lit(query))) == tier


def test_speculative(spark):
    assert [one(spark, text.speculative(F.lit(q))) for q in ("Would it fit?", "probably so", "what if it could")] == [True, True, False]


@pytest.mark.parametrize(("type_", "title", "content", "key"), [
    ("bugfix", "Fix the login", "", "bug/fix-the-login"), ("ADR", "Hexagonal ports", "", "architecture/hexagonal-ports"), ("manual", "Notes", "a tradeoff was made", "decision/notes"), ("manual", "", "Some words   only", "topic/some-words-only"),
    ("decision", "decision: use JSON", "", "decision/use-json"), ("tool_use", "Plain", "", "tool-use/plain"), ("", "", "", "topic/general"), ("root-cause", "x" * 120, "", "discovery/" + "x" * 100),
])
def test_topic(spark, type_, title, content, key):
    assert one(spark, text.suggested_topic(F.lit(type_), F.lit(title), F.lit(content))) == key


def test_entities(spark):
    t = "See https://a.example/x. Edit src/auth/mid.ts, main.go and notes.zzz; import {x} from 'react'\ntype Config and def f\nselect * FROM users JOIN `orders` INTO where\nGET /api/users/:id $DATABASE_URL ${HOME} $PA v1.2.3 Go 1.26 --verbose -p\nError: ECONNREFUSED by host\n@scope/pkg github.com/a/b"
    got = sorted({(e.kind, e.value) for e in one(spark, text.entities(F.lit(t)))})
    assert got == sorted([("url", "https://a.example/x"), ("file", "src/auth/mid.ts"), ("file", "main.go"), ("package", "react"), ("package", "@scope/pkg"), ("package", "github.com/a/b"), ("symbol", "Config"), ("sql_table", "users"), ("sql_table", "orders"),
                          ("endpoint", "/api/users/:id"), ("env_var", "DATABASE_URL"), ("env_var", "HOME"), ("version", "1.2.3"), ("version", "1.26"), ("cli_flag", "--verbose"), ("cli_flag", "-p"), ("error", "ECONNREFUSED by host")])


def test_learnings():
    body = "## Key Learnings:\n- only a bullet that is long enough\n1. **always** check the `bounds` first\n2. short one here\n### Next\n1. not of this section at all\n"
    assert text.learnings_of(body) == ["always check the bounds first"]
    assert text.learnings_of("# Learnings\n1. a header of one mark is none\n") == []
    assert text.learnings_of("## Takeaways\n1. another header is none at all\n") == []
    assert text.learnings_of("## Aprendizajes Clave\n* siempre hay que probar los bordes\n## Learnings\nnothing here") == ["siempre hay que probar los bordes"]


def test_drafts(spark):
    got = one(spark, text.memory_drafts(F.lit("We decided to use Spark. Fine\n\nfixed the cache bug\nRule: no globals\nplain line")))
    assert [(d.title, d.content, d.type, d.confidence) for d in got] == [("to use Spark", "We decided to use Spark. Fine", "decision", 0.85), ("the cache bug", "fixed the cache bug", "bugfix", 0.85), ("no globals", "Rule: no globals", "pattern", 0.9)]
    edges = one(spark, text.draft_edges(text.memory_drafts(F.lit("We decided to use Spark\nRule: no globals"))))
    assert [(e.from_title, e.to_title, e.relation) for e in edges] == [("to use Spark", "no globals", "relates_to")]
    assert [(d.title, d.type) for d in one(spark, text.memory_drafts(F.lit("just a note")))] == [("just a note", "manual")]


def test_hubs(spark):
    nodes = spark.createDataFrame([("a", "Context", "x.go"), ("b", "context", "x.go"), ("c", ".hidden", "y.go"), ("d", "Store", "")], "id string, label string, source_file string")
    edges = spark.createDataFrame([("a", "b", "calls"), ("b", "c", "calls"), ("c", "d", "contradicts")], "source string, target string, type string")
    assert [(r.id, r.degree) for r in graph.hubs(nodes, edges).collect()] == [("b", 2), ("d", 1)]
    assert [(r.source, r.target, r.score) for r in graph.surprising(nodes, edges).collect()] == [("c", "d", 3), ("b", "c", 2)]


def test_rank_of_each_query(spark):
    """A query's ranks are the same alone and beside others, and those of the plain PageRank."""
    edges = spark.createDataFrame([("1", "2"), ("2", "3"), ("3", "4"), ("4", "5"), ("9", "8"), ("2", "8")], "source string, target string").withColumn("weight", F.lit(1.0))
    seeds = spark.createDataFrame([(1, "1", 1.0), (1, "3", 0.5), (2, "9", 2.0)], "qid int, id string, weight double")
    both = {(r.qid, r.id): r.score for r in graph.pagerank_each(edges, seeds, rounds=5).collect()}
    for q in (1, 2):
        alone = {(r.qid, r.id): r.score for r in graph.pagerank_each(edges, seeds.where(f"qid = {q}"), rounds=5).collect()}
        assert alone == pytest.approx({k: v for k, v in both.items() if k[0] == q}, abs=1e-12)
        plain = {r.id: r.score for r in graph.pagerank(edges, seeds.where(f"qid = {q}").drop("qid"), rounds=5).collect()}
        assert {k[1]: v for k, v in alone.items()} == pytest.approx({k: v for k, v in plain.items() if v}, abs=1e-9)


def test_graph_stage_by_query(spark, monkeypatch):
    monkeypatch.setattr(graph, "pagerank_each", partial(graph.pagerank_each, rounds=3))
    nodes = spark.createDataFrame([(str(i),) for i in range(1, 6)], "id string")
    edges = spark.createDataFrame([("1", "2"), ("2", "3"), ("3", "4"), ("4", "5")], "source string, target string").withColumn("weight", F.lit(1.0))
    hits = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 5, 1), (2, 2, 2)], "qid int, id long, position int")
    rows = lambda df: sorted((r.qid, r.id, round(r.score, 9)) for r in df.collect())
    both = rows(adaptive.graph_stage(hits, nodes, edges))
    assert both == rows(adaptive.graph_stage(hits.where("qid = 1"), nodes, edges)) + rows(adaptive.graph_stage(hits.where("qid = 2"), nodes, edges))
