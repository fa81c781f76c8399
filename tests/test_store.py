"""Known answers of the store's operators."""

import math

import pytest
from pyspark.sql import functions as F

from sparkmem.functions import text, timerange
from sparkmem.operators import code, evaluation, fusion, graph, lexical, lifecycle, packs, relational, rerank, temporal, vector


def ts(x):
    return F.lit(x).cast("timestamp")


def test_rrf(spark):
    lists = spark.createDataFrame([(1, "A", 1, 10), (1, "A", 2, 20), (1, "A", 3, 30), (1, "B", 1, 20), (1, "B", 2, 10)], "qid int, list string, position int, id long")
    got = [(r.id, round(r.score, 9)) for r in fusion.rrf(lists).orderBy("position").collect()]
    assert got == [(10, round(1 / 61 + 1 / 62, 9)), (20, round(1 / 61 + 1 / 62, 9)), (30, round(1 / 63, 9))]


@pytest.mark.parametrize(("kind", "days", "accesses", "hours", "edges", "want"), [("decision", 2, 5, 1, 3, 2.58), ("bugfix", 30, 0, 48, 0, 0.5), ("manual", 1, 15, 0.5, 0, 1.99), ("pattern", 0, 0, 0, 10, 2.2), ("config", 365, 0, 8760, 0, 0.1), ("discovery", 0, 0, 48, 0, 0.65)])
def test_importance(spark, kind, days, accesses, hours, edges, want):
    now = ts("2025-06-15 12:00:00")
    past = lambda h: F.timestamp_micros(F.unix_micros(now) - F.lit(int(h * 3_600_000_000)))
    got = spark.range(1).select(lifecycle.importance_score(F.lit(kind), past(days * 24), F.lit(accesses), past(hours), F.lit(edges), now).alias("s")).first().s
    assert got == pytest.approx(want, abs=1e-9)


def test_time_ranges(spark):
    rows = spark.createDataFrame([("notes from March 2024",), ("plan for tomorrow",), ("nothing",), ("March of 2024",), ("in 2024-13-01, year 2024",), ("tomorrow, not today",)], "t string")
    got = [(str(r.r.low), str(r.r.high)) if r.r else None for r in rows.select(timerange.time_range(F.col("t"), ts("2025-06-15 12:30:00")).alias("r")).collect()]
    assert got == [("2024-03-01 00:00:00", "2024-04-01 00:00:00"), ("2025-06-16 00:00:00", "2025-06-17 00:00:00"), None, ("2024-03-01 00:00:00", "2024-04-01 00:00:00"), ("2024-01-01 00:00:00", "2025-01-01 00:00:00"), ("2025-06-16 00:00:00", "2025-06-17 00:00:00")]


@pytest.mark.parametrize(("total", "matching", "plan"), [(800, 100, "exact"), (799, 100, "constrained"), (8, 1, "exact"), (7, 1, "constrained"), (32768, 4096, "exact"), (40000, 4097, "constrained"), (100, 0, "none")])
def test_scan_plan(total, matching, plan):
    assert vector.scan_plan(total, matching) == plan


def test_grade(spark):
    got = {r.qid: (r.grade, r.kept, r.refine) for r in fusion.grade(spark.createDataFrame([(1, 1, 0.85), (1, 2, 0.001), (2, 1, 0.15)], "qid int, id int, score double")).collect()}
    assert got == {1: ("high", 1, False), 2: ("low", 1, True)}


def chain(spark, pairs, kind="imports"):
    return spark.createDataFrame([(a, b, kind, 1.0) for a, b in pairs], "source string, target string, type string, weight double")


def test_pagerank(spark):
    got = {r.id: r.score for r in graph.pagerank(chain(spark, ["AB", "BC", "CD"]), spark.createDataFrame([("A", 1.0)], "id string, weight double"), directed=True).collect()}
    assert got["A"] > got["B"] > got["C"] > got["D"]
    assert sum(got.values()) == pytest.approx(1, abs=1e-6)


def test_path(spark):
    steps = graph.adjacency(spark.createDataFrame([(1, 2), (1, 3), (2, 9), (3, 4), (4, 10), (9, 10)], "source long, target long"))
    assert graph.shortest_path(steps, 1, 10) == ("found", [1, 2, 9, 10])
    assert graph.shortest_path(steps, 1, 77) == ("none", [])
    assert graph.shortest_path(steps, 1, 10, most_visited=2)[0] == "truncated"


def test_traversal(spark):
    steps = graph.adjacency(spark.createDataFrame([(0, i) for i in range(1, 8)] + [(7, 8)], "source long, target long"))
    found, reasons = graph.bounded_traversal(steps, 0, depth=2, most_visited=5)
    assert [r.id for r in found.collect()] == [1, 2, 3, 4]
    assert reasons.first().reasons == ["visited"]


def test_cycles_and_components(spark):
    edges = chain(spark, ["AB", "BC", "CA", "CD", "XY"])
    assert [r.cycle for r in graph.cycles(edges).collect()] == [["A", "B", "C"]]
    nodes = spark.createDataFrame([(x, x, "k") for x in "ABCDXYZ"], "id string, label string, kind string")
    got = {r.component: (r.size, r.edges, r.hub, r.cohesion) for r in graph.communities(nodes, edges).collect()}
    assert got == {"A": (4, 4, "C", round(4 / 6, 6)), "X": (2, 1, "X", 1.0), "Z": (1, 0, "Z", 1.0)}


def test_code_graph(spark):
    files = spark.createDataFrame(
        [("src/a/m.py", "python", 'class A(B):\n    """Doc."""\n    def go(self, x):\n        if x:\n            return helper(x)\n\ndef helper(y):\n    return y\n'), ("db/s.sql", "sql", "CREATE TABLE app.users (\n id int);\nCREATE TABLE orders (\n user_id int REFERENCES users(id)\n);"), ("w/t.ts", "typescript", "import { x } from './x'\nexport class T extends S {}\nexport const f = (a) => f2(a)\n"), ("g/m.go", "go", 'import "fmt"\ntype S struct {}\nfunc (s S) Run() {\n if true { helper2() }\n}\nfunc helper2() {}\n'), ("tests/test_m.py", "python", "from m import helper\ndef test_helper():\n    assert helper(1)\n")],
        "path string, language string, content string",
    )
    syms = code.symbols(files).cache()
    assert {(r.kind, r.name) for r in syms.collect()} >= {("class", "A"), ("method", "go"), ("function", "helper"), ("table", "users"), ("table", "orders"), ("class", "T"), ("function", "f"), ("struct", "S"), ("method", "Run")}
    edges = code.resolve(syms, code.relations(files)).cache()
    names = {r.id: r.name for r in syms.collect()}
    assert {(names[r.source_id], names[r.target_id], r.relation) for r in edges.collect()} >= {("go", "helper", "calls"), ("orders", "users", "references"), ("test_helper", "helper", "calls"), ("Run", "helper2", "calls")}
    wanted = spark.createDataFrame([("helper",)], "target string")
    assert [r.command for r in code.impacted_tests(syms, edges, wanted).collect()] == ["pytest tests/test_m.py"]
    assert code.search_symbols(syms, "helper").first().name == "helper"
    assert code.repo_map(syms, edges).count() == 5
    assert {r.name: r.score for r in code.hubs(syms, edges).collect()}["helper"] == 3.0
    assert code.package_cohesion(syms, edges).count() >= 2


def test_text():
    long_text = ("Sentence one. Sentence two.\n" * 50) + "ä" * 3000
    assert "".join(text.units_of(long_text)) == long_text
    assert all(len(u.encode()) <= 1200 for u in text.units_of(long_text))
    pieces = text.chunks_of("Sentence one. Sentence two.\n" * 50, 200, 40)
    assert len(pieces) >= 2 and all(len(p) <= 300 for p in pieces)
    assert text.redacted("a <private>x</PRIVATE> b") == ("a [REDACTED] b", "redacted", 1, None)
    for bad in ("<private>x", "</private>", "<private><private>x</private></private>"):
        assert text.redacted(bad)[1] == "rejected"
    assert text.redacted("<private>x</private>", required=True)[1] == "rejected"
    assert [text.stem_of(w) for w in ("caresses", "ponies", "motoring", "relational", "hopeful", "adjustment", "rate")] == ["caress", "poni", "motor", "relat", "hope", "adjust", "rate"]
    assert text.learnings_of("## Learnings\n1. always check the bounds first\n2. short\n") == ["always check the bounds first"]
    assert text.preview_of("x" * 2000 + " needle", ["needle"], 100).endswith("needle")
    assert "[needle]" in text.snippet_of("one two needle three", ["needle"])


def test_text_columns(spark):
    row = spark.createDataFrame([("Fix the DB config: see https://x.example/a v1.2.3 --dry-run", "¿ase deploy, config?")], "t string, q string")
    got = row.select(text.entities(F.col("t")).alias("e"), text.expanded_query(F.col("q")).alias("x"), text.sanitised(F.lit('a-b "c" (d)*')).alias("s"), text.slug(F.col("t")).alias("k"), text.redact(F.lit("a<private>b</private>")).alias("r"), text.canonical_entity(F.lit("url"), F.lit("Ａ B/c")).alias("c")).first()
    assert {(e.kind, e.value) for e in got.e} == {("url", "https://x.example/a"), ("version", "1.2.3"), ("cli_flag", "--dry-run")}
    assert got.x == "hace or deploy or despliegue or publicación or config or configuración or settings"
    assert got.s == "a AND b AND 'c' AND d"
    assert got.r.text == "a[REDACTED]" and got.c == "url:ab/c"


def test_rerank(spark):
    assert rerank.similarity("auth", "auth") == 1 and rerank.similarity("auth", "author") == pytest.approx(4 / 6)
    assert 0 < rerank.similarity("night", "nacht") < 1
    e = spark.createDataFrame([(1, 0.9, "a", "p", "x" * 60), (1, 0.8, "b", "p", "x" * 60), (1, 0.7, "c", "p", "x" * 30)], "qid int, score double, title string, path string, text string")
    assert sorted(r.title for r in rerank.budgeted(e, 100, 5).collect()) == ["a", "c"]


def test_temporal(spark):
    f = spark.createDataFrame([(1, 1, 2, "r", "2024-01-01", None, "current"), (2, 1, 3, "r", "2024-01-01", None, "current")], "id long, from_id long, to_id long, relation string, valid_from string, valid_until string, fact_state string").withColumn("valid_from", F.to_timestamp("valid_from")).withColumn("valid_until", F.to_timestamp("valid_until"))
    new = f.where("id = 1").withColumn("id", F.lit(3).cast("long"))
    out = {r.id: r.fact_state for r in temporal.supersede(f, new, ts("2025-01-01")).collect()}
    assert out == {1: "superseded", 2: "current", 3: "current"}
    assert temporal.one_current(temporal.supersede(f, new, ts("2025-01-01"))).count() == 0


def test_save(spark):
    cols = "id long, project string, scope string, topic_key string, content string, created_at timestamp, deleted_at timestamp"
    store = spark.sql("SELECT 1L id, 'p' project, 's' scope, 'k' topic_key, 'old' content, timestamp'2025-01-01 00:00:00' created_at, cast(null as timestamp) deleted_at UNION ALL SELECT 2L, 'p', 's', '', 'same  Text', timestamp'2025-01-01 00:00:00', null")
    assert ", ".join(store.columns) == ", ".join(c.split()[0] for c in cols.split(", "))
    batch = spark.sql("""SELECT * FROM VALUES (1L, 'p', 's', 'k', 'new', 'decision', timestamp'2025-01-01 00:05:00'), (2L, 'p', 's', '', 'Same text', 'manual', timestamp'2025-01-01 00:10:00'),
      (3L, 'p', 's', 'n', 'a', 'decision', timestamp'2025-01-01 00:10:00'), (4L, 'p', 's', 'n', 'b', 'decision', timestamp'2025-01-01 00:11:00'), (5L, 'p', 's', '', 'Same text', 'decision', timestamp'2025-01-01 00:10:00') AS t(seq, project, scope, topic_key, content, type, created_at)""")
    got = {r.seq: (r.target, r.status) for r in lifecycle.save(store, batch).collect()}
    assert got == {1: (1, "updated"), 2: (2, "replayed"), 3: (-3, "created"), 4: (-3, "updated"), 5: (-5, "created")}


def test_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.standard_normal(64)]) for i in range(200)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>")
    q = v.where("id < 5").select(F.col("id").alias("qid"), F.col("embedding").alias("vector"))
    exact = {(r.qid, r.id) for r in vector.exact_topk(v, q, 10).collect()}
    rough = {(r.qid, r.id) for r in vector.quantised_topk(v.select("id", vector.quantised("embedding").alias("q")), q, 10).collect()}
    assert len(exact & rough) / len(exact) >= 0.9
    twice = v.unionByName(v.where("id = 3").select(F.lit(900).cast("long").alias("id"), "embedding"))
    assert {(r.id, r.duplicate_of) for r in vector.near_duplicates(twice, 0.95).collect()} == {(3, 900), (900, 3)}  # the nearest other, both ways
    assert vector.quantise(np.array([0.5, -0.5]))[2].tolist() == [127, -127]


def test_vectors_in_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(vector, "MOST_QUERIES", 7)
    monkeypatch.setattr(vector, "BLOCK_ROWS", 30)
    m = np.random.default_rng(2).normal(size=(100, 8))
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, embedding array<float>")
    q = v.where("id % 4 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("vector"))
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {(i, int(j)) for i in range(0, 100, 4) for j in np.argsort(-(unit[i] @ unit.T))[:5]}
    assert {(r.qid, r.id) for r in vector.exact_topk(v, q, 5).collect()} == want
    assert {(r.qid, r.id) for r in vector.prefix_rerank(v, q, 5, pool=100).collect()} == want
    rough = {(r.qid, r.id) for r in vector.quantised_topk(v.select("id", vector.quantised("embedding").alias("q")), q, 5).collect()}
    assert {i for i, _ in rough} == set(range(0, 100, 4)) and len(rough & want) >= 0.9 * len(want)


def test_whole_tables(spark):
    from sparkmem.plans import catalogue

    SF = "/root/testdata/sf0.001"
    asked = {r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 20 = 0").collect()}
    for name in ("quantized_topk", "mrl_rerank"):
        assert {r.qid for r in catalogue.QUERIES[name](spark, SF).collect()} == asked
    l = {(r.l_partkey, r.l_suppkey * 7) for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_partkey", "l_suppkey").collect()}
    two = {(a, b) for a, b in l if a < b and (b, a) in l}
    after = {}
    for a, b in l:
        after.setdefault(a, set()).add(b)
    three = {(a, b, c) for a, b in l if a < b for c in after.get(b, ()) if a < c != b and a in after.get(c, ())}
    assert {tuple(r.cycle) for r in catalogue.QUERIES["cycles"](spark, SF).collect()} == two | three
    hits, _, live = catalogue._ranked(spark, SF, 5)
    whole = rerank.notes(hits.select("qid", "id").join(live.select("id", "content"), "id"), catalogue.asked(spark))
    notes = {(r.qid, r.id, r.note) for r in whole.collect()}
    assert {(r.qid, r.id, r.note) for r in catalogue.QUERIES["chain_of_note"](spark, SF).collect()} == notes


def test_evaluation(spark):
    res = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (1, 7, 3)], "qid int, id int, position int")
    truth = spark.createDataFrame([(1, 6, 2.0), (1, 9, 1.0)], "qid int, id int, gain double")
    r = evaluation.recall_precision_mrr(res, truth, 3).first()
    assert (r.recall, r.precision, r.mrr) == (0.5, pytest.approx(1 / 3), 0.5)
    assert evaluation.ndcg_at(res, truth, 3).first().ndcg == pytest.approx(3 / math.log2(3) / (3 + 1 / math.log2(3)))
    assert evaluation.gate({"recall": 0.5}, {"recall": 0.58}) == ["recall: 0.5000 < 0.5800"]
    assert spark.range(1).select(evaluation.rouge_l(F.lit("a b c"), F.lit("a c d")).alias("r")).first().r == pytest.approx(4 / 6)


def test_relational(spark):
    old, new = spark.createDataFrame([("a", 1), ("b", 1)], "path string, stamp int"), spark.createDataFrame([("b", 2), ("c", 1)], "path string, stamp int")
    assert {(r.path, r.change) for r in relational.manifest_diff(old, new).collect()} == {("a", "deleted"), ("b", "changed"), ("c", "added")}
    assert relational.clamp_limit(0) == 10 and relational.clamp_limit(1000) == 100
    ranked = spark.createDataFrame([(10, 1), (20, 2), (30, 3)], "id int, position int")
    token = relational.cursor("q", {}, 20)
    assert [r.id for r in relational.page(ranked, token, "q", {}, 5).collect()] == [30]
    assert [r.id for r in relational.page(ranked, token, "other", {}, 5).collect()] == [10, 20, 30]
    assert relational.page(ranked, relational.cursor("q", {}, 30), "q", {}, 5).count() == 0
    assert packs.canonical({"b": [1, None], "a": "ä"}) == '{"a":"ä","b":[1,null]}'


def test_lexical_phases(spark):
    docs = spark.createDataFrame([(1, "Auth flow", "uses jwt tokens for auth. Rotation of tokens is daily."), (2, "Cache", "the cache holds tokens"), (3, "Other", "nothing here")], "id long, title string, content string")
    index = lexical.build(docs, {"title": 1.0, "content": 2.0})
    q = spark.createDataFrame([(1, ["tokens", "auth"]), (2, ["nothing", "zzz"])], "qid int, terms array<string>")
    assert [(r.qid, r.id) for r in lexical.bm25(index, q).collect()] == [(1, 1)]
    assert {(r.qid, r.id) for r in lexical.relaxed(index, q, 5).collect()} == {(1, 1), (2, 3)}


def test_lookup(spark):
    from sparkmem.operators import lookup

    assert lookup.cover_density_of([[1, 9], [2, 5]]) == pytest.approx(1 / 2 + 1 / 5)
    assert lookup.cover_density_of([[1], []]) == 0
    a = spark.createDataFrame([(1,), (2,)], "id long")
    same = lookup.fingerprint(a).first().digest == lookup.fingerprint(a.orderBy(F.desc("id"))).first().digest
    assert same and lookup.fingerprint(a.where("id = 1")).first().digest != lookup.fingerprint(a).first().digest
