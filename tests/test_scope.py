"""Known answers of scoped traversal, snapshots, code reports, profiles and vector indexes."""

import pytest
from pyspark.sql import functions as F

from sparkmem.functions import text
from sparkmem.interfaces import Capabilities, TableIndex, searched
from sparkmem.operators import code, lexical, packs, relational, temporal


def ts(x):
    return F.lit(x).cast("timestamp")


@pytest.fixture(scope="module")
def obs(spark):
    rows = [(1, "p", "t"), (2, "p", "t"), (3, "q", "t"), (4, "p", "u"), (5, "p", "t"), (6, "p", "t")]
    df = spark.createDataFrame(rows, "id long, project string, tenant string")
    return df.withColumn("created_at", ts("2024-01-01") + F.make_interval(days=F.col("id").cast("int"))).withColumn("deleted_at", F.when(F.col("id") == 5, ts("2024-05-01")))


@pytest.fixture(scope="module")
def facts(spark):
    rows = [(1, 1, 2, "current", None), (2, 2, 3, "current", None), (3, 2, 4, "current", None), (4, 2, 5, "current", None), (5, 5, 6, "current", None), (6, 1, 6, "superseded", "2024-03-01"), (7, 2, 1, "current", None)]
    df = spark.createDataFrame(rows, "id long, from_id long, to_id long, fact_state string, end string")
    return df.select("id", "from_id", "to_id", "fact_state", F.lit("contradicts").alias("relation"), ts("2024-02-01").alias("valid_from"), F.col("end").cast("timestamp").alias("valid_until"), F.col("end").cast("timestamp").alias("invalid_at"), ts("2024-02-01").alias("created_at"))


def near(df):
    return sorted((r.id, r.hop) for r in df.collect())


def test_scoped_related(spark, obs, facts):
    root = spark.createDataFrame([(1,)], "root long")
    assert near(temporal.scoped_related(facts, obs, root)) == [(2, 1)]
    # 5 is deleted: it is passed through, but not returned
    assert near(temporal.scoped_related(facts, obs, root, 3)) == [(2, 1), (3, 2), (4, 2), (6, 3)]
    assert near(temporal.scoped_related(facts, obs, root, 3, project="p", tenant="t")) == [(2, 1), (6, 3)]
    assert near(temporal.scoped_related(facts, obs, root, 1, at=ts("2024-02-15"))) == [(2, 1), (6, 1)]
    assert near(temporal.scoped_related(facts, obs, root, 1, at=ts("2024-01-15"))) == []
    assert near(temporal.scoped_related(facts, obs, root, 2, most=2)) == [(2, 1), (4, 2)]
    assert near(temporal.scoped_related(facts, obs, spark.createDataFrame([(77,)], "root long"), 3)) == []
    assert near(temporal.scoped_related(facts.limit(0), obs, root, 3)) == []


def test_known_at_a_time(facts):
    later = facts.withColumn("tx_from", ts("2024-02-10")).withColumn("tx_until", F.when(F.col("id") == 2, ts("2024-04-01")))
    assert temporal.usable(later, ts("2024-02-05")).count() == 0
    assert 2 not in {r.id for r in temporal.usable(later, ts("2024-04-01")).collect()}


def test_temporal_neighbours(spark, obs, facts):
    hits = spark.createDataFrame([(0, 1, 1), (0, 2, 9)], "qid long, id long, position int")
    at = lambda t: sorted(r.id for r in lexical.temporal_neighbours(hits, facts, obs, ts(t)).collect())
    assert at("2024-02-15") == [6]  # superseded later, but valid then; 2 is a hit itself
    assert at("2024-06-01") == []


def test_snapshots(spark, facts):
    taken = spark.sql("SELECT * FROM VALUES (1L, 'a', timestamp'2024-01-01', 7L), (2L, 'a', timestamp'2024-02-01', 8L), (3L, 'b', timestamp'2024-03-01', NULL) AS v(id, snapshot_key, timestamp, root_observation_id)")
    ids = lambda **x: [r.id for r in temporal.snapshots(taken, **x).collect()]
    assert ids() == [3, 2, 1] and ids(key="a") == [2, 1] and ids(root=8) == [2]
    assert ids(low=ts("2024-02-01"), high=ts("2024-03-01")) == [3, 2]
    assert temporal.contradictions_between(facts, ts("2024-02-01"), ts("2024-02-01")).count() == 7


def test_code_reports(spark):
    syms = spark.createDataFrame([("a1", "class", "Shop", "src/a.py", 1), ("a2", "function", "buy", "src/a.py", 5), ("b1", "function", "Pay", "src/b.py", 1), ("c1", "function", "test_buy", "tests/test_c.py", 1), ("d1", "function", "pay", "lib/d.py", 1)], "id string, kind string, name string, file string, line int")
    edges = spark.createDataFrame([("a2", "b1"), ("b1", "a2"), ("c1", "a2"), ("a1", "a2"), ("a2", "a1")], "source_id string, target_id string")
    wanted = spark.createDataFrame([("b.py",), ("src/b.py",), ("pay",), ("PAY",), ("B1",), ("nothing",), ("",)], "target string")
    got = {}
    for r in code.targets(syms, wanted).collect():
        got.setdefault((r.target, r.rule), set()).add(r.root)
    assert got == {("b.py", 1): {"b1"}, ("src/b.py", 0): {"b1"}, ("pay", 3): {"d1"}, ("PAY", 4): {"b1", "d1"}, ("B1", 4): {"b1"}}
    assert [(r.name, r.files) for r in code.cross_file_cycles(syms, edges).collect()] == [("buy -> Pay -> buy", ["src/a.py", "src/b.py"])]
    report = {r.target: tuple(r)[1:] for r in code.blast_report(syms, edges, wanted).collect()}
    assert report["b.py"] == ("file", 1, 3, 2, 60.0, 1)
    assert report["nothing"] == ("unknown", 0, 0, 0, 0.0, 0) == report[""]
    assert report["pay"] == ("symbol", 0, 0, 0, 0.0, 0)
    assert [r.file for r in code.impacted_tests(syms, edges, wanted.where("target = 'b.py'")).collect()] == ["tests/test_c.py"]
    assert code.list_symbols(syms, kind="function").count() == 4 and {r.kind: r.n for r in code.symbol_counts(syms).collect()} == {"class": 1, "function": 4}


@pytest.mark.parametrize(("path", "want"), [("a/x_test.go", True), ("test_x.py", True), ("x_test.py", True), ("a\\B.Spec.TSX", True), ("ShopTests.cs", True), ("shopTest.kt", True), ("a/tests/x/y.rs", True), ("tests/y.rs", False), ("contest.py", False), ("a/test.go", False), ("x_test.rb", False)])
def test_test_files(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(code.is_test_file(F.col("p"))).first()[0] is want


def test_profile(spark):
    rows = [(1, "p", None, "decision", "Use Spark", "\nBecause.\nMore.", "2024-01-01"), (2, "p", None, "decision", "Older", "", "2024-01-02"), (3, "p", None, "config", "Port", "x", "2024-01-03"), (4, "p", None, "manual", "Note", "x", "2024-01-04")]
    obs = spark.createDataFrame(rows, "id long, project string, tenant string, type string, title string, content string, at string").withColumn("created_at", F.col("at").cast("timestamp")).withColumn("deleted_at", F.lit(None).cast("timestamp"))
    scores = spark.createDataFrame([(1, 1.5)], "observation_id long, score double")
    got = packs.profile(obs, scores).first().profile
    assert got.startswith("# Project DNA: p\n\nAuto-generated from 4 observations.\n\n## Key Decisions\n\n- **Use Spark** (score: 1.5)\n")
    assert "- **Older** (score: 0.5)\n\n## Configuration & Stack\n\n- Port\n\n---\n\n**Stats:** 4 observations (config: 1, decision: 2, manual: 1)\n" in got


def test_tags_and_merges(spark):
    got = spark.createDataFrame([('["a","b"]',), ("",), (None,), ("{",)], "t string").select(relational.tags_of(F.col("t")).alias("t"))
    assert [r.t for r in got.collect()] == [["a", "b"], [], [], []]
    assert [r[0] for r in got.select(relational.tags_json(F.col("t"))).collect()] == ['["a","b"]', "", "", ""]
    o = spark.createDataFrame([(1, "Web"), (2, "web"), (3, "api"), (4, None)], "id long, project string")
    report = relational.merge_report(o, o.where("id = 1"), ["WEB", "web", "none", " "], " Main ")
    assert sorted(tuple(r) for r in report.collect()) == [("WEB", 2, 1, True), ("none", 0, 0, False)]
    assert sorted(r.project or "" for r in relational.merge_projects(o, ["WEB"], " Main ").collect()) == ["", "api", "main", "main"]
    with pytest.raises(ValueError):
        relational.merge_projects(o, ["WEB"], " ")


def test_counts(spark, obs, facts):
    s = spark.sql("SELECT * FROM VALUES (1L, timestamp'2024-01-01'), (2L, NULL) AS v(id, ended_at)")
    assert relational.store_counts(obs, s, facts).first().asDict() == {"observations": 5, "projects": 2, "sessions": 2, "active": 1, "ended": 1, "edges": 7}
    assert tuple(relational.index_coverage(obs.limit(0), s.select("id", F.lit("indexed").alias("state"))).first()) == (0, 0, 0, 0, 0.0)


def test_vector_index(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.9, 0.1], "b"), (3, [0.0, 1.0], "a")], "id long, embedding array<float>, kind string")
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "qid long, vector array<float>")
    index = TableIndex(points)
    ids = lambda x, **o: [r.id for r in searched(x, asked, 2, points, **o).orderBy("position").collect()]
    assert ids(index) == [1, 2] and ids(index, where=F.col("kind") == "a") == [1, 3]

    class Late(TableIndex):
        def search(self, queries, limit, *, threshold=None, where=None):
            assert where is None
            return super().search(queries, limit, threshold=threshold)

        def capabilities(self):
            return Capabilities("late", filters="post")

    assert ids(Late(points), where=F.col("kind") == "a") == [1, 3]
    assert ids(index.delete(points.where("id = 1").select("id"))) == [2, 3]
    assert ids(index.upsert(spark.createDataFrame([(3, [1.0, 0.0], "a")], points.schema))) == [1, 3]
    assert index.health() == ("healthy", "") and TableIndex(points.drop("embedding")).health()[0] == "unhealthy"


def test_stemmed_index(spark):
    rows = spark.createDataFrame([(1, "running engines"), (2, "other")], "id long, title string")
    stem = lambda x: text.stemmed(text.terms(x))
    index = lexical.build(rows, {"title": 1.0}, analyser=stem)
    asked = spark.createDataFrame([(0, "engine runs")], "qid long, text string").select("qid", stem(F.col("text")).alias("terms"))
    assert [r.id for r in lexical.bm25(index, asked).collect()] == [1]
