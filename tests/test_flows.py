"""Streams against batches, exchange round trips, and the façade."""

import json

import pytest
from pyspark.sql import functions as F

from sparkmem.plans import adaptive
from sparkmem.session import MemoryStore
from sparkmem.sources import adapters, io
from sparkmem.streaming import pipelines

SF = "/root/testdata/sf0.001"


def run(stream, sink, path, mode="append"):
    q = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{path}/c").option("path", sink).trigger(availableNow=True).start()
    q.awaitTermination()


def test_rolling_metrics(spark, tmp_path):
    m = adapters.metrics(spark, SF).repartition(1).sortWithinPartitions("timestamp")
    m.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(m.schema).parquet(f"{tmp_path}/in")
    run(pipelines.rolling_metrics(stream), f"{tmp_path}/out", tmp_path)
    got = {(r.start, r.operation_type): r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.start, r.operation_type): r.n for r in m.groupBy(F.window("timestamp", "1 hour").alias("w"), "operation_type").count().select(F.col("w.start").alias("start"), "operation_type", F.col("count").alias("n")).collect()}
    assert got and all(want[k] == n for k, n in got.items())
    assert len(want) - len(got) < 30  # what the watermark still holds


def test_reconcile(spark, tmp_path):
    path = f"{tmp_path}/store"
    sink = pipelines.reconcile(path, pipelines.facts_of)
    sink(spark.sql("SELECT 1L id, 'One. Two.' content, timestamp'2025-01-01' updated_at UNION ALL SELECT 2L, 'Three.', timestamp'2025-01-01'"), 0)
    sink(spark.sql("SELECT 1L id, 'Changed.' content, timestamp'2025-01-02' updated_at"), 1)
    assert {(r.id, r.fact) for r in pipelines.reconciled(spark, path).collect()} == {(1, "Changed."), (2, "Three.")}
    gone = spark.sql("SELECT 2L id, 'Three.' content, timestamp'2025-01-03' updated_at, timestamp'2025-01-03' deleted_at")
    sink(gone, 2)
    assert {(r.id, r.fact) for r in pipelines.reconciled(spark, path).collect()} == {(1, "Changed.")}


def test_leases(spark):
    rows = [(i, "pending", 0, 2, None, None) for i in range(3)] + [(3, "pending", 1, 2, "2025-01-02", None)]
    queue = spark.createDataFrame(rows, "id long, status string, attempts int, max_attempts int, retry string, lease string").select("id", "status", "attempts", "max_attempts", F.col("retry").cast("timestamp").alias("next_retry_at"), F.col("lease").cast("timestamp").alias("leased_at"))
    at = lambda x: F.lit(x).cast("timestamp")
    seen = lambda df: {r.id: (r.status, r.attempts) for r in df.collect()}
    one = pipelines.leased(queue, at("2025-01-01"), 10)
    assert seen(one) == {0: ("leased", 1), 1: ("leased", 1), 2: ("leased", 1), 3: ("pending", 1)}
    two = pipelines.finished(one, spark.createDataFrame([(0, True), (1, False), (3, False)], "id long, ok boolean"), at("2025-01-01"))
    assert seen(two) == {0: ("complete", 1), 1: ("pending", 1), 2: ("leased", 1), 3: ("pending", 1)}
    assert two.where("id = 1 AND next_retry_at > timestamp'2025-01-01'").count() == 1
    three = pipelines.leased(pipelines.recovered(two), at("2025-01-01"))
    assert seen(three) == {0: ("complete", 1), 1: ("pending", 1), 2: ("leased", 2), 3: ("pending", 1)}
    assert seen(pipelines.finished(three, spark.createDataFrame([(2, False)], "id long, ok boolean"), at("2025-01-01")))[2] == ("dead_letter", 2)


def test_deliveries(spark, tmp_path):
    rows = [(1, i, False) for i in range(6)] + [(2, 0, False), (2, 1, True), (3, 0, False)]
    df = spark.createDataFrame(rows, "id long, at int, ok boolean")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = pipelines.deliveries(stream).writeStream.outputMode("update").format("memory").queryName("deliveries").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination()
    assert {r.id: (r.status, r.attempts) for r in spark.sql("SELECT * FROM deliveries").collect()} == {1: ("dead", 5), 2: ("delivered", 2), 3: ("retry", 1)}


def test_deduplicated(spark, tmp_path):
    df = spark.sql("SELECT 'p' project, 's' scope, 'Same text' content, timestamp'2025-01-01 00:00:00' created_at UNION ALL SELECT 'p', 's', 'same  TEXT', timestamp'2025-01-01 00:05:00' UNION ALL SELECT 'p', 's', 'other', timestamp'2025-01-01 00:06:00'")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    run(pipelines.deduplicated(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/out", tmp_path)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_exchange(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (1500, "c")], "id long, t string")
    first = io.export_chunks(df, None, f"{tmp_path}/chunks").collect()
    assert sum(r.n for r in first) == 3 and len(first) == 2
    again = io.export_chunks(df, spark.createDataFrame(first).select("chunk"), f"{tmp_path}/chunks")
    assert again.count() == 0
    back = io.import_chunks(spark, f"{tmp_path}/chunks", "id long, t string")
    assert sorted((r.id, r.t) for r in back.collect()) == [(1, "a"), (2, "b"), (1500, "c")]
    io.export_archive({"x": df}, f"{tmp_path}/archive")
    assert io.restore_archive(spark, f"{tmp_path}/archive", {"x": "id long, t string"})["x"].count() == 3


def test_readers(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"sample_id": "s", "conversation": {"speaker_a": "A", "session_1": [{"speaker": "A", "dia_id": "D1", "text": "hi"}], "session_1_date_time": "now"}, "qa": [{"question": "?", "answer": 5, "evidence": ["D1"], "category": 2}]}]))
    turns, questions = io.dialogue_questions(spark, f"{tmp_path}/q.json")
    assert [(r.session, r.at, r.text) for r in turns.collect()] == [(1, "now", "hi")] and questions.first().answer == "5"
    (tmp_path / "tree/node_modules").mkdir(parents=True)
    (tmp_path / "tree/a.py").write_text("x = 1")
    (tmp_path / "tree/node_modules/b.py").write_text("x = 1")
    (tmp_path / "tree/c.txt").write_text("x")
    assert [r.language for r in io.source_tree(spark, f"{tmp_path}/tree").collect()] == ["python"]
    obs = adapters.observations(spark, SF).where("id < 3")
    edges = spark.createDataFrame([(0, 1, "follows")], "from_id long, to_id long, relation string")
    notes = io.vault_notes(obs, edges)
    assert notes.count() == 3 and "## Links" in notes.where("name = '0.md'").first().note
    assert io.vault_notes(obs, edges, notes.select("name", "hash")).count() == 0


@pytest.fixture(scope="module")
def store(spark):
    return MemoryStore(spark, adapters.observations(spark, SF), adapters.edges(spark, SF), adapters.importance(spark, SF), adapters.vectors(spark, SF), adapters.now())


def test_facade(store):
    found = store.search(["the thing of that", "de/src9", ""], limit=5).collect()
    assert {r.qid for r in found} == {0, 1} and all(r.position <= 5 for r in found)
    assert [r.id for r in store.get([3, 1, 3, 99999]).collect()] == [3, 1, 3]
    assert store.related(1, 1).count() > 0
    assert store.path(1, 1) == ("found", [1])
    assert store.delete([3]).where("deleted_at is not null AND id = 3").count() == 1
    merged, report = store.merge_projects(["src1", "nowhere"], "one", store.observations.limit(0))
    assert merged.where("project = 'src1'").count() == 0 and {r.source: r.matched for r in report.collect()} == {"src1": True, "nowhere": False}
    assert store.context_pack(100).count() > 0 and store.rules(project="src1").where("project != 'src1'").count() == 0
    files = store.spark.createDataFrame([("a.py", "python", "def f():\n    g()\n"), ("b.py", "python", "def g():\n    f()\n")], "path string, language string, content string")
    found = store.code(files, ["a.py"])
    assert found["report"].first().kind == "file" and found["cycles"].first().files == ["a.py", "b.py"]


def test_adaptive(spark, store):
    asked = adaptive.queries(spark.createDataFrame([(0, "the"), (1, "overview of the thing"), (2, "how that relates"), (3, "qqzz wwxx yyvv")], "qid long, text string"))
    assert {r.qid: r.tier for r in asked.collect()} == {1: "architectural_global", 2: "multi_hop_graph", 3: "semantic_hybrid"}
    hits = spark.createDataFrame([(1, 1, 0.5, 1), (2, 3, 0.9, 1), (2, 4, 0.4, 2)], "qid long, id long, score double, position int")
    nodes = spark.createDataFrame([("obs:3", "x", "k"), ("obs:4", "y", "k")], "id string, label string, kind string")
    edges = spark.createDataFrame([("obs:3", "obs:4", "uses", 1.0)], "source string, target string, type string, weight double")
    vectors = store.vectors.where("id < 20").select("id", "embedding")
    asked_vectors = asked.join(store.vectors.select(F.col("id").alias("qid"), F.col("embedding").alias("vector")), "qid").select("qid", "vector")
    got = adaptive.adaptive_search(hits, vectors, asked_vectors, store.observations, nodes, edges, asked).collect()
    assert {r.qid for r in got} == {1, 2}  # no passage bears an answer to the third
    assert adaptive.refined_text("a b", ["b c d"]) == "a b c d"
