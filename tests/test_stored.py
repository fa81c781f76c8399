"""The stored index against a scan of everything: rows, blocks read, batches, merges and replays."""

import random

import pytest
from pyspark.sql import functions as F

from sparkmem.functions.text import stemmed
from sparkmem.operators import lexical
from sparkmem.operators.stored import StoredIndex, porter

ROW = "id long, title string, content string, type string, project string, scope string, topic_key string, updated_at long, deleted_at long"
WORDS = [f"w{i}" for i in range(300)]


def row(draw, i, stamp=0, deleted=None):
    text = lambda n: " ".join(WORDS[min(int(draw.expovariate(0.03)), 299)] for _ in range(draw.randrange(n)))
    return (i, text(6), text(40) or None, draw.choice(["bugfix", "decision"]), draw.choice(["p1", "w3", None]), "project", text(3), stamp, deleted)


@pytest.fixture(scope="module")
def queries(spark):
    asked = [(1, ["w0", "w1"]), (2, ["w3"]), (3, ["w2", "w30", "w5"]), (4, ["absent", "w0"]), (5, ["bugfix", "w9"]), (6, ["w55"]), (7, ["w1", "w1", "w4"]), (8, [])]
    return spark.createDataFrame(asked, "qid int, terms array<string>")


def rows(df):
    return sorted((r.qid, r.position, r.id, round(r.score, 8)) for r in df.collect())


def scanned(df, queries, k, all_terms=True):
    return rows(lexical.ranked(lexical.bm25(lexical.build(df), queries, all_terms=all_terms), k, F.round("score", 9).desc(), F.asc("id")))


def test_same_as_scan(spark, queries, tmp_path):
    draw = random.Random(1)
    data = [row(draw, i) for i in range(1500)]
    data += [(i + 5000, "w3 w3 w55 w30 w2 w5", "w3 w3 w3 w0 w1", "bugfix", "p1", "project", "w9", 0, None) for i in range(40)]  # they outdo the rest
    df = spark.createDataFrame(data, ROW)
    index = StoredIndex(spark, str(tmp_path), part_docs=32)
    index.apply(df, 0)
    for all_terms in (True, False):
        assert rows(index.search(queries, 10, all_terms=all_terms)) == scanned(df, queries, 10, all_terms)
    blocks = {r.qid: (r.blocks, r.read) for r in index.scored(queries, 10, all_terms=False)[1].collect()}
    assert all(r <= b for b, r in blocks.values()) and blocks[2][1] < blocks[2][0] / 4, blocks
    laid = spark.read.parquet(f"{tmp_path}/blocks/seg=0")
    assert index._blocks_of([0], ["w3", "w30"]).count() < laid.count() / 20
    assert rows(lexical.ranked(lexical.bm25(lexical.build(df, queries=queries), queries), 10, F.round("score", 9).desc(), F.asc("id"))) == scanned(df, queries, 10)
    plan = index._blocks_of([0], ["w3"])._jdf.queryExecution().toString()
    assert "folder" in plan.split("PartitionFilters: ")[1].split("]")[0] and "w3" in plan.split("PushedFilters: ")[1].split("]")[0]


def test_batches_equal_fresh_build(spark, queries, tmp_path):
    draw = random.Random(2)
    now, index = {}, StoredIndex(spark, str(tmp_path), part_docs=16, fan=3)
    for number in range(5):
        ids = draw.sample(range(200), 60) if number else range(150)
        batch = [row(draw, i, number * 10 + k, 1 if number and draw.random() < 0.3 else None) for k, i in enumerate(ids)]
        batch += [row(draw, batch[0][0], 99 * 100 + number)] if number == 3 else []  # the same id twice
        for r in sorted(batch, key=lambda r: r[7]):
            now[r[0]] = r
        index.apply(spark.createDataFrame(batch, ROW).repartition(2), number)
        index.apply(spark.createDataFrame([row(draw, 0, 10**6)], ROW), number)  # a replay changes nothing
        if number in (1, 4):
            live = spark.createDataFrame([r for r in now.values() if r[8] is None], ROW)
            assert rows(index.search(queries, 8)) == scanned(live, queries, 8)
    state = index.state()
    assert len(state["segments"]) < 5 and state["docs"] == sum(r[8] is None for r in now.values())
    before = rows(index.search(queries, 8, all_terms=False))
    index.vacuum()
    assert rows(index.search(queries, 8, all_terms=False)) == before == scanned(live, queries, 8, False)


def test_failed_batch_and_stream(spark, queries, tmp_path):
    draw = random.Random(3)
    schema = ROW
    parts = [[row(draw, i, n) for i in range(n * 20, n * 20 + 30)] for n in range(3)]
    for n, p in enumerate(parts):
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    index = StoredIndex(spark, f"{tmp_path}/index")
    spark.createDataFrame([(7,)], "id long").write.parquet(f"{tmp_path}/index/dead/seg=0")  # what a batch left that failed
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream.writeStream.foreachBatch(index.apply).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(200)
    latest = {}
    for p in parts:
        latest |= {r[0]: r for r in p}
    assert index.state()["batch"] == 2 and index.state()["docs"] == len(latest)


def test_stemmer_and_empty(spark, tmp_path):
    index = StoredIndex(spark, str(tmp_path), weights={"content": 1.0}, analyser=porter)
    asked = spark.createDataFrame([(1, ["running"])], "qid int, terms array<string>").withColumn("terms", stemmed("terms"))
    assert index.search(asked, 5).collect() == []
    index.apply(spark.createDataFrame([(1, "he runs"), (2, "a walk"), (3, None)], "id long, content string"), 0)
    assert [r.id for r in index.search(asked, 5).collect()] == [1]
    index.apply(spark.createDataFrame([], "id long, content string"), 1)
    assert [r.id for r in index.search(asked, 5).collect()] == [1]
