"""Searches without a stored index: only what is asked leaves the scan, and the lists are those of a full index."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkmem.functions import text
from sparkmem.operators import lexical

WORDS = ["memory", "graph", "index", "search", "error", "tool", "fix"]


@pytest.fixture(scope="module")
def rows(spark):
    said = lambda i: " ".join(WORDS[(i * k) % 7] for k in range(1, 3 + i % 5)) + (". Fixed the index! why" if i % 3 == 0 else "") + (" " + "graph memory " * 150 if i == 11 else "")
    data = [(i, f"title {WORDS[i % 7]}", said(i) if i % 13 else None) for i in range(-20, 40)]
    return spark.createDataFrame(data, "id long, title string, content string")


def found(hits):
    return sorted((r.qid, r.id, round(r.score, 9)) for r in hits.collect())


def test_scans_keep_asked_terms_alone(spark, rows):
    weights = {"title": 1.0, "content": 2.0}
    asked = spark.createDataFrame([(1, ["memory", "graph"]), (2, ["index", "nothing"]), (3, ["graph", "graph"])], "qid int, terms array<string>")
    whole, scanned = lexical.build(rows, weights), lexical.Scanned(rows, weights)
    own = scanned.of(asked)
    assert {r.term for r in own.postings.select("term").distinct().collect()} == {"memory", "graph", "index"}
    assert own.corpus.first() == whole.corpus.first() and own.corpus.first().docs == 60
    for every in (True, False):
        assert found(lexical.bm25(scanned, asked, all_terms=every)) == found(lexical.bm25(whole, asked, all_terms=every)) != []
    assert found(lexical.bm25(scanned, asked.limit(0))) == []
    first = lexical.with_feedback(scanned, rows, asked, 5)
    assert found(first) == found(lexical.with_feedback(whole, rows, asked, 5))


def test_scanned_sentences(spark, rows):
    asked = spark.createDataFrame([(1, "what is the graph memory"), (2, "fixed the index"), (3, "why")], "qid int, text string")
    got = found(lexical.fact_hits(*lexical.fact_index(rows, scanned=True), asked, 10))
    assert got == found(lexical.fact_hits(*lexical.fact_index(rows), asked, 10)) and {q for q, _, _ in got} == {1, 2}
    assert min(i for _, i, _ in got) < 0


def test_stems_of_distinct_words(spark):
    data = [(i, None if i % 9 == 4 else ["running", None, "flies", f"words{i % 3}"][: i % 5]) for i in range(300)]
    got = spark.createDataFrame(data, "id int, t array<string>").where("id != 7").select("id", text.stemmed("t").alias("s")).collect()
    want = {i: None if t is None else [w and text.stem_of(w) for w in t] for i, t in data}
    assert {r.id: r.s for r in got} == {i: s for i, s in want.items() if i != 7}
    calls = text.stem_of.cache_info().misses
    assert pd.Series([text.stem_of("running") for _ in range(5)]).nunique() == 1 and text.stem_of.cache_info().misses == calls
