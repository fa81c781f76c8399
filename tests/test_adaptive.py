"""Tiers of adaptive search, sentence keys of units, relaxed tiers, synonyms and the second try, on small tables by hand."""

import random

import pytest
from pyspark.sql import functions as F

from sparkmem.functions.text import units_of
from sparkmem.operators import graph, lexical
from sparkmem.plans import adaptive


def unit(*x):
    return [float(v) for v in x]


@pytest.fixture(scope="module")
def obs(spark):
    rows = [
        (1, "Cache", "t/1", "The cache holds sessions. Nothing else.", "manual"), (2, "Limits", "t/2", "The retry limit is five. It never changes.", "decision"), (3, "Noise", "t/3", "zzz yyy.", "manual"),
        (4, "Gateway", "t/4", "The gateway calls billing.", "pattern"), (5, "Billing", "t/5", "billing depends on ledger.", "manual"),
    ]
    return spark.createDataFrame(rows, "id long, title string, topic_key string, content string, type string")


def search(spark, obs, texts, hits, dense=(), nodes=(), edges=(), limit=2, **options):
    asked = adaptive.queries(spark.createDataFrame(texts, "qid long, text string"))
    vectors = spark.createDataFrame([(i, unit(*(i == k for k in range(1, 6)))) for i in range(1, 6)], "id long, embedding array<float>")
    wanted = spark.createDataFrame(list(dense), "qid long, vector array<float>")
    lexical_hits = spark.createDataFrame(hits, "qid long, id long, score double, position int")
    nodes = spark.createDataFrame(list(nodes), "id string, label string, kind string")
    edges = spark.createDataFrame(list(edges), "source string, target string, type string, weight double")
    found = adaptive.adaptive_search(lexical_hits, vectors, wanted, obs, nodes, edges, asked, limit, **options)
    return {q: [(r.id, r.tier, r.confidence) for r in sorted(rows, key=lambda r: r.position)] for q, rows in _by(found.collect()).items()}


def _by(rows):
    out = {}
    for r in rows:
        out.setdefault(r.qid, []).append(r)
    return out


def test_tiers(spark, obs):
    texts = [(1, "getUser()"), (2, "overview of the modules"), (3, "retry limit value today"), (4, "the retry limit number"), (5, "would the retry limit be five")]
    hits = [(1, 1, 0.9, 1), (1, 2, 0.5, 2), (1, 3, 0.4, 3), (1, 4, 0.001, 2), *((2, i, 0.1, i) for i in range(1, 6)), (3, 5, 0.4, 1)]
    best = unit(0, 1, 0.2, 0, 0)
    got = search(spark, obs, texts, hits, [(q, best) for q in (3, 4, 5)])
    assert [x[0] for x in got[1]] == [1, 2] and got[1][0][1:] == ("direct_factual", "high")  # one below the floor goes
    assert [x[0] for x in got[2]] == [1, 2, 3, 4] and got[2][0][1:] == ("architectural_global", "high")  # twice the limit, patterns and decisions raised
    assert [x[0] for x in got[3]] == [5]  # it has a hit, so no dense list
    assert [x[0] for x in got[4]] == [2, 3] and 5 not in got  # a passage bears the answer; a speculative query has no fallback
    noise = search(spark, obs, [(4, "the retry limit number")], hits[:1], [(4, unit(0, 0, 1, 0, 0))], limit=1)
    assert noise == {}  # the nearest passage doesn't bear it


def test_multi_hop(spark, obs):
    nodes = [("4", "gateway", "k"), ("5", "billing", "k"), ("1", "cache", "k")]
    edges = [("4", "5", "calls", 1.0)]
    hits = [(1, 1, 0.030, 1), (1, 5, 0.029, 2)]
    plain = search(spark, obs, [(1, "how does the gateway relate")], hits, nodes=nodes, limit=5)
    led = search(spark, obs, [(1, "how does the gateway relate")], hits, nodes=nodes, edges=edges, limit=5)
    assert plain[1][0][0] == 1 and led[1][0][0] == 5  # the concept that the query names leads to 5
    dense = [(q, unit(0, 0, 0, 0.9, 1)) for q in (1, 2)]
    texts = [(1, "the retry gateway calls impact"), (2, "would the retry gateway calls impact")]
    both = search(spark, obs, texts, [(1, 3, 0.03, 1), (2, 3, 0.03, 1)], dense, limit=3)
    first = {q: [x[0] for x in rows if x[0] != 3][0] for q, rows in both.items()}
    assert first == {1: 4, 2: 5}  # the dense order is 5, 4; read as notes, 4 comes first, but a speculative query reads recognised hits only


def test_concepts(spark):
    nodes = spark.createDataFrame([("sym:a", "Gateway", "k"), ("billing", "x", "k"), ("n3", "no", "k")], "id string, label string, kind string")
    asked = spark.createDataFrame([(1, "the GATEWAY and Billing, no"), (2, "none")], "qid long, text string")
    assert {(r.qid, r.id, r.weight) for r in graph.concepts_named(asked, nodes).collect()} == {(1, "sym:a", 1.0), (1, "billing", 1.0)}


def test_facts_of_units(spark):
    draw = random.Random(4)
    texts = ["", None, "One. Two; three!\nfour", "é" * 1500, "word " * 700 + ". end", "x" * 3000, ("a b " * 200 + ".") * 3]
    texts += ["".join(draw.choice("ab é.;\n ") * draw.randrange(1, 90) for _ in range(60)) for _ in range(15)]
    got = {}
    for r in lexical.facts_of(spark.createDataFrame(list(enumerate(texts)), "id long, content string")).collect():
        got.setdefault(r.observation_id, {})[r.n] = r.fact
    for i, text in enumerate(texts):
        want = [" ".join(s.split(" ")) for u in units_of(text or "") for s in _sentences(u)]
        assert [got.get(i, {})[n] for n in sorted(got.get(i, {}))] == want, i


def _sentences(text):
    import re

    return [x for s in re.split(r"(?<=[.!?;\n])", text) if (x := re.sub(r"[ \t\n\x0b\f\r]+", " ", s).strip(" "))]


def test_question_words_dont_have_to_occur(spark):
    df = spark.createDataFrame([(1, "My dog is called Rex. He barks."), (2, "The dog sleeps.")], "id long, content string")
    index, owners = lexical.fact_index(df)
    asked = spark.createDataFrame([(1, "What is my dog called?"), (2, "what is it")], "qid int, text string")
    assert [(r.qid, r.id) for r in lexical.fact_hits(index, owners, asked, 5).collect()] == [(1, 1)]


def test_relaxed_tiers_and_synonyms(spark):
    df = spark.createDataFrame([(1, "the alpha of beta"), (2, "alpha beta"), (3, "gamma"), (4, "despliegue")], "id long, title string")
    asked = spark.createDataFrame([(1, "the alpha of beta"), (2, "is the beta an alpha"), (3, "is the gamma alpha in delta"), (4, "delta"), (5, "the of")], "qid int, text string")
    index = lexical.build(df, {"title": 1.0})
    assert {(r.qid, r.id, r.tier) for r in lexical.relaxed_tiers(index, asked, 5).collect()} == {(1, 1, 0), (2, 1, 1), (2, 2, 1), (3, 1, 2), (3, 2, 2), (3, 3, 2), (5, 1, 0)}
    lost = spark.createDataFrame([(1, "deploy qq"), (2, "deploy or qq"), (3, "gamma"), (4, '"deploy"')], "qid int, text string")
    hits = spark.createDataFrame([(3, 3, 1.0, 1)], "qid int, id long, score double, position int")
    assert {(r.qid, r.id) for r in lexical.with_synonyms(index, lost, hits, 5).collect()} == {(1, 4), (3, 3)}


def test_second_try_for_low_grades(spark):
    scores = {"weak": 0.1, "strong": 0.9, "weak more": 0.8}
    asked_with = []

    def find(asked):
        asked_with.append(sorted(r.text for r in asked.collect()))
        table = spark.createDataFrame(list(scores.items()), "text string, score double")
        return asked.join(table, "text").select("qid", F.col("qid").alias("id"), "score")

    first = adaptive.queries(spark.createDataFrame([(1, "weak"), (2, "strong")], "qid long, text string"))
    found = adaptive.with_retry(find, first, lambda q: q.select("qid", F.concat("text", F.lit(" more")).alias("text")))
    assert {(r.qid, r.score) for r in found.collect()} == {(1, 0.8), (2, 0.9)} and asked_with == [["strong", "weak"], ["weak more"]]
