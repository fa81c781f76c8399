"""Spelling variant groups against loops over all pairs."""

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sparkmem.llm.spelling import near_pairs, parity_mask, roots, spelling_groups, word_counts

SCHEMA = "doc_id long, text string"


def one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, every=31, factor=10):
    lower = {i: i + 32 for i in range(65, 91)}
    counts = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= factor * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def found(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed):
    draw = random.Random(seed)
    alphabet = "abcxÉ" + "éß÷"
    base = ["".join(draw.choice(alphabet) for _ in range(draw.randint(6, 9))) for _ in range(40)]
    rows = []
    for doc_id in range(250):
        words = []
        for _ in range(draw.randint(1, 12)):
            w = base[min(int(draw.expovariate(0.25)), 39)]
            if draw.random() < 0.2:
                at, kind = draw.randrange(len(w)), draw.random()
                w = w[:at] + ("" if kind < 0.3 else draw.choice(alphabet) + (w[at] if kind < 0.6 else "")) + w[at + 1 :]
            words.append(w.upper() if draw.random() < 0.1 and "ß" not in w and "é" not in w else w)
        rows.append((doc_id, draw.choice([" ", ", ", "_9"]).join(words)))
    want = brute(rows, every=5)
    assert sum(x[1] is not None for x in want) > 5 and sum(x[2] != x[1] and x[1] is not None for x in want) >= 0
    assert found(spelling_groups(spark.createDataFrame(rows, SCHEMA).repartition(3), every=5)) == want


def test_chain_of_forms_and_ties(spark):
    text = [("abcdefg", 2), ("abcdefgh", 25), ("abcdefghi", 400), ("zbcdefghi", 400), ("wwwwwww", 2), ("wwwwwwa", 30), ("wwwwwwb", 30)]
    rows = [(None, " ".join([w] * n)) for w, n in text]
    got = {r[0]: r[1:] for r in found(spelling_groups(spark.createDataFrame(rows, SCHEMA), every=0))}
    assert got["abcdefg"] == ("abcdefgh", "abcdefghi", 2, 1, 25)
    assert got["abcdefgh"] == ("abcdefghi", "abcdefghi", 25, 2, 400)
    assert got["abcdefghi"] == (None, "abcdefghi", 400, 2, None)  # its like is as frequent, not ten times as frequent
    assert got["wwwwwww"] == ("wwwwwwa", "wwwwwwa", 2, 2, 30)


def test_every_place_and_kind_of_edit(spark):
    word = "straßenbahnhöfe"
    edits = {word[:i] + x + word[j:] for i in range(len(word) + 1) for j in (i, i + 1) if j <= len(word) for x in ("", "q", "ÿ")} - {word}
    words = spark.createDataFrame([(w, 1) for w in edits | {word, word + "qq", "q" + word + "q"}], "word string, n long")
    assert {r["b"] if r["a"] == word else r["a"] for r in near_pairs(words).collect() if word in (r["a"], r["b"])} == edits


def test_mask_and_roots(spark):
    rows = spark.createDataFrame([("abcabca",), ("",)], "word string").select(parity_mask(F.col("word")).alias("m")).collect()
    assert rows[0]["m"] == 1 << (97 % 30)
    chain = spark.createDataFrame([(str(i), str(i + 1)) for i in range(11)], "word string, form string")
    assert {r["word"]: r["root"] for r in roots(chain).collect()} == {str(i): "11" for i in range(11)}


def test_odd_rows(spark):
    odd = [(1, None), (2, ""), (None, "Wiederholung wiederholung"), (3, "x" * 30000 + " " + "x" * 30000), (3, "x" * 30000), (3, "Kürze 1234567 ________")]
    df = spark.createDataFrame(odd, SCHEMA)
    assert found(spelling_groups(df, every=0)) == {("wiederholung", None, "wiederholung", 2, 0, None), ("x" * 30000, None, "x" * 30000, 3, 0, None)}
    clash = df.withColumns({"word": F.lit("a"), "n": F.lit(7), "key": F.lit(1), "root": F.lit(None)})
    assert found(spelling_groups(clash)) == brute(odd)
    assert spelling_groups(df.limit(0)).count() == 0 and word_counts(df.where("doc_id = 1")).count() == 0
