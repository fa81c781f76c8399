"""Packing beside lexical neighbours: exact round trips, no padding, and likeness against packing by id."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkmem.llm.neighbourpack import Shard, Windows, Words, neighbour_pack, signatures

PATH = __import__("public_tokenizers").path("word_bpe_49k.json")
ODD = ["", " \n\t", "İstanbul ΣΑΣ ß Å ﬁ ½", "<|endoftext|> a<|startoftext|>b", "\x00 zero\x00 \x1c one", "don't we'll 12345", "漢字 かな é ́x", "x" * 30_000, "a b c\u0085d", "﻿|</w>|", "ǅ Ω K"]


@pytest.fixture(scope="module")
def model():
    return Tokenizer.from_file(PATH)


def ids_of(model, text):
    return [*model.encode(text or "", add_special_tokens=False).ids, 1]


def held(docs, df, model, size):
    """Checks pieces and sequences; returns the documents of each sequence."""
    whole = {}
    for i, t in docs:
        whole.setdefault(i, []).append(ids_of(model, t))
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in df.collect():
        parts[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, texts in whole.items():
        for r in parts[i]:
            fits = [x for x in texts if len(x) == r.doc_tokens and zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32]
            assert fits and r.length > 0
        for n in {len(x) for x in texts}:
            cover = np.zeros(n, int)
            for r in parts[i]:
                if r.doc_tokens == n:
                    cover[r.start : r.start + r.length] += 1
            assert (cover == sum(len(x) == n for x in texts)).all()
    assert set(parts) == set(whole)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size and at & (at - 1) == 0  # full, or a power of two: nothing is padded
    return [{r.doc_id for r in rows} for rows in sequences.values()], sequences


def test_words_equal_tokenizer(model):
    words = Words(PATH)
    draw = random.Random(3)
    texts = ODD + ["".join(draw.choice("abAB' .é<|>\n0İ́\x00Σ") for _ in range(draw.randrange(60))) for _ in range(300)] + ["".join(map(chr, range(a, a + 500))) for a in range(1, 12_000, 500)]
    for some in (texts, texts[::-1], texts[:1], [""]):
        assert [x.tolist() for x in words.of_texts([t.encode() for t in some], 1)] == [ids_of(model, t) for t in some]


@pytest.mark.parametrize("shard_tokens", [300, 1 << 20])
def test_round_trip(spark, model, shard_tokens):
    draw = random.Random(shard_tokens)
    docs = [(i, " ".join(draw.choice(["haus", "Zug", "tree", "of", "the", "ab7"]) for _ in range(draw.choice([1, 3, 30, 128, 700])))) for i in range(120)]
    docs += [(200 + i, t) for i, t in enumerate([None, *ODD])] + [docs[3], docs[3], (None, "no id"), (3, "another text")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"ids": F.lit("x"), "length": F.lit(3), "signature": F.lit(1), "sequence_id": F.lit(None)}).repartition(3)
    _, sequences = held(docs, neighbour_pack(df, PATH, size=128, shard_tokens=shard_tokens), model, 128)
    assert sum(sum(r.length for r in rows) == 128 for rows in sequences.values()) > 0.5 * len(sequences)
    assert neighbour_pack(df.limit(0), PATH).count() == 0


def test_neighbours_share_windows(spark, model):
    draw = random.Random(9)
    topics = [[f"{chr(97 + t)}{draw.randrange(10**4)}" for _ in range(40)] for t in range(12)]
    docs = [(i, " ".join(draw.choice(topics[i % 12]) for _ in range(25))) for i in range(480)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    windows, _ = held(docs, neighbour_pack(df, PATH, size=512), model, 512)
    alike = [sum(a % 12 == b % 12 for a in w for b in w if a < b) / max(1, len(w) * (len(w) - 1) // 2) for w in windows if len(w) > 2]
    assert np.mean(alike) > 0.6  # by id or at random it is a twelfth


def test_scores_by_loops():
    draw = np.random.default_rng(2)
    ids = [draw.integers(0, 30, int(draw.integers(1, 40))).astype("<u2") for _ in range(25)]
    weight = draw.random(30)
    shard = Shard(ids, weight, 17.0)
    for seed in ids[:5]:
        want = [sum(weight[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / 17.0)) for t in set(seed.tolist()) if (tf := x.tolist().count(t))) for x in ids]
        assert np.allclose(shard.scores(seed), want)
    again = signatures(ids, weight, draw.choice([-1.0, 1.0], (30, 8)))
    assert len(again) == 25 and again.min() >= 0 and again.max() < 256


def test_window_takes_best_unused_neighbours():
    word = lambda *x: np.array(x, "<u2")
    ids = [word(1, 2, 3), word(9, 9), word(1, 2, 3, 4), word(8, 8, 8), word(1, 2, 7, 7)]
    windows = Windows(8)
    windows.fill(Shard(ids, np.ones(10), 3.0), 0)
    # the seed, its best neighbour, then one id of the next best, whose rest seeds the next window
    assert windows.full == [[(0, 0, 3), (2, 0, 4), (4, 0, 1)], [(4, 1, 3), (1, 0, 2), (3, 0, 3)]]
    assert windows.open == [] == windows.tail()
    windows.put(7, 0, 7)
    assert windows.tail() == [[(7, 0, 4)], [(7, 4, 2)], [(7, 6, 1)]]
