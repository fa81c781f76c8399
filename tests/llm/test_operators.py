"""The training-data operators against brute force, round trips and held-out accuracy, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkmem.llm import attention, htmltext, linededup, packing, suffix
from sparkmem.llm.decontaminate import decontaminate
from sparkmem.llm.langid import fit, predict, viterbi
from sparkmem.llm.linededup import line_dedup, patience, run_keys
from sparkmem.llm.lm import lm_scores
from sparkmem.llm.packing import pack
from sparkmem.llm.substrings import remove_copies, stretches
from sparkmem.llm.tokencount import count_tokens, document_tokens, file_blocks
from sparkmem.llm.topk import top_k

SF = "/root/testdata/sf0.001"
VOCABULARY = __import__("public_tokenizers").path("byte_bpe_50k.json")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def odd_rows():
    """Ids and texts: null, empty, blank, no letters, multi-byte, very long, ties and repeated rows."""
    rng = random.Random(5)
    line = lambda: " ".join(rng.choice(["der", "und", "the", "of", "haus", "house", "ä", "é", "Zug", "Test"]) + str(rng.randrange(50)) for _ in range(rng.randrange(3, 14)))
    shared = [line() for _ in range(6)]
    texts = [None, "", " \n\t", "12 34 --", "ß ä 漢字 かな", "a", "\x00 zero \x1c one", "<|endoftext|> and more"]
    for _ in range(30):
        own = [line() for _ in range(rng.randrange(1, 8))]
        at = rng.randrange(len(own) + 1)
        texts.append("\n".join(own[:at] + rng.sample(shared, rng.randrange(3)) + own[at:]))
    texts += [texts[12], texts[12], "\n".join(shared), "x" * 30_000, " ".join(["word"] * 20_000), "\n".join(shared[:3] + [""] + shared[3:])]
    rows = list(enumerate(texts))
    return rows + [rows[13], rows[20], (None, texts[15])]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 1, 2, "x", "y") for i, t in odd_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row long, score long, found string, carried0 string").repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def test_top_k(spark, empty):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.0, 0.7]) for _ in range(4)]) for i in range(600)] + [(600, None), (601, [1.0, None, 0.0, 0.0]), (602, [float("nan")] * 4), (None, [1.0] * 4), (603, [1.0, 2.0]), (650, [0.5, 0.5]), (604, [float("inf")] * 4)]
    df = spark.createDataFrame([(*r, "q") for r in rows], "vec_id long, embedding array<float>, id string")
    ok = {i: [math.floor(256 * x) for x in np.array(v, np.float32).astype(float)] for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v))}
    want = []
    for q in (i for i in ok if i % 50 == 0):
        s = sorted((-sum(a * b for a, b in zip(ok[q], v, strict=True)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:5]
        want += [(q, k + 1, i, -n) for k, (n, i) in enumerate(s)]
    got = sorted(map(tuple, top_k(df, F.col("vec_id") % 50 == 0).collect()))
    assert got == sorted(want)
    assert top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_suffix_order():
    for seed in range(60):
        rng = random.Random(seed)
        t = np.array([rng.randrange(1, rng.choice([2, 3, 5]) + 1) for _ in range(rng.randrange(1, 150))] + [0], np.uint8)
        depth = rng.choice([3, 9, 50])
        order, lcp = suffix.suffix_order(t, depth)
        raw = t.tobytes()
        heads = [raw[i : i + depth] for i in order]
        assert sorted(order.tolist()) == list(range(len(t))) and heads == sorted(heads)
        common = [next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b))) for a, b in zip(heads, heads[1:], strict=False)]
        assert lcp[1:].tolist() == common


def test_suffix_queue_spills(monkeypatch):
    monkeypatch.setattr(suffix, "SPILL_ROWS", 4)
    t = np.array([random.Random(3).randrange(1, 3) for _ in range(500)] + [0], np.uint8)
    order, _ = suffix.suffix_order(t, 20)
    heads = [t.tobytes()[i : i + 20] for i in order]
    assert heads == sorted(heads)


def brute_copies(rows, length):
    low = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for k in range(len(t) - length + 1):
            if i is not None:
                low[t[k : k + length]] = min(i, low.get(t[k : k + length], i))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if i is not None and low[t[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length", [50, 20])
def test_remove_copies(docs, empty, length):
    got = remove_copies(docs, length=length, anchor=10).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=str) == brute_copies(odd_rows(), length)
    assert remove_copies(empty).count() == 0


def test_long_text():
    """The anchors of a passage behind the first 64 MiB of a text are those of the passage alone."""
    rng = np.random.default_rng(1)
    passage = rng.integers(97, 123, 200).astype(np.uint8).tobytes()
    alone = set(stretches([passage], 50, 16, {})[3].tolist())
    doc, first, stop, keys = stretches([b"a line\n" * 9_600_000 + passage], 50, 16, {})
    assert len(alone) > 5 and alone <= set(keys[first > 64 << 20].tolist()) and (doc == 0).all() and (first[1:] == stop[:-1]).all()


def test_lm(docs, empty):
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    got = lm_scores(docs, learn, VOCABULARY, top_words=40).collect()
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))) for i, t in odd_rows()]
    counts = Counter()
    for i, w in words:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            counts.update([*w, "<end of text>"])
    total = sum(counts.values())
    below = total + 0.1 * (len(counts) + 1)
    want = sorted((str(i), len(w) + 1, sum(counts[x] > 0 for x in [*w, "<end of text>"]), total, round(sum(math.log10((counts[x] + 0.1) / below) for x in [*w, "<end of text>"]), 4)) for i, w in words)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm_scores(empty, learn, VOCABULARY).count() == 0


def brute_scores(table, counts, rows):
    """Log10 probabilities by loops over single positions, from the model's weights and the counts alone."""
    model, p = packing.encoder(VOCABULARY), {k: v.astype(float) for k, v in table.weights.items()}
    in_unit, out_unit, own = table.units
    kinds = Counter(int(out_unit[model.encode_ordinary(" " + w)[0]]) for w in counts)
    tokens = Counter()
    for w, c in counts.items():
        tokens[int(out_unit[model.encode_ordinary(" " + w)[0]])] += c
    end = 50256
    out = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
        ids, goals = [], []
        for w in words:
            goals.append((len(ids), w))
            ids += model.encode_ordinary(" " + w)
        goals.append((len(ids), None))
        ids.append(end)
        before = [end, *ids[:-1]]
        total = 0.0
        for at, w in goals:
            if at < 32:
                low = 0
            else:  # the first window that ends behind the position, moved back at the end of the text
                low = min(32 + 24 * (1 + (at - 32) // 24), len(ids)) - 32
            h = [p["embed"][in_unit[before[j]]] + p["own"][own[before[j]]] + p["place"][j - low] for j in range(low, at + 1)]
            a = np.array([(h[-1] @ p["q"]) @ (x @ p["k"]) / 4 for x in h])
            a = np.exp(a - a.max())
            z = sum(x * (y @ p["v"]) for x, y in zip(a / a.sum(), h, strict=True))
            logits = (h[-1] + z @ p["o"]) @ p["out"] + p["pair"][in_unit[before[at]]]
            unit = int(out_unit[ids[at]])
            total += (logits[unit] - logits.max() - math.log(np.exp(logits - logits.max()).sum())) / math.log(10)
            if w is not None:
                total += math.log10((counts[w] + 0.1) / (tokens[unit] + 0.1 * (kinds[unit] + 1)))
        out.append(total)
    return out


def test_lm_score(docs):
    from sparkmem.llm import lm

    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    table, counts = lm.fit(docs, learn, VOCABULARY, top_words=40)
    held = Counter({r.word: r.c for r in counts.collect()})
    rows = [r for r in odd_rows() if len(r[1] or "") < 5000]
    want = sorted((str(i), round(x, 2)) for (i, _), x in zip(rows, brute_scores(table, held, rows), strict=True))
    got = sorted((str(r.doc_id), round(r.score, 2)) for r in lm.score(docs, table, counts).collect())
    got = [x for x in got if x[0] in {str(i) for i, _ in rows}]
    assert [x for x, _ in got] == [x for x, _ in want]
    assert np.allclose([x for _, x in got], [x for _, x in want], atol=0.05, rtol=1e-4)


def test_lm_beats_base(spark):
    from sparkmem.llm.catalogue import op3_lm

    r = op3_lm(spark, SF).where("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base"), F.sum("n_tokens").alias("n")).first()
    assert r.score / r.n > r.base / r.n + 0.1


def test_attention_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) + 0.05 for k, v in attention.initial().items()}
    x, goal = (rng.integers(0, attention.UNITS, (3, attention.WINDOW)) for _ in range(2))
    own = rng.integers(0, 9, (3, attention.WINDOW))
    scored = (np.arange(attention.WINDOW)[None, :] >= np.array([[0], [8], [20]])) & (rng.random((3, attention.WINDOW)) < 0.7)

    def loss(p):
        top = (attention._forward(p, x, own)[6] @ p["out"] + p["pair"][x])[scored]
        top -= top.max(axis=1, keepdims=True)
        return -(top[np.arange(len(top)), goal[scored]] - np.log(np.exp(top).sum(axis=1))).mean()

    g = attention.gradients(p, x, own, goal, scored)
    for name in p:
        at = {"embed": (int(x[1, 9]), 3), "own": (int(own[own > 0][0]), 5), "pair": (int(x[scored][0]), 3)}.get(name) or tuple(rng.integers(0, n) for n in p[name].shape)
        up, down = ({**p, name: p[name].copy()} for _ in range(2))
        up[name][at] += 1e-5
        down[name][at] -= 1e-5
        assert g[name][at] == pytest.approx((loss(up) - loss(down)) / 2e-5, rel=1e-3, abs=1e-6)


def test_windows_score_once():
    bounds = np.array([0, 5, 5, 40, 200, 264])
    starts, shape = attention.windows(bounds)
    seen = Counter()
    for s, (size, fresh) in zip(starts.tolist(), shape.tolist(), strict=True):
        assert size <= attention.WINDOW
        seen.update(range(s + size - fresh, s + size))
    assert seen == Counter(range(264))


def test_causal():
    p = attention.initial()
    x = np.random.default_rng(0).integers(0, attention.UNITS, (1, attention.WINDOW))
    other = x.copy()
    other[0, 20:] = 1
    assert np.allclose(attention._forward(p, x, x)[6][0, :20], attention._forward(p, other, other)[6][0, :20])


def test_line_dedup(spark, docs, empty):
    a, b, c = "one two three four five six", "seven eight nine ten eleven", "alpha beta gamma delta epsilon"
    rows = [(1, f"{a}\n{b}\nown text of the first"), (2, f"fresh start here\n{a}\n\n{b}\nend"), (3, c), (4, f"{c}\n{c}"), (5, "short\nown"), (6, "short\nother")]
    got = {r.doc_id: (r.text, r._n_removed, r._n_blocks) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_words=5).collect()}
    assert got == {1: (rows[0][1], 0, 0), 2: ("fresh start here\nend", 3, 1), 3: (c, 0, 0), 4: (c, 1, 1), 5: (rows[4][1], 0, 0), 6: (rows[5][1], 0, 0)}
    out = line_dedup(docs)
    assert out.columns[: len(docs.columns)] == docs.columns and out.count() == docs.count()
    assert out.where("doc_id is null").first().text == odd_rows()[15][1]
    assert line_dedup(empty).count() == 0


def test_line_runs(spark):
    """A block of short lines, each of them first seen elsewhere and held by many."""
    block = [f"{x} two three four five six" for x in ("first", "second", "third")]
    rows = [(i, f"{block[i % 3]}\nown words of {i}") for i in range(30)]
    text = lambda i: f"head of {i}\n{block[0]}\n{block[1]}\n\n{block[2]}\ntail of {i}"
    rows += [(40, text(40)), *((i, f"{block[i % 3]}\nown words of {i}") for i in range(50, 80)), (90, text(90))]
    got = {r.doc_id: (r.text, r._n_removed) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (t, 0) for i, t in rows} | {90: ("head of 90\ntail of 90", 4)}


def test_run_keys():
    for seed in range(50):
        rng = np.random.default_rng(seed)
        words = rng.integers(1, 13, rng.integers(0, 20)).astype(np.int32)
        keys = np.append(rng.integers(-(1 << 63), 1 << 63, 5), 0)[rng.integers(0, 6, len(words))]
        words[keys == 0] = 0
        real, w = keys[keys != 0].tolist(), words[keys != 0].tolist()
        runs = {(a, b) for a in range(len(w)) for b in range(a + 2, len(w) + 1) if sum(w[a:b]) >= 10 and (sum(w[a : b - 1]) < 10 or sum(w[a + 1 : b]) < 10)}
        assert len(run_keys(keys, words, 10)) == len({tuple(real[a:b]) for a, b in runs})


def test_patience():
    assert patience([1, 2, 3, 4], [2, 9, 3, 4]) == [(1, 0), (2, 2), (3, 3)]
    assert patience([5, 5, 5], [5, 5]) == [(0, 0), (1, 1)]
    assert patience([], [1]) == []
    for seed in range(100):
        rng = random.Random(seed)
        a, b = ([rng.randrange(8) for _ in range(rng.randrange(15))] for _ in range(2))
        pairs = patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))


def test_repeated_lines(spark, monkeypatch):
    p = "\n".join(" ".join(f"{x}{k}" for k in range(27)) for x in ("left", "right"))
    rows = [(1, f"a\n{p}\nb"), (2, f"x\n{p}\ny\n{p}\nz")]
    got = {r.doc_id: r.text for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: f"x\ny\n{p}\nz"}  # one alignment takes one copy
    rows = [(1, f"a\n{p}\nb\n{p}\nc"), (2, f"x\n{p}\ny")]
    got = {r.doc_id: r.text for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "x\ny"}
    assert linededup._slid([1, 2, 3, 8, 1], [9, 1, 8, 1, 2, 3], [(0, 1), (1, 4), (2, 5)]) == [(0, 3), (1, 4), (2, 5)]
    for seed in range(300):
        rng = random.Random(seed)
        a, b = ([rng.randrange(rng.choice([2, 5])) for _ in range(rng.randrange(20))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        monkeypatch.setattr(linededup, "ROW_BITS", rng.choice([8, 1 << 27]))
        for pairs in (linededup._lcs(a, b), linededup._slid(a, b, linededup._lcs(a, b))):
            assert len(pairs) == table[-1][-1] and all(a[i] == b[j] for i, j in pairs)
            assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))


@pytest.mark.parametrize("limit", [1 << 20, 60])
def test_decontaminate(spark, docs, empty, limit):
    texts = dict(odd_rows()[:-1])
    items = [(1, " ".join(texts[13].split()[:14])), (2, "word word"), (10, "word"), (3, None), (4, "--"), (5, "ß ä"), (6, texts[41])]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    windows = {i: {tuple(w[k : k + 10]) for k in range(max(len(w) - 10, 0) + 1)} for i, t in items if (w := words(t))}
    want = []
    for d, t in odd_rows():
        w, hit, found = words(t), set(), set()
        for i, own in windows.items():
            for n in {len(x) for x in own}:
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) in own:
                        hit |= set(range(k, k + n))
                        found.add(str(i))
        want.append((d, len(w), len(hit), len(found), sorted(found), bool(hit)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(docs, bench, automaton_bytes=limit, carry=("score", "carried0")).collect()
    assert sorted(((r[0], r[1], r[2], r[3], list(r[4]), r[6]) for r in got), key=str) == sorted(want, key=str)
    assert {(r[7], r[8]) for r in got} == {(2, "y")}
    spans = next(r for r in got if r[0] == 13)[5]
    assert words(texts[13].encode()[spans[0].start : spans[0].stop].decode())[:14] == words(items[0][1])
    assert decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate(empty, bench).count() == 0


PAGE = '<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><div class="cookie-notice">We use cookies</div><header><a>Home</a></header><nav><ul><li>Menu<li>More</ul></nav>{body}<div id="comments"><p>nice post</p></div><aside>side</aside><form><input>go</form><footer>&copy; x</footer></body></html>'


def test_html(spark):
    body = lambda k: f'<article><header><h1>Head {k}</h1></header><p>Some &amp; text <b>bold\n  {k}</b><br>more<p>Second &#228; {k}<div class="ad-box">Buy now</div><ul><li>one<li>two {k}</ul></article>'
    plain = lambda k: f'<div class="content"><h2>Head {k}</h2><p>Body of page {k} with some words in it.</p></div>'
    rows = [(k, f"http://a.example/{k}", PAGE.format(body=body(k))) for k in range(6)] + [(100 + k, f"http://b.example/{k}", PAGE.format(body=plain(k))) for k in range(6)] + [(200, "http://c.example/", PAGE.format(body=body(200))), (300, None, None), (301, "x", ""), (302, "y", "bare < text"), (0, "http://a.example/0", PAGE.format(body=body(0)))]
    from sparkmem.llm.htmltext import main_text

    got = main_text(spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")).collect()
    want = lambda k: f"Head {k}\n\nSome & text bold {k} more\n\nSecond ä {k}\n\none\n\ntwo {k}"
    held = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert all(held[k] == want(k) for k in (*range(6), 200))
    assert all(held[100 + k] == f"Head {k}\n\nBody of page {k} with some words in it." for k in range(6))
    assert (held[300], held[301], held[302]) == ("", "", "bare < text")
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_marks():
    """An element that holds the article stays whatever its marks, and so do an article's own parts."""
    text = "A long enough sentence that stands for the article of this page and says nothing else."
    cases = [
        (f'<body class="nav"><div class="has-sidebar"><article><p>{text}</article></div></body>', text),
        (f'<div class="sidebar"><article><p>{text}</article></div><div class="sidebar">links</div>', text),
        (f'<div class="post widget"><div class="comments"><p>{text}</div></div><div class="comments">nice</div>', text),
        (f'<article><p>{text}<div class="search-history"><p>History of search</div><p class="notice">Mind the gap</article>', f"{text}\n\nHistory of search\n\nMind the gap"),
        (f'<div class="ad">{text} {text}</div><article><p>{text}</article>', text),
        (f'<article><p>{text}<p class="ad">Buy</p><div class="cookie-notice">ok?</div><div class="share-buttons">x</div></article>', text),
    ]
    for page, want in cases:
        assert htmltext.extract([htmltext.Page(page)]) == [want]


def test_html_nested_classes():
    """Rows of a menu and labels of repeated blocks go, without any marks, by the classes that nest in the template."""
    def page(k):
        menu = "".join(f"<li><a href=/{k}{j}>Link{k}x{j}</a></li>" for j in range(k + 2))
        blocks = "".join(f"<section><h4>Step</h4><p>Part {j} of page {k} tells its own story at some length, with words enough to be no label at all.</p></section>" for j in range(k % 3 + 1))
        return f"<html><body><div id=b><ul>{menu}</ul><h1>Title {k}</h1>{blocks}</div></body></html>"

    pages = [htmltext.Page(page(k)) for k in range(6)]
    template = htmltext.Template(pages)
    assert template.menus and {"<section>", "<h4>"} <= set(template.nested)
    for k, text in enumerate(htmltext.extract(pages)):
        assert text == "\n\n".join([f"Title {k}", *(f"Part {j} of page {k} tells its own story at some length, with words enough to be no label at all." for j in range(k % 3 + 1))])


def test_html_groups(spark):
    """Texts don't depend on the partitions; a host's last pages join the group before, and hosts with many pages are dealt in parts."""
    rows = [(k, f"http://{host}/{k}", f"<body><div><p>Some banner of {host}</p><p>Page {k} of {host} has a text of its own and no two are the same.</p></div></body>") for host, n in (("a", 65), ("b", 33), ("c", 300), ("d", 2)) for k in range(n)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    old, htmltext.PART_PAGES = htmltext.PART_PAGES, 100
    try:
        got = []
        for n in (2, 7):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(sorted(map(tuple, htmltext.main_text(pages.repartition(n)).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        htmltext.PART_PAGES = old
    assert got[0] == got[1] and len(got[0]) == len(rows)
    assert all(("banner" in text) == ("//d/" in url) for _, url, text, _ in got[0])


def test_template_classes():
    pages = [htmltext.Page(PAGE.format(body=f"<main><p>text {k}</p></main>" + "<i>x</i>" * k)) for k in range(1, 6)]
    found = htmltext.classes(pages)
    assert "<main>" in found[0] and found[0].index("<nav>") < found[0].index("<main>") < found[0].index("<footer>")
    assert any("<i>" in c and "</i>" in c for c in found[1:])


def test_tokens(spark, docs, empty, tmp_path):
    encode = packing.encoder(VOCABULARY).encode_ordinary
    want = Counter((i, len(encode(t or ""))) for i, t in odd_rows())
    for size in (1 << 20, 7):
        assert Counter(map(tuple, document_tokens(docs, VOCABULARY, block_tokens=size).collect())) == want
    assert document_tokens(empty, VOCABULARY).count() == 0
    ids = np.array([1, 2, 9, 9, 3, 9, 4, 5], "<u2")
    (tmp_path / "a.bin").write_bytes(ids.tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    for step in (1, 2, 3, 100):
        got = count_tokens(file_blocks(spark, str(tmp_path), block_tokens=step), end_id=9).orderBy("ordinal").collect()
        assert [(r.ordinal, r.start, r.n_tokens, r.closed) for r in got] == [(0, 0, 2, True), (1, 3, 0, True), (2, 4, 1, True), (3, 6, 2, False)]


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(VOCABULARY)
    got = pack(docs, VOCABULARY, size=128, rounds=20).collect()
    want = Counter()
    for i, t in odd_rows():
        ids = [*(tk.encode(t, add_special_tokens=False).ids if t else []), 0]
        first = len(ids) if len(ids) <= 128 else len(ids) % 128 or 128
        cuts = [0, *range(first, len(ids) + 1, 128)] if len(ids) > 128 else [0, len(ids)]
        want.update((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 128
    assert len(by) <= 1.05 * sum(r.length for r in got) / 128 + 1
    assert pack(empty, VOCABULARY).count() == 0


def test_language(spark, docs, empty):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = fit(d.where("doc_id % 4 != 2"))
    got = predict(d.drop("lang"), model).join(d.select("doc_id", "lang"), "doc_id").where("doc_id % 4 = 2").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) >= 0.95
    de, en = (d.where(f"lang = '{x}' AND n_chars > 800").orderBy("doc_id").first().text[:700] for x in ("de", "en"))
    mixed = predict(spark.createDataFrame([(1, de + "\n" + en)], "doc_id long, text string"), model).first()
    assert [s.lang for s in mixed.spans] == ["de", "en"] and 0.3 < mixed.score < 0.7
    odd = {r.doc_id: (r.lang_pred, r.score) for r in predict(docs, model).collect()}
    assert all(odd[k] == ("und", 0.0) for k in range(4)) and odd[4][0] in model.langs
    assert {r.lang_pred for r in predict(docs, fit(empty)).collect()} == {"und"}
    assert predict(empty, model).count() == 0


def test_viterbi():
    for seed in range(200):
        rng = np.random.default_rng(seed)
        s = rng.normal(size=(rng.integers(1, 7), 3)) * 5
        best = max(np.ndindex(*(3,) * len(s)), key=lambda p: sum(s[t, k] for t, k in enumerate(p)) - 4 * sum(a != b for a, b in zip(p, p[1:], strict=False)))
        value = lambda p: sum(s[t, k] for t, k in enumerate(p)) - 4 * sum(a != b for a, b in zip(p, p[1:], strict=False))
        assert value(viterbi(s, 4.0)) == pytest.approx(value(best))


def test_viterbi_without_the_best_sum():
    s = np.array([[0.0, -8.0, -3.5]] * 4 + [[-8.0, 0.0, -3.5]] * 4)
    assert viterbi(s, 20.0).tolist() == [0] * 4 + [1] * 4


def test_pipeline(spark, docs):
    import corpus_pipeline

    real = spark.read.parquet(f"{SF}/documents.parquet")
    kept, before = real, real.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == real.columns, name
    assert before * 0.8 <= kept.count() < before
    few = docs.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"), "score", "row", F.lit("a").alias("_N_removed"), F.lit("b").alias("line_row"), F.lit("c").alias("contaminated"), F.lit("d").alias("key"), F.lit("e").alias("component_id"))
    for frame in (few, few.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            before = frame
            frame = stage(spark, frame, SF)
            assert frame.schema.names == before.schema.names and frame.where("_N_removed <> 'a' or line_row <> 'b' or contaminated <> 'c' or key <> 'd' or component_id <> 'e'").isEmpty()
        corpus_pipeline.STAGES[-1][1](spark, frame, SF).collect()
