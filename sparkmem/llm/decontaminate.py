"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark items are normalised to words and cut into windows of ``n`` words; all windows go into one
automaton. Every document is normalised the same way and scanned once; matches are mapped back to word
numbers and to byte offsets of the original text.

Defined results: a null or wordless text has no words, no hits and is not contaminated; an item without
words has no window; repeated rows give one result each; an empty table gives an empty result; a null
item id counts as an item of its own, sorted as an empty string; further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import runs, slices, texts_of

WINDOW = 10
#: Bytes of benchmark text in one automaton; a larger benchmark is scanned in several passes.
AUTOMATON_BYTES = 32 << 20

_WORD = np.ones(256, bool)
_WORD[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if _WORD[c] else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words of a text with A-Z in lower case; every other ASCII character but digits separates."""
    return text.translate(_FOLD).split()


def windows_of(items: list[tuple[object, bytes]], n: int) -> dict[bytes, list[str]]:
    """Window text (with a space before and after) -> ids of the items that hold it."""
    found: dict[bytes, list[str]] = {}
    for item, text in items:
        words = words_of(text)
        for at in range(max(len(words) - n, 0) + 1 if words else 0):
            held = found.setdefault(b" %s " % b" ".join(words[at : at + n]), [])
            key = "" if item is None else str(item)
            if not held or held[-1] != key:
                held.append(key)
    return found


_built: dict[str, tuple] = {}


def _automaton(key: str, windows: dict[bytes, list[str]]):
    if key not in _built:
        _built.clear()
        machine = ahocorasick.Automaton()
        for window, items in windows.items():
            machine.add_word(window.decode("latin-1"), (window.count(b" ") - 1, items))
        machine.make_automaton()
        _built[key] = machine
    return _built[key]


def scan(text: bytes, machine) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words; word ranges of the windows that occur; items they belong to."""
    words = words_of(text)
    if not words or not len(machine):
        return len(words), [], set()
    joined = b" %s " % b" ".join(words)
    found = list(machine.iter(joined.decode("latin-1")))
    if not found:
        return len(words), [], set()
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    last = np.searchsorted(spaces, [end for end, _ in found])
    ranges = sorted({(int(stop) - size, int(stop)) for stop, (_, (size, _)) in zip(last, found, strict=True)})
    return len(words), ranges, {x for _, (_, items) in found for x in items}


def spans_in(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte ranges in the original text of the merged word ranges."""
    starts, ends = runs(_WORD[np.frombuffer(text, np.uint8)])
    merged: list[list[int]] = []
    for a, b in ranges:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [(int(starts[a]), int(ends[b - 1])) for a, b in merged]


_STATE = "doc_id {kind}, text string, ranges array<struct<a:int,b:int>>, items array<string>"
_RESULT = "doc_id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start:long,stop:long>>"


def _closed(batch: pa.RecordBatch, kept: list[str], texts: list[bytes], seen: list[tuple[int, list[tuple[int, int]], set[str]]]) -> pa.RecordBatch:
    hits, spans = [], []
    for text, (_, ranges, _) in zip(texts, seen, strict=True):
        reach, n_hit = 0, 0
        for a, b in ranges:
            n_hit += max(0, b - max(a, reach))
            reach = max(reach, b)
        hits.append(n_hit)
        spans.append([{"start": a, "stop": b} for a, b in spans_in(text, ranges)] if ranges else [])
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array([c for c, _, _ in seen], pa.int64()), pa.array(hits, pa.int64()), pa.array([sorted(i) for _, _, i in seen], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), *(batch.column(x) for x in kept)],
        names=["doc_id", "n_words", "n_hit", "items", "spans", *kept],
    )


def _groups(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[list[tuple[object, bytes]]]:
    rows = benchmark.select(item_col, F.col(text_col).cast("string")).where(F.col(text_col).isNotNull())
    held, size = [], 0
    for item, text in rows.toLocalIterator(prefetchPartitions=False):
        raw = text.encode()
        if held and size + len(raw) > limit:
            yield held
            held, size = [], 0
        held.append((item, raw))
        size += len(raw)
    yield held


def decontaminate(
    documents: DataFrame, benchmark: DataFrame, *, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", automaton_bytes: int = AUTOMATON_BYTES, carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items (sorted), spans (byte ranges in the text), contaminated; then the columns to carry."""
    spark = documents.sparkSession
    kind = documents.schema[id_col].dataType.simpleString()
    kept = [f"carried{i}" for i in range(len(carry))]
    more = "".join(f", {y} {documents.schema[x].dataType.simpleString()}" for x, y in zip(carry, kept, strict=True))
    state = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(x).alias(y) for x, y in zip(carry, kept, strict=True)))
    first, groups = True, _groups(benchmark, item_col, item_text_col, automaton_bytes)
    group = next(groups)
    while group is not None:
        following = next(groups, None)
        windows = windows_of(group, n)
        sent = spark.sparkContext.broadcast(windows)
        key = uuid.uuid4().hex

        def passes(batches, sent=sent, key=key, first=first, last=following is None):
            machine = _automaton(key, sent.value)
            for batch in slices(batches):
                texts = texts_of(batch, "text")
                seen = [scan(t, machine) for t in texts]
                if not first:
                    had = zip(batch.column("ranges").to_pylist(), batch.column("items").to_pylist(), strict=True)
                    seen = [(c, sorted({*r, *((x["a"], x["b"]) for x in p)}), i.union(h)) for (c, r, i), (p, h) in zip(seen, had, strict=True)]
                if last:
                    yield _closed(batch, kept, texts, seen)
                else:
                    ranges = pa.array([[{"a": a, "b": b} for a, b in r] for _, r, _ in seen], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), ranges, pa.array([sorted(i) for _, _, i in seen], pa.list_(pa.string())), *(batch.column(x) for x in kept)], names=["doc_id", "text", "ranges", "items", *kept])

        state = state.mapInArrow(passes, (_STATE if following is not None else _RESULT).format(kind=kind) + more)
        first, group = False, following
    return state.select(
        F.col("doc_id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "spans", (F.col("n_hit") > 0).alias("contaminated"),
        *(F.col(y).alias(x) for x, y in zip(carry, kept, strict=True)),
    )
