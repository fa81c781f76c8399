"""Removal of byte substrings that an earlier document holds too, by suffix sorting in shards.

Every window of ``length`` bytes has an anchor: the k-byte piece in it whose hash is least. Windows with equal bytes
have equal anchors, so shards dealt by anchor see all copies of a window. First, anchors alone are dealt, as
arrays of hashes, to find those that several documents hold. Then the stretches of consecutive windows around
such anchors are dealt, each distinct stretch once from each batch of documents with the smallest id that has it.
Equal texts count as one with the smallest of their ids; the others lose all they have. A shard puts its stretches into suffix order (suffix.py); runs of windows whose common prefix reaches
the length are copies, and a window is removed wherever a smaller id holds a copy. What a batch can decide by
itself, it does, so a hot passage costs a shard one entry from each batch.

Defined results: a null text is empty; texts shorter than the length lose nothing; rows with a null id lose nothing
and remove nothing; rows with equal ids don't remove from each other; repeated rows give one result each; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, cut, forget, mix, runs, settle, slices, texts_of
from .suffix import suffix_order

LENGTH, ANCHOR = 50, 16
#: Anchors in one task's bucket, bytes of stretches in one task's shard.
BUCKET, SHARD_BYTES = 1_500_000, 3_000_000
#: Buckets at least: a row's anchors lie in up to so many, at every size.
LEAST_BUCKETS = 64
#: Bytes of text that a task reads before it deals out what it found.
GATHER = 24_000_000

_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def stretches(texts: list[bytes], length: int, k: int, cache: dict):
    """Document, first window and end window, and anchor hash, of each stretch of windows with one anchor."""
    sizes = np.array([len(t) for t in texts])
    buffer = np.frombuffer(b"".join(texts) + bytes(length), np.uint8)
    n = len(buffer)
    if len(cache.get("up", ())) < n:
        cache["up"], cache["down"] = _powers(n + (n >> 2))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((buffer + np.uint64(1)) * cache["up"][:n], dtype=np.uint64)))
    hashes = mix((sums[k:] - sums[:-k]) * cache["down"][: n - k + 1])
    wide, step = length - k + 1, 1
    low = (1 << max(wide - 1, 1).bit_length()) - 1  # the places of a window differ in these bits
    places = np.arange(len(hashes), dtype=np.uint64)
    least = (hashes & ~np.uint64(low)) | (places & np.uint64(low))
    while step < wide:  # least over wide places, by doubling
        hop = min(step, wide - step)
        least = np.minimum(least[:-hop], least[hop:])
        step += hop
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    doc_at = np.repeat(np.arange(len(texts)), np.maximum(sizes - length + 1, 0))
    where = np.arange(len(doc_at)) - np.repeat(np.cumsum(np.maximum(sizes - length + 1, 0)) - np.maximum(sizes - length + 1, 0), np.maximum(sizes - length + 1, 0)) + bounds[doc_at]
    anchor = where + (((least[where] & np.uint64(low)).astype(np.int64) - where) & low)
    change = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc_at[1:] != doc_at[:-1])))) if len(anchor) else np.zeros(0, np.int64)
    stop = np.append(change[1:], len(anchor))
    doc = doc_at[change]
    first = where[change] - bounds[doc]
    return doc, first, first + (stop - change), hashes[anchor[change]]


def _spread(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


_ANCHORS = pa.schema([("bucket", pa.int32()), ("shared", pa.bool_()), ("keys", pa.binary()), ("rows", pa.binary()), ("more", pa.binary())])
_SHARED = pa.schema([("row", pa.int64()), ("keys", pa.binary())])
_PIECES = pa.schema([("shard", pa.int32()), ("decided", pa.bool_()), ("bytes", pa.binary()), ("sizes", pa.binary()), ("refs", pa.binary()), ("ids", pa.binary()), ("rows", pa.binary()), ("firsts", pa.binary())])
_RANGES = pa.schema([("row", pa.int64()), ("ranges", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.bool_(): "boolean", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _gathered(batches, columns: tuple[str, ...], limit: int):
    """Texts with their other columns, as many as fill the limit."""
    held: list[list] = [[] for _ in range(len(columns) + 1)]
    size = 0
    for batch in slices(batches):
        texts = texts_of(batch, "text")
        own = [batch.column(c).to_pylist() for c in columns]
        for i, t in enumerate(texts):
            held[0].append(t)
            for k, values in enumerate(own):
                held[k + 1].append(values[i])
            size += len(t)
            if size >= limit:
                yield held
                held, size = [[] for _ in range(len(columns) + 1)], 0
    if held[0]:
        yield held


def _merged(lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Sorted ranges with overlaps and contacts joined, as rows of low and high."""
    order = np.argsort(lows, kind="stable")
    lows, highs = lows[order], np.maximum.accumulate(highs[order])
    fresh = np.concatenate(([True], lows[1:] > highs[:-1]))
    return np.stack((lows[fresh], highs[np.append(np.flatnonzero(fresh)[1:] - 1, len(lows) - 1)]), axis=1)


def _range_rows(rows: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(rows, kind="stable")
    rows, lows, highs = rows[order], lows[order], highs[order]
    kinds, begins = np.unique(rows, return_index=True)
    parts = [_merged(a, b).astype(np.int64).tobytes() for a, b in zip(np.split(lows, begins[1:]), np.split(highs, begins[1:]), strict=True)] if len(kinds) else []
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int64()), pa.array(parts, pa.binary())], schema=_RANGES)


def _parts(texts: list[bytes], most: int = 200_000):
    """Runs of texts whose arrays fit a processor's cache, as far as single texts do."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < most):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def _key_ids(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys >> np.uint64(32)) | (keys % np.uint64(buckets) << np.uint64(32))


def _by_row(rows: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(rows, kind="stable")
    kinds, begins = np.unique(rows[order], return_index=True)
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int64()), pa.array([x.tobytes() for x in np.split(keys[order], begins[1:])] if len(kinds) else [], pa.binary())], schema=_SHARED)


def _anchor_blobs(texts: list[bytes], row_ids: np.ndarray, buckets: int, length: int, k: int, cache: dict) -> list[dict]:
    """A batch's anchors by bucket; those that several of its rows hold are known to be shared and go on once."""
    keys, docs = [], []
    for at, end in _parts(texts):
        doc, _, _, key = stretches(texts[at:end], length, k, cache)
        keys.append(key)
        docs.append(doc + at)
    keys, rows = np.concatenate(keys), row_ids[np.concatenate(docs)]
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((rows, keys))
    keys, rows, bucket = keys[order], rows[order], bucket[order]
    fresh = np.concatenate(([True], (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])))
    keys, rows, bucket = keys[fresh], rows[fresh], bucket[fresh]
    begins = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    counts = np.diff(np.append(begins, len(keys)))
    several = np.repeat(counts > 1, counts)
    marks = begins[counts > 1]
    out = []
    if len(marks):
        out.append({"bucket": int(abs(int(rows[0])) % buckets), "shared": True, "keys": _key_ids(keys[several], buckets).tobytes(), "rows": rows[several].tobytes(), "more": b""})
    order = np.argsort(bucket[~several], kind="stable")
    single, own, where = keys[~several][order], rows[~several][order], bucket[~several][order]
    cuts = np.searchsorted(where, np.arange(buckets + 1))
    mark_order = np.argsort(bucket[marks], kind="stable")
    mark_keys, mark_where = keys[marks][mark_order], bucket[marks][mark_order]
    mark_cuts = np.searchsorted(mark_where, np.arange(buckets + 1))
    short = lambda x: (x >> np.uint64(32)).astype(np.uint32).tobytes()
    for b in range(buckets):
        x, y, u, v = cuts[b], cuts[b + 1], mark_cuts[b], mark_cuts[b + 1]
        if y > x or v > u:
            out.append({"bucket": b, "shared": False, "keys": short(single[x:y]), "rows": own[x:y].tobytes(), "more": short(mark_keys[u:v])})
    return out


def _shared_anchors(group: pa.Table) -> pa.Table:
    """Rows with the anchors of theirs that other rows hold too."""
    bucket = np.uint64(group.column("bucket")[0].as_py())
    keys, rows, more, known = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)], [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for shared, k, r, m in zip(*(group.column(c).to_pylist() for c in ("shared", "keys", "rows", "more")), strict=True):
        if shared:
            known.append((np.frombuffer(k, np.uint64), np.frombuffer(r, np.int64)))
        else:
            keys.append(np.frombuffer(k, np.uint32))
            rows.append(np.frombuffer(r, np.int64))
            more.append(np.frombuffer(m, np.uint32))
    keys, rows = np.concatenate(keys), np.concatenate(rows)
    order = np.lexsort((rows, keys))
    keys, rows = keys[order], rows[order]
    fresh = np.concatenate(([True], (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1]))) if len(keys) else np.zeros(0, bool)
    keys, rows = keys[fresh], rows[fresh]
    begins = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(begins, len(keys)))
    shared = np.repeat((counts > 1) | np.isin(keys[begins], np.concatenate(more)), counts) if len(keys) else np.zeros(0, bool)
    ids = keys[shared].astype(np.uint64) | (bucket << np.uint64(32))
    return pa.Table.from_batches([_by_row(np.concatenate([rows[shared], *(r for _, r in known)]), np.concatenate([ids, *(k for k, _ in known)]))])


def _pieces(texts, ids, rows, held, buckets, shards, length, k, cache) -> list[dict]:
    """The stretches of a batch with shared anchors, by shard; where another row of the batch with a smaller id has the same stretch, it is decided."""
    names: dict[bytes, int] = {}
    refs, where_doc, first_at, shard_of = [], [], [], []
    low: list[int] = []
    for at, end in _parts(texts):
        doc, first, stop, key = stretches(texts[at:end], length, k, cache)
        own, shard = _key_ids(key, buckets), (key % np.uint64(shards)).astype(np.int64)
        cuts = np.searchsorted(doc, np.arange(end - at + 1))
        for d in range(at, end):
            x, y = cuts[d - at], cuts[d - at + 1]
            pick = np.flatnonzero(np.isin(own[x:y], np.frombuffer(held[d], np.uint64))) + x
            text, id_ = texts[d], ids[d]
            for f, e in zip(first[pick].tolist(), stop[pick].tolist(), strict=True):
                ref = names.setdefault(text[f : e - 1 + length], len(names))
                if ref == len(low):
                    low.append(id_)
                elif id_ < low[ref]:
                    low[ref] = id_
                refs.append(ref)
            where_doc.append(np.full(len(pick), d))
            first_at.append(first[pick])
            shard_of.append(shard[pick])
    if not refs:
        return []
    refs, docs, firsts, shard = np.array(refs), np.concatenate(where_doc), np.concatenate(first_at), np.concatenate(shard_of)
    low, ids, rows = np.array(low), np.array(ids, np.int64), np.array(rows, np.int64)
    strings = list(names)
    sizes = np.array([len(x) for x in strings])
    done = ids[docs] > low[refs]
    out = []
    if done.any():
        out.append({"shard": int(refs[done][0] % shards), "decided": True, "bytes": b"", "sizes": b"", "refs": b"", "ids": firsts[done].astype(np.int64).tobytes(), "rows": rows[docs[done]].tobytes(), "firsts": (firsts[done] + sizes[refs[done]]).astype(np.int64).tobytes()})
    keep = np.flatnonzero(~done)
    keep = keep[np.lexsort((refs[keep], shard[keep]))]
    cuts = np.searchsorted(shard[keep], np.arange(shards + 1))
    for s in range(shards):
        own = keep[cuts[s] : cuts[s + 1]]
        if len(own):
            kinds, ref = np.unique(refs[own], return_inverse=True)
            out.append({"shard": s, "decided": False, "bytes": b"".join(strings[x] for x in kinds.tolist()), "sizes": sizes[kinds].astype(np.int32).tobytes(), "refs": ref.astype(np.int32).tobytes(), "ids": ids[docs[own]].tobytes(), "rows": rows[docs[own]].tobytes(), "firsts": firsts[own].astype(np.int64).tobytes()})
    return out


def copies(group: pa.Table, length: int) -> pa.Table:
    """The ranges of a shard's stretches that a smaller id holds too."""
    texts: dict[bytes, int] = {}
    none = np.zeros(0, np.int64)
    ids, rows, firsts, refs, decided = [none], [none], [none], [none], [(none, none, none)]
    for ready, raw, sizes, ref, i, r, f in zip(*(group.column(c).to_pylist() for c in ("decided", "bytes", "sizes", "refs", "ids", "rows", "firsts")), strict=True):
        i, r, f = np.frombuffer(i, np.int64), np.frombuffer(r, np.int64), np.frombuffer(f, np.int64)
        if ready:
            decided.append((r, i, f))
            continue
        at, own = 0, []
        for n in np.frombuffer(sizes, np.int32).tolist():
            own.append(texts.setdefault(raw[at : at + n], len(texts)))
            at += n
        refs.append(np.array(own, np.int64)[np.frombuffer(ref, np.int32)])
        ids.append(i)
        rows.append(r)
        firsts.append(f)
    known = tuple(np.concatenate(x) for x in zip(*decided, strict=True))
    if not texts:
        return pa.Table.from_batches([_range_rows(*known)])
    ids, rows, firsts, refs = (np.concatenate(x) for x in (ids, rows, firsts, refs))
    low = np.full(len(texts), np.iinfo(np.int64).max)
    np.minimum.at(low, refs, ids)
    sizes = np.array([len(t) for t in texts])
    text = np.concatenate((np.frombuffer(b"".join(t + b"\xff" for t in texts), np.uint8) + np.uint8(2), np.zeros(1, np.uint8)))
    order, lcp = suffix_order(text, length)
    begin = np.cumsum(sizes + 1) - sizes - 1
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    window = np.zeros(len(text), bool)
    offset = np.arange(len(owner)) - begin[owner]
    window[:-1] = offset + length <= sizes[owner]
    # A window's copies are the run of windows whose common prefixes reach the length; other suffixes in between take no part.
    group_of = np.cumsum(lcp < length)
    keep = window[order]
    order, group_of = order[keep], group_of[keep]
    smallest = np.full(len(text) + 1, np.iinfo(np.int64).max)
    np.minimum.at(smallest, group_of, low[owner[order]])
    least = np.full(len(text), np.iinfo(np.int64).max)
    least[order] = smallest[group_of]
    # The removed runs of all stretches at once: their windows side by side, each with a gap behind.
    counts = sizes[refs] - length + 1
    start = np.cumsum(counts + 1) - counts - 1
    each = np.repeat(np.arange(len(refs)), counts)
    inner = np.arange(len(each)) - np.repeat(np.cumsum(counts) - counts, counts)
    flat = np.zeros(int((counts + 1).sum()), bool)
    flat[start[each] + inner] = least[begin[refs[each]] + inner] < ids[each]
    a, b = runs(flat)
    of = np.searchsorted(start, a, side="right") - 1
    move = firsts[of] - start[of]
    return pa.Table.from_batches([_range_rows(np.concatenate((known[0], rows[of])), np.concatenate((known[1], a + move)), np.concatenate((known[2], b - 1 + length + move)))])


def remove_copies(documents: DataFrame, *, length: int = LENGTH, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept (the bytes that stay), spans (byte ranges removed)."""
    spark = documents.sparkSession
    least_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = documents.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = documents.select(F.col(id_col).alias("doc_id"), F.xxhash64(text, F.octet_length(text)).alias("row"), text.alias("text"))  # row: of the text alone
    whole = rows.where(f"doc_id is not null and octet_length(text) >= {length}")
    total = whole.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(least_parts, LEAST_BUCKETS, -(-2 * total // (length - anchor + 2) // BUCKET))

    def anchors(batches):
        cache: dict = {}
        for texts, ids in _gathered(batches, ("row",), GATHER):
            yield _spread(_anchor_blobs(texts, np.array(ids, np.int64), buckets, length, anchor, cache), _ANCHORS)

    dealt = whole.select("row", "text").mapInArrow(anchors, _ddl(_ANCHORS)).repartition(buckets, "bucket")
    shared = dealt.groupBy("bucket").applyInArrow(_shared_anchors, _ddl(_SHARED)).groupBy("row").agg(F.collect_list("keys").alias("keys"))
    firsts = cut(whole.groupBy("row").agg(F.min("doc_id").alias("first")))
    shared = cut(shared.join(firsts.hint("merge"), "row"))
    del dealt
    pieces = shared.agg(F.sum(F.expr("aggregate(keys, 0L, (s, k) -> s + length(k) div 8)"))).first()[0] or 0
    shards = max(least_parts, -(-pieces * (length + (length - anchor) // 2) // SHARD_BYTES))

    def stretched(batches):
        cache: dict = {}
        for texts, ids, own, keys in _gathered(batches, ("doc_id", "row", "keys"), GATHER // 2):
            if rows_out := _pieces(texts, ids, own, [b"".join(k) for k in keys], buckets, shards, length, anchor, cache):
                yield _spread(rows_out, _PIECES)

    held = whole.join(shared.hint("merge"), "row").where("doc_id = first").select("doc_id", "row", "text", "keys").mapInArrow(stretched, _ddl(_PIECES)).repartition(shards, "shard")
    ranges = held.groupBy("shard").applyInArrow(lambda g: copies(g, length), _ddl(_RANGES)).groupBy("row").agg(F.collect_list("ranges").alias("ranges"))
    ranges = cut(firsts.join(ranges.hint("merge"), "row", "left"))
    forget(shared, firsts)
    del held
    settle(spark)

    def close(batches):
        for batch in slices(batches):
            sizes, gone, spans, kept = [], [], [], []
            for t, found, copy in zip(texts_of(batch, "text"), batch.column("ranges").to_pylist(), batch.column("copy").to_pylist(), strict=True):
                both = np.frombuffer(b"".join(found or ()), np.int64).reshape(-1, 2)
                both = [[0, len(t)]] if copy else _merged(both[:, 0], both[:, 1]).tolist() if len(both) else []
                edges = [0, *(x for pair in both for x in pair), len(t)]
                sizes.append(len(t))
                gone.append(sum(b - a for a, b in both))
                spans.append([{"start": a, "stop": b} for a, b in both])
                kept.append(b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array([len(x) for x in spans], pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"],
            )

    closed = rows.join(ranges.hint("merge"), "row", "left").select("doc_id", "text", F.when(F.col("doc_id").isNotNull(), F.col("ranges")).alias("ranges"), F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("copy"))
    return closed.mapInArrow(close, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:long,stop:long>>").withColumnRenamed("doc_id", id_col)
