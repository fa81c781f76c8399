"""Line deduplication by pairwise alignment.

Lines are compared by a hash of their trimmed bytes. A line that several documents hold names partners: every
later holder is paired with the first one, and of a rare line also with the holder before it. Runs of short
lines name partners, too: the shortest run of at least ``min_words`` words from each line on, and the one up to
each line, is paired with its first holder. So every block that an earlier document has consists of runs that
some partner has whole, and there are at most four partners a line, whatever the size of a group. Each pair is
aligned by patience diff, and where no line is unique on both sides by a longest common subsequence; the lines of
every aligned common block of at least ``min_words`` words are deleted from the later document (larger id).
Alignments are made on the input, not on what other deletions leave.

Defined results: a null text stays null with no lines; blank lines are never compared and go only inside a
deleted block; rows with a null id are neither changed nor used; rows with equal ids don't reduce each other;
repeated rows give one result each; an empty table gives an empty result; further columns are kept, and where one
bears the name of an added column, the added one takes an underscore more.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import cut, free, mix, slices, texts_of

MIN_WORDS = 10
#: Holders up to which a line counts as rare.
RARE = 8
#: Columns that are added: lines, lines removed, runs of removed lines.
ADDED = ("_n_lines", "_n_removed", "_n_blocks")


def line_keys(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and word count of each line; blank lines have hash 0."""
    lines = [x.strip() for x in text.split(b"\n")]
    keys = np.array([int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True) or 1 if x else 0 for x in lines], np.int64)
    return keys, np.array([len(x.split()) for x in lines], np.int32)


#: Bits of the rows that an alignment of repeated lines holds at once.
ROW_BITS = 1 << 27
#: Odd multiplier of the polynomial hash of a run, and its inverse modulo 2 ** 64.
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)


def run_keys(keys: np.ndarray, words: np.ndarray, min_words: int) -> np.ndarray:
    """Hashes of the shortest runs of min_words words from each line on and up to each line, if of two lines or more; blank lines don't count."""
    real = np.flatnonzero(keys)
    n, least = len(real), max(min_words, 1)
    total = np.concatenate(([0], np.cumsum(words[real], dtype=np.int64)))
    ends = np.searchsorted(total, total[:-1] + least)
    starts = np.searchsorted(total, total[1:] - least, side="right") - 1
    lo = np.concatenate((np.arange(n), starts))
    hi = np.concatenate((ends, np.arange(1, n + 1)))
    ok = (lo >= 0) & (hi <= n) & (hi - lo > 1)
    lo, hi = lo[ok], hi[ok]
    powers = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, STEP, np.uint64))))
    back = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, BACK, np.uint64))))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(keys[real].view(np.uint64) * powers[:-1])))
    return np.unique(mix((sums[hi] - sums[lo]) * back[lo] ^ (hi - lo).astype(np.uint64)).view(np.int64))


def _anchors(a: list[int], b: list[int], alo: int, ahi: int, blo: int, bhi: int) -> list[tuple[int, int]]:
    """Lines that are unique in both ranges, as the longest chain that rises in both."""
    where_a: dict[int, int] = {}
    for i in range(alo, ahi):
        where_a[a[i]] = -1 if a[i] in where_a else i
    where_b: dict[int, int] = {}
    for j in range(blo, bhi):
        where_b[b[j]] = -1 if b[j] in where_b else j
    pairs = sorted((i, j) for x, i in where_a.items() if i >= 0 and x and (j := where_b.get(x, -1)) >= 0)
    tails: list[int] = []
    last: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        before[k] = last[at - 1] if at else -1
        tails[at : at + 1] = [j]
        last[at : at + 1] = [k]
    chain = []
    k = last[-1] if last else -1
    while k >= 0:
        chain.append(pairs[k])
        k = before[k]
    return chain[::-1]


def _rows(a: list[int], b: list[int]) -> list[int]:
    """After each line of a (and before the first) a number with bit j clear where the LCS grows by line j of b."""
    full, where = (1 << len(b)) - 1, {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    rows = [full]
    for x in a:
        v = rows[-1]
        u = v & where[x]
        rows.append(((v + u) | (v - u)) & full)
    return rows


def _last_row(a: list[int], b: list[int]) -> np.ndarray:
    """LCS lengths of a with each head of b."""
    full, where, v = (1 << len(b)) - 1, {}, (1 << len(b)) - 1
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _lcs(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """A longest common subsequence, by rows of bits; halved by Hirschberg's rule where the rows would take over ROW_BITS."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        both = set(a[alo:ahi]) & set(b[blo:bhi])
        ia, ib = [i for i in range(alo, ahi) if a[i] in both], [j for j in range(blo, bhi) if b[j] in both]
        xa, xb = [a[i] for i in ia], [b[j] for j in ib]
        if len(xa) > 1 and len(xa) * len(xb) > ROW_BITS:
            half = len(xa) // 2
            at = int((_last_row(xa[:half], xb) + _last_row(xa[half:][::-1], xb[::-1])[::-1]).argmax())
            mid = ib[at] if at < len(ib) else bhi
            todo += [(alo, ia[half], blo, mid), (ia[half], ahi, mid, bhi)]
            continue
        rows = _rows(xa, xb)
        i, j = len(xa), len(xb)
        while i and j:
            if rows[i] >> (j - 1) & 1:
                j -= 1
                continue
            i -= 1
            if not i or rows[i] >> (j - 1) & 1:
                j -= 1
                found.append((ia[i], ib[j]))
    return sorted(found)


def _slid(a: list[int], b: list[int], pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same number of pairs, where a whole block that can lie right before the next one, in both lists, is moved there."""
    done: list[tuple[int, int]] = []
    end = len(pairs)
    while end:
        start = end - 1
        while start and pairs[start - 1] == (pairs[start][0] - 1, pairs[start][1] - 1):
            start -= 1
        block, n = pairs[start:end], end - start
        if done:
            (i, j), (p, q) = done[-1], block[0]
            if a[i - n : i] == b[j - n : j] == a[p : p + n] and i - n >= p and j - n >= q:
                block = [(i - n + k, j - n + k) for k in range(n)]
        done += block[::-1]
        end = start
    return done[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned line numbers of two lists of line hashes."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            found.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            found.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            continue
        anchors = _anchors(a, b, alo, ahi, blo, bhi)
        if not anchors:  # no line is unique on both sides, so repeated ones are aligned
            part_a, part_b = a[alo:ahi], b[blo:bhi]
            found += [(alo + i, blo + j) for i, j in _slid(part_a, part_b, _lcs(part_a, part_b))]
            continue
        low_a, low_b = alo, blo
        for i, j in [*anchors, (ahi, bhi)]:
            todo.append((low_a, i, low_b, j))
            if i < ahi:
                found.append((i, j))
            low_a, low_b = i + 1, j + 1
    return sorted(found)


def common_blocks(own: np.ndarray, words: np.ndarray, other: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """Line ranges of own in aligned blocks of at least min_words words; blank lines don't part a block."""
    real, theirs = np.flatnonzero(own), np.flatnonzero(other)
    aligned = patience(own[real].tolist(), other[theirs].tolist())
    blocks: list[tuple[int, int]] = []
    at = 0
    while at < len(aligned):
        end = at + 1
        while end < len(aligned) and aligned[end] == (aligned[end - 1][0] + 1, aligned[end - 1][1] + 1):
            end += 1
        first, last = real[aligned[at][0]], real[aligned[end - 1][0]]
        if words[first : last + 1].sum() >= min_words:
            blocks.append((int(first), int(last) + 1))
        at = end
    return blocks


def remove(text: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The text without the line ranges, the number of lines removed and of maximal runs of them."""
    lines = text.split(b"\n")
    gone = np.zeros(len(lines), bool)
    for a, b in ranges:
        gone[a:b] = True
    starts = int((np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1).sum())
    return b"\n".join(x for x, g in zip(lines, gone, strict=True) if not g), int(gone.sum()), starts


def line_dedup(documents: DataFrame, *, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents' columns with the text reduced, and _n_lines, _n_removed, _n_blocks."""
    kind = documents.schema[id_col].dataType.simpleString()
    row = F.xxhash64(F.col(id_col), F.col(text_col).cast("string"))
    rows = documents.select(F.col(id_col).alias("doc_id"), row.alias("row"), F.col(text_col).cast("string").alias("text"))

    def hashes(batches):
        for batch in slices(batches):
            got = [line_keys(t) for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array([k.tolist() for k, _ in got], pa.list_(pa.int64())), pa.array([w.tolist() for _, w in got], pa.list_(pa.int32())), pa.array([run_keys(k, w, min_words).tolist() for k, w in got], pa.list_(pa.int64()))], names=["doc_id", "row", "keys", "words", "runs"])

    held = cut(rows.where("doc_id is not null and text is not null").mapInArrow(hashes, f"doc_id {kind}, row long, keys array<long>, words array<int>, runs array<long>"))
    lines = held.select("doc_id", "row", F.explode(F.array_distinct("keys")).alias("key"), F.lit(True).alias("line")).where("key != 0")
    lines = lines.unionByName(held.select("doc_id", "row", F.explode("runs").alias("key"), F.lit(False).alias("line")))
    first = cut(lines.groupBy("key").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("holders")).where("holders > 1"))
    shared = lines.join(first.hint("merge"), "key")
    pairs = shared.select("doc_id", "row", F.col("first.doc_id").alias("p_id"), F.col("first.row").alias("p_row"))
    order = Window.partitionBy("key").orderBy("doc_id", "row")
    near = shared.where(f"line and holders <= {RARE}").select("doc_id", "row", F.lag("doc_id").over(order).alias("p_id"), F.lag("row").over(order).alias("p_row"))
    pairs = pairs.unionByName(near).where("p_id < doc_id").select("row", "p_row").distinct()

    one = held.dropDuplicates(["row"])
    sides = pairs.join(one.select("row", "keys", "words").hint("merge"), "row").join(one.select(F.col("row").alias("p_row"), F.col("keys").alias("p_keys")).hint("merge"), "p_row").select("row", "keys", "words", "p_keys")

    def align(batches):
        for batch in slices(batches):
            at, lo, hi = [], [], []
            for row, keys, words, other in zip(*(batch.column(x).to_pylist() for x in ("row", "keys", "words", "p_keys")), strict=True):
                for a, b in common_blocks(np.array(keys, np.int64), np.array(words), np.array(other, np.int64), min_words):
                    at.append(row)
                    lo.append(a)
                    hi.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=["row", "lo", "hi"])

    ranges = cut(sides.mapInArrow(align, "row long, lo int, hi int").groupBy("row").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")))

    schema = documents.schema
    added = [free(x, schema.names) for x in ADDED]
    own_row, own_ranges = free("line_row", schema.names), free("line_ranges", schema.names)
    full = StructType([*schema.fields, *(StructField(x, LongType()) for x in added)])

    def reduce(batches):
        for batch in slices(batches):
            texts, found = batch.column(text_col).cast(pa.binary()).to_pylist(), batch.column(own_ranges).to_pylist()
            done = [(None, 0, 0) if t is None else (t, 0, 0) if not r else remove(t, [(x["lo"], x["hi"]) for x in r]) for t, r in zip(texts, found, strict=True)]
            n = [0 if t is None else t.count(b"\n") + 1 for t in texts]
            own = [pa.array([None if t is None else t.decode() for t, _, _ in done], pa.string()) if f.name == text_col else batch.column(f.name) for f in schema.fields]
            yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), pa.array([x for _, x, _ in done], pa.int64()), pa.array([x for _, _, x in done], pa.int64())], names=[*schema.names, *added])

    marked = documents.withColumn(own_row, row).join(ranges.withColumnsRenamed({"row": own_row, "ranges": own_ranges}).hint("merge"), own_row, "left").drop(own_row)
    return marked.mapInArrow(reduce, full)
