"""Ranked lexical search over a bit-sliced impact index.

The index is a table of segments, each of at most BLOCK_DOCS consecutive documents of one task: the segment's terms, their
postings (places and occurrences) and the documents' lengths. Building it shuffles nothing. A search turns each asked
term's impacts in a segment into bit slices: bitmap b has the documents whose impact has bit b. The slices of a query's
terms are added for all documents at once by carry-save and ripple-carry arithmetic on the bitmaps; the best documents
are found from the most significant slice of the sums downwards: a slice that leaves enough documents keeps only
those, one that leaves too few takes them and goes on among the rest. What is left at the end has equal scores, and
the smallest ids are taken.

Counts of the corpus are sums over all segments. Queries go to the executors in groups of at most SENT_BYTES, one after the
other, so that a broadcast never grows with their number. Each task keeps the best of what it has seen for each query.

Defined results: a null text has no terms and is never found; a query without terms, or whose terms no document has,
gives no rows; repeated rows of documents are found each, repeated queries are answered each; documents with a null id
come behind all others of equal score; empty tables give an empty result; further columns are ignored, whatever their
names.
"""

from __future__ import annotations

import math
from collections import Counter, OrderedDict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lower_ascii, runs, slices, spans, texts_of

#: Documents of a segment: their places fit 16 bits.
BLOCK_DOCS = 1 << 14
#: Postings from which a segment is closed early, and bytes of text that are analysed at once.
BLOCK_POSTINGS, TEXT_BYTES = 3_000_000, 4 << 20
#: Bytes of queries that are sent at once.
SENT_BYTES = 8 << 20
#: Slices of asked terms that a task holds, in bytes.
HELD_BYTES = 96 << 20
#: Impacts: scale, saturation, and the document's length in hundredths.
SCALE, SATURATION, LENGTH_PART, LENGTH_FACTOR = 1_000_000_000, 1000, 25, 12

_TERM = np.ones(256, bool)
_TERM[:128] = [chr(c).isalnum() for c in range(128)]
_LAST = np.iinfo(np.int64).max


def terms_of(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """The place of its text for each term, in order, and the terms: runs of ASCII letters, digits and all other characters."""
    joined = lower_ascii(b"\n".join(texts))
    starts, ends = runs(_TERM[np.frombuffer(joined, np.uint8)]) if joined else (np.zeros(0, np.int64),) * 2
    after = np.cumsum([len(t) + 1 for t in texts])
    return np.searchsorted(after, starts, side="right"), spans(joined, starts, ends)


class Segment:
    """Documents in the making of a segment."""

    def __init__(self) -> None:
        self.ids: list = []
        self.lengths: list[np.ndarray] = []
        self.parts: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []
        self.postings = 0

    def add(self, ids: list, texts: list[bytes]) -> None:
        where, terms = terms_of(texts)
        self.lengths.append(np.bincount(where, minlength=len(texts)))
        if len(where):
            coded = terms.dictionary_encode()
            size = len(coded.dictionary)
            held, counts = np.unique(where * size + coded.indices.to_numpy(), return_counts=True)
            self.parts.append((coded.dictionary, held % size, held // size + len(self.ids), counts))
            self.postings += len(held)
        self.ids += ids

    def row(self) -> tuple:
        """ids, lengths, documents with terms, terms; then offsets and bytes of the distinct terms, documents of each, places and occurrences."""
        lengths = np.concatenate(self.lengths)
        if not self.parts:
            return self.ids, lengths, 0, 0, *([b""] * 5)
        coded = pa.concat_arrays([p[0] for p in self.parts]).dictionary_encode()
        at = np.cumsum([0, *(len(p[0]) for p in self.parts)])
        code = coded.indices.to_numpy()
        term = np.concatenate([code[at[k] + p[1]] for k, p in enumerate(self.parts)])
        doc, count = (np.concatenate([p[k] for p in self.parts]) for k in (2, 3))
        order = np.lexsort((doc, term))
        sizes = pc.binary_length(coded.dictionary).to_numpy()
        return (
            self.ids, lengths, int((lengths > 0).sum()), int(lengths.sum()), np.concatenate(([0], np.cumsum(sizes))).astype("<i8").tobytes(), b"".join(coded.dictionary.to_pylist()),
            np.bincount(term, minlength=len(sizes)).astype("<i4").tobytes(), doc[order].astype("<u2").tobytes(), count[order].astype("<u4").tobytes(),
        )


_SEGMENT = "segment long, doc_ids array<long>, lengths array<long>, n_docs long, n_terms long, offsets binary, terms binary, held binary, places binary, counts binary"
_TYPES = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), *([pa.binary()] * 5)]


def index(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Segments of the documents, to be written and kept."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, now = TaskContext.get().partitionId() << 32, Segment()

        def close() -> pa.RecordBatch:
            row = (number, *now.row())
            return pa.RecordBatch.from_arrays([pa.array([x.tolist() if isinstance(x, np.ndarray) else x], t) for x, t in zip(row, _TYPES, strict=True)], names=[x.split()[0] for x in _SEGMENT.split(", ")])

        for batch in slices(batches, 256):
            ids, texts = batch.column("doc_id").to_pylist(), texts_of(batch, "text")
            at = 0
            while at < len(ids):
                size, stop = 0, at
                while stop < len(ids) and size < TEXT_BYTES and stop - at < block_docs - len(now.ids):
                    size += len(texts[stop])
                    stop += 1
                now.add(ids[at:stop], texts[at:stop])
                at = stop
                if len(now.ids) >= block_docs or now.postings >= BLOCK_POSTINGS:
                    yield close()
                    number, now = number + 1, Segment()
        if now.ids:
            yield close()

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(build, _SEGMENT)


def segment_terms(offsets: bytes, terms: bytes) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), max(len(offsets) // 8 - 1, 0), [None, pa.py_buffer(offsets), pa.py_buffer(terms)])


def to_slices(places: np.ndarray, values: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps by bit of the values (0 or more) that the places have: row b, bit p is bit b of p's value."""
    bits = max(int(values.max()).bit_length(), 1)
    if len(places) < 64 * words // 8:
        out = np.zeros((bits, words), np.uint64)
        at = (values[None, :] >> np.arange(bits)[:, None]) & 1
        row, col = np.nonzero(at)
        np.bitwise_or.at(out, (row, places[col] >> 6), np.uint64(1) << (places[col] & 63).astype(np.uint64))
        return out
    full = np.zeros(64 * words, np.int64)
    full[places] = values
    return np.stack([np.packbits(((full >> b) & 1).astype(bool), bitorder="little").view(np.uint64) for b in range(bits)])


def add_slices(terms: Iterable[tuple[np.ndarray, int]], bits: int, words: int) -> np.ndarray:
    """Slices of the sums of terms' slices, each taken a number of times: carries are saved till the end, then rippled."""
    total, carry = np.zeros((bits, words), np.uint64), np.zeros((bits, words), np.uint64)
    for rows, times in terms:
        for shift in range(times.bit_length()):
            if times >> shift & 1:
                more = np.zeros((bits, words), np.uint64)
                more[shift : shift + len(rows)] = rows
                odd = total ^ carry
                held = (total & carry) | (odd & more)
                total = odd ^ more
                carry[1:] = held[:-1]
                carry[0] = 0
    over = np.zeros(words, np.uint64)
    for b in range(bits):
        odd = total[b] ^ carry[b]
        total[b], over = odd ^ over, (total[b] & carry[b]) | (odd & over)
    return total


def places_of(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def top_slices(total: np.ndarray, k: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best above 0 (ties: smaller ids), from the most significant slice downwards."""
    sure = np.zeros_like(total[0])
    among = np.bitwise_or.reduce(total, axis=0)
    count = lambda x: int(np.bitwise_count(x).sum())
    found = 0
    if count(among) > k:
        for row in total[::-1]:
            high = among & row
            n = count(high)
            if found + n > k:
                among = high
            else:
                sure |= high
                found += n
                among &= ~row
            if found == k:
                break
    best, ties = places_of(sure), places_of(among)
    ties = ties[np.argsort(ids[ties], kind="stable")[: k - found]] if found < k else ties[:0]
    best = np.concatenate((best, ties))
    score = np.zeros(len(best), np.int64)
    for b, row in enumerate(total):
        score |= ((row[best >> 6] >> (best & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << b
    order = np.lexsort((ids[best], -score))
    return best[order], score[order]


def analysed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries' ids with their distinct terms and how often each occurs; those without terms go."""
    for batch in slices(batches, 256):
        where, terms = terms_of(texts_of(batch, "text"))
        rows = [Counter() for _ in range(batch.num_rows)]
        for at, term in zip(where.tolist(), terms.to_pylist(), strict=True):
            rows[at][term] += 1
        kept = [k for k, row in enumerate(rows) if row]
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(kept, pa.int64())), pa.array([list(rows[k]) for k in kept], pa.list_(pa.binary())), pa.array([list(rows[k].values()) for k in kept], pa.list_(pa.int64()))], names=["id", "terms", "times"])


def groups(queries: DataFrame, size: int) -> Iterator[list]:
    """Analysed queries in groups of about size bytes, one partition in the driver at a time."""
    held, room = [], size
    for row in queries.toLocalIterator():
        held.append(row)
        room -= sum(map(len, row["terms"])) + 16 * len(row["terms"]) + 64
        if room < 0:
            yield held
            held, room = [], size
    if held:
        yield held


def document_counts(segments: DataFrame, asked: list[bytes]) -> np.ndarray:
    """How many documents hold each asked term."""
    sent = segments.sparkSession.sparkContext.broadcast(asked)

    def count(batches):
        total = np.zeros(len(sent.value), np.int64)
        wanted = pa.array(sent.value, pa.large_binary())
        for batch in slices(batches, 1):
            offsets, terms, held = (batch.column(x)[0].as_py() for x in ("offsets", "terms", "held"))
            at = pc.index_in(wanted, value_set=segment_terms(offsets, terms)).fill_null(-1).to_numpy()
            total[at >= 0] += np.frombuffer(held, "<i4")[at[at >= 0]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["term", "n"])

    out = np.zeros(len(asked), np.int64)
    for row in segments.select("offsets", "terms", "held").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row["term"]] = row["n"]
    sent.unpersist()
    return out


class Scorer:
    """Slices of asked terms' impacts in one segment, and queries' best documents by them."""

    def __init__(self, row: dict, asked: pa.Array, weights: np.ndarray, corpus: tuple[int, int]):
        self.ids = np.array([_LAST if x is None else x for x in row["doc_ids"]], np.int64)
        self.words = -(-len(self.ids) // 64)
        length = np.array(row["lengths"], np.int64)
        docs, terms = corpus
        self.norm = LENGTH_FACTOR * (100 - LENGTH_PART + LENGTH_PART * length * docs // max(terms, 1))
        self.at = pc.index_in(asked, value_set=segment_terms(row["offsets"], row["terms"])).fill_null(-1).to_numpy()
        self.ends = np.cumsum(np.frombuffer(row["held"], "<i4").astype(np.int64))
        self.places, self.counts = np.frombuffer(row["places"], "<u2"), np.frombuffer(row["counts"], "<u4")
        self.weights, self.held, self.bytes = weights, OrderedDict(), 0

    def slices(self, term: int) -> np.ndarray | None:
        """Of a term that is here and weighs anything."""
        at = self.at[term]
        if at < 0 or not self.weights[term]:
            return None
        if term in self.held:
            self.held.move_to_end(term)
            return self.held[term]
        some = slice(self.ends[at - 1] if at else 0, self.ends[at])
        places, tf = self.places[some].astype(np.int64), self.counts[some].astype(np.int64)
        made = to_slices(places, self.weights[term] * ((SCALE * tf) // (SATURATION * tf + self.norm[places])), self.words)
        self.held[term] = made
        self.bytes += made.nbytes
        while self.bytes > HELD_BYTES and len(self.held) > 1:
            self.bytes -= self.held.popitem(last=False)[1].nbytes
        return made

    def best(self, terms: list[int], times: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        here = [(term, n) for term, n in zip(terms, times, strict=True) if self.slices(term) is not None]
        if not here:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        bits = sum(n << len(self.slices(term)) for term, n in here).bit_length()
        where, score = top_slices(add_slices(((self.slices(term), n) for term, n in here), bits, self.words), k, self.ids)
        return self.ids[where], score


def search(segments: DataFrame, queries: DataFrame, k: int = 20, *, id_col: str = "item_id", text_col: str = "text", sent_bytes: int = SENT_BYTES) -> DataFrame:
    """query's id, rank, doc_id, score: the k best documents of each query, best first."""
    spark = segments.sparkSession
    kind = queries.schema[id_col].dataType.simpleString()
    corpus = segments.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    rows = queries.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(analysed, f"id {kind}, terms array<binary>, times array<long>")
    empty = spark.createDataFrame([], f"{id_col} {kind}, rank int, doc_id long, score long")
    found = [_search_group(segments, held, (corpus[0], corpus[1]), k, kind) for held in groups(rows, sent_bytes)]
    if len(found) > 1:  # a group's rows are written before the next group is sent
        found = [cut(x) for x in found]
    for some in found:
        empty = empty.unionByName(some.withColumnRenamed("id", id_col))
    return empty


def _search_group(segments: DataFrame, held: list, corpus: tuple[int, int], k: int, kind: str) -> DataFrame:
    spark = segments.sparkSession
    asked = sorted({bytes(t) for row in held for t in row["terms"]})
    number = {t: i for i, t in enumerate(asked)}
    docs = document_counts(segments, asked)
    weights = np.array([math.floor(1000 * math.log((2 * corpus[0] + 2) / (2 * int(df) + 1))) for df in docs], np.int64)
    sent = spark.sparkContext.broadcast((asked, weights, [([number[bytes(t)] for t in row["terms"]], list(row["times"])) for row in held]))

    def score(batches):
        asked, weights, wanted = sent.value
        asked = pa.array(asked, pa.large_binary())
        best = [(np.zeros(0, np.int64),) * 2 for _ in wanted]
        for batch in slices(batches, 1):
            segment = Scorer(batch.to_pylist()[0], asked, weights, corpus)
            for q, (terms, times) in enumerate(wanted):
                found = segment.best(terms, times, k)
                if len(found[0]):
                    ids, scores = (np.concatenate(x) for x in zip(best[q], found, strict=True))
                    order = np.lexsort((ids, -scores))[:k]
                    best[q] = ids[order], scores[order]
        n = [len(ids) for ids, _ in best]
        doc = np.concatenate([np.zeros(0, np.int64), *(ids for ids, _ in best)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(n)), n)), pa.array(np.full(sum(n), TaskContext.get().partitionId() % 64)), pa.array(doc, mask=doc == _LAST), pa.array(np.concatenate([np.zeros(0, np.int64), *(s for _, s in best)]))],
            names=["query", "part", "doc_id", "score"],
        )

    found = segments.select("doc_ids", "lengths", "offsets", "terms", "held", "places", "counts").mapInArrow(score, "query long, part long, doc_id long, score long")
    ids = spark.createDataFrame([(i, row["id"]) for i, row in enumerate(held)], f"query long, id {kind}")
    return best_of(best_of(found, ["query", "part"], k), ["query"], k).join(F.broadcast(ids), "query").select("id", "rank", "doc_id", "score")


def best_of(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order: list[Column] = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def ranked_search(documents: DataFrame, queries: DataFrame, k: int = 20, **columns: str) -> DataFrame:
    """Index the documents (doc_id, text) and answer the queries."""
    return search(cut(index(documents)), queries, k, **columns)
