"""Packing of documents beside their lexical neighbours.

Documents become token ids with an end id. Windows that a document fills alone are sequences of their own; the rest of each
document (a unit, less than a window) is packed with units like it. Units are dealt by a signature, the signs of random
projections of their weighted terms, so that like units are near in one order; the order is dealt to tasks by ranges and cut
into shards of SHARD_TOKENS ids. Ties of the signature go by a hash of the id: a group of copies of any size is dealt to as
many shards as it takes. Each shard has an inverted index with BM25 weights, its document counts taken over all units.
A seed's unused neighbours fill its window in the order of their scores; the one that exceeds the window is cut, and its rest
is the seed of the next window. So every window is full but the last of a task, which is cut into powers of two: nothing is
padded.

Defined results: a null or empty text is a piece with the end id alone; repeated rows are packed each; an empty table gives
an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blank_words, cut, slices, spans, texts_of

SEQUENCE, END_ID = 2048, 1
#: Ids that are indexed together.
SHARD_TOKENS = 1 << 20
#: Okapi's constants.
K1, B = 1.2, 0.75
#: Signs in a signature.
SIGNS = 16
#: Bytes of text that are encoded at once.
TEXT_BYTES = 8 << 20


# How the vocabulary's file says that text is normalised and split, and the same split for plain characters in lower case.
_NORMALISER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_runs = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
#: Anything but plain characters: those whose class, lower case and composition no version of Unicode changes.
_odd = re.compile(r"[^\t-\r -~À-ÖØ-öø-ÿ]|<\|")


class Words:
    """Ids of texts by a tokenizers JSON file of a lower-casing word vocabulary that drops white space.

    What stands between blanks is encoded independently, so each distinct word of a batch is encoded once: plain ones by a
    faster implementation of the same merges, a mark with an id of its own between them, others by tokenizers itself. A word's
    end is a blank there, as no blank is left in a word. That implementation merges whatever two pieces make a known one;
    proven() checks that for no piece of the vocabulary this takes another pair than the file's, so it never does."""

    def __init__(self, path: str):
        import json

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model, splits = held["model"], (held["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        if (held["normalizer"] or {}).get("normalizers") != _NORMALISER or splits[0].get("pattern") != {"Regex": _SPLIT} or model["end_of_word_suffix"] != "</w>" or model["continuing_subword_prefix"]:
            raise ValueError(f"{path} isn't a vocabulary of lower-cased words")
        self.model = Tokenizer.from_file(path)
        self.size = self.model.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in kept)}
        raw = lambda t: bytes(letter[c] for c in t.removesuffix("</w>")) + (b" " if t.endswith("</w>") else b"")
        self.ranks = {raw(t): i for t, i in model["vocab"].items()}
        self.pairs = {raw(a + b): (raw(a), raw(b)) for a, b in (x if isinstance(x, list) else x.split(" ") for x in model["merges"])}
        self.fast = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=self.ranks, special_tokens={})
        self.mark = self.ranks[b"\x00 "]

    def proven(self) -> bool:
        """Whether joining the two neighbours whose join ranks first makes every piece of the vocabulary by the file's own merges."""
        for piece in self.ranks:
            parts = [piece[i : i + 1] for i in range(len(piece))]
            if len(piece) > 1 and piece.endswith(b" "):
                parts[-2:] = [piece[-2:]]
            while len(parts) > 1:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], self.size), i) for i in range(len(parts) - 1))
                if rank == self.size or self.pairs[parts[at] + parts[at + 1]] != (parts[at], parts[at + 1]):
                    return False
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return True

    def _plain(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain words, and how many each has."""
        runs = _runs.findall(b" \x00 ".join(words).decode().lower())
        ids = np.array(self.fast._core_bpe.encode_ordinary(" ".join(runs) + " "), self.dtype)
        marks = np.flatnonzero(ids == self.mark)
        return np.delete(ids, marks), np.diff(marks, prepend=-1, append=len(ids)) - 1

    def of_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and for each of the distinct words where its ids begin and how many they are."""
        if not _odd.search(b" ".join(words).decode()):
            ids, size = self._plain(words)
            return ids, np.cumsum(size) - size, size
        odd = np.array([bool(_odd.search(w.decode())) for w in words])
        plain, n = self._plain([w for w, x in zip(words, odd, strict=True) if not x]) if not odd.all() else (np.zeros(0, self.dtype), np.zeros(0, int))
        rest = [x.ids for x in self.model.encode_batch_fast([w.decode() for w, x in zip(words, odd, strict=True) if x], add_special_tokens=False)]
        size = np.zeros(len(words), np.int64)
        size[~odd], size[odd] = n, [len(x) for x in rest]
        first = np.zeros(len(words), np.int64)
        first[~odd], first[odd] = np.cumsum(n) - n, len(plain) + np.cumsum(size[odd]) - size[odd]
        return np.concatenate((plain, np.array([i for x in rest for i in x], self.dtype))), first, size

    def of_texts(self, texts: list[bytes], end: int) -> list[np.ndarray]:
        """The ids of each text, the end id behind them."""
        joined = b"\n".join(texts)
        starts, ends = blank_words(np.frombuffer(joined, np.uint8)) if joined else (np.zeros(0, np.int64),) * 2
        last = np.array([end], self.dtype)
        if not len(starts):
            return [last] * len(texts)
        coded = spans(joined, starts, ends).dictionary_encode()
        flat, first, size = self.of_words(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        code = coded.indices.to_numpy()
        n = size[code]
        upto = np.cumsum(n)
        ids = flat[np.repeat(first[code] - (upto - n), n) + np.arange(int(upto[-1]))]
        stops = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
        cuts = np.concatenate(([0], upto))[stops]
        return [np.concatenate((ids[a:b], last)) for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]


@lru_cache(maxsize=2)
def words_of(path: str) -> Words:
    return Words(path)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


_PIECE = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenised(documents: DataFrame, tokenizer: str, *, size: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Pieces that fill a sequence alone, with null ids, and units: the rest of each document with its ids, in no sequence yet."""
    kind = documents.schema[id_col].dataType.simpleString()

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, number = words_of(tokenizer), TaskContext.get().partitionId() << 32
        for batch in slices(batches, 1024):
            texts = texts_of(batch, "text")
            at = 0
            while at < len(texts):
                stop, held = at, 0
                while stop < len(texts) and held < TEXT_BYTES:
                    held += len(texts[stop])
                    stop += 1
                rows: list[tuple] = []
                for k, ids in enumerate(model.of_texts(texts[at:stop], end_id), at):
                    whole = len(ids) // size * size
                    for start in range(0, whole, size):
                        rows.append((k, start, size, crc(ids[start : start + size]), len(ids), number << 1 | 1, 0, None))
                        number += 1
                    if whole < len(ids):
                        rows.append((k, whole, len(ids) - whole, crc(ids[whole:]), len(ids), None, None, ids[whole:].tobytes()))
                at = stop
                of, *rest = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(of)), *(pa.array(x, pa.int64()) for x in rest[:-1]), pa.array(rest[-1], pa.binary())],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
                )

    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(encode, _PIECE.format(kind) + ", ids binary")


def unit_terms(ids: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit, term and occurrences of each distinct pair, by unit."""
    unit = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    pair, n = np.unique(unit * size + np.concatenate(ids), return_counts=True)
    return pair // size, pair % size, n


def unit_counts(units: DataFrame, size: int, dtype: np.dtype) -> np.ndarray:
    """How many units hold each term: one row a term and task, and no more rows in the end than the vocabulary has."""

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in slices(batches, 2048):
            if batch.num_rows:
                _, term, _ = unit_terms([np.frombuffer(x, dtype) for x in batch.column("ids").to_pylist()], size)
                total += np.bincount(term, minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

    out = np.zeros(size, np.int64)
    for row in units.select("ids").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row["term"]] = row["n"]
    return out


def signatures(ids: list[np.ndarray], weight: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """The signs of the projections of each unit's weighted terms, as the bits of a number."""
    unit, term, _ = unit_terms(ids, len(weight))
    first = np.flatnonzero(np.diff(unit, prepend=-1))
    sums = np.add.reduceat(signs[term] * weight[term, None], first, axis=0)
    return (sums > 0) @ (1 << np.arange(signs.shape[1]))


class Shard:
    """An inverted index of units with BM25 weights."""

    def __init__(self, ids: list[np.ndarray], weight: np.ndarray, mean: float):
        self.ids, self.lengths = ids, np.array([len(x) for x in ids])
        unit, term, n = unit_terms(ids, len(weight))
        value = weight[term] * n * (K1 + 1) / (n + K1 * (1 - B + B * self.lengths[unit] / mean))
        order = np.argsort(term, kind="stable")
        self.term, self.unit, self.value = term[order].astype(np.int32), unit[order].astype(np.int32), value[order]

    def keep(self, left: np.ndarray) -> None:
        """Let go of the postings of units that are used."""
        some = left[self.unit]
        self.term, self.unit, self.value = self.term[some], self.unit[some], self.value[some]

    def scores(self, seed: np.ndarray) -> np.ndarray:
        asked = np.unique(seed).astype(np.int32)
        a, b = np.searchsorted(self.term, asked), np.searchsorted(self.term, asked + 1)
        n = b - a
        at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.bincount(self.unit[at], self.value[at], minlength=len(self.ids))


class Windows:
    """Windows filled shard by shard; the open window and its seed go on to the next shard."""

    def __init__(self, size: int):
        self.size, self.room = size, size
        self.open: list[tuple[int, int, int]] = []
        self.full: list[list[tuple[int, int, int]]] = []
        self.seed: np.ndarray | None = None

    def put(self, unit: int, start: int, n: int) -> None:
        """The unit's ids from start on, in this window and, if they exceed it, in the next."""
        while n:
            took = min(n, self.room)
            self.open.append((unit, start, took))
            self.room -= took
            start, n = start + took, n - took
            if not self.room:
                self.full.append(self.open)
                self.open, self.room = [], self.size

    def fill(self, shard: Shard, number: int) -> None:
        """All units of the shard, numbered from number on."""
        left = np.ones(len(shard.ids), bool)
        indexed = len(left)
        while n_left := int(left.sum()):
            if n_left < indexed * 7 // 8:
                shard.keep(left)
                indexed = n_left
            if not self.open or self.seed is None:
                at = int(np.argmax(left))
                left[at] = False
                self.seed = shard.ids[at]
                self.put(number + at, 0, int(shard.lengths[at]))
                continue
            some = np.flatnonzero(left)
            some = some[np.argsort(-shard.scores(self.seed)[some], kind="stable")]
            reach = np.cumsum(shard.lengths[some])
            n = int(np.searchsorted(reach, self.room)) + 1  # the last of them fills the window or exceeds it
            for at in some[:n].tolist():
                self.put(number + at, 0, int(shard.lengths[at]))
            left[some[:n]] = False
            if n <= len(some):
                self.seed = shard.ids[int(some[n - 1])] if self.open else None

    def tail(self) -> list[list[tuple[int, int, int]]]:
        """The open window as windows of falling powers of two."""
        out, total = [], sum(x[2] for x in self.open)
        rest = [*self.open]
        for power in (1 << b for b in reversed(range(total.bit_length())) if total >> b & 1):
            window, room = [], power
            while room:
                unit, start, n = rest.pop(0)
                took = min(n, room)
                window.append((unit, start, took))
                room -= took
                if took < n:
                    rest.insert(0, (unit, start + took, n - took))
            out.append(window)
        return out


def neighbour_pack(documents: DataFrame, tokenizer: str, *, size: int = SEQUENCE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = documents.sparkSession
    kind = documents.schema[id_col].dataType.simpleString()
    model = words_of(tokenizer)
    if not model.proven():
        raise ValueError(f"merges of {tokenizer} depend on more than the order of its pieces")
    dtype, terms = model.dtype, model.size
    made = cut(tokenised(documents, tokenizer, size=size, end_id=end_id, id_col=id_col, text_col=text_col))
    units = made.where("ids is not null")
    n, total = units.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    df = unit_counts(units, terms, dtype)
    sent = spark.sparkContext.broadcast(np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32))
    mean = total / max(n, 1)

    def sign(batches):
        signs = np.random.default_rng(1).choice(np.array([-1, 1], np.float32), (terms, SIGNS))
        for batch in slices(batches, 1024):
            if batch.num_rows:
                ids = [np.frombuffer(x, dtype) for x in batch.column("ids").to_pylist()]
                yield batch.append_column("signature", pa.array(signatures(ids, sent.value, signs), pa.int64()))

    def fill(batches):
        weight, windows = sent.value.astype(float), Windows(size)
        held: dict[int, tuple] = {}
        sequence, number = TaskContext.get().partitionId() << 32, 0

        def emit(full):
            nonlocal sequence
            rows = []
            for window in full:
                offset = 0
                for unit, start, took in window:
                    doc_id, base, tokens, ids = held[unit]
                    rows.append((doc_id, base + start, took, crc(ids[start : start + took]), tokens, sequence << 1, offset))
                    offset += took
                sequence += 1
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if k else of_id) for k, x in enumerate(columns)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        def close(rows):
            nonlocal number
            for k, row in enumerate(rows, number):
                held[k] = row
            windows.fill(Shard([row[3] for row in rows], weight, mean), number)
            number += len(rows)
            out, windows.full = emit(windows.full), []
            kept = {x[0] for x in windows.open}
            for k in [k for k in held if k not in kept]:
                del held[k]
            return out

        shard, room, of_id = [], shard_tokens, None
        for batch in batches:
            of_id = batch.schema.field("doc_id").type
            for row in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "start", "doc_tokens", "ids")), strict=True):
                shard.append((*row[:3], np.frombuffer(row[3], dtype)))
                room -= len(shard[-1][3])
                if room <= 0:
                    yield close(shard)
                    shard, room = [], shard_tokens
        if shard:
            yield close(shard)
        if windows.open:
            yield emit(windows.tail())

    signed = units.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids").mapInArrow(sign, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids binary, signature long")
    dealt = signed.withColumn("salt", F.xxhash64("doc_id")).repartitionByRange("signature", "salt", "ids_crc32").sortWithinPartitions("signature", "salt", "ids_crc32", "doc_tokens")
    packed = dealt.select("doc_id", "start", "doc_tokens", "ids").mapInArrow(fill, _PIECE.format(kind))
    alone = made.where("ids is null").drop("ids")
    return alone.unionByName(packed).withColumnRenamed("doc_id", id_col)
