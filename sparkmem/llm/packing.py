"""Best-fit packing of tokenised documents into sequences of bounded length.

Documents become token ids with an end id; longer ones than a sequence are cut into full pieces, a shorter
piece first. The histogram of piece lengths defines a configuration linear program (a column is a multiset
of lengths that fits one sequence); multiplicative weights price the lengths, a knapsack dynamic program
finds the best column at those prices, and the whole parts of the columns' shares are taken. What is left after
rounding is packed best fit, by length classes. Pieces get their places by rank within their length, so that
no group is ever collected: driver and broadcasts hold the histogram and the columns, which the sequence
length bounds.

Defined results: a null or empty text is a piece with the end id alone; repeated rows are packed each;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices

SEQUENCE = 2048
END_ID = 0
#: Rounds at most (with few lengths, as many more as they are quicker), the share of a length's demand that a round may meet,
#: and the gap between bounds at which rounds end. What the rounds don't cover is packed without them.
ROUNDS, STEP, GAP = 600, 0.2, 0.005
#: How fast the price of a length falls with its coverage.
RATE = 4.0
#: Pieces of one length that are numbered together.
RANK_ROWS = 50_000


class Encoder:
    """The ids that a tokenizers JSON file of byte-level BPE gives (add_special_tokens=False), added tokens in a text included.

    The merges run in a faster implementation of the same algorithm; added tokens are cut out of the text first."""

    def __init__(self, path: str):
        import json
        import re

        import tiktoken

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model, added = held["model"], {t["content"]: t for t in held.get("added_tokens") or ()}
        if model["type"] != "BPE" or held.get("normalizer") or (held.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or held["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError(f"{path} isn't a plain byte-level vocabulary")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added.values()):
            raise ValueError(f"{path} has added tokens that take their surroundings")
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in kept)}
        ranks = {bytes(letter[c] for c in token): i for token, i in model["vocab"].items() if token not in added and all(c in letter for c in token)}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.plain = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.added = {k: t["id"] for k, t in added.items()}
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def encode_ordinary(self, text: str) -> list[int]:
        """Ids of the text, in which added tokens are plain text."""
        return self.plain.encode_ordinary(text)

    def decode_single_token_bytes(self, i: int) -> bytes:
        return self.plain.decode_single_token_bytes(i)

    def encode(self, text: str) -> list[int]:
        if not self.cuts or not self.cuts.search(text):
            return self.plain.encode_ordinary(text)
        out: list[int] = []
        for k, part in enumerate(self.cuts.split(text)):
            out += [self.added[part]] if k % 2 else self.plain.encode_ordinary(part)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces_of(ids: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Start and length of each piece; the first takes the remainder."""
    n = len(ids)
    if n <= size:
        return [(0, n)]
    first = n % size or size
    return [(0, first), *((at, size) for at in range(first, n, size))]


def tokenised(documents: DataFrame, tokenizer: str, *, size: int = SEQUENCE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    kind = documents.schema[id_col].dataType.simpleString()

    def encode(batches):
        model = encoder(tokenizer)
        for batch in slices(batches, 256):
            rows: list[tuple] = []
            for at, text in enumerate(batch.column("text").to_pylist()):
                ids = np.array([*(model.encode(text) if text else ()), end_id], "<u4")
                rows += [(at, k, start, n, zlib.crc32(ids[start : start + n].tobytes())) for k, (start, n) in enumerate(pieces_of(ids, size))]
            at, k, start, n, crc = (np.array(x) for x in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at)), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc.astype(np.int64))], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(encode, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_column(value: np.ndarray, size: int) -> dict[int, int]:
    """The multiset of lengths within size of the largest total value (unbounded knapsack by dynamic programming).

    Few lengths are taken one after the other, each over all rooms in strides of its own; many, a room after the other."""
    best, took = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    lengths = np.flatnonzero(value)
    if strides(lengths, size) < size:
        for n in lengths.tolist():
            for at in range(n, size + 1, n):
                stop = min(at + n, size + 1)
                total = best[at - n : stop - n] + value[n]
                more = total > best[at:stop]
                best[at:stop][more], took[at:stop][more] = total[more], n
    else:
        for room in range(1, size + 1):
            total = value[1 : room + 1] + best[room - 1 :: -1][:room]
            k = int(total.argmax())
            if total[k] > best[room - 1]:
                best[room], took[room] = total[k], k + 1
            else:
                best[room] = best[room - 1]
    column: dict[int, int] = {}
    room = size
    while room > 0:
        if took[room]:
            column[int(took[room])] = column.get(int(took[room]), 0) + 1
            room -= int(took[room])
        else:
            room -= 1
    return column


def strides(lengths: np.ndarray, size: int) -> int:
    return int((size // lengths).sum())


def linear_program(demand: np.ndarray, size: int, rounds: int) -> tuple[dict[tuple[tuple[int, int], ...], float], float]:
    """Shares of columns that solve the configuration program, and the best dual bound of the number of sequences.

    Multiplicative weights: the price of a length falls exponentially with how much of its demand is covered, starting
    from its share of a sequence. Each round prices a column by the knapsack program and uses it until it has met STEP of the
    demand of one of its lengths. Prices over the column's value are a dual solution, so they bound the optimum; the shares
    over the least coverage are a primal one. The rounds end when the two are within GAP of each other."""
    used = np.flatnonzero(demand)
    rounds = rounds * max(1, size // max(strides(used, size), 1))
    covered, shares, bound, total, mean = np.zeros(size + 1), {}, 0.0, 0.0, np.zeros(size + 1)
    held = np.maximum(demand, 1)
    for turn in range(1, rounds + 1 if len(used) else 1):
        price = np.zeros(size + 1)
        price[used] = used / size * np.exp(-RATE * (covered[used] - covered[used].min()))
        column = best_column(price, size)
        worth = sum(price[n] * k for n, k in column.items())
        bound = max(bound, float(demand @ price / worth))
        step = STEP * min(demand[n] / k for n, k in column.items())
        for n, k in column.items():
            covered[n] += k * step / held[n]
        mean += price / worth * step
        if not turn & (turn - 1) or not turn % 256:  # the mean of all prices, too, is a dual solution over its best column's value
            worth = sum(mean[n] * k for n, k in best_column(mean, size).items())
            bound = max(bound, float(demand @ mean / worth))
        name = tuple(sorted(column.items(), reverse=True))
        shares[name] = shares.get(name, 0.0) + step
        total += step
        if total <= (1 + GAP) * bound * covered[used].min():
            break
    least = covered[used].min() if len(used) else 1.0
    scale = least if least > 0 else max(1.0, float(covered.max()))
    return {name: x / scale for name, x in shares.items()}, bound


def best_fit(left: np.ndarray, size: int) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest first, of so many pieces of each length: columns and how many sequences use each.

    A piece goes where least room is left that takes it. While a sequence takes more of the same length, its room is the
    least, so sequences alike are filled at once."""
    rooms: dict[int, list[tuple[dict[int, int], int]]] = {}
    open_rooms: list[int] = []

    def put(column: dict[int, int], times: int, room: int) -> None:
        if room not in rooms:
            rooms[room] = []
            insort(open_rooms, room)
        rooms[room].append((column, times))

    for n in np.flatnonzero(left)[::-1].tolist():
        count = int(left[n])
        while count:
            at = bisect_left(open_rooms, n)
            if at == len(open_rooms):
                put({}, -(-count // (size // n)), size)
                continue
            room = open_rooms[at]
            column, times = rooms[room].pop()
            if not rooms[room]:
                del rooms[room], open_rooms[at]
            each = min(room // n, count)
            full = min(times, count // each)
            if full < times:
                put(column, times - full, room)
            put({**column, n: each}, full, room - each * n)
            count -= each * full
    return [(column, times) for held in rooms.values() for column, times in held if column]


def fullest(left: np.ndarray, room: int) -> dict[int, int]:
    """The pieces, of so many of each length, that fill most of the room: a knapsack program over sums as bits, long pieces preferred."""
    lengths = np.flatnonzero(left[: room + 1]).tolist()
    within, reach = (1 << (room + 1)) - 1, [1]
    for n in lengths:
        sums, k, part = reach[-1], min(int(left[n]), room // n), 1
        while k:
            part = min(part, k)
            sums |= sums << n * part & within
            k, part = k - part, 2 * part
        reach.append(sums)
    target, column = reach[-1].bit_length() - 1, {}
    for i in range(len(lengths) - 1, -1, -1):
        n = lengths[i]
        k = min(int(left[n]), target // n)
        while not reach[i] >> (target - k * n) & 1:
            k -= 1
        if k:
            column[n] = k
            target -= k * n
    return column


def fill_up(left: np.ndarray, size: int) -> list[tuple[dict[int, int], int]]:
    """Columns that hold every piece: the longest piece that is left, and those that fill most of its room; each use ends a length."""
    left, out = left.copy(), []
    while left.any():
        n = int(np.flatnonzero(left)[-1])
        left[n] -= 1
        column = fullest(left, size - n)
        left[n] += 1
        column[n] = column.get(n, 0) + 1
        times = min(int(left[x]) // k for x, k in column.items())
        out.append((column, times))
        for x, k in column.items():
            left[x] -= k * times
    return out


def columns_for(counts: dict[int, int], size: int, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """Columns and how many sequences use each; together they hold every piece exactly once.

    The program is always solved. Whole parts of its shares are taken first; what is left is packed by columns of what is
    left, the longest piece first. Many lengths of few pieces leave the shares few whole parts, so the same without the program
    and best fit are compared afterwards, and taken only where they use fewer sequences."""
    left = np.zeros(size + 1, np.int64)
    for n, k in counts.items():
        left[n] = k
    out: list[tuple[dict[int, int], int]] = []
    if left[size]:
        out.append(({size: 1}, int(left[size])))
        left[size] = 0
    used = lambda columns: sum(times for _, times in columns)
    volume = -(-int(left @ np.arange(size + 1)) // size)
    whole = left.copy()
    solved: list[tuple[dict[int, int], int]] = []
    shares, _ = linear_program(left.astype(float), size, rounds)
    for name, share in sorted(shares.items(), key=lambda x: (-x[1], x[0])):
        times = min(int(share + 1e-9), min(int(left[n]) // k for n, k in name))
        if times:
            solved.append((dict(name), times))
            for n, k in name:
                left[n] -= k * times
    found = [solved + fill_up(left, size)]
    if used(found[0]) > volume:
        found += [fill_up(whole, size), best_fit(whole, size)]
    return out + min(found, key=used)


def places(columns: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """By length: rows of first rank, copies in a column, first sequence, offset of the first copy."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for column, times in columns:
        offset = 0
        for n in sorted(column, reverse=True):
            rows.setdefault(n, []).append((ranks.get(n, 0), column[n], sequence, offset))
            ranks[n] = ranks.get(n, 0) + column[n] * times
            offset += n * column[n]
        sequence += times
    return {n: np.array(x, np.int64) for n, x in rows.items()}


def pack(documents: DataFrame, tokenizer: str, *, size: int = SEQUENCE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = documents.sparkSession
    kind = documents.schema[id_col].dataType.simpleString()
    pieces = cut(tokenised(documents, tokenizer, size=size, end_id=end_id, id_col=id_col, text_col=text_col))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most size rows
    sent = spark.sparkContext.broadcast(places(columns_for(counts, size, rounds)))
    salts = max(1, -(-sum(counts.values()) // RANK_ROWS))
    dealt = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(salts)))
    sums = dealt.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = sums.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    def place(batches):
        where = sent.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                rows = where[int(n)]
                row = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                nth = rank[at] - row[:, 0]
                sequence[at] = row[:, 2] + nth // row[:, 1]
                offset[at] = row[:, 3] + nth % row[:, 1] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("doc_id", id_col)
