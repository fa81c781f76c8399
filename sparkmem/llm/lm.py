"""Language-model scores of whole texts, beside a unigram base.

Texts become lower-case words and an end. Word counts of all learning documents give the base score. The model is
causal self-attention over subword ids (see attention.py). Texts are turned into ids once; classes come from counts of all
neighbouring ids of all learning documents, and every window of these documents trains the weights. This takes two rounds:
a share of the windows, drawn by a hash of document and window, gives the weights that the others start from; in each round all tasks
train on what they read, and their results are averaged by the windows seen. A word's probability is that of the class of its
first id, given the ids before it in the window, times its share of the learning words of that class, smoothed as the base
is: by 0.1 for each known word and for one unknown word of the class. Scoring runs over overlapping
windows, in which each word is scored once. The most frequent words travel as a table of bounded size; the others are
joined with the counts.

Defined results: a null or empty text is an end alone; rows with a null id are scored, not held out and not learned
from; with nothing to learn from, the counts are 0 and all classes are as likely; repeated rows give one result each; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import pickle
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import attention
from .common import blank_words, cut, lower_ascii, mix, slices, texts_of, word_hashes
from .packing import encoder

#: Words that are sent to every executor with their counts and ids, at most.
TOP_WORDS = 300_000
IDS = 50_257
END_ID = 50_256
#: Rates of the rounds; of all windows, one in so many takes part in the first round, the others in the second.
RATES, FIRST_SHARE = (0.01, 0.003), 4
#: With fewer windows than this, each is trained on several times, but at most so often.
LEAST_WINDOWS, MOST_TURNS = 100_000, 40
#: Windows that a task gathers before it trains on them.
GATHER = 8192


def _counts(batches):
    """Words with their counts, as far as a task has come each time its table is full."""
    held: list[pa.Table] = []
    rows, limit = 0, 1_000_000

    def merged() -> pa.Table:
        return pa.TableGroupBy(pa.concat_tables(held), "word", use_threads=False).aggregate([("c", "sum")]).select(["word", "c_sum"]).rename_columns(["word", "c"])

    for batch in slices(batches):
        words = pc.list_flatten(pc.ascii_split_whitespace(pc.ascii_lower(batch.column("text").cast(pa.string()))))
        found = pc.value_counts(words)
        new = pa.table([found.field(0), found.field(1)], names=["word", "c"])
        held.append(new.filter(pc.not_equal(new["word"], "")))  # white space at an end of a text, or no word
        rows += held[-1].num_rows
        if rows > limit:
            held = [merged()]
            rows = held[0].num_rows
            if rows > limit // 2:
                yield from held[0].to_batches()
                held, rows = [], 0
    if rows:
        yield from merged().to_batches()


@lru_cache(maxsize=2)
def _opening(tokenizer: str) -> np.ndarray:
    """Which ids begin with a blank."""
    plain, out = encoder(tokenizer).plain, np.zeros(IDS, bool)
    out[[plain.encode_single_token(x) for x in plain.token_byte_values() if x.startswith(b" ")]] = True
    return out


def _encode(words: list[bytes], tokenizer: str) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of the words, each behind a blank, and how many each has.

    Words without white space of any kind are encoded side by side: no piece of the vocabulary reaches over the blank before a word."""
    if not words:
        return np.zeros(0, np.uint16), np.zeros(0, np.int64)
    model, text = encoder(tokenizer), b" ".join(words).decode()
    apart = text.split(" ")
    odd = [] if apart == text.split() else [i for i, w in enumerate(apart) if w.split() != [w]]
    if odd:
        text = " ".join(np.delete(np.array(apart, object), odd).tolist())
    flat = model.plain.encode_to_numpy(" " + text, disallowed_special=()).astype(np.uint16) if len(odd) < len(apart) else np.zeros(0, np.uint16)
    begin = np.flatnonzero(_opening(tokenizer)[flat])
    sizes = np.diff(begin, append=len(flat))
    if odd:
        alone = [model.encode_ordinary(" " + apart[i]) for i in odd]
        place = np.array(odd) - np.arange(len(odd))  # among the others
        flat = np.insert(flat, np.repeat(np.append(begin, len(flat))[place], [len(x) for x in alone]), np.array([i for x in alone for i in x], np.uint16))
        sizes = np.insert(sizes, place, [len(x) for x in alone])
    return flat, sizes


class Table:
    """The frequent words' hashes, counts and ids, and the model; what every executor gets.

    units: the class of each id as input and as output, and the row of its own vector. weights: of the attention model.
    sizes: by output class, the learning words in it and the distinct ones."""

    def __init__(self, words: list[str], counts: np.ndarray, total: int, distinct: int, ends: int, tokenizer: str):
        self.tokenizer, self.total, self.distinct, self.ends = tokenizer, total, distinct, ends
        self.words, self.counts = words, counts
        self.units, self.weights, self.class_sizes = None, None, None

    def ready(self):
        raw = [w.encode() for w in self.words]
        buffer = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        starts, ends = blank_words(buffer)
        self.index = pd.Index(word_hashes(buffer, starts, ends))
        self.flat, self.sizes = _encode(raw, self.tokenizer)
        self.at = np.concatenate(([0], np.cumsum(self.sizes)))
        self.logs = np.log10(self.counts + 0.1)
        del self.words
        return self

    def fitted(self):
        self.table = attention.prepared(self.weights, self.units[0], self.units[2])
        words, kinds = self.class_sizes
        self.below = np.log10(words + 0.1 * (kinds + 1))  # of each class: what a smoothed count is divided by
        return self

    def log_scores(self, flat, opens, bounds) -> np.ndarray:
        """Log10 probability of each text, without the smoothed counts of its words."""
        found = attention.log_probs(self.weights, self.table, self.units, inputs(flat, bounds), flat, opens, bounds) / np.log(10)
        at = np.flatnonzero(opens)
        word = found[at] - self.below[self.units[1][flat[at]]] * (flat[at] != END_ID)
        return np.bincount(np.searchsorted(bounds, at, side="right") - 1, word, len(bounds) - 1)

    def ids_of(self, texts: list[bytes]):
        """Flat ids of the texts with an end each, bounds; of each word its begin in them, number if frequent and text; and the other words with their numbers among all."""
        data = lower_ascii(b"\n".join(texts)) + b"\n"
        buffer = np.frombuffer(data, np.uint8)
        starts, ends = blank_words(buffer)
        number = self.index.get_indexer(word_hashes(buffer, starts, ends)) if len(self.index) else np.full(len(starts), -1)
        word_bounds = np.concatenate(([0], np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))))
        rare_at = np.flatnonzero(number < 0)
        rare_words = [data[a:b] for a, b in zip(starts[rare_at].tolist(), ends[rare_at].tolist(), strict=True)]
        rare_ids, rare_sizes = _encode(rare_words, self.tokenizer)
        sizes = np.where(number < 0, 0, self.sizes[number]) if len(self.sizes) else np.zeros(len(number), np.int64)
        sizes[rare_at] = rare_sizes
        place = np.concatenate(([0], np.cumsum(sizes)))  # without ends
        text_of = np.repeat(np.arange(len(texts)), np.diff(word_bounds))
        flat = np.full(place[-1] + len(texts), END_ID, np.uint16)
        begin = place[:-1] + text_of
        common = np.flatnonzero(number >= 0)
        for at, source, source_at in ((common, self.flat, self.at[number[common]]), (rare_at, rare_ids, np.cumsum(rare_sizes) - rare_sizes)):
            n = sizes[at]
            inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            flat[np.repeat(begin[at], n) + inner] = np.take(source, np.repeat(source_at, n) + inner)
        bounds = place[word_bounds] + np.arange(len(texts) + 1)
        return flat, bounds, begin, number, text_of, rare_at, rare_words


_held: dict[str, Table] = {}


def _table(sent, key: str) -> Table:
    if key not in _held:
        _held.clear()
        _held[key] = pickle.loads(sent.value).ready()
    return _held[key]


def _send(spark, table: Table):
    sent = spark.sparkContext.broadcast(pickle.dumps(table))
    return sent, f"table-{id(sent)}-{table.total}-{table.distinct}-{np.random.randint(1 << 60)}"


def inputs(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The id before each position; the end id where a document begins."""
    before = np.concatenate(([END_ID], flat[:-1])).astype(np.uint16) if len(flat) else flat
    before[bounds[:-1]] = END_ID
    return before


def _binaries(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _packed(opens: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The marks of each text as bits, in bytes of its own."""
    n = np.diff(bounds)
    begin = np.concatenate(([0], np.cumsum(-(-n // 8))))
    bits = np.zeros(8 * int(begin[-1]), bool)
    bits[np.arange(len(opens)) + np.repeat(8 * begin[:-1] - bounds[:-1], n)] = opens
    return _binaries(np.packbits(bits), begin)


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat ids of a batch of encoded texts, where a word or end begins, and bounds."""
    ids, marks = batch.column("ids").to_pylist(), batch.column("opens").to_pylist()
    n = np.array([len(x) // 2 for x in ids], np.int64)
    bounds = np.concatenate(([0], np.cumsum(n)))
    begin = np.concatenate(([0], np.cumsum([len(x) for x in marks])))
    bits = np.unpackbits(np.frombuffer(b"".join(marks), np.uint8)).view(bool)
    return np.frombuffer(b"".join(ids), np.uint16), bits[np.arange(int(n.sum())) + np.repeat(8 * begin[:-1] - bounds[:-1], n)], bounds


def encoded(rows: DataFrame, table: Table) -> DataFrame:
    """Of each row (doc_id, learn, text) the ids with marks where words begin, the number of training windows, what the table's words give to the scores, and the other words; written down."""
    sent, key = _send(rows.sparkSession, table)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def encode(batches):
        table = _table(sent, key)
        under = float(np.log10(table.total + 0.1 * (table.distinct + 1)))
        end = float(np.log10(table.ends + 0.1)) - under
        number_of, part = 0, TaskContext.get().partitionId() << 36
        for batch in slices(batches, 256):
            texts = texts_of(batch, "text")
            flat, bounds, begins, number, text_of, rare_at, rare_words = table.ids_of(texts)
            opens = np.zeros(len(flat), bool)
            opens[begins] = opens[bounds[1:] - 1] = True
            common = number >= 0
            size = np.bincount(text_of, minlength=len(texts))
            logs = np.bincount(text_of[common], table.logs[number[common]], len(texts)) if len(table.logs) else np.zeros(len(texts))
            known = np.bincount(text_of[common], minlength=len(texts)) + (table.ends > 0)
            cuts = np.searchsorted(text_of[rare_at], np.arange(len(texts) + 1))
            rare = _binaries(np.frombuffer(b"".join(rare_words), np.uint8), np.concatenate(([0], np.cumsum([len(w) for w in rare_words]))))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(number_of, number_of + len(texts)) + part), batch.column("doc_id"), batch.column("learn"), pa.array(size + 1), pa.array(known.astype(np.int64)),
                    pa.array(logs - under * size + end), pa.array(logs), pa.array(-(-np.diff(bounds) // attention.WINDOW)), _binaries(flat, 2 * bounds), _packed(opens, bounds),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), rare.cast(pa.string())),
                ],
                names=["row", "doc_id", "learn", "n_tokens", "known", "base", "logs", "windows", "ids", "opens", "rare"],
            )
            number_of += len(texts)

    return cut(rows.mapInArrow(encode, f"row long, doc_id {kind}, learn boolean, n_tokens long, known long, base double, logs double, windows long, ids binary, opens binary, rare array<string>"))


def _top(counts: DataFrame, limit: int) -> DataFrame:
    """The most frequent words, limit at most: all words whose counts reach a bound."""
    size = F.floor(F.log2("c") * 8)
    least, held = None, 0
    for r in counts.groupBy(size.alias("k")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("k")).collect():  # some hundred rows
        held += r["n"]
        if held > limit:
            break
        least = r["c"]
    return counts.where(F.lit(False) if least is None else F.col("c") >= least)


def _rows(documents: DataFrame, learn: Column, id_col: str, text_col: str) -> DataFrame:
    return documents.select(F.col(id_col).alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text_col).cast("string").alias("text"))


def fit(documents: DataFrame, learn: Column, tokenizer: str, *, top_words: int = TOP_WORDS, id_col: str = "doc_id", text_col: str = "text") -> tuple[Table, DataFrame]:
    """The model, and the counts of all learning words; learn: which documents to learn from."""
    return _fit(_rows(documents, learn, id_col, text_col), tokenizer, top_words)[:2]


def _fit(rows: DataFrame, tokenizer: str, top_words: int) -> tuple[Table, DataFrame, DataFrame]:
    """The model, the counts of all learning words, and all rows as ids."""
    taught = rows.where("learn")
    ends = taught.count()
    counts = cut(taught.select("text").mapInArrow(_counts, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, distinct = total + ends, distinct + (ends > 0)
    top = _top(counts, top_words).orderBy("word").toPandas()
    table = Table(top["word"].tolist(), top["c"].to_numpy(np.int64), total, distinct, ends, tokenizer)
    held = encoded(rows, table)

    def subwords(batches):
        seen = np.zeros((3, IDS), np.int64)  # of each id: how often in words, how often first in a word, in how many words first
        for batch in slices(batches, 4096):
            ids, sizes = _encode(texts_of(batch, "word"), tokenizer)
            c = batch.column("c").to_numpy()
            first = ids[np.cumsum(sizes) - sizes]
            seen[0] += np.bincount(ids, np.repeat(c, sizes), IDS).astype(np.int64)
            seen[1] += np.bincount(first, c, IDS).astype(np.int64)
            seen[2] += np.bincount(first, minlength=IDS)
        at = np.flatnonzero(seen[0])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(x[at]) for x in seen)], names=["id", "c", "first", "kinds"])

    id_counts = np.zeros((3, IDS), np.float64)
    for r in counts.mapInArrow(subwords, "id int, c long, first long, kinds long").groupBy("id").agg(*(F.sum(x).alias(x) for x in ("c", "first", "kinds"))).toLocalIterator():  # at most IDS rows
        id_counts[:, r["id"]] = r["c"], r["first"], r["kinds"]
    words, kinds = id_counts[1].copy(), id_counts[2]
    id_counts[:2, END_ID] = ends

    column = np.full(IDS, attention.BESIDE, np.int64)
    column[np.argsort(-id_counts[0], kind="stable")[: attention.BESIDE]] = np.arange(attention.BESIDE)

    def beside(batches):
        """How often each id stands before, and each first id of a word behind, each of the frequent ids."""
        wide = IDS * (attention.BESIDE + 1)
        seen = np.zeros(2 * wide, np.int64)
        for batch in slices(batches, 4096):
            flat, opens, bounds = _unpacked(batch)
            before = inputs(flat, bounds).astype(np.int64) * (attention.BESIDE + 1) + column[flat]
            behind = flat[opens].astype(np.int64) * (attention.BESIDE + 1) + column[inputs(flat, bounds)[opens]]
            for low, keys in ((0, before), (wide, behind)):
                seen[low : low + wide] += np.bincount(keys, minlength=wide)
        at = np.flatnonzero(seen)
        at = at[at % (attention.BESIDE + 1) < attention.BESIDE]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at])], names=["at", "n"])

    learnt = held.where("learn")
    pairs = learnt.select("ids", "opens").mapInArrow(beside, "at int, n long").groupBy("at").agg(F.sum("n").cast("float").alias("n")).toPandas()  # a number for each id and frequent id, at most
    near = np.zeros(2 * IDS * (attention.BESIDE + 1), np.float32)
    near[pairs["at"].to_numpy()] = pairs["n"].to_numpy()
    del pairs
    near = near.reshape(2, IDS, -1)[:, :, : attention.BESIDE]
    table.units = (attention.unit_map(id_counts[0], near[0], END_ID, 31), attention.unit_map(id_counts[1], near[1], END_ID, 39), attention.own_rows(id_counts[0]))
    table.class_sizes = tuple(np.bincount(table.units[1], x, attention.UNITS) for x in (words, kinds))
    del near
    table.weights = attention.initial()
    windows = learnt.agg(F.coalesce(F.sum("windows"), F.lit(0))).first()[0]
    turns = min(MOST_TURNS, -(-LEAST_WINDOWS // max(1, windows)))
    if windows:
        for number, rate in enumerate(RATES):
            table.weights = _trained(learnt, table.weights, table.units, number, rate, turns)
    return table, counts, held


def drawn(draws: np.ndarray, number: int, starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which windows take part in a round; draws: of each text a hash. Each window takes part in one round."""
    doc = np.searchsorted(bounds, starts, side="right") - 1
    pick = mix(draws.view(np.uint64)[doc] + mix((starts - bounds[doc]).astype(np.uint64))) >> np.uint64(32)
    return (pick < np.uint64((1 << 32) // FIRST_SHARE)) == (number == 0)


def _trained(learnt: DataFrame, weights: dict, units: tuple, number: int, rate: float, turns: int) -> dict:
    """The weights after a round over its windows of all learning documents."""
    sent = learnt.sparkSession.sparkContext.broadcast(pickle.dumps((weights, units)))
    names, shapes = list(weights), [x.shape for x in weights.values()]

    def train(batches):
        weights, units = pickle.loads(sent.value)
        key, kinds = attention.keyed(units[0], units[2])
        trainer, rest, seen, size = attention.Trainer(weights, rate, kinds), [], 0, 0

        def learn() -> int:
            x = [np.concatenate(x) for x in zip(*rest, strict=True)]
            rest.clear()
            rng = np.random.default_rng(seen)
            for _ in range(turns):
                order = rng.permutation(len(x[0]))
                order = order[np.argsort(x[2][order].sum(axis=1).astype(np.uint8), kind="stable")]  # like numbers of words together
                for low in rng.permutation(np.arange(0, len(order), attention.BATCH)).tolist():
                    trainer.step(*(np.take(y, order[low : low + attention.BATCH], axis=0) for y in x))
            return len(x[0])

        for batch in slices(batches):
            flat, opens, bounds = _unpacked(batch)
            before = inputs(flat, bounds)
            starts, shape = attention.windows(bounds, attention.WINDOW)
            chosen = drawn(batch.column("draw").to_numpy(), number, starts, bounds)
            at, scored = attention.gathered(starts[chosen], shape[chosen], opens)
            rest.append((np.take(key, before[at]), np.take(units[1], flat[at]), scored))
            size += len(at)
            if size >= GATHER:
                seen, size = seen + learn(), 0
        if size:
            seen += learn()
        if seen:
            flat = np.concatenate([trainer.p[k].ravel() for k in names]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 16], pa.int32()), pa.array([float(seen)]), pa.array([(flat * seen).tobytes()], pa.binary())], names=["g", "n", "w"])

    def total(batches):  # one result after the other
        n, w = 0.0, 0.0
        for batch in slices(batches, 1):
            n, w = n + batch.column("n")[0].as_py(), w + np.frombuffer(batch.column("w")[0].as_py(), np.float64)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([n]), pa.array([w.tobytes()], pa.binary())], names=["g", "n", "w"])

    found = learnt.select("ids", "opens", F.xxhash64(F.col("doc_id").cast("string"), F.lit(23)).alias("draw")).mapInArrow(train, "g int, n double, w binary").repartition(16, "g").mapInArrow(total, "g int, n double, w binary").collect()  # at most 16 rows
    if not found:
        return weights
    mean = sum(np.frombuffer(bytes(r["w"]), np.float64) for r in found) / sum(r["n"] for r in found)
    parts = np.split(mean, np.cumsum([int(np.prod(s)) for s in shapes])[:-1])
    return {k: x.reshape(s).astype(np.float32) for k, x, s in zip(names, parts, shapes, strict=True)}


def lm_scores(documents: DataFrame, learn: Column, tokenizer: str, *, top_words: int = TOP_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score for each document; learn: which documents to learn from."""
    return _score(*_fit(_rows(documents, learn, id_col, text_col), tokenizer, top_words), id_col)


def score(documents: DataFrame, table: Table, counts: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return _score(table, counts, encoded(_rows(documents, F.lit(False), id_col, text_col), table), id_col)


def _score(table: Table, counts: DataFrame, held: DataFrame, id_col: str) -> DataFrame:
    kind = held.schema["doc_id"].dataType.simpleString()
    model = Table([], np.zeros(0, np.int64), table.total, table.distinct, table.ends, table.tokenizer)
    model.units, model.weights, model.class_sizes = table.units, table.weights, table.class_sizes
    sent = held.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def scored(batches):
        table = pickle.loads(sent.value).fitted()
        for batch in slices(batches, 256):
            scores = table.log_scores(*_unpacked(batch)) + batch.column("logs").to_numpy()
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("row", "doc_id", "n_tokens", "known", "base")), pa.array(scores)], names=["row", "doc_id", "n_tokens", "known", "base", "score"])

    found = held.select("row", "doc_id", "n_tokens", "known", "base", "logs", "ids", "opens").mapInArrow(scored, f"row long, doc_id {kind}, n_tokens long, known long, base double, score double")
    rare = held.select("row", F.explode("rare").alias("word"))
    c = F.coalesce(F.col("c"), F.lit(0))
    sums = rare.join(counts, "word", "left").groupBy("row").agg(F.sum(F.log10(c + 0.1)).alias("rare_logs"), F.count_if(c > 0).alias("rare_known"))
    whole = found.join(sums, "row", "left")
    return whole.select(
        F.col("doc_id").alias(id_col), "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"), F.lit(int(table.total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_logs", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("rare_logs", F.lit(0.0))).alias("score"),
    )
