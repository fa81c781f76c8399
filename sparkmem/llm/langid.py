"""Language identification of mixed-language text.

Learning: byte trigrams of the words of labelled documents, hashed to a table per language, and the
scripts that each language's letters use. Predicting: every word gets a score per language, languages
whose scripts the word does not use are set aside, and a Viterbi path with a penalty for each switch
labels the words; runs of one label are the spans. The language of most letters is the document's.

Defined results: a text that is null or has no letter is ``und`` with score 0 and no spans; with nothing
to learn from, every document is ``und``; a word in a script that no learned language uses keeps all
languages as candidates; ties go to the language first in alphabetical order; repeated rows give one
result each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Labelled documents per language that the classifier is fitted on, at most (a sample by hash of the id).
FIT_ROWS = 4000
TABLE = 1 << 16
SWITCH_PENALTY = 20.0
#: How far a word may speak against a language, as a natural logarithm.
WORD_RANGE = 8.0
#: A script is a language's own from this share of its letters on.
SCRIPT_SHARE = 0.005
#: Upper bound of a script's code points: Latin, Greek, Cyrillic, Armenian to Thai, kana, Han, Hangul, others.
SCRIPT_BOUNDS = np.array([0x250, 0x370, 0x400, 0x530, 0x590, 0x600, 0x900, 0x980, 0xE00, 0xE80, 0x1100, 0x2000, 0x3040, 0x3100, 0x4E00, 0xA000, 0xAC00, 0xD7B0, 0x20000, 0x110000])

_word = regex.compile(r"[\p{L}\p{M}]+")
_letter = regex.compile(r"\p{L}")


def tokens(text: str) -> list[str]:
    return _word.findall(text.lower())


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of the words with a space at each end, and where each word's trigrams begin."""
    joined = np.frombuffer((" " + " ".join(words) + " ").encode(), np.uint8).astype(np.uint32)
    code = (joined[:-2] * np.uint32(0x9E3779B1) + joined[1:-1] * np.uint32(0x85EBCA77) + joined[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(16)
    begins = np.flatnonzero(joined[:-1] == 32)
    keep = np.ones(len(code), bool)
    inner = begins[1:] - 1  # a trigram over two words
    keep[inner[inner >= 0]] = False
    first = begins - np.arange(len(begins))
    return code[keep], first[: len(words)]


def scripts(words: list[str]) -> np.ndarray:
    """The script of each word, by its first letter."""
    points = np.array([ord(w[0]) for w in words], np.uint32)
    return np.searchsorted(SCRIPT_BOUNDS, points, side="right")


class Model:
    """Word scores and candidate scripts of the learned languages, in alphabetical order."""

    def __init__(self, langs: list[str], counts: np.ndarray, letters: np.ndarray):
        self.langs = langs
        total = counts.sum(axis=1, keepdims=True)
        self.table = np.log((counts + 0.5) / (total + 0.5 * TABLE)).T.astype(np.float32).copy() if langs else np.zeros((TABLE, 0), np.float32)
        share = letters / np.maximum(letters.sum(axis=1, keepdims=True), 1)
        self.uses = (share >= SCRIPT_SHARE).T.copy() if langs else np.zeros((len(SCRIPT_BOUNDS) + 1, 0), bool)
        self.uses[~self.uses.any(axis=1)] = True

    def scores(self, words: list[str]) -> np.ndarray:
        code, first = _codes(words)
        score = np.add.reduceat(self.table[code], first, axis=0)
        score = np.maximum(score - score.max(axis=1, keepdims=True), np.float32(-WORD_RANGE))
        return np.where(self.uses[scripts(words)], score, np.float32(-1e6))


def viterbi(scores: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """The best label of each word; a switch of label costs the penalty, ties keep the smaller label."""
    sums = scores.sum(axis=0, dtype=np.float64)
    best = int(sums.argmax())
    # A path with m stays in other labels has m - 1 switches at least, and m or more if m is 1 and best occurs: where no
    # stretch of any label gains more than half a switch, m stays gain no more than m / 2 <= m - 1 switches from m = 2 on.
    # One stay without best is the constant path of that label, whose sum is no larger.
    gain = np.zeros((len(scores) + 1, scores.shape[1]))
    np.cumsum(scores - scores[:, best : best + 1], axis=0, dtype=np.float64, out=gain[1:])
    if (gain - np.minimum.accumulate(gain, axis=0)).max() <= penalty / 2:
        return np.full(len(scores), best)
    n, k = scores.shape
    came = np.zeros((n, k), np.int16)
    at = scores[0].astype(np.float64)
    rows = scores.astype(np.float64)
    own = np.arange(k)
    for t in range(1, n):
        top = int(at.argmax())
        switch = at[top] - penalty
        stay = at >= switch
        came[t] = np.where(stay, own, top)
        at = np.where(stay, at, switch) + rows[t]
    label = np.empty(n, np.int64)
    label[-1] = int(at.argmax())
    for t in range(n - 1, 0, -1):
        label[t - 1] = came[t, label[t]]
    return label


def _learn(batches):
    """Trigram and script counts of the sampled rows of each language."""
    found: dict[str, list[np.ndarray]] = {}
    for batch in slices(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if words := tokens(text):
                counts, letters = found.setdefault(lang, [np.zeros(TABLE, np.int64), np.zeros(len(SCRIPT_BOUNDS) + 1, np.int64)])
                counts += np.bincount(_codes(words)[0], minlength=TABLE)
                letters += np.bincount(scripts(words), minlength=len(letters))
    for lang, (counts, letters) in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([counts.tobytes()], pa.binary()), pa.array([letters.tobytes()], pa.binary())], names=["lang", "counts", "letters"])


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> Model:
    """Learn from at most about fit_rows documents of each language, chosen by a hash of their ids."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(7)), F.lit(1 << 30)).alias("draw")
    )
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(int(min(1.0, fit_rows / n) * (1 << 30)))).otherwise(share)
    parts = max(1, min(16, sum(min(n, fit_rows) for n in sizes.values()) // 1000))
    learned = rows.where(F.col("draw") < share).select("lang", "text").coalesce(parts).mapInArrow(_learn, "lang string, counts binary, letters binary")
    counts: dict[str, np.ndarray] = {}
    letters: dict[str, np.ndarray] = {}
    for r in learned.collect():  # at most 16 rows a language
        counts[r["lang"]] = counts.get(r["lang"], 0) + np.frombuffer(bytes(r["counts"]), np.int64)
        letters[r["lang"]] = letters.get(r["lang"], 0) + np.frombuffer(bytes(r["letters"]), np.int64)
    langs = sorted(counts)
    return Model(langs, np.array([counts[x] for x in langs], np.float64).reshape(len(langs), TABLE), np.array([letters[x] for x in langs], np.float64).reshape(len(langs), len(SCRIPT_BOUNDS) + 1))


def label(text: str | None, model: Model, penalty: float = SWITCH_PENALTY) -> tuple[str, float, list[dict]]:
    """Language, score and spans (language, first word, end word) of one text."""
    words = tokens(text) if text else []
    if not words or not model.langs or not (_letter.search(text)):
        return "und", 0.0, []
    path = viterbi(model.scores(words), penalty)
    weight = np.bincount(path, np.fromiter(map(len, words), np.float64, len(words)), len(model.langs))
    best = int(weight.argmax())
    edges = np.concatenate(([0], np.flatnonzero(np.diff(path)) + 1, [len(path)]))
    spans = [{"lang": model.langs[path[a]], "first_word": int(a), "end_word": int(b)} for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return model.langs[best], float(weight[best] / weight.sum()), spans


SPANS = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64())]))


def predict(documents: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", penalty: float = SWITCH_PENALTY, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, lang_pred, score (share of letters in that language), spans; then the columns to carry."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    kind = documents.schema[id_col].dataType.simpleString()
    kept = [f"carried{i}" for i in range(len(carry))]

    def tag(batches):
        for batch in slices(batches):
            found = [label(t, sent.value, penalty) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x for x, _, _ in found], pa.string()), pa.array([x for _, x, _ in found], pa.float64()), pa.array([x for _, _, x in found], SPANS), *(batch.column(x) for x in kept)],
                names=["doc_id", "lang_pred", "score", "spans", *kept],
            )

    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(x).alias(y) for x, y in zip(carry, kept, strict=True)))
    more = "".join(f", {y} {documents.schema[x].dataType.simpleString()}" for x, y in zip(carry, kept, strict=True))
    found = rows.mapInArrow(tag, f"doc_id {kind}, lang_pred string, score double, spans array<struct<lang:string,first_word:long,end_word:long>>{more}")
    return found.select(F.col("doc_id").alias(id_col), "lang_pred", "score", "spans", *(F.col(y).alias(x) for x, y in zip(carry, kept, strict=True)))
