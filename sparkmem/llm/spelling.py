"""Groups of spelling variants: words one edit apart, each led to the far more frequent word beside it.

A word's mask holds the parity of each letter's count, letters dealt to 30 bits by code point. One inserted or deleted
letter flips one bit, a replaced one at most two, so of three bands of the mask one at least stays as it is. Words
meet by an equal band. A band alone has a few hundred values, so the key also holds what else such an edit leaves
alone: the shorter word's length (the length filter) and the half of the word that the edit isn't in. What meets is
held to two flipped bits and then to an edit distance of one. All of it is joins and aggregates of Spark's own.

Defined results: a null or empty text has no words; a null id is written as empty before the colon; repeated rows count
each; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, forget

#: Maximal runs of these are words, A-Z lower-cased.
LETTERS = r"A-Za-zÀ-ÿ"
#: Code points and occurrences that a word must have.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: How many times as frequent as a word its form must be.
FACTOR = 10
#: Bits of a mask; bit i belongs to band i % BANDS.
BITS, BANDS = 30, 3
BAND_BITS = [sum(1 << i for i in range(BITS) if i % BANDS == k) for k in range(BANDS)]


def slipped(doc_id: Column, run: Column, every: int) -> Column:
    """The run without one of its code points where every divides its checksum in the document."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.char_length(run)).cast("int")
    return F.when(F.pmod(h, F.lit(every)) == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def word_counts(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", every: int = 31) -> DataFrame:
    """word, n: words of at least LEAST_LENGTH code points and LEAST_COUNT occurrences. every = 0 leaves the runs as they are."""
    runs = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}"), F.lit(0))
    found = documents.select(F.col(id_col).alias("d"), F.explode(runs).alias("r"))
    found = found.select("d", F.translate("r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("r"))
    word = slipped(F.col("d"), F.col("r"), every) if every else F.col("r")
    counted = found.select(word.alias("word")).where(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


def parity_mask(word: Column) -> Column:
    """One bit for each letter (code point modulo BITS): whether the word holds it an odd number of times."""
    return F.aggregate(F.split(word, ""), F.lit(0), lambda m, x: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1), F.pmod(F.ascii(x), F.lit(BITS)))))


def _keys(length: Column) -> list[Column]:
    """Keys of a word seen as having, or being compared with a word of, this length: bands by the half left alone."""
    half = F.floor(length / 2).cast("int")
    sides = [F.substring("word", F.lit(1), half), F.substring(F.col("word"), F.col("size") - length + half + 1, length)]
    return [F.xxhash64(F.lit(k), F.lit(side), length, F.col("mask").bitwiseAND(F.lit(BAND_BITS[k])), kept) for k in range(BANDS) for side, kept in enumerate(sides)]


def near_pairs(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: each two words that differ by exactly one inserted, deleted or replaced code point, once."""
    held = words.withColumns({"size": F.char_length("word"), "mask": parity_mask(F.col("word"))})
    own, longer = _keys(F.col("size")), _keys(F.col("size") - 1)
    a = held.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("mask").alias("mask_a"), F.explode(F.array(*own)).alias("key"))
    # a word also meets the words one shorter, of which it may be a longer form
    roles = F.explode(F.array(*(F.struct(F.lit(i).alias("long"), k.alias("key")) for i, keys in enumerate((own, longer)) for k in keys)))
    b = held.select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("mask").alias("mask_b"), roles.alias("as")).select("b", "n_b", "mask_b", "as.long", "as.key")
    flips = F.bit_count(F.col("mask_a").bitwiseXOR(F.col("mask_b"))) <= 2
    met = (a["key"] == b["key"]) & flips & ((F.col("long") == 1) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)
    return a.join(b, met).select("a", "n_a", "b", "n_b").dropDuplicates(["a", "b"])


def spelling_groups(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", every: int = 31, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n: each word with the most frequent word beside it, if that is factor times as frequent."""
    words = cut(word_counts(documents, id_col=id_col, text_col=text_col, every=every))
    both = F.explode(F.array(*(F.struct(F.col(x).alias("word"), F.struct((-F.col(f"n_{y}")).alias("less"), F.col(y).alias("form")).alias("beside")) for x, y in ("ab", "ba"))))
    beside = near_pairs(words).select(both.alias("p")).groupBy("p.word").agg(F.count("*").alias("n_near"), F.min("p.beside").alias("best"))
    led = -F.col("best.less") >= factor * F.col("n")
    forms = cut(
        words.join(beside, "word", "left").select(
            "word", F.when(led, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(led, -F.col("best.less")).alias("form_n")
        )
    )
    forget(words)
    return forms.join(roots(forms.where("form is not null").select("word", "form")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(links: DataFrame) -> DataFrame:
    """word, root: the last of the forms that links lead to. Each round doubles the steps; counts grow with every step, so there are few."""
    now = cut(links.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = cut(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        forget(now)
        if after.where("moved").isEmpty():
            return after.drop("moved")
        now = after.drop("moved")
        now.written_to = after.written_to
