"""Which texts hold which labels: a join on each label's rarest trigram, verified."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys up to which texts are reduced to them by a literal list.
MOST_LITERALS = 10_000
#: One text in so many, by a hash of its id, tells how common trigrams are. This decides which trigram is a key, and nothing else.
SAMPLE = 16


def grams(text: Column, n: int = 3) -> Column:
    """Distinct runs of n characters, overlapping ones too."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def _keys(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """label_id, label, key: the trigram of each label that fewest texts of the sample hold; a label of less is its own key."""
    each = labels.select("label_id", "label", F.explode(F.when(F.char_length("label") >= 3, grams(F.col("label"))).otherwise(F.array("label"))).alias("key"))
    drawn = texts.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).select(F.explode(grams(F.col("text"))).alias("key"))
    common = drawn.join(each.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("label_id").orderBy(F.coalesce("n", F.lit(0)), "key"))
    return each.join(common, "key", "left").withColumn("place", place).where("place = 1").select("label_id", "label", "key", F.char_length("key").alias("width"))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _met(labels: list[tuple[int, str, str]]):
    """Of batches of texts (id, text): id and number of each label (number, label, key) that is in a text; only labels whose key a text holds are looked for."""
    by_key: dict[str, list] = {}
    for number, label, key in labels:
        by_key.setdefault(key, []).append((number, label))
    short = [(n, x) for key, own in by_key.items() if len(key) < 3 for n, x in own]
    packed = lambda c: (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]  # noqa: E731, three code points of 21 bits each
    long = sorted((int(packed(_codes(key))[0]), key) for key in by_key if len(key) >= 3)
    values, own = np.array([v for v, _ in long], np.int64), [by_key[key] for _, key in long]
    mixed = lambda v: ((v * -7046029254386353131) >> 44) & 0xFFFFF
    seen = np.zeros(1 << 20, bool)
    seen[mixed(values)] = True

    def run(batches):
        for batch in batches:
            found: list[tuple] = []
            for i, text in zip(batch["id"], batch["text"], strict=True):
                c = _codes(text)
                if len(c) >= 3 and len(values):
                    grams_ = packed(c)
                    grams_ = np.unique(grams_[seen[mixed(grams_)]])
                    at = np.searchsorted(values, grams_)
                    for k in at[values[np.minimum(at, len(values) - 1)] == grams_]:
                        found += [(i, n) for n, label in own[k] if label in text]
                found += [(i, n) for n, label in short if label in text]
            yield pd.DataFrame(found, columns=["id", "number"])

    return run


def contained(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """id, label_id of texts (id, text) that hold a label (label_id, label), whatever the case; null or empty texts and labels meet nothing.

    A text's trigrams meet the keys of labels, of which a text holds few; only what meets is compared. Labels of one or two
    characters need a pass of their own, which is made only if there are any. Keys up to a number go to the texts as a list,
    so that other trigrams are dropped before they spread out; beyond that they meet by a join."""
    texts = texts.select("id", F.lower("text").alias("text")).where("text != ''")
    labels = labels.select("label_id", F.lower("label").alias("label")).where("label != ''").distinct()
    keys = _keys(texts, labels).persist()  # one row a label
    listed = [r[0] for r in keys.select("key").distinct().limit(MOST_LITERALS + 1).collect()]
    widths = sorted(r[0] for r in keys.select("width").distinct().collect())
    known = keys.select("label_id", "label", "key").limit(MOST_LITERALS + 1).collect()
    if 0 < len(known) <= MOST_LITERALS:  # labels as well as keys are few: texts don't spread out at all
        kind = lambda df, c: df.schema[c].dataType
        numbered = texts.sparkSession.createDataFrame([(n, r["label_id"]) for n, r in enumerate(known)], T.StructType([T.StructField("number", T.LongType()), T.StructField("label_id", kind(labels, "label_id"))]))
        met = texts.mapInPandas(_met([(n, r["label"], r["key"]) for n, r in enumerate(known)]), T.StructType([T.StructField("id", kind(texts, "id")), T.StructField("number", T.LongType())]))
        return met.join(F.broadcast(numbered), "number").select("id", "label_id").distinct()
    found = None
    for width in widths:
        own = grams(F.col("text"), width)
        if len(listed) <= MOST_LITERALS:
            own = F.array_intersect(own, F.array(*(F.lit(x) for x in listed if len(x) == width)))
        met = texts.select("id", "text", F.explode(own).alias("key")).join(keys.where(F.col("width") == width), "key")
        met = met.where(F.contains("text", F.col("label"))).select("id", "label_id")
        found = met if found is None else found.unionByName(met)
    return texts.sparkSession.createDataFrame([], f"id {texts.schema['id'].dataType.simpleString()}, label_id {labels.schema['label_id'].dataType.simpleString()}") if found is None else found.distinct()
