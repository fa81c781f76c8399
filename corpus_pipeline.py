"""A training-data pipeline over the documents table: each stage calls one operator and hands on what it keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmem.llm.catalogue import PACKING_VOCABULARY, vocabulary
from sparkmem.llm.common import cut, free, table
from sparkmem.llm.decontaminate import decontaminate
from sparkmem.llm.jaccard import jaccard_groups
from sparkmem.llm.langid import fit, predict
from sparkmem.llm.linededup import line_dedup
from sparkmem.llm.packing import pack

#: Share of the letters that must be in one language.
LANGUAGE_SHARE = 0.4
#: Near duplicates: words in a shingle and Jaccard similarity in hundredths.
SHINGLE_WORDS, SIMILARITY = 5, 80


def _held(docs: DataFrame) -> dict[str, str]:
    """Names for the columns that pass an operator, so that none clashes with what it adds."""
    return {x: f"held_{i}" for i, x in enumerate(docs.columns) if x not in ("doc_id", "text")}


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters that are mostly in one language, their lang set to it; the others go."""
    held = _held(docs)
    found = predict(docs.withColumnsRenamed(held), fit(docs), carry=("text", *held.values()))
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LANGUAGE_SHARE))
    return kept.select(*(F.col("lang_pred" if x == "lang" else held.get(x, x)).alias(x) for x in docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines that an earlier one has; those with nothing left go."""
    found, removed = line_dedup(docs), free("_n_removed", docs.columns)
    left = F.trim(F.regexp_replace("text", r"\s+", " ")) != ""
    reduced = found.where((F.col(removed) == 0) | left)
    size = F.when(F.col(removed) > 0, F.char_length("text")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return (reduced if size is None else reduced.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates; repeated rows once."""
    groups = jaccard_groups(docs, n=SHINGLE_WORDS, percent=SIMILARITY)
    heads = groups.where(F.col("component_id") == F.col("doc_id")).select("doc_id").distinct()
    kept = docs.join(heads, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
    return kept.dropDuplicates(["doc_id", "text"]).select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    held = _held(docs)
    found = decontaminate(docs.withColumnsRenamed(held), table(spark, sf_dir, "benchmark"), carry=("text", *held.values()))
    return found.where(~F.col("contaminated")).select(*(F.col(held.get(x, x)).alias(x) for x in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    return pack(docs, vocabulary(PACKING_VOCABULARY))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("packing", packing)]

#: SQL can't express the language model, the alignment and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
