"""Token counts of documents in flat, unindexed token files, by a separator scan.

A file is a run of fixed-width little-endian ids in which an end-of-document id closes each document. Files are
read as blocks that know nothing of documents. Each block is searched for the end id as one array; a
prefix scan over block summaries (tokens, ends, last end) gives every block the place and the number
of the document that is open where it begins, and so joins documents that reach over blocks.

Defined results: tokens behind the last end id form a last document with closed = false; two ends in a row
enclose a document of 0 tokens; an empty file has no documents; a null or empty text is a document of 0
tokens; rows with a null id count like others; repeated rows give one result each; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, slices
from .packing import encoder

BLOCK_TOKENS = 1 << 20
END_ID = 50256
WIDTH = 2


def file_blocks(spark: SparkSession, path: str, *, width: int = WIDTH, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """file, block, data of the token files under a path, each no larger than Spark's binary reader allows."""

    def blocks(batches):
        step = width * block_tokens
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                raw = content.as_buffer()
                for k, at in enumerate(range(0, raw.size, step)):
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([k], pa.int64()), pa.array([raw.slice(at, min(step, raw.size - at)).to_pybytes()], pa.binary())], names=["file", "block", "data"])

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content").mapInArrow(blocks, "file string, block long, data binary")


def flatten(documents: DataFrame, tokenizer: str, *, end_id: int = END_ID, width: int = WIDTH, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The documents as flat token files, one for each partition, in blocks (file, block, data); and the order of the ids in each (file, chunk, ids)."""
    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def flat(batches):
        model, file = encoder(tokenizer), f"part-{TaskContext.get().partitionId():06d}"
        block, chunk, size = 0, 0, block_tokens * width
        ids_type = None

        def row(block, data, chunk, ids):
            return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([data], pa.binary()), pa.array([chunk], pa.int64()), pa.array([ids], pa.list_(ids_type))], names=["file", "block", "data", "chunk", "ids"])

        buffer = bytearray()
        for batch in slices(batches, 256):
            ids_type = batch.column("doc_id").type
            for text in batch.column("text").to_pylist():
                buffer += np.array([*(model.encode_ordinary(text) if text else ()), end_id], f"<u{width}").tobytes()
                while len(buffer) >= size:
                    yield row(block, bytes(buffer[:size]), None, None)
                    block += 1
                    del buffer[:size]
            yield row(None, None, chunk, batch.column("doc_id").to_pylist())
            chunk += 1
        if buffer:
            yield row(block, bytes(buffer), None, None)

    both = cut(rows.mapInArrow(flat, f"file string, block long, data binary, chunk long, ids array<{kind}>"))
    return both.where("block is not null").select("file", "block", "data"), both.where("chunk is not null").select("file", "chunk", "ids")


def count_tokens(blocks: DataFrame, *, end_id: int = END_ID, width: int = WIDTH) -> DataFrame:
    """file, ordinal (from 0), start (token number in the file), n_tokens (without the end id), closed."""

    def scan(batches):
        for batch in slices(batches, 1):
            ids = np.frombuffer(batch.column("data")[0].as_py(), f"<u{width}")
            ends = np.flatnonzero(ids == end_id)
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array([len(ids)], pa.int64()), pa.array([ends], pa.list_(pa.int64()))], names=["file", "block", "n", "ends"])

    found = cut(blocks.select("file", "block", "data").mapInArrow(scan, "file string, block long, n long, ends array<long>"))
    summary = found.select("file", "block", "n", F.size("ends").cast("long").alias("k"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = summary.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    placed = placed.withColumn("first", F.coalesce(F.sum("k").over(before), F.lit(0))).withColumn("open", F.coalesce(F.max(F.col("base") + F.col("last") + 1).over(before), F.lit(0)))
    placed = placed.withColumn("final", F.row_number().over(Window.partitionBy("file").orderBy(F.col("block").desc())) == 1)
    joined = found.select("file", "block", "ends").join(placed, ["file", "block"])
    end = F.transform("ends", lambda e: e + F.col("base"))
    stop = F.when(F.col("final"), F.concat(end, F.array(F.col("base") + F.col("n")))).otherwise(end)
    docs = joined.select("file", "first", "k", "open", stop.alias("stops")).select("file", "first", "k", "open", "stops", F.posexplode("stops").alias("i", "stop"))
    start = F.when(F.col("i") == 0, F.col("open")).otherwise(F.element_at("stops", F.col("i")) + 1)
    docs = docs.select("file", (F.col("first") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("stop") - start).alias("n_tokens"), (F.col("i") < F.col("k")).alias("closed"))
    return docs.where("closed or n_tokens > 0")


def document_tokens(documents: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", **shape) -> DataFrame:
    """id, n_tokens of each document, counted in the flat files of all documents."""
    blocks, names = flatten(documents, tokenizer, id_col=id_col, text_col=text_col, **shape)
    counted = count_tokens(blocks, **{k: v for k, v in shape.items() if k in ("end_id", "width")})
    sizes = names.select("file", "chunk", F.size("ids").cast("long").alias("n"))
    before = sizes.select("file", "chunk", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    order = names.join(before, ["file", "chunk"]).select("file", "base", F.posexplode("ids").alias("i", "doc_id")).select("file", (F.col("base") + F.col("i")).alias("ordinal"), "doc_id")
    return order.join(counted, ["file", "ordinal"]).select(F.col("doc_id").alias(id_col), "n_tokens")
