"""What the training-data operators share: table reading, lineage cuts, blobs of numpy arrays."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(name: str, taken: Iterable[str]) -> str:
    """The name, behind as many underscores as it takes not to clash with those taken (case doesn't count)."""
    held = {x.lower() for x in taken}
    while name.lower() in held:
        name = "_" + name
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        where = tempfile.mkdtemp(prefix="sparkmem-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where.rstrip("/")


#: Spark's own setting by which a query's shuffle files go as soon as it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again, so that a lost executor costs no recomputation.

    Once it is written, nothing needs the shuffle files of the plan, so they are removed with the query."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    settle(spark)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def settle(spark: SparkSession) -> None:
    """Let go of the shuffle files of plans that nothing holds any more."""
    gc.collect()
    spark._jvm.System.gc()


def forget(*written: DataFrame) -> None:
    """Delete what cut() wrote, once nothing will read it any more."""
    for df in written:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, which bounds what a worker holds."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(batch: pa.RecordBatch, column: int | str) -> list[bytes]:
    """UTF-8 bytes of a text column; null counts as empty."""
    return [b"" if x is None else x for x in batch.column(column).cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def lower_ascii(text: bytes) -> bytes:
    return text.translate(_LOWER)


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the true runs of a boolean array."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def blank_words(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ in a buffer of bytes."""
    return runs(~_SPACE[buffer])


def spans(buffer: bytes, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Arrow's array of the byte ranges, which are in order and apart."""
    if not len(starts):
        return pa.array([], pa.large_binary())
    edges = np.empty(2 * len(starts), np.int64)
    edges[::2], edges[1::2] = starts, ends
    between = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(buffer)])
    return between.take(pa.array(np.arange(0, len(edges), 2)))


#: Odd multiplier of the polynomial word hash.
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def word_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges: a polynomial over the bytes, scrambled with the length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = ends - starts
    powers = np.ones(max(int(n.max()), 1), np.uint64)
    np.multiply.accumulate(np.full(len(powers) - 1, BASE, np.uint64), out=powers[1:]) if len(powers) > 1 else None
    where = np.repeat(starts, n) + (inner := np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
    values = (buffer[where].astype(np.uint64) + np.uint64(1)) * powers[inner]
    return mix(np.add.reduceat(values, np.cumsum(n) - n) ^ (n.astype(np.uint64) << np.uint64(48)))
