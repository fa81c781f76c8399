"""Exact top-k inner products with a KD-tree per shard.

Vectors are scaled to integers and dealt to shards by a hash of their id. Each shard splits its vectors at the
median of the widest dimension down to small leaves and keeps the tight bounding box of every node. The
upper bound of a box for a query takes, in each dimension, the box's end that the query's sign favours. Blocks of
queries walk down the trees, dropping boxes below the query's k-th score so far, and visit the remaining leaves best
first until the next bound falls below it. Every block first searches one shard; the k-th scores found there
start the search of all others.

Defined results: vectors that are null, have a null id or hold null or non-finite components take no part; vectors of
different length aren't compared; of rows with equal id the smallest vector counts, and a query's id is never its own result;
equal scores go to the smaller id; fewer than k candidates give fewer rows; an empty table gives an empty
result; further columns are ignored. Scores must fit 64 bits.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

K, SCALE = 5, 256
SHARD_ROWS, LEAF_ROWS, BLOCK_ROWS = 8192, 128, 512


def _compact(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.int16) if codes.size == 0 or (codes.min() >= -(1 << 15) and codes.max() < 1 << 15) else codes


def _exact(codes: np.ndarray) -> np.ndarray:
    """As float64 where products stay exact in it, else as int64."""
    top = float(np.abs(codes.astype(np.float64)).max()) if codes.size else 0.0
    return codes.astype(np.float64) if top * top * max(1, codes.shape[1]) < 2**52 else codes.astype(np.int64)


def _rows(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and codes, one row an id, sorted."""
    ids = group.column("id").to_numpy()
    dim = group.column("dim")[0].as_py()
    codes = group.column("codes").combine_chunks().flatten().to_numpy().reshape(len(ids), dim)
    order = np.lexsort((*codes.T[::-1], ids))
    ids, codes = ids[order], codes[order]
    first = np.concatenate(([True], ids[1:] != ids[:-1]))
    return ids[first], codes[first]


def build_tree(ids: np.ndarray, codes: np.ndarray, leaf: int = LEAF_ROWS) -> dict:
    """Ids and codes in leaf order; levels of nodes, each with boxes and row ranges (children of i: 2i and 2i + 1)."""
    order = np.arange(len(ids))
    ranges = [(0, len(ids))]
    levels = []
    while True:
        low = np.array([codes[order[a:b]].min(axis=0) if b > a else np.zeros(codes.shape[1], codes.dtype) for a, b in ranges])
        high = np.array([codes[order[a:b]].max(axis=0) if b > a else np.zeros(codes.shape[1], codes.dtype) for a, b in ranges])
        levels.append((_compact(low), _compact(high), np.array(ranges)))
        if max(b - a for a, b in ranges) <= leaf:
            break
        halves = []
        for (a, b), lo, hi in zip(ranges, low, high, strict=True):
            half = (a + b) // 2
            if b - a > 1 and codes.shape[1]:
                own = order[a:b]
                order[a:b] = own[np.argpartition(codes[own, int((hi.astype(np.int64) - lo).argmax())], half - a)]
            halves += [(a, half), (half, b)]
        ranges = halves
    return {"ids": ids[order], "codes": _compact(codes[order]), "levels": levels}


def search(tree: dict, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query number, id and score of each query's k best rows of the tree that reach its floor."""
    ids, codes = tree["ids"], tree["codes"]
    both = _exact(np.concatenate((codes.astype(np.int64), queries)))
    codes, queries = both[: len(codes)], both[len(codes) :]
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    nq = len(queries)
    alive = np.ones((nq, 1), bool)
    for depth, (low, high, ranges) in enumerate(tree["levels"]):
        if depth:
            alive = np.repeat(alive, 2, axis=1)
        bound = np.full(alive.shape, -np.inf)
        at = np.flatnonzero(alive.any(axis=0) & (ranges[:, 1] > ranges[:, 0]))
        bound[:, at] = up @ high[at].T.astype(both.dtype) + down @ low[at].T.astype(both.dtype)
        alive &= bound >= floor[:, None]
    bound[~alive] = -np.inf
    best_score = np.full((nq, k), -np.inf) if both.dtype == np.float64 else np.full((nq, k), np.iinfo(np.int64).min)
    best_id = np.full((nq, k), np.iinfo(np.int64).max)
    filled = np.zeros((nq, k), bool)
    kth = floor.copy()
    order = np.argsort(-bound, axis=1, kind="stable")
    for nth in range(order.shape[1]):
        leaf = order[:, nth]
        reach = bound[np.arange(nq), leaf]
        go = np.flatnonzero((reach > -np.inf) & (reach >= kth))
        if not len(go):
            break
        go = go[np.argsort(leaf[go], kind="stable")]
        for part in np.split(go, np.flatnonzero(np.diff(leaf[go])) + 1):
            a, b = ranges[leaf[part[0]]]
            score = queries[part] @ codes[a:b].T
            ok = (score >= kth[part, None]) & (ids[a:b][None, :] != query_ids[part, None])
            some = ok.any(axis=1)
            if not some.any():
                continue
            part, score, ok = part[some], score[some], ok[some]
            all_score = np.concatenate((best_score[part], score), axis=1)
            all_id = np.concatenate((best_id[part], np.broadcast_to(ids[a:b], score.shape)), axis=1)
            all_ok = np.concatenate((filled[part], ok), axis=1)
            rank = np.lexsort((all_id, -all_score, ~all_ok), axis=1)[:, :k]
            best_score[part], best_id[part], filled[part] = (np.take_along_axis(x, rank, axis=1) for x in (all_score, all_id, all_ok))
            full = filled[part, k - 1]
            kth[part[full]] = np.maximum(kth[part[full]], best_score[part[full], k - 1])
    q, n = np.nonzero(filled)
    return q, best_id[q, n], best_score[q, n].astype(np.int64)


def _pack(group: pa.Table, what: str) -> pa.Table:
    ids, codes = _rows(group)
    if what == "tree":
        held = build_tree(ids, codes)
    else:
        floor = dict(zip(group.column("id").to_pylist(), group.column("floor").to_pylist(), strict=True))
        held = {"ids": ids, "codes": _compact(codes), "floor": np.array([-np.inf if floor[i] is None else float(floor[i]) for i in ids.tolist()])}
    return pa.table({"dim": pa.array([group.column("dim")[0].as_py()], pa.int32()), "part": pa.array([group.column("part")[0].as_py()], pa.int64()), what: pa.array([pickle.dumps(held, 5)], pa.binary())})


def _part(column: str, rows: int, sizes: dict[int, int]) -> Column:
    out = F.lit(1)
    for dim, n in sizes.items():
        out = F.when(F.col("dim") == dim, F.lit(max(1, -(-n // rows)))).otherwise(out)
    return F.pmod(F.xxhash64(column), out)


def top_k(vectors: DataFrame, is_query: Column, *, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank from 1, id, score: the k best rows of each query row by inner product of the scaled vectors."""
    spark = vectors.sparkSession
    x = F.col(vector_col).cast("array<double>")
    whole = F.col(id_col).isNotNull() & x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = cut(
        vectors.where(whole).select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("query"), F.size(x).alias("dim"), F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("long")).alias("codes"))
    )
    counted = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("query").alias("q")).collect()  # a row for each vector length
    sizes, asked = {r["dim"]: r["n"] for r in counted}, {r["dim"]: r["q"] for r in counted}
    trees = cut(rows.withColumn("part", _part("id", SHARD_ROWS, sizes)).groupBy("dim", "part").applyInArrow(lambda g: _pack(g, "tree"), "dim int, part long, tree binary"))
    shards = F.lit(1)
    for dim, n in sizes.items():
        shards = F.when(F.col("dim") == dim, F.lit(max(1, -(-n // SHARD_ROWS)))).otherwise(shards)
    queries = rows.where("query").select("id", "dim", "codes").withColumn("part", _part("id", BLOCK_ROWS, asked))

    def visit(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                tree, block = pickle.loads(batch.column("tree")[at].as_py()), pickle.loads(batch.column("block")[at].as_py())
                q, ids, scores = search(tree, block["ids"], block["codes"].astype(np.int64), block["floor"], k)
                yield pa.RecordBatch.from_arrays([pa.array(block["ids"][q]), pa.array(ids), pa.array(scores)], names=["query_id", "id", "score"])

    def searched(blocks: DataFrame, where: Column) -> DataFrame:
        met = blocks.withColumn("shard", F.explode(where)).join(trees.withColumnRenamed("part", "shard"), ["dim", "shard"])
        return met.select("tree", "block").mapInArrow(visit, "query_id long, id long, score long")

    packed = lambda df: df.groupBy("dim", "part").applyInArrow(lambda g: _pack(g, "block"), "dim int, part long, block binary")
    home = F.pmod(F.col("part"), shards)
    first = cut(searched(packed(queries.withColumn("floor", F.lit(None).cast("long"))), F.array(home)))
    floors = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("floor")).withColumnRenamed("query_id", "id")
    others = F.filter(F.sequence(F.lit(0).cast("long"), shards.cast("long") - 1), lambda s: s != home)
    rest = searched(packed(queries.join(floors, "id", "left")), others)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    best = first.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("id").alias(id_col), "score")
