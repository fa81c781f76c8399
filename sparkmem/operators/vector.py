"""Cosine and inner-product top-k, quantised scans, plan choice and near duplicates."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import cut

MOST_QUERIES = 1024  # queries that are broadcast; more are searched in blocks
BLOCK_ROWS = 65_536  # vectors in a block, about
CHUNK = 4096  # vectors that are multiplied at once
EXACT_SHARE, EXACT_ROWS = 8, 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where sizes differ or a norm is 0."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size).otherwise(0.0)


def upsert_vectors(old: DataFrame, new: DataFrame, dims: int, strict: bool = False) -> DataFrame:
    """Vectors by id, the last of a batch counting; of another size they are dropped, or raise if strict."""
    ok = F.size("embedding") == dims
    new = new.withColumn("embedding", F.when(ok, F.col("embedding")).otherwise(F.raise_error(F.lit("dimension mismatch")))) if strict else new.where(ok)
    last = new.groupBy("id").agg(F.max_by("embedding", "seq").alias("embedding"))
    return old.join(last, "id", "left_anti").select("id", "embedding").unionByName(last)


def _each_block(vectors: DataFrame, queries: DataFrame, asked: pd.DataFrame, match: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """match(queries, vectors) over all pairs; asked is the queries if they are few, which are then broadcast.

    More of them are dealt in blocks by hash, and so are the vectors; every pair of blocks is one call."""
    if len(asked) <= MOST_QUERIES:
        return vectors.mapInPandas(lambda batches: (match(asked, batch) for batch in batches), schema)
    most, rows = -(-queries.count() // MOST_QUERIES), max(1, -(-vectors.count() // BLOCK_ROWS))
    part = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    left = vectors.withColumn("_v", part("id", rows)).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    right = queries.withColumn("_q", part("qid", most)).withColumn("_v", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    return left.groupBy("_v", "_q").cogroup(right.groupBy("_v", "_q")).applyInPandas(lambda v, q: match(q, v), schema)


def _leading(asked: int, chunks, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row of the query, id, score and a value beside it of each query's k best, smaller ids first on ties.

    chunks: (rows of queries, ids, scores, values), one row a query; scores of -inf take no part. Between chunks only the best are kept."""
    at, ids, best, beside = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    floor = np.full(asked, -np.inf)
    for rows, names, scores, values in chunks:
        low = floor[rows]
        if scores.shape[1] > k:
            low = np.maximum(low, np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k])
        i, j = np.nonzero((scores >= low[:, None]) & (scores > -np.inf))
        at, ids = np.concatenate([at, rows[i]]), np.concatenate([ids, names[j]])
        best, beside = np.concatenate([best, scores[i, j]]), np.concatenate([beside, values[i, j]])
        order = np.lexsort((ids, -best, at))
        sizes = np.bincount(at, minlength=asked)
        nth = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at, ids, best, beside = (x[order][nth < k] for x in (at, ids, best, beside))
        full = nth[nth < k] == k - 1
        floor[at[full]] = best[full]
    return at, ids, best, beside


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int, *, metric: str = "cosine", threshold: float | None = None, rescale: bool = False, exclude_self: bool = False) -> DataFrame:
    """qid, id, score, position: the k best rows of each query by one block product a batch, then by rank.

    queries: (qid, vector), broadcast up to MOST_QUERIES, else in blocks; vectors: (id, embedding) filtered before."""
    queries = queries.select("qid", "vector")
    asked = queries.limit(MOST_QUERIES + 1).toPandas()
    if not len(asked):
        return vectors.sparkSession.createDataFrame([], "qid long, id long, score double, position int")

    def scores(asked: pd.DataFrame, batch: pd.DataFrame):
        sizes = asked["vector"].map(len)
        for at in range(0, len(batch), CHUNK):
            some = batch.iloc[at : at + CHUNK]
            for dim, rows in some.groupby(some["embedding"].map(len)):
                of = np.flatnonzero(sizes == dim)
                if not len(of):
                    continue
                q = np.array(asked["vector"].iloc[of].tolist(), np.float64)
                m = np.array(rows["embedding"].tolist(), np.float64)
                if metric == "cosine":
                    qn, mn = np.linalg.norm(q, axis=1), np.linalg.norm(m, axis=1)
                    s = (q @ m.T) / np.where(qn == 0, 1, qn)[:, None] / np.where(mn == 0, 1, mn)
                    s[:, mn == 0] = np.nan if rescale else 0
                else:
                    s = q @ m.T
                if rescale:
                    s = (s + 1) / 2
                ids, qids = rows["id"].to_numpy(), asked["qid"].to_numpy()[of]
                if exclude_self:
                    s[qids[:, None] == ids[None, :]] = np.nan
                if threshold is not None:
                    s[s < min(max(threshold, 0.0), 1.0)] = np.nan
                s = np.nan_to_num(s, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
                yield of, ids, s, s

    def match(asked: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
        at, ids, best, _ = _leading(len(asked), scores(asked, batch), k)
        return pd.DataFrame({"qid": asked["qid"].to_numpy(np.int64)[at], "id": ids, "score": best})

    part = _each_block(vectors.select("id", "embedding").where("embedding is not null"), queries, asked, match, "qid long, id long, score double")
    return part.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("id")))).where(F.col("position") <= k)


def scan_plan(total: int, matching: int) -> str:
    """none, exact (few matches, of a small share) or constrained."""
    if matching == 0:
        return "none"
    return "exact" if matching * EXACT_SHARE <= total and matching <= EXACT_ROWS else "constrained"


def filter_probe(vectors: DataFrame, predicate: Column) -> DataFrame:
    """total, matching and the plan for it."""
    n = vectors.agg(F.count("*").alias("total"), F.count_if(predicate).alias("matching"))
    plan = F.when(F.col("matching") == 0, "none").when((F.col("matching") * EXACT_SHARE <= F.col("total")) & (F.col("matching") <= EXACT_ROWS), "exact").otherwise("constrained")
    return n.withColumn("plan", plan)


def quantise(vector: np.ndarray, energy: float = 0.999) -> tuple[int, float, np.ndarray]:
    """Dimensions kept, scale, and int8 codes of a unit vector's prefix that holds the energy; halves round away from 0."""
    size = np.linalg.norm(vector)
    if not np.isfinite(size) or size == 0:
        return 0, 0.0, np.zeros(0, np.int8)
    unit = vector / size
    dims = int(np.searchsorted(np.cumsum(unit * unit), energy) + 1)
    head = unit[:dims]
    scale = float(np.abs(head).max()) / 127 or 1.0
    x = head / scale
    return min(dims, len(vector)), scale, np.clip(np.sign(x) * np.floor(np.abs(x) + 0.5), -127, 127).astype(np.int8)


@F.pandas_udf(T.StructType([T.StructField("dims", T.IntegerType()), T.StructField("scale", T.FloatType()), T.StructField("codes", T.BinaryType())]))
def quantised(v: pd.Series) -> pd.DataFrame:
    rows = [quantise(np.asarray(x, np.float64)) for x in v]
    return pd.DataFrame({"dims": [d for d, _, _ in rows], "scale": [s for _, s, _ in rows], "codes": [c.tobytes() for _, _, c in rows]})


def quantised_topk(vectors: DataFrame, queries: DataFrame, k: int, *, threshold: float = 0.0, coarse: float = 0.75, least: int = 512, factor: int = 16) -> DataFrame:
    """Two passes over int8 codes (id, q): three quarters of the kept dimensions make a shortlist, all of them the order."""
    queries = queries.select("qid", "vector")
    asked = queries.limit(MOST_QUERIES + 1).toPandas()
    if not len(asked):
        return vectors.sparkSession.createDataFrame([], "qid long, id long, score double, position int")
    shortlist = max(factor * k, least)

    def scores(q: np.ndarray, batch: pd.DataFrame):
        for at in range(0, len(batch) if len(q) else 0, CHUNK):
            some = batch.iloc[at : at + CHUNK]
            m = np.zeros((len(some), q.shape[1]))
            head = np.zeros_like(m)
            for i, (dims, scale, codes) in enumerate(zip(some["dims"], some["scale"], some["codes"], strict=True)):
                c = np.frombuffer(codes, np.int8).astype(np.float64) * scale
                m[i, :dims] = c
                n = int(np.ceil(dims * coarse))
                head[i, :n] = c[:n]
            yield np.arange(len(q)), some["id"].to_numpy(), q @ head.T, q @ m.T

    def match(asked: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
        q = np.array(asked["vector"].tolist(), np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=-1, keepdims=True), 1e-300)
        at, ids, rough, score = _leading(len(asked), scores(q, batch), shortlist)
        return pd.DataFrame({"qid": asked["qid"].to_numpy(np.int64)[at], "id": ids, "rough": rough, "score": score})

    part = _each_block(vectors.select("id", "q.dims", "q.scale", "q.codes").where("dims > 0"), queries, asked, match, "qid long, id long, rough double, score double")
    near = part.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rough"), F.asc("id")))).where(F.col("r") <= shortlist)
    kept = near.where(F.col("score") >= threshold)
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("id")))).where(F.col("position") <= k).select("qid", "id", "score", "position")


def prefix_rerank(vectors: DataFrame, queries: DataFrame, k: int, *, share: float = 0.5, pool: int = 50) -> DataFrame:
    """The pool best by the half-precision prefix, ordered by the whole vectors."""

    @F.pandas_udf("array<float>")
    def half(v: pd.Series) -> pd.Series:
        return v.map(lambda x: np.asarray(x[: max(1, int(len(x) * share))], np.float16).astype(np.float32))

    rough = exact_topk(vectors.select("id", half("embedding").alias("embedding")), queries.select("qid", half("vector").alias("vector")), pool)
    joined = rough.select("qid", "id").join(queries.select("qid", "vector"), "qid").join(vectors.select("id", "embedding"), "id").select("qid", "id", cosine(F.col("vector"), F.col("embedding")).alias("score"))
    return joined.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("id")))).where(F.col("position") <= k)


#: Near duplicates: vectors of a block, centres at most, widths of a ring within the threshold's angle, vectors of a shelf, pairs of blocks looked at together.
BLOCK, MOST_CENTRES, RINGS, SHELF, AT_ONCE = 1024, 512, 4, 16_384, 1024


def _units(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the rows (float64), and which rows have one."""
    m = np.array(rows, np.float64).reshape(len(rows), -1)
    size = np.linalg.norm(m, axis=1)
    ok = np.isfinite(m).all(axis=1) & (size > 0)
    return m / np.where(ok, size, 1.0)[:, None], ok


def near_pairs(vectors: DataFrame, threshold: float = 0.95, block: int = BLOCK, *, best: bool = False, shelf: int = SHELF) -> tuple[DataFrame, DataFrame]:
    """id, near, score of distinct vectors (id, embedding) of one size within the threshold, both ways, and the pairs of blocks that were compared.

    Each vector belongs to its nearest centre and lies in a ring of its angle to it; rings are cut into blocks by a hash, so
    that a crowded centre is dealt out. By the triangle inequality of angles, blocks can hold near vectors only if their
    centres are no farther apart than the outer angles of both rings and the threshold's together, and, as a vector's own
    centre is its nearest, if neither ring begins beyond the other's end by more than the threshold's angle. Blocks move by
    shelves of many, once for each other shelf that they can meet; two blocks are compared once, for both ways. best: of
    each vector only the nearest one of two shelves (scores rounded to 12 digits, smaller ids on ties), so that what is
    found doesn't grow with the pairs."""
    reach = float(np.arccos(np.clip(threshold, -1.0, 1.0))) + 1e-9
    width = max(reach / RINGS, 1e-3)
    n = vectors.count()
    drawn = [r[0] for r in vectors.orderBy(F.xxhash64("id")).limit(max(1, min(MOST_CENTRES, round((n / 4) ** 0.5)))).select("embedding").collect()]  # a bounded sample
    spark = vectors.sparkSession
    centres = _units(drawn)[0] if drawn else np.zeros((0, 1))
    sent = spark.sparkContext.broadcast(centres)

    def own(batches):
        for batch in batches:
            m, ok = _units(batch["embedding"].tolist())
            at = np.arccos(np.clip(m[ok] @ sent.value.T, -1.0, 1.0))
            home = at.argmin(axis=1)
            yield pd.DataFrame({"id": batch["id"].to_numpy()[ok], "embedding": batch["embedding"][ok].to_numpy(), "centre": home, "ring": (at[np.arange(len(home)), home] / width).astype(np.int64)})

    homes = cut(vectors.mapInPandas(own, f"id long, embedding {vectors.schema['embedding'].dataType.simpleString()}, centre int, ring int"))
    rings = homes.groupBy("centre", "ring").agg(F.count("*").alias("n")).orderBy("centre", "ring").collect()  # centres x rings at most
    if not rings:
        return spark.createDataFrame([], "id long, near long, score double"), spark.createDataFrame([], "x int, y int, a long, b long")
    parts = [(r["centre"], r["ring"], part, of, r["n"] / of) for r in rings for of in (-(-r["n"] // block),) for part in range(of)]
    blocks = pd.DataFrame(parts, columns=["centre", "ring", "part", "of", "n"])
    shelves = (np.cumsum(blocks["n"].to_numpy()) // shelf).astype(np.int64)
    blocks = blocks.assign(block=np.arange(len(blocks)), shelf=shelves)
    centre, ring = blocks["centre"].to_numpy(), blocks["ring"].to_numpy()
    apart = np.arccos(np.clip(centres @ centres.T, -1.0, 1.0))
    inner, outer = np.maximum(ring * width - 1e-9, 0.0), (ring + 1) * width + 1e-9

    count = int(shelves.max()) + 1
    meets = np.zeros((count, count), bool)
    ranges = [slice(at, at + AT_ONCE) for at in range(0, len(blocks), AT_ONCE)]
    for x, y in ((x, y) for k, x in enumerate(ranges) for y in ranges[k:]):
        i, j = np.nonzero((apart[centre[x, None], centre[None, y]] <= outer[x, None] + outer[None, y] + reach) & (inner[None, y] <= outer[x, None] + reach) & (inner[x, None] <= outer[None, y] + reach))
        meets[shelves[x][i], shelves[y][j]] = True
    meets |= meets.T
    bounds = spark.sparkContext.broadcast((centre, inner, outer, apart))  # a few numbers a block
    placed = spark.createDataFrame(blocks[["centre", "ring", "part", "block", "shelf"]].astype("int64"), "centre int, ring int, part long, block int, shelf int")
    dealt = spark.createDataFrame([(r["centre"], r["ring"], -(-r["n"] // block)) for r in rings], "centre int, ring int, of long")
    partners = spark.createDataFrame([(i, [j for j in range(count) if meets[i, j]]) for i in range(count)], "shelf int, others array<int>")
    held = homes.join(F.broadcast(dealt), ["centre", "ring"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("of")))
    held = held.join(F.broadcast(placed), ["centre", "ring", "part"]).join(F.broadcast(partners), "shelf")
    sides = held.select("id", "embedding", "block", "shelf", F.explode("others").alias("other"))
    sides = sides.select("id", "embedding", "block", "shelf", F.least("shelf", "other").alias("x"), F.greatest("shelf", "other").alias("y"))

    def compare(group: pd.DataFrame, tell):
        """tell(rows of one block, of another, ids, unit vectors) for the blocks of two shelves that can meet, each two once."""
        centre, inner, outer, apart = bounds.value
        x, y = group["x"].iat[0], group["y"].iat[0]
        group = group.sort_values(["shelf", "block"], kind="stable").reset_index(drop=True)
        ids, (m, _), of = group["id"].to_numpy(np.int64), _units(group["embedding"].tolist()), group["block"].to_numpy()
        names, starts = np.unique(of, return_index=True)
        ends = np.append(starts[1:], len(of))
        shelf_of = group["shelf"].to_numpy()[starts]
        for k in np.flatnonzero(shelf_of == x):
            others = np.flatnonzero((shelf_of == y) & ((names >= names[k]) if x == y else True))
            a, b = names[k], names[others]
            can = others[(apart[centre[a], centre[b]] <= outer[a] + outer[b] + reach) & (inner[b] <= outer[a] + reach) & (inner[a] <= outer[b] + reach)]
            if len(can):
                tell(slice(starts[k], ends[k]), can, starts, ends, ids, m)

    def match(group: pd.DataFrame) -> pd.DataFrame:
        found, lead = [], np.full(len(group), -np.inf)
        whose = np.zeros(len(group), np.int64)

        def tell(rows, can, starts, ends, ids, m):
            cols = np.concatenate([np.arange(starts[c], ends[c]) for c in can])
            for at in range(0, len(cols), 4 * BLOCK):
                some = cols[at : at + 4 * BLOCK]
                score = m[rows] @ m[some].T
                i, j = np.nonzero(score >= threshold)
                s, i, j = np.minimum(score[i, j], 1.0), i + rows.start, some[j]
                once = (i < j) | (j < rows.start) | (j >= rows.stop)  # a block against itself holds each pair twice
                s, i, j = s[once], i[once], j[once]
                if not best:
                    found.append(pd.DataFrame({"id": np.concatenate([ids[i], ids[j]]), "near": np.concatenate([ids[j], ids[i]]), "score": np.concatenate([s, s])}))
                    continue
                s = np.round(s, 12)
                for p, q in ((i, j), (j, i)):
                    order = np.lexsort((ids[q], -s, p))
                    p, q, t = p[order], q[order], s[order]
                    first = np.ones(len(p), bool)
                    first[1:] = p[1:] != p[:-1]
                    p, q, t = p[first], ids[q[first]], t[first]
                    better = (t > lead[p]) | (t == lead[p]) & (q < whose[p])
                    lead[p[better]], whose[p[better]] = t[better], q[better]

        order = group.sort_values(["shelf", "block"], kind="stable")["id"].to_numpy(np.int64)
        compare(group, tell)
        if best:
            has = np.isfinite(lead)
            return pd.DataFrame({"id": order[has], "near": whose[has], "score": lead[has]})
        return pd.concat(found) if found else pd.DataFrame({"id": np.zeros(0, np.int64), "near": np.zeros(0, np.int64), "score": np.zeros(0)})

    def tested(group: pd.DataFrame) -> pd.DataFrame:
        rows = []
        compare(group, lambda mine, can, starts, ends, ids, m: rows.extend((int(group["x"].iat[0]), int(group["y"].iat[0]), mine.stop - mine.start, int(ends[c] - starts[c])) for c in can))
        return pd.DataFrame(rows, columns=["x", "y", "a", "b"])

    pairs = sides.groupBy("x", "y")
    return pairs.applyInPandas(match, "id long, near long, score double"), pairs.applyInPandas(tested, "x int, y int, a long, b long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, block: int = BLOCK) -> DataFrame:
    """id, duplicate_of, confidence: the nearest other vector of each one, where it is near enough; smaller ids on ties.

    Copies of a vector are compared as one. Vectors of other sizes, null or of no length are near to none."""
    held = vectors.where("embedding is not null and id is not null").select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    held = held.where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)) & F.exists("embedding", lambda x: x != 0))
    size = held.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    held = held.where(F.size("embedding") == (size["size"] if size else 0))
    classes = cut(held.groupBy("embedding").agg(F.min("id").alias("low"), F.count_distinct("id").alias("n")))
    pairs, _ = near_pairs(classes.select(F.col("low").alias("id"), "embedding"), threshold, block, best=True)
    found = pairs.groupBy("id").agg(F.max(F.struct("score", (-F.col("near")).alias("less"))).alias("b")).select(F.col("id").alias("low"), "b.score", (-F.col("b.less")).alias("near"))
    ids = held.select("id", "embedding").distinct().join(classes, "embedding").select("id", "low", "n")
    second = ids.where("n > 1 and id != low").groupBy("low").agg(F.min("id").alias("second"))
    each = ids.join(second, "low", "left").join(found, "low", "left")
    copy = F.when(F.col("n") > 1, F.struct(F.lit(1.0).alias("score"), (-F.when(F.col("id") == F.col("low"), F.col("second")).otherwise(F.col("low"))).alias("less")))
    near = F.when(F.col("near").isNotNull(), F.struct("score", (-F.col("near")).alias("less")))
    best = each.select("id", F.when(copy.isNull() | (near > copy), F.coalesce(near, copy)).otherwise(copy).alias("b"))
    return best.where("b is not null").select("id", (-F.col("b.less")).alias("duplicate_of"), F.col("b.score").alias("confidence"))


def best_per_id(hits: DataFrame) -> DataFrame:
    return hits.groupBy("qid", "id").agg(F.max("score").alias("score"))


def first_of(hits: DataFrame, limit: int) -> DataFrame:
    """The best hits of each query, their positions counted anew."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return hits.withColumn("position", place).where(F.col("position") <= limit)
