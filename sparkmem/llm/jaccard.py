"""N-gram Jaccard self-join and its groups.

Texts with equal shingle sets form classes; everything below is between classes. Shingles are ordered by
hash. Two sets with the asked similarity share a shingle of their prefixes; the prefixes are extended to a common
bound of the hash, below which everything is known of every set. A prefix shingle that few classes hold
is indexed alone. Sets whose rare shingles could all be missing from a similar set are indexed once more among
themselves by all their shingles; where again too few are rare, by combinations: the shingles are dealt to so many token classes by hash that two similar sets must agree on one, and the
combination of shingles in each class is a key. What the prefixes share bounds a pair's similarity; pairs
that can reach it are verified on the whole sets. Large candidate groups are verified against one member first; members
that its links leave outside the group's largest component are then compared with blocks of the group, so no link
between components is lost. Links that join nothing new in a large group aren't looked for.

Defined results: a null or wordless text has no shingles and is linked with nothing; a null id takes no part
in links and has a null component; repeated rows give one result each; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, mix, slices, texts_of
from .components import with_roots
from .shingles import set_key, shingle_sets

WORDS, PERCENT = 4, 85
#: Holders of an index key from which on it counts as frequent.
RARE = 8
#: The extended prefix covers so many times the hashes that a similar set may lack.
EXTEND = 1.4
#: Index entries in one task's bucket.
BUCKET = 1_500_000
#: Shingles in a block of a large candidate group.
BLOCK = 400_000
#: Index entries that a task gathers before it hands them on.
GATHER = 1_000_000


def least_overlap(n, percent: int):
    return (percent * n + 99) // 100


def similar(shared: int, a: int, b: int, percent: int) -> bool:
    return 100 * shared >= percent * (a + b - shared)


@lru_cache(maxsize=8)
def _levels(percent: int, longest: int) -> np.ndarray:
    """First size of each size level; similar sets are of one level or of neighbouring ones."""
    out = [1]
    while out[-1] <= longest:
        out.append(out[-1] * 100 // percent + 1)
    return np.array([*out, out[-1] * 100 // percent + 1], np.int64)


def combinations(hashes: np.ndarray, percent: int) -> np.ndarray:
    """Index keys of a set: at its own size level and the next, one key for the combination in each token class.

    With more classes than two similar sets of the level can differ in, the sets agree on some classes; keys of empty
    classes are left out where a non-empty one must be among them."""
    level = int(np.searchsorted(firsts := _levels(percent, 1 << max(4, int(len(hashes)).bit_length())), len(hashes), side="right")) - 1
    out = []
    for at in (level, level + 1):
        largest = int(firsts[at + 1]) - 1
        differ = 2 * largest * (100 - percent) // (100 + percent)
        classes = differ + 1 + largest // 50
        seed = mix(np.array([at + 1], np.uint64))
        own = (mix(hashes ^ seed) % np.uint64(classes)).astype(np.int64)
        order = np.argsort(own, kind="stable")
        kinds, begins, counts = np.unique(own[order], return_index=True, return_counts=True)
        sums = np.add.reduceat(mix(hashes[order] + seed), begins)
        keys = mix(sums + mix((kinds * 1_000_003 + counts).astype(np.uint64)) + seed)
        out.append(keys)
        if classes - len(kinds) >= classes - differ:
            empty = np.setdiff1d(np.arange(classes), kinds)
            out.append(mix(mix((empty * 1_000_003).astype(np.uint64)) + seed))
    return np.concatenate(out)


def _reach(percent: int) -> np.uint64:
    """Bound of the hashes that every set's extended prefix covers."""
    return np.uint64(min(2**64 - 1, int(2**64 * EXTEND * (100 - percent) / 100)))


def _prefix(hashes: np.ndarray, percent: int) -> np.ndarray:
    """The extended prefix: the standard one, and all shingles up to the bound."""
    standard = len(hashes) - least_overlap(len(hashes), percent) + 1
    return hashes[: max(int(np.searchsorted(hashes, _reach(percent), side="right")), standard)]


def _sizes(batches, n: int, percent: int):
    for batch in slices(batches):
        sizes, low, keys = [], [], []
        for s in shingle_sets(texts_of(batch, "text"), n):
            sizes.append(len(s))
            low.append(int(np.searchsorted(s, _reach(percent), side="right")))
            keys.append(set_key(s) if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(low, pa.int64()), pa.array(keys, pa.int64())], names=["doc_id", "n", "m", "node"])


_BLOB = "bucket int, kind int, keys binary, refs binary, nodes binary"
_ENTRIES, _HELD, _MET = 0, 1, 2
#: In place of a holder: the key has more holders, which were dealt with before.
_MORE = np.uint32(0xFFFFFFFF)


def _row(bucket: int, kind: int, keys: np.ndarray, refs: np.ndarray, nodes: np.ndarray) -> dict:
    return {"bucket": bucket, "kind": kind, "keys": keys.tobytes(), "refs": refs.tobytes(), "nodes": nodes.tobytes()}


def _groups(keys: np.ndarray, nodes: np.ndarray):
    """Distinct entries in order of key and node, where each key's begin, and how many there are."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
    keys, nodes = keys[fresh], nodes[fresh]
    begins = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys, nodes, begins, np.diff(np.concatenate((begins, [len(keys)])))


def _index(batches, buckets: int, entries, bound: np.uint64, star: bool):
    """Index entries by bucket, keys that are frequent among those gathered here being dealt with at once.

    A frequent shingle goes on as a mark, its holders' counts (up to the bound) beside it; a frequent combination
    goes on with its first holder, all its holders beside it."""

    def out(keys, nodes):
        keys, nodes, begins, counts = _groups(keys, nodes)
        often, rows = np.repeat(counts > RARE, counts), []
        marks = begins[counts > RARE]
        hot_keys, hot_nodes = keys[often], nodes[often]
        if len(marks):
            bucket = int(hot_nodes[0] % buckets)
            if star:
                rows.append(_row(bucket, _MET, _key_id(hot_keys, buckets), np.zeros(0, np.int64), hot_nodes))
            else:
                held, where = np.unique(hot_nodes, return_inverse=True)
                rows.append(_row(bucket, _HELD, np.bincount(where, hot_keys <= bound).astype(np.int64), np.zeros(0, np.int64), held))
        all_keys = np.concatenate((keys[~often], keys[marks]))
        all_nodes = np.concatenate((nodes[~often], nodes[marks]))
        mark = np.concatenate((np.zeros((~often).sum(), bool), np.ones(len(marks), bool)))
        where = (all_keys % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        cuts = np.searchsorted(where[order], np.arange(buckets + 1))
        for b in range(buckets):
            at = order[cuts[b] : cuts[b + 1]]
            if len(at):
                own, refs = np.unique(all_nodes[at], return_inverse=True)
                refs, short = refs.astype(np.uint32), (all_keys[at] >> np.uint64(32)).astype(np.uint32)
                more = mark[at]
                if star:
                    refs, short = np.concatenate((refs, np.full(more.sum(), _MORE))), np.concatenate((short, short[more]))
                else:
                    refs[more] = _MORE
                rows.append(_row(b, _ENTRIES, short, refs, own))
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("refs", pa.binary()), ("nodes", pa.binary())]))

    held: list[tuple] = []
    size = 0
    for keys, node in entries(batches):
        held.append((keys, np.full(len(keys), node, np.int64)))
        size += len(keys)
        if size >= GATHER:
            yield out(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held, size = [], 0
    if held:
        yield out(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _key_id(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) | (keys % np.uint64(buckets) << np.uint64(32))).view(np.int64)


def _blobs(group: pa.Table):
    """The bucket's entries (keys, nodes), the keys that have more holders, and the other kinds' arrays."""
    keys, nodes, more, other = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)], []
    for kind, k, r, n in zip(*(group.column(x).to_pylist() for x in ("kind", "keys", "refs", "nodes")), strict=True):
        if kind == _ENTRIES:
            short, refs, own = np.frombuffer(k, np.uint32), np.frombuffer(r, np.uint32), np.frombuffer(n, np.int64)
            mark = refs == _MORE
            keys.append(short[~mark])
            nodes.append(own[refs[~mark]])
            more.append(short[mark])
        else:
            other.append((np.frombuffer(k, np.int64), np.frombuffer(r, np.int64), np.frombuffer(n, np.int64)))
    keys, nodes, begins, counts = _groups(np.concatenate(keys), np.concatenate(nodes))
    often = np.repeat((counts > RARE) | np.isin(keys[begins], np.unique(np.concatenate(more))), counts) if len(keys) else np.zeros(0, bool)
    return keys, nodes, begins, counts, often, other


def _group_pairs(nodes, begins, counts, often):
    """All pairs within the groups of rare keys."""
    found = [np.zeros((2, 0), np.int64)]
    for size in range(2, RARE + 1):
        at = begins[counts == size]
        at = at[~often[at]]
        for i in range(size):
            found += [np.stack((nodes[at + i], nodes[at + j])) for j in range(i + 1, size)]
    return np.concatenate(found, axis=1)


_PAIRS = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("s", pa.int64())])


def _shared_pairs(group: pa.Table, bound: np.uint64) -> pa.Table:
    """Pairs of classes and how many rare shingles up to the bound they share here; (node, null) and how many frequent ones it holds."""
    keys, nodes, begins, counts, often, other = _blobs(group)
    low = keys <= np.uint32(bound >> np.uint64(32))
    a, b = _group_pairs(nodes, begins, counts, often)
    pairs, shared = np.unique(np.stack((a, b)), axis=1, return_counts=True) if len(a) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
    held = [nodes[often], *(n for _, _, n in other)]
    count = [low[often].astype(np.int64), *(k for k, _, _ in other)]
    hot, where = np.unique(np.concatenate(held), return_inverse=True)
    number = np.bincount(where, np.concatenate(count), len(hot)).astype(np.int64)
    n = len(shared) + len(hot)
    return pa.table([pa.nulls(n, pa.int64()), pa.array(np.concatenate((pairs[0], hot))), pa.concat_arrays([pa.array(pairs[1]), pa.nulls(len(hot), pa.int64())]), pa.array(np.concatenate((shared, number)))], schema=_PAIRS)


def _combination_pairs(group: pa.Table) -> pa.Table:
    """Pairs that share a combination; of a frequent one, its key and each holder (null, holder)."""
    keys, nodes, begins, counts, often, other = _blobs(group)
    a, b = _group_pairs(nodes, begins, counts, often)
    if len(a):
        a, b = np.unique(np.stack((a, b)), axis=1)
    bucket = np.int64(group.column("bucket")[0].as_py()) << np.int64(32)
    key = np.concatenate([keys[often].astype(np.int64) | bucket, *(k for k, _, _ in other)])
    node = np.concatenate([nodes[often], *(n for _, _, n in other)])
    n = len(a) + len(key)
    return pa.table([pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(key)]), pa.concat_arrays([pa.array(a), pa.nulls(len(key), pa.int64())]), pa.array(np.concatenate((b, node))), pa.nulls(n, pa.int64())], schema=_PAIRS)


def _verify(batches, percent: int):
    for batch in slices(batches, 256):
        keep = []
        for a, b in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True):
            x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            if len(x) > len(y):
                x, y = y, x
            if 100 * len(x) < percent * len(y):
                keep.append(False)
                continue
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            keep.append(similar(int((y[at] == x).sum()), len(x), len(y), percent))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are similar."""
    held = sets.select("node", "hashes")
    joined = pairs.join(held.withColumnsRenamed({"node": "a", "hashes": "set_a"}).hint("merge"), "a").join(held.withColumnsRenamed({"node": "b", "hashes": "set_b"}).hint("merge"), "b")
    return joined.select("a", "b", "set_a", "set_b").mapInArrow(lambda x: _verify(x, percent), "a long, b long")


def _stats(classes: DataFrame, found: DataFrame) -> DataFrame:
    """The classes with f, how many frequent shingles they hold among those indexed (null: not even beyond the bound)."""
    frequent = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("s").alias("f"))
    return classes.join(frequent.hint("merge"), "node", "left")


def _reaches(shared, percent: int):
    """Whether sets with n shingles, m of them indexed and f of those frequent, can be similar if they share so many of the rare ones."""
    met = shared + F.least(F.coalesce("f_a", F.lit(0)), F.coalesce("f_b", F.lit(0)))
    most = F.least(F.col("n_a") - F.greatest(F.col("m_a") - met, F.lit(0)), F.col("n_b") - F.greatest(F.col("m_b") - met, F.lit(0)))
    return 100 * most >= percent * (F.col("n_a") + F.col("n_b") - most)


def _possible(shared: DataFrame, stats: DataFrame, percent: int) -> DataFrame:
    """The pairs that can be similar, by the rare shingles they share."""
    side = lambda x: stats.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "m", "f"))).hint("merge")
    return shared.join(side("a"), "a").join(side("b"), "b").where(_reaches(F.col("s"), percent)).select("a", "b")


def _between(placed: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Links between members of a group that lie in different components so far, one for each member and component at least.

    Members outside a group's largest component are compared with blocks of the whole group: an asker meets each block
    once and only links leave a block, so no pairs are written. Blocks and askers are dealt by the shingles they hold."""
    per = placed.groupBy("centre", "root").agg(F.count("*").alias("c"), F.sum("n").alias("size"))
    mixed = per.groupBy("centre").agg(F.count("*").alias("k"), F.max(F.struct("c", "root"))["root"].alias("main"), F.sum("size").alias("size"), F.max(F.struct("c", "size"))["size"].alias("most")).where("k > 1")
    blocks = lambda x: F.ceil(x / F.lit(BLOCK)).cast("int")
    open_ = placed.join(mixed.select("centre", "main", blocks(F.col("size")).alias("wide"), blocks(F.greatest(F.col("size") - F.col("most"), F.lit(1))).alias("tall")).hint("merge"), "centre")
    draw = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    fields = ["centre", "node", "root", "n", "f"]
    asked = open_.select(*fields, draw("wide", 1).alias("x"), every("tall").alias("y"), F.lit(False).alias("asks"))
    askers = open_.where("root != main").select(*fields, every("wide").alias("x"), draw("tall", 2).alias("y"), F.lit(True).alias("asks"))
    both = asked.unionByName(askers).join(held.select("node", "hashes").hint("merge"), "node")

    def compare(group: pa.Table) -> pa.Table:
        node, root, n, f, asks = (np.array([0 if v is None else v for v in group.column(c).to_pylist()]) for c in ("node", "root", "n", "f", "asks"))
        sets = [np.frombuffer(x, np.uint64) for x in group.column("hashes").to_pylist()]
        there = np.flatnonzero(~asks)
        a, b = [], []
        if len(there):
            flat = np.concatenate([sets[i] for i in there])
            starts = np.cumsum([0, *(len(sets[i]) for i in there[:-1])])
            for i in np.flatnonzero(asks):
                most = np.minimum(f[i], f[there])
                can = (root[there] != root[i]) & (100 * most >= percent * (n[i] + n[there] - most))
                if not can.any():
                    continue
                at = np.searchsorted(sets[i], flat)
                at[at == len(sets[i])] = 0
                shared = np.add.reduceat((sets[i][at] == flat).astype(np.int64), starts)
                hit = np.flatnonzero(can & (100 * shared >= percent * (n[i] + n[there] - shared)))
                hit = hit[np.unique(root[there[hit]], return_index=True)[1]]  # one for each component
                a += [min(node[i], node[j]) for j in there[hit]]
                b += [max(node[i], node[j]) for j in there[hit]]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return both.groupBy("centre", "x", "y").applyInArrow(compare, "a long, b long").distinct()


def _buckets(entries: int, least: int) -> int:
    return max(least, -(-entries // BUCKET))


def jaccard_groups(documents: DataFrame, *, n: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, n_spanning (verified links of its class to other classes; they span each component, but in groups of more than RARE members of one key not all links are looked for)."""
    spark = documents.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = cut(rows.mapInArrow(lambda x: _sizes(x, n, percent), f"doc_id {kind}, n long, m long, node long"))
    linked = base.where("node is not null and doc_id is not null")
    classes = cut(linked.groupBy("node").agg(F.min("doc_id").alias("first_doc"), F.min("n").alias("n"), F.min("m").alias("m")))

    def prefixes(batches):
        for batch in slices(batches):
            for s in shingle_sets(texts_of(batch, "text"), n):
                if len(s):
                    yield _prefix(s, percent), set_key(s)

    reach, everything = _reach(percent), np.uint64(2**64 - 1)
    buckets = _buckets(linked.agg(F.sum(F.greatest("m", F.lit(1)))).first()[0] or 0, least)
    index = rows.where("doc_id is not null").select("text").mapInArrow(lambda x: _index(x, buckets, prefixes, reach, False), _BLOB)
    found = cut(index.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(lambda g: _shared_pairs(g, reach), "key long, a long, b long, s long"))
    stats = cut(_stats(classes, found))
    # Rare shingles up to the bound that outnumber what a similar set may lack: then it shares one of them, and no more is needed.
    lacking = F.col("n") - F.floor((F.col("n") * percent + 99) / 100)
    flagged = stats.where(F.col("f").isNotNull() & (F.col("m") - F.col("f") <= lacking)).select("node")
    pairs = cut(_possible(found.where("b is not null").groupBy("a", "b").agg(F.sum("s").alias("s")), stats, percent))
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(flagged).distinct()
    wanted = needed.join(classes.hint("merge"), "node").select("node", F.col("first_doc").alias("doc_id"))

    def full(batches):
        for batch in slices(batches):
            got = list(shingle_sets(texts_of(batch, "text"), n))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([set_key(s) if len(s) else None for s in got], pa.int64()), pa.array([len(s) for s in got], pa.int64()), pa.array([s.tobytes() for s in got], pa.binary())], names=["node", "own", "n", "hashes"])

    sets = rows.join(wanted.hint("merge"), "doc_id").select("node", "text").mapInArrow(full, "node long, own long, n long, hashes binary").where("node = own").drop("own")
    sets = cut(sets.dropDuplicates(["node"]))
    forget(found)
    held = cut(sets.join(flagged.hint("merge"), "node", "left_semi"))

    def shingled(batches):
        for batch in slices(batches, 64):
            for node, raw in zip(batch.column("node").to_pylist(), batch.column("hashes").to_pylist(), strict=True):
                yield np.frombuffer(raw, np.uint64), node

    def combined(batches):
        for hashes, node in shingled(batches):
            yield combinations(hashes, percent), node

    # Among the sets that remain, all shingles are indexed; those rich in shingles that are rare among them need no combinations either.
    wide = _buckets(held.agg(F.sum("n")).first()[0] or 0, least)
    index = held.mapInArrow(lambda x: _index(x, wide, shingled, everything, False), _BLOB)
    second = cut(index.repartition(wide, "bucket").groupBy("bucket").applyInArrow(lambda g: _shared_pairs(g, everything), "key long, a long, b long, s long"))
    own = cut(_stats(held.select("node", "n", F.col("n").alias("m")), second))
    pairs = pairs.unionByName(_possible(second.where("b is not null").groupBy("a", "b").agg(F.sum("s").alias("s")), own, percent))
    core = own.where(F.col("m") - F.coalesce("f", F.lit(0)) <= lacking)
    index = held.join(core.select("node").hint("merge"), "node", "left_semi").mapInArrow(lambda x: _index(x, wide, combined, everything, True), _BLOB)
    more = cut(index.repartition(wide, "bucket").groupBy("bucket").applyInArrow(_combination_pairs, "key long, a long, b long, s long"))
    members = more.where("key is not null").select("key", F.col("b").alias("node")).distinct().join(core.hint("merge"), "node")
    centre = members.groupBy("key").agg(F.min(F.struct((F.col("n") - F.col("f")).alias("r"), "node"))["node"].alias("centre"))
    groups = cut(members.join(centre.hint("merge"), "key").select("centre", "node", "n", "f").distinct())  # keys of one centre make one group
    stars = groups.where("node != centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
    met = more.where("key is null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(stars).distinct().withColumn("s", F.lit(0))
    pairs = cut(pairs.unionByName(_possible(met, own, percent)).distinct())
    links = cut(_links(pairs, sets, percent))

    roots = with_roots(links)
    placed = cut(groups.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node")))
    extra = cut(_between(placed, held, percent))
    links = links.unionByName(extra).distinct()
    roots = with_roots(links) if not extra.isEmpty() else roots
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_spanning"))

    of = classes.select("node", "first_doc").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = of.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    of = cut(of.join(lowest.hint("merge"), "root").join(degree.hint("merge"), "node", "left").select("node", "component_id", F.coalesce("n_spanning", F.lit(0)).alias("n_spanning")))
    forget(stats, sets, held, second, own, more, groups, pairs, placed)
    return base.select("doc_id", "n", "node").join(of.hint("merge"), "node", "left").select(
        F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), F.coalesce("n_spanning", F.lit(0)).cast("long").alias("n_spanning")
    )
