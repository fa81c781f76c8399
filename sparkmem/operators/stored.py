"""A stored keyword index: postings in blocks with bounds, in segments that are never changed once written.

Every batch of rows becomes a segment of four tables: the rows with their term counts, their postings in blocks, how
much each term's document count changes by the batch, and the ids whose older postings are dead. A block has the
postings of one term in one part (about PART_DOCS rows of like length, as length decides much of a score) and the most
that one of them can add to a score. Blocks lie in folders by a hash of the term, in order of term and part, so that a
search's terms and parts reach the scan as filters.

A search first adds up, from blocks without their postings, how much a row of each part could score at most. It reads
the postings of each query's best parts, which gives a score that the others must be able to reach, and then those of
the parts that can. Nothing is lost: the rows are those of a scan of everything.

The last thing a batch writes is its state row; a batch that failed before is written again, one that was recorded is
passed over. Segments of like size are merged from their rows, without the dead ones."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import stemmed, terms
from . import lexical
from .graph import cut

#: Rows of a part, folders by hash of the term, segments of a size that are merged, parts that give a query its first scores.
PART_DOCS, FOLDERS, FAN, PROBES = 256, 32, 4, 4
#: Allowance for sums in another order.
SLACK = 1e-9
_WORDS = "array<struct<term: string, tf: double>>"
_STATE = "version long, batch long, segments array<struct<seg: long, age: long, docs: long>>, docs long, length long"


def plain(text: Column) -> Column:
    return terms(text)


def porter(text: Column) -> Column:
    return stemmed(terms(text))


def counted(words: pa.Array) -> pa.Array:
    """The terms of each row (term, w) with the sum of their weights; a row's words lie together, so nothing has to be moved."""
    own = words.flatten()
    sizes = np.asarray(words.value_lengths().fill_null(0))
    rows = np.repeat(np.arange(len(words)), sizes)
    table = pa.table({"row": rows, "term": own.field("term"), "w": own.field("w")})
    sums = table.group_by(["row", "term"], use_threads=False).aggregate([("w", "sum")]).sort_by("row")
    starts = np.searchsorted(sums["row"].to_numpy(), np.arange(len(words) + 1)).astype(np.int32)
    each = pa.StructArray.from_arrays([sums["term"].combine_chunks(), sums["w_sum"].combine_chunks().cast(pa.float64())], ["term", "tf"])
    return pa.ListArray.from_arrays(pa.array(starts), each)


def _counted_rows(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("length"), counted(batch.column("words"))], names=["id", "length", "words"])


class StoredIndex:
    """An index in a folder that driver and executors share. weights and analyser stay the same for its life."""

    def __init__(self, spark: SparkSession, path: str, *, weights: dict[str, float] | None = None, analyser: Callable[[Column], Column] = plain, part_docs: int = PART_DOCS, fan: int = FAN):
        self.spark, self.path, self.weights, self.analyser, self.part_docs, self.fan = spark, path.rstrip("/"), weights, analyser, part_docs, fan

    # -- state

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def state(self) -> dict:
        """The last recorded state; an empty one before the first batch."""
        empty = {"version": -1, "batch": -1, "segments": [], "docs": 0, "length": 0}
        if not self._exists("state"):
            return empty
        row = self.spark.read.schema(_STATE).parquet(f"{self.path}/state").orderBy(F.desc("version")).first()
        return row.asDict(recursive=True) if row else empty

    def _record(self, state: dict) -> None:
        row = self.spark.createDataFrame([(state["version"], state["batch"], state["segments"], state["docs"], state["length"])], _STATE)
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/state/v={state['version']}")

    def _read(self, table: str, segs: list[int], schema: str) -> DataFrame:
        """A table of some segments, with seg."""
        if not segs:
            return self.spark.createDataFrame([], f"{schema}, seg long")
        return self.spark.read.schema(f"{schema}, seg long").option("basePath", f"{self.path}/{table}").parquet(*(f"{self.path}/{table}/seg={s}" for s in segs))

    def _rows(self, segments: list[dict]) -> DataFrame:
        """Rows of the segments that no younger segment declares dead."""
        rows = self._read("rows", [s["seg"] for s in segments], f"id long, length long, words {_WORDS}")
        return self._alive(rows, segments)

    def _alive(self, rows: DataFrame, segments: list[dict], every: list[dict] | None = None) -> DataFrame:
        every = every or self.state()["segments"]
        if not every:
            return rows
        ages = F.create_map(*(F.lit(x) for s in every for x in (s["seg"], s["age"])))
        dead = self._read("dead", [s["seg"] for s in every], "id long").select("id", ages[F.col("seg")].alias("since")).groupBy("id").agg(F.max("since").alias("since"))
        return rows.withColumn("age", ages[F.col("seg")]).join(dead, "id", "left").where("since is null or since <= age").drop("since", "age")

    # -- writing

    def apply(self, batch: DataFrame, number: int) -> None:
        """Insert, replace or delete the batch's rows by id; of repeated ids the one updated last stays. A sink of foreachBatch.

        Rows with a deleted_at only take away what was there."""
        state = self.state()
        if number <= state["batch"]:
            return
        seg = state["version"] + 1
        if "updated_at" in batch.columns and not batch.groupBy("id").count().where("count > 1").isEmpty():  # whole rows move only if they must
            batch = batch.groupBy("id").agg(F.max_by(F.struct("*"), "updated_at").alias("r")).select("r.*")
        held = batch.where("deleted_at is null") if "deleted_at" in batch.columns else batch
        made = lexical.analysed(lexical.indexed(held) if self.weights is None else held, self.weights or lexical.WEIGHTS, "id", self.analyser)
        rows = made.select(F.col("id").cast("long"), "length", "words").mapInArrow(_counted_rows, f"id long, length long, words {_WORDS}")
        batch.select(F.col("id").cast("long")).distinct().write.mode("overwrite").parquet(f"{self.path}/dead/seg={seg}")
        rows.write.mode("overwrite").parquet(f"{self.path}/rows/seg={seg}")
        new = self._read("rows", [seg], f"id long, length long, words {_WORDS}")
        gone = self._rows(state["segments"]).join(self._read("dead", [seg], "id long").select("id"), "id", "left_semi")
        changed = new.withColumn("by", F.lit(1)).unionByName(gone.withColumn("by", F.lit(-1)))
        changed.select("by", F.explode("words.term").alias("term")).groupBy("term").agg(F.sum("by").alias("n")).where("n <> 0").write.mode("overwrite").parquet(f"{self.path}/counts/seg={seg}")
        docs, length, more = changed.agg(F.coalesce(F.sum("by"), F.lit(0)), F.coalesce(F.sum(F.col("by") * F.col("length")), F.lit(0)), F.count_if(F.col("by") == 1)).first()
        self._blocks(seg, (state["length"] + length) / max(state["docs"] + docs, 1))
        self._record({"version": seg, "batch": number, "segments": [*state["segments"], {"seg": seg, "age": seg, "docs": more}], "docs": state["docs"] + docs, "length": state["length"] + length})
        self.merge()

    def _blocks(self, seg: int, mean: float) -> None:
        """Write a segment's postings from its rows: one row for each term and part. mean: the rows' mean length, by which bounds hold."""
        rows = self._read("rows", [seg], f"id long, length long, words {_WORDS}")
        kind = F.floor(8 * F.log2(F.col("length") + 1)).cast("int")
        parts, at = {}, 0
        for r in rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).orderBy("kind").collect():  # eight a power of two
            parts[r["kind"]] = (at, -(-r["n"] // self.part_docs))
            at += parts[r["kind"]][1]
        if not parts:
            parts = {0: (0, 1)}
        from_, of = (F.create_map(*(F.lit(x) for k, v in parts.items() for x in (k, v[i])))[kind] for i in (0, 1))
        part = (from_ + F.pmod(F.xxhash64("id"), of)).cast("long")
        each = rows.select("id", "length", part.alias("part"), F.explode("words").alias("x")).select("id", "length", "part", "x.*").withColumn("folder", _folder(F.col("term")))
        each = each.repartition("folder", "part")  # the only time that postings move
        posting = F.sort_array(F.collect_list(F.struct("id", "tf", "length")))  # one part's rows at most
        blocks = each.groupBy("folder", "term", "part").agg(F.count("*").alias("n"), F.max(lexical.saturated(F.col("tf"), F.col("length"), F.lit(float(mean or 1)))).alias("most"), F.lit(float(mean or 1)).alias("mean"), posting.alias("postings"))
        laid = blocks.sortWithinPartitions("folder", "term", "part")
        laid.write.mode("overwrite").partitionBy("folder").parquet(f"{self.path}/blocks/seg={seg}")

    def merge(self) -> None:
        """Merge the youngest segments while `fan` of them, one behind the other, are within the same power of `fan` in size."""
        while True:
            state = self.state()
            tier = lambda s: next(t for t in range(64) if s["docs"] < self.fan ** (t + 1))
            run: list[dict] = []
            for s in reversed(state["segments"]):
                if run and tier(s) > max(map(tier, run)):
                    break
                run.insert(0, s)
            if len(run) < self.fan:
                return
            seg, old = state["version"] + 1, [s["seg"] for s in run]
            self._rows(run).select("id", "length", "words").write.mode("overwrite").parquet(f"{self.path}/rows/seg={seg}")
            self._read("dead", old, "id long").select("id").distinct().write.mode("overwrite").parquet(f"{self.path}/dead/seg={seg}")
            counts = self._read("counts", old, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).where("n <> 0")
            counts.write.mode("overwrite").parquet(f"{self.path}/counts/seg={seg}")
            docs = self._read("rows", [seg], "id long").count()
            self._blocks(seg, state["length"] / max(state["docs"], 1))
            kept = [s for s in state["segments"] if s not in run]
            self._record({**state, "version": seg, "segments": [*kept, {"seg": seg, "age": max(s["age"] for s in run), "docs": docs}]})

    def vacuum(self) -> None:
        """Remove folders of segments and states that the last state doesn't name; no search may be reading them."""
        state, jvm = self.state(), self.spark._jvm
        live = {f"seg={s['seg']}" for s in state["segments"]} | {f"v={state['version']}"}
        for table in ("rows", "dead", "counts", "blocks", "state"):
            if self._exists(table):
                top = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
                fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
                for status in fs.listStatus(top):
                    if status.isDirectory() and status.getPath().getName() not in live:
                        fs.delete(status.getPath(), True)

    # -- reading

    def asked(self, queries: DataFrame) -> DataFrame:
        """qid, n_terms, term of queries (qid, terms)."""
        once = queries.select("qid", F.array_distinct("terms").alias("terms"))
        return once.select("qid", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))

    def search(self, queries: DataFrame, k: int = 10, *, all_terms: bool = True) -> DataFrame:
        """qid, id, score, position of the k best rows of each query (qid, terms), smaller ids first on ties."""
        return lexical.ranked(self.scored(queries, k, all_terms=all_terms)[0], k, F.round("score", 9).desc(), F.asc("id"))

    def scored(self, queries: DataFrame, k: int, *, all_terms: bool = True) -> tuple[DataFrame, DataFrame]:
        """Scores of the rows that can be among the k best, and how many blocks were there and were read for each query."""
        state = self.state()
        segments = state["segments"]
        segs, mean = [s["seg"] for s in segments], state["length"] / max(state["docs"], 1)
        asked = cut(self.asked(queries))
        listed = lexical.asked_terms(queries)
        counts = self._read("counts", segs, "term string, n long")
        df = (counts if listed is None else counts.where(F.col("term").isin(*listed))).groupBy("term").agg(F.sum("n").alias("df")).where("df > 0")
        weighed = cut(asked.join(df, "term").select("qid", "n_terms", "term", lexical.idf(F.lit(state["docs"]), F.col("df")).alias("idf"), _folder(F.col("term")).alias("folder")))
        heads = self._blocks_of(segs, listed)
        best = F.col("idf") * F.col("most") * F.greatest(F.lit(1.0), F.lit(mean) / F.col("mean"))  # a larger mean adds no more than its share
        parts = heads.join(weighed, ["folder", "term"]).groupBy("qid", "seg", "part").agg(F.sum(best).alias("most"), F.count("*").alias("met"), F.first("n_terms").alias("n_terms"))
        parts = parts.where("met = n_terms") if all_terms else parts
        place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("most"), "seg", "part"))
        parts = cut(parts.select("qid", "seg", "part", "met", "most", place.alias("place")))
        first = self._score(parts.where(F.col("place") <= PROBES), weighed, segments, listed, mean, all_terms)
        first = cut(first)
        floor = lexical.ranked(first, k).where(F.col("position") == k).select("qid", (F.col("score") - SLACK).alias("floor"))
        rest = parts.where(F.col("place") > PROBES).join(floor, "qid", "left").where("floor is null or most >= floor").select("qid", "seg", "part", "met")
        rest = cut(rest)
        found = first.unionByName(self._score(rest, weighed, segments, listed, mean, all_terms))
        total = parts.groupBy("qid").agg(F.sum("met").alias("blocks"))
        read = parts.where(F.col("place") <= PROBES).select("qid", "met").unionByName(rest.select("qid", "met")).groupBy("qid").agg(F.sum("met").alias("read"))
        return found, total.join(read, "qid")

    def _blocks_of(self, segs: list[int], listed: list[str] | None, more: str = "") -> DataFrame:
        """Blocks of the listed terms, or of all: the list reaches the scan, folders without any of them aren't read."""
        blocks = self._read("blocks", segs, f"term string, part long, n long, most double, mean double{more}, folder int")
        if listed is None:
            return blocks
        folders = [r[0] for r in self.spark.createDataFrame([(t,) for t in listed], "t string").select(_folder(F.col("t"))).distinct().collect()]
        return blocks.where(F.col("folder").isin(*folders) & F.col("term").isin(*listed))

    def _score(self, parts: DataFrame, weighed: DataFrame, segments: list[dict], listed: list[str] | None, mean: float, all_terms: bool) -> DataFrame:
        """qid, id, score of the rows in parts (qid, seg, part)."""
        blocks = self._blocks_of([s["seg"] for s in segments], listed, ", postings array<struct<id: long, tf: double, length: long>>")
        wanted = [r["part"] for r in parts.select("part").distinct().limit(lexical.MOST_LITERALS + 1).collect()]
        blocks = blocks.where(F.col("part").isin(*wanted)) if len(wanted) <= lexical.MOST_LITERALS else blocks
        met = blocks.join(weighed, ["folder", "term"]).join(parts.select("qid", "seg", "part"), ["qid", "seg", "part"])
        each = met.select("qid", "n_terms", "idf", "seg", F.explode("postings").alias("p")).select("qid", "n_terms", "idf", "seg", "p.*")
        score = F.sum(F.col("idf") * lexical.saturated(F.col("tf"), F.col("length"), F.lit(mean)))
        found = each.groupBy("qid", "seg", "id").agg(score.alias("score"), F.count("*").alias("met"), F.first("n_terms").alias("n_terms"))
        found = found.where("met = n_terms") if all_terms else found
        return self._alive(found, segments, segments).select("qid", "id", "score")


def _folder(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(FOLDERS)).cast("int")
