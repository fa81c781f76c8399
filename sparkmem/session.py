"""The façade: a memory store over DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import code, graph, lexical, lifecycle, lookup, packs, relational, temporal, vector
from .plans import adaptive


@dataclass
class MemoryStore:
    """Tables of a store: observations, edges, scores, vectors; nothing is read before a method is called."""

    spark: SparkSession
    observations: DataFrame
    edges: DataFrame
    scores: DataFrame | None = None
    vectors: DataFrame | None = None
    now: Column = field(default_factory=F.current_timestamp)

    def _live(self, filters: dict) -> DataFrame:
        return relational.matching(relational.live(self.observations), filters)

    def search(self, texts: list[str], limit: int = 10, **filters) -> DataFrame:
        """qid, id, score, position of the best observations for each text."""
        obs = self._live(filters)
        asked = adaptive.queries(self.spark.createDataFrame(list(enumerate(texts)), "qid long, text string"))
        scores = self.scores if self.scores is not None else self.spark.createDataFrame([], "observation_id long, score double")
        return adaptive.keyword_search(lexical.Scanned(obs), lexical.fact_index(obs, scanned=True), obs, self.edges, asked, scores, self.now, relational.clamp_limit(limit))

    def search_vectors(self, queries: DataFrame, limit: int = 10, threshold: float | None = 0.3, **filters) -> DataFrame:
        held = self.vectors.join(self._live(filters).select("id"), "id", "left_semi") if filters else self.vectors
        return vector.exact_topk(held, queries, relational.clamp_limit(limit), threshold=threshold)

    def get(self, ids: list[int]) -> DataFrame:
        return relational.hydrate(self.spark.createDataFrame(list(enumerate(ids)), "position int, id long"), relational.live(self.observations))

    def context(self, **filters) -> DataFrame:
        return relational.list_observations(self.observations, **filters)

    def timeline(self, focus_id: int, before: int = 5, after: int = 5) -> DataFrame:
        return relational.timeline(relational.live(self.observations), focus_id, before, after)

    def related(self, root: int, depth: int = 2) -> DataFrame:
        steps = graph.adjacency(temporal.current(self.edges), "from_id", "to_id")
        return graph.khop(steps, self.spark.createDataFrame([(root,)], "root long"), depth).where("hop > 0")

    def path(self, a: int, b: int, depth: int = 5) -> tuple[str, list]:
        return graph.shortest_path(graph.adjacency(temporal.current(self.edges), "from_id", "to_id"), a, b, depth)

    def as_of(self, at: Column) -> DataFrame:
        return temporal.valid_at(self.edges, at)

    def relate(self, new: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Edges with the valid new ones in place of what they supersede, and those rejected."""
        good, bad = graph.checked_edges(new)
        return temporal.supersede(self.edges, good, self.now), bad

    def save(self, batch: DataFrame) -> DataFrame:
        return lifecycle.save(self.observations, batch)

    def importance(self) -> DataFrame:
        access = self.scores.select("observation_id", "access_count", "last_accessed")
        return lifecycle.importance(relational.live(self.observations), access, self.edges, self.now)

    def consolidate(self, least: int = 3) -> DataFrame:
        return relational.consolidation_groups(self.observations, least)

    def orphans(self) -> DataFrame:
        return relational.orphans(relational.live(self.observations), self.edges)

    def architecture(self, files: DataFrame) -> dict[str, DataFrame]:
        syms = code.symbols(files)
        edges = code.resolve(syms, code.relations(files), code.imports(files))
        return {"symbols": syms, "relations": edges, "hubs": code.hubs(syms, edges), "cohesion": code.package_cohesion(syms, edges), "map": code.repo_map(syms, edges)}

    def search_temporal(self, texts: list[str], at: Column, limit: int = 10, **filters) -> DataFrame:
        """qid, id, rank of the hits for each text, then of their neighbours over facts valid at a time."""
        hits = self.search(texts, limit, **filters).select("qid", "id", "position").persist()  # at most limit rows a query
        near = lexical.temporal_neighbours(hits, self.edges, self._live(filters), at).withColumn("position", F.lit(None).cast("int"))
        return lexical.ranked(hits.unionByName(near), relational.clamp_limit(limit) * 2, F.col("position").asc_nulls_last(), F.asc("id")).select("qid", "id", F.col("position").alias("rank"))

    def adaptive(self, texts: list[str], query_vectors: DataFrame, nodes: DataFrame, links: DataFrame, limit: int = 10, **filters) -> DataFrame:
        asked = adaptive.queries(self.spark.createDataFrame(list(enumerate(texts)), "qid long, text string"))
        return adaptive.adaptive_search(self.search(texts, limit, **filters), self.vectors, query_vectors, self.observations, nodes, links, asked, limit)

    def search_payload(self, payloads: DataFrame, texts: list[str], payload_id: object | None = None, limit: int = 10) -> DataFrame:
        asked = adaptive.queries(self.spark.createDataFrame(list(enumerate(texts)), "qid long, text string"))
        return lookup.payload_search(payloads, asked, payload_id, limit)

    def delete(self, ids: list[int]) -> DataFrame:
        """The observations with these marked as deleted."""
        return lifecycle.soft_delete(self.observations, self.spark.createDataFrame([(i,) for i in ids], "id long"), self.now)

    def restore(self, ids: list[int]) -> DataFrame:
        return lifecycle.restore(self.observations, self.spark.createDataFrame([(i,) for i in ids], "id long"))

    def merge_projects(self, sources: list[str], canonical: str, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The observations with the sources renamed, and what matched."""
        return relational.merge_projects(self.observations, sources, canonical), relational.merge_report(self.observations, sessions, sources, canonical)

    def rules(self, **filters) -> DataFrame:
        return relational.rule_like(self._live(filters))

    def profile(self, **filters) -> DataFrame:
        return packs.profile(self._live(filters), self.scores)

    def context_pack(self, budget_tokens: int = 2000, **filters) -> DataFrame:
        return packs.context_pack(self._live(filters), self.scores, budget_tokens)

    def fact_state(self) -> DataFrame:
        return temporal.state_map(self.edges)

    def evolution(self) -> DataFrame:
        return temporal.evolution(self.edges)

    def snapshot(self, root: int, at: Column) -> DataFrame:
        return temporal.snapshot(self.edges, root, at)

    def revisions(self, snapshots: DataFrame, limit: int = 20) -> DataFrame:
        return temporal.revisions(snapshots, limit)

    def related_scoped(self, root: int, depth: int = 1, **scope) -> DataFrame:
        return temporal.scoped_related(self.edges, self.observations, self.spark.createDataFrame([(root,)], "root long"), depth, **scope)

    def quality(self, metrics: DataFrame, snapshots: DataFrame) -> DataFrame:
        return relational.quality(metrics, self.edges, self.observations, snapshots)

    def system_metrics(self, metrics: DataFrame, low: Column | None = None, high: Column | None = None) -> DataFrame:
        return relational.system_metrics(metrics, low, high)

    def health(self, metrics: DataFrame) -> DataFrame:
        return relational.health(metrics)

    def stats(self, sessions: DataFrame) -> DataFrame:
        return relational.store_counts(self.observations, sessions, self.edges)

    def code(self, files: DataFrame, targets: list[str], hops: int = 3) -> dict[str, DataFrame]:
        """What a change of files or symbols reaches: report, rows, test files; and the cycles across files."""
        syms = code.symbols(files)
        edges = code.resolve(syms, code.relations(files), code.imports(files))
        wanted = self.spark.createDataFrame([(t,) for t in targets], "target string")
        return {"report": code.blast_report(syms, edges, wanted, hops), "impact": code.blast_radius(syms, edges, wanted, hops), "tests": code.impacted_tests(syms, edges, wanted, hops), "cycles": code.cross_file_cycles(syms, edges)}
