"""What callers may supply: time inference, vector indexes, embedders, feedback sinks and edge providers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame

from .operators import vector

#: A text and a clock to a (low, high) struct, or null.
TimeRangeInferencer = Callable[[Column, Column], Column]
#: Clicks (query, observation_id, rank_position) to a store of the caller's.
FeedbackSink = Callable[[DataFrame], None]
#: Ids (id) to the edges that touch them (from_id, to_id, relation).
GraphEdgeProvider = Callable[[DataFrame], DataFrame]
#: A text column to a vector column, e.g. a pandas UDF around a model.
Embedder = Callable[[Column], Column]


@dataclass(frozen=True)
class Capabilities:
    """What an index supports; filters are pushed down (pre), applied behind a search (post), or not known (none)."""

    index_type: str
    metrics: tuple[str, ...] = ("cosine", "ip")
    filters: str = "pre"
    max_dimensions: int = 0
    batch_upsert: bool = True


class VectorIndex(Protocol):
    def upsert(self, points: DataFrame) -> VectorIndex: ...

    def search(self, queries: DataFrame, limit: int, *, threshold: float | None = None, where: Column | None = None) -> DataFrame: ...

    def delete(self, ids: DataFrame) -> VectorIndex: ...

    def health(self) -> tuple[str, str]: ...

    def capabilities(self) -> Capabilities: ...


@dataclass(frozen=True)
class TableIndex:
    """An exact index over a table (id, embedding and columns to filter by); changes give a new index."""

    points: DataFrame

    def upsert(self, points: DataFrame) -> TableIndex:
        """The index with the points in place of those with their ids."""
        return TableIndex(self.points.join(points.select("id"), "id", "left_anti").unionByName(points, allowMissingColumns=True))

    def search(self, queries: DataFrame, limit: int, *, threshold: float | None = None, where: Column | None = None) -> DataFrame:
        return vector.exact_topk(self.points if where is None else self.points.where(where), queries, limit, threshold=threshold)

    def delete(self, ids: DataFrame) -> TableIndex:
        return TableIndex(self.points.join(ids.select("id"), "id", "left_anti"))

    def health(self) -> tuple[str, str]:
        missing = {"id", "embedding"} - set(self.points.columns)
        return ("unhealthy", f"without {sorted(missing)}") if missing else ("healthy", "")

    def capabilities(self) -> Capabilities:
        return Capabilities("table")


def searched(index: VectorIndex, queries: DataFrame, limit: int, store: DataFrame, *, where: Column | None = None, threshold: float | None = None) -> DataFrame:
    """A search by what an index can do: filters go to one that applies them first, else three times as many hits are
    taken; either way hits that the store (live rows) doesn't hold, or that fail the filter there, go."""
    pre = index.capabilities().filters == "pre"
    hits = index.search(queries, limit * 3, threshold=threshold, where=where if pre else None)
    kept = hits.join((store if where is None else store.where(where)).select("id"), "id", "left_semi")
    return vector.first_of(kept, limit)
