"""Vector search in two tiers: sessions by centroid, then passages of the best sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SearchConfig, UsageError
from ..functions.vectors import dot

EMBEDDABLE_FROM = 24


def embeddable(role: Column, text: Column) -> Column:
    """Whether a passage gets a vector; writer, backfill and status share this."""
    return (F.lower(role) != "tool") & (F.length(text) >= EMBEDDABLE_FROM)


def query_vector(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)).cast("float") for x in v])


def scored(rows: DataFrame, v: Column, vector: str = "vector") -> DataFrame:
    """Rows with a positive ``score`` against a unit vector."""
    return rows.withColumn("score", dot(F.col(vector), v)).where("score > 0")


def shortlist(centroids: DataFrame, v: Column, candidates: DataFrame | None = None, config: SearchConfig = SearchConfig()) -> DataFrame:
    """Tier 1: the best sessions among the candidates."""
    rows = centroids if candidates is None else centroids.join(candidates.select("uri"), "uri", "left_semi")
    return scored(rows, v).orderBy(F.desc("score"), "uri").limit(config.session_shortlist)


def passages(chunk_vectors: DataFrame, v: Column, sessions: DataFrame) -> DataFrame:
    """Tier 2: passages of those sessions by score."""
    return scored(chunk_vectors.join(sessions.select("uri"), "uri", "left_semi"), v)


def search(chunk_vectors: DataFrame, centroids: DataFrame, v: Column, candidates: DataFrame | None = None, deep: bool = False, config: SearchConfig = SearchConfig()) -> DataFrame:
    """Passages with ``score``; deep search skips the first tier.

    The shortlist has at most ``session_shortlist`` rows, so it is broadcast.
    """
    if deep:
        rows = chunk_vectors if candidates is None else chunk_vectors.join(candidates.select("uri"), "uri", "left_semi")
        return scored(rows, v)
    return passages(chunk_vectors, v, F.broadcast(shortlist(centroids, v, candidates, config).select("uri")))


def effective_mode(mode: str, embeddings: bool, has_model: bool) -> str:
    """The mode that runs: without embeddings keywords alone; hybrid without a model too; semantic without one: none."""
    if not embeddings:
        return "lexical"
    if mode == "hybrid" and not has_model:
        return "lexical"
    if mode == "semantic" and not has_model:
        return "none"
    return mode


def check_model(stored: str | None, wanted: str | None, force: bool = False) -> bool:
    """Whether an index's vectors must go; raises if they are another model's and nothing forces it."""
    if stored and wanted and stored != wanted:
        if not force:
            raise UsageError(f"the index has vectors of {stored!r}, not of {wanted!r}: rebuild with force")
        return True
    return False
