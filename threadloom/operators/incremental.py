"""What a refresh must do: changed, vanished and vectorless sessions; tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tag_name


def changed_since(live: DataFrame, cursor: str | int | None, column: str = "change_cursor") -> DataFrame:
    """Sessions strictly beyond a source's cursor; all without one."""
    return live if cursor is None else live.where(F.col(column) > F.lit(cursor))


def changed(live: DataFrame, indexed: DataFrame, force: bool = False) -> DataFrame:
    """Sessions whose URI and content hash the index lacks."""
    return live if force else live.join(indexed.select("uri", "content_hash"), ["uri", "content_hash"], "left_anti")


def vanished(indexed: DataFrame, live: DataFrame) -> DataFrame:
    """Indexed sessions that no source has any more."""
    return indexed.join(live.select("uri"), "uri", "left_anti")


def without_vectors(sessions: DataFrame, embeddable_chunks: DataFrame, session_vectors: DataFrame) -> DataFrame:
    """Sessions with something to embed and no centroid."""
    return sessions.join(embeddable_chunks.select("uri"), "uri", "left_semi").join(session_vectors.select("uri"), "uri", "left_anti")


def merged_generation(old: DataFrame, new: DataFrame, gone: DataFrame) -> DataFrame:
    """An index table after a refresh: old rows of sessions neither written anew nor gone, and the new rows."""
    touched = new.select("uri").union(gone.select("uri")).distinct()
    return old.join(touched, "uri", "left_anti").unionByName(new, allowMissingColumns=True)


def source_states(sessions: DataFrame, chunks: DataFrame, cursor: Column) -> DataFrame:
    s = sessions.groupBy("source_id").agg(F.count(F.lit(1)).alias("session_count"), F.max(cursor).alias("change_cursor"))
    c = chunks.groupBy("source_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    return s.join(c, "source_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))


def tags_added(tags: DataFrame, wanted: DataFrame) -> DataFrame:
    """New rows of (``uri, tag``) after normalising, those already there left out; the caller appends and counts them."""
    named = wanted.withColumn("tag", tag_name(F.col("tag"))).where("tag <> ''").dropDuplicates(["uri", "tag"])
    have = tags.select(F.col("uri").alias("__u"), F.lower("tag").alias("__t"))
    return named.join(have, (F.col("uri") == F.col("__u")) & (F.col("tag") == F.col("__t")), "left_anti")


def tags_removed(tags: DataFrame, gone: DataFrame) -> DataFrame:
    """The tag table without (``uri, tag``) pairs, whatever their case."""
    out = gone.select(F.col("uri").alias("__u"), F.lower(tag_name(F.col("tag"))).alias("__t"))
    return tags.join(out, (F.col("uri") == F.col("__u")) & (F.lower("tag") == F.col("__t")), "left_anti")


def latest_version(rows: DataFrame, version: str = "version", at: str = "time_updated") -> DataFrame:
    return rows.where(F.col(version).isNotNull()).agg(F.max_by(version, F.struct(at, version)).alias("version"))


def first_of_each(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
