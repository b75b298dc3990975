"""Counts and sums: usage, coverage, tags, health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .semantic import embeddable

NANOS = 1_000_000_000


def usage_by_model(events: DataFrame) -> DataFrame:
    """Usage events by (session, model)."""
    tokens = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0)) + F.coalesce("reasoning_tokens", F.lit(0))
    return events.groupBy("session_id", "model").agg(F.max("agent_id").alias("agent"), F.sum(tokens).alias("tokens"), F.sum(F.coalesce("total_nano", F.lit(0))).alias("nano"))


def usage_by_session(by_model: DataFrame) -> DataFrame:
    """Models, agent, tokens and cost of each session; none where nothing was used.

    Of models that differ in case only the first is kept, as it is spelled; blank ones are left out.
    """
    named = F.array_sort(F.collect_set(F.when(F.trim("model") != "", F.col("model"))))
    first = lambda names: F.filter(names, lambda m, i: F.array_position(F.transform(names, lambda x: F.lower(x)), F.lower(m)) == i + 1)
    positive = lambda c: F.when(c > 0, c)
    return by_model.groupBy("session_id").agg(
        named.alias("models"), F.min_by("agent", F.when(F.col("agent").isNotNull(), F.col("model"))).alias("agent"),
        positive(F.sum("tokens")).alias("total_tokens"), positive(F.sum("nano") / NANOS).alias("cost"),
    ).withColumn("models", first(F.col("models")))


def usage_by_turn(events: DataFrame) -> DataFrame:
    return events.where("turn_index is not null").groupBy("session_id", "turn_index").agg(F.max("model").alias("model"), F.max("agent_id").alias("agent"))


def coverage(chunks: DataFrame, session_vectors: DataFrame) -> DataFrame:
    """By source: sessions with something to embed, and those that have a vector."""
    can = chunks.where(embeddable(F.col("role"), F.col("text"))).select("source_id", "uri").distinct()
    have = session_vectors.select("uri").distinct().withColumn("has", F.lit(1))
    return can.join(have, "uri", "left").groupBy("source_id").agg(F.count(F.lit(1)).alias("embeddable_sessions"), F.sum(F.coalesce("has", F.lit(0))).cast("bigint").alias("embedded_sessions"))


def tag_counts(tags: DataFrame) -> DataFrame:
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag")


def freshness(live: DataFrame, states: DataFrame) -> DataFrame:
    """By source: live sessions, indexed ones, and how many are new."""
    now = live.groupBy("source_id").agg(F.countDistinct("native_id").alias("live_sessions"))
    return now.join(states.select("source_id", "session_count"), "source_id", "left").select("source_id", "live_sessions", F.coalesce("session_count", F.lit(0)).cast("bigint").alias("indexed_sessions"), F.greatest(F.lit(0), F.col("live_sessions") - F.coalesce("session_count", F.lit(0))).cast("bigint").alias("new_sessions"))


def health(checks: list[DataFrame]) -> DataFrame:
    """``name, ok, detail`` rows of checks, and one for all of them."""
    every = checks[0]
    for c in checks[1:]:
        every = every.unionByName(c)
    whole = every.agg(F.bool_and("ok").alias("ok")).select(F.lit("overall").alias("name"), "ok", F.when(F.col("ok"), "all checks passed").otherwise("some checks failed").alias("detail"))
    return every.unionByName(whole)
