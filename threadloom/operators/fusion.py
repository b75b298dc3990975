"""Reciprocal rank fusion, boosts, the final order."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SearchConfig
from ..functions.paths import is_under


def session_ranks(passages: DataFrame, bounded: bool = True) -> DataFrame:
    """``uri, rank``: each session's place among distinct sessions by its best passage.

    A session's best passage is found by aggregation.  If the list is ``bounded``, by a cap on passages or by the
    shortlist, one window ranks what is left; else ranks are counted range by range of scores, so that no task sees
    all sessions.
    """
    best = passages.groupBy("uri").agg(F.max("score").alias("score"), F.min_by("ordinal", F.struct(-F.col("score"), "ordinal")).alias("ordinal"))
    order = [F.desc("score"), F.col("uri").asc(), F.col("ordinal").asc()]
    if bounded:
        return best.select("uri", F.row_number().over(Window.orderBy(*order)).alias("rank"))
    n = int(passages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = best.select(F.percentile_approx("score", [i / n for i in range(1, n)], 20 * n).alias("q")).first().q if n > 1 else None
    cuts = sorted(set(cuts or []))
    # Equal scores share a range, and a range counts those above it.
    ranges = F.size(F.filter(F.lit(cuts).cast("array<double>"), lambda c: c > F.col("score"))) if cuts else F.lit(0)
    placed = best.withColumn("range", ranges)
    counts = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    before = counts.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = placed.withColumn("r", F.row_number().over(Window.partitionBy("range").orderBy(*order)))
    return within.join(F.broadcast(before), "range").select("uri", (F.col("r") + F.col("before")).cast("int").alias("rank"))


def fused(lists: dict[str, DataFrame], config: SearchConfig = SearchConfig()) -> DataFrame:
    """``uri, score`` and a contribution for each list (``lexical_score``, ``semantic_score``), with its ranks.

    A union and one aggregation instead of a full outer join.
    """
    k = max(config.rrf_k, 1)
    weights = {"lexical": config.lexical_weight, "semantic": config.semantic_weight}
    parts = None
    for name, ranks in lists.items():
        one = ranks.select("uri", F.lit(name).alias("list"), "rank", (F.lit(weights[name]) / (k + F.col("rank"))).alias("gain"))
        parts = one if parts is None else parts.unionByName(one)
    of = lambda name, c: F.max(F.when(F.col("list") == name, F.col(c)))
    return parts.groupBy("uri").agg(
        of("lexical", "rank").alias("lexical_rank"), of("semantic", "rank").alias("semantic_rank"),
        F.coalesce(of("lexical", "gain"), F.lit(0.0)).alias("lexical_score"), F.coalesce(of("semantic", "gain"), F.lit(0.0)).alias("semantic_score"),
    ).withColumn("score", F.col("lexical_score") + F.col("semantic_score"))


def cut(rows: DataFrame, top: int) -> DataFrame:
    """Twice the wanted sessions before boosts."""
    return rows.orderBy(F.desc("score"), F.asc_nulls_last("lexical_rank"), F.asc_nulls_last("semantic_rank"), "uri").limit(2 * max(top, 1))


def recency(score: Column, updated_at: Column, now: datetime, config: SearchConfig = SearchConfig()) -> Column:
    """The score and a share of it that halves with age."""
    days = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(updated_at.cast("timestamp"))) / F.lit(86_400_000_000.0)
    return score * (1 + config.recency_boost * F.pow(F.lit(0.5), F.greatest(days, F.lit(0.0)) / config.recency_half_life_days))


def boosted(rows: DataFrame, now: datetime, workspace: str | None = None, config: SearchConfig = SearchConfig()) -> DataFrame:
    """``score`` with the boosts for age and for the workspace at hand."""
    score = recency(F.col("score"), F.col("updated_at"), now, config)
    if workspace:
        score = score + F.when(is_under(F.col("workspace_path"), workspace, ignore_case=True), score * config.workspace_boost).otherwise(0.0)
    return rows.withColumn("score", score)


def chosen_passages(lists: dict[str, DataFrame], config: SearchConfig = SearchConfig()) -> DataFrame:
    """``uri, ordinal, place``: up to eight distinct passages of each session, keyword hits first."""
    order = {"lexical": 0, "semantic": 1}
    parts = None
    for name, passages in lists.items():
        one = passages.select("uri", "ordinal", F.lit(order[name]).alias("list"), F.col("score"))
        parts = one if parts is None else parts.unionByName(one)
    best = parts.groupBy("uri", "ordinal").agg(F.min(F.struct("list", (-F.col("score")).alias("s"))).alias("m"))
    w = Window.partitionBy("uri").orderBy("m.list", "m.s", "ordinal")
    return best.withColumn("place", F.row_number().over(w)).where(F.col("place") <= config.chunks_per_session).select("uri", "ordinal", "place")
