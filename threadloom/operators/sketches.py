"""Mergeable summaries: sets of keys for distinct counts, distributions for quantiles.

A sketch has a bounded size and merges exactly, so parts that were summarised when they were written answer for all without
being read.  Sets are theta sketches, as these can also be subtracted: of a key that a later generation replaced or
dropped, the earlier one's entry goes.  Distributions are KLL sketches; they can't be subtracted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Log2 of the entries of a set: at 12 the error is some 1.6 % at one standard deviation.
LOG_ENTRIES = 12
#: KLL's parameter; ranks are within some 1.3 %.
RANK_K = 200


def keys(column: Column) -> Column:
    """An aggregate: the set of the keys that are not null."""
    return F.theta_sketch_agg(column, LOG_ENTRIES)


def distribution(column: Column) -> Column:
    """An aggregate: the distribution of whole numbers."""
    return F.kll_sketch_agg_bigint(column.cast("bigint"), RANK_K)


def merged_keys(column: Column) -> Column:
    return F.theta_union_agg(column, LOG_ENTRIES)


def merged_distribution(column: Column) -> Column:
    return F.kll_merge_agg_bigint(column, RANK_K)


def estimate(set_: Column) -> Column:
    """How many keys a set has."""
    return F.theta_sketch_estimate(set_)


def quantile(dist: Column, at: float) -> Column:
    return F.kll_sketch_get_quantile_bigint(dist, F.lit(at))


def live(generations: Column, empty: Column) -> Column:
    """The set that is live after ``generations``, an array in order of structs ``has`` and ``gone``: each takes away, then adds."""
    return F.aggregate(generations, empty, lambda s, g: F.theta_union(F.theta_difference(s, g["gone"]), g["has"]))


def summary(chunks: DataFrame, embedded: DataFrame | None, gone: DataFrame | None, embeddable: Column) -> DataFrame:
    """One row for a generation: sets of sessions that have something to embed, a vector, or are gone, and passages' lengths."""
    none = chunks.select(F.lit(None).cast("string").alias("uri")).where("false")
    first = chunks.agg(keys(F.when(embeddable, F.col("uri"))).alias("embeddable"), keys(F.lit(None).cast("string")).alias("nothing"), distribution(F.col("n_tokens")).alias("tokens"))
    second = (embedded if embedded is not None else none).agg(keys(F.col("uri")).alias("embedded"))
    third = (gone if gone is not None else none).agg(keys(F.col("uri")).alias("gone"))
    return first.crossJoin(second).crossJoin(third)  # one row each
