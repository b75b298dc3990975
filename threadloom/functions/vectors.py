"""Vector expressions on ``array<float>`` columns, summed in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """0 where sizes differ or either is null or empty."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.coalesce(F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x)), F.lit(0.0))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def normalize(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def centroids(rows: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """``key, vector``: the normalised mean of each key's vectors that have the size of its first by the smallest
    order of vectors; the mean divides by all of them."""
    sized = rows.select(key, F.col(vector).alias("v"), F.size(vector).alias("n"))
    totals = sized.groupBy(key).agg(F.max("n").alias("dims"), F.count(F.lit(1)).alias("total"))
    cells = sized.select(key, "n", F.posexplode("v").alias("pos", "x")).groupBy(key, "n", "pos").agg(F.sum(F.col("x").cast("double")).alias("s"))
    kept = cells.join(totals, key).where("n = dims")
    means = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", (F.col("s") / F.col("total")).alias("x")))).alias("cells"))
    mean = F.transform("cells", lambda c: c["x"])
    return means.select(key, normalize(mean).alias("vector"))
