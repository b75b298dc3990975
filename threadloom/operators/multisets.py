"""Set operations on multisets: rows with how often they come, by one exchange.

Both sides become one table of rows and counts, so equal rows meet once, already counted in each task, however often
they come; null equals null.  What an operation wants is then arithmetic on two numbers, and copies are made again last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Copies that one array makes; more are made in levels.
COPIES = 4096


def _free(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def counted(left: DataFrame, right: DataFrame) -> tuple[DataFrame, Column, Column]:
    """The distinct rows of both sides, and how often each comes in the left and in the right one.

    Columns go by position, as in SQL; names and types are the left side's.
    """
    if len(left.columns) != len(right.columns):
        raise ValueError("both sides need as many columns")
    a, b = _free(left, "in_left"), _free(left, "in_right")
    one = left.select("*", F.lit(1).cast("long").alias(a), F.lit(0).cast("long").alias(b))
    two = right.toDF(*left.columns).select("*", F.lit(0).cast("long").alias(a), F.lit(1).cast("long").alias(b))
    rows = one.union(two).groupBy(*[F.col(f"`{c}`") for c in left.columns]).agg(F.sum(a).alias(a), F.sum(b).alias(b))
    return rows, F.col(a), F.col(b)


def repeated(rows: DataFrame, times: Column, columns: list[str]) -> DataFrame:
    """Each row as often as ``times`` says, through levels of short arrays, so that no row holds a long one."""
    n, kept = _free(rows, "times"), [F.col(f"`{c}`") for c in columns]
    out = rows.select(*kept, times.cast("long").alias(n)).where(F.col(n) > 0)
    for size in (COPIES * COPIES, COPIES):
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / size)))
        out = out.select(*kept, n, each.alias(f"{n}_part")).select(*kept, F.least(F.lit(size).cast("long"), F.col(n) - F.col(f"{n}_part") * size).alias(n))
    return out.select(*kept, F.explode(F.array_repeat(F.lit(0), F.col(n).cast("int"))).alias(n)).select(*kept)


def intersect_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each row as often as it comes in both."""
    rows, a, b = counted(left, right)
    return repeated(rows, F.least(a, b), left.columns)


def except_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each row of ``left`` as often as it comes there more than in ``right``."""
    rows, a, b = counted(left, right)
    return repeated(rows, a - b, left.columns)


def union_most(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each row as often as in the side that has it more often: the union of multisets."""
    rows, a, b = counted(left, right)
    return repeated(rows, F.greatest(a, b), left.columns)


def union_distinct(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each row of either side once."""
    return counted(left, right)[0].select(*[F.col(f"`{c}`") for c in left.columns])
