"""Joins by time: as-of, points in intervals, overlapping intervals.

Positions are long numbers; timestamps become microseconds.  No join here compares rows of a key all against all: an
as-of join is one sorted pass over both sides, an interval join is an equality of bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a key from which on its time is cut into slices, and into how many.
LONG_KEY, SLICES = 1 << 20, 256


def ticks(df: DataFrame, column: str) -> Column:
    """A column's position as a long: microseconds of times, days of dates, whole numbers as they are."""
    kind = dict(df.dtypes)[column]
    c = F.col(column)
    if kind.startswith("timestamp"):
        return F.unix_micros(c.cast("timestamp"))
    return F.unix_date(c).cast("long") if kind == "date" else c.cast("long")


def _packed(df: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def _sliced(rows: DataFrame, long_key: int, slices: int) -> DataFrame:
    """``rows`` (``key, at, ...``) with ``slice``: 0, or for keys of more than ``long_key`` rows the part of their time by quantiles."""
    long = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > long_key).select("key")
    parts = [i / slices for i in range(1, slices)]
    cuts = rows.join(long, "key", "left_semi").groupBy("key").agg(F.array_distinct(F.percentile_approx("at", parts)).alias("cuts"))
    slice_ = F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("at"))), F.lit(0))
    return rows.join(cuts, "key", "left").withColumn("slice", slice_).drop("cuts")


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, *, strict: bool = False, tie: str | None = None, within: int | None = None, long_key: int = LONG_KEY, slices: int = SLICES) -> DataFrame:
    """Each row of ``left`` with the last row of ``right`` of the same ``by`` at or before its ``at`` (before it if ``strict``).

    The outcome has the structs ``left`` and ``right``, the latter null where there is none.  Of several rows of ``right`` at one
    time, that with the largest ``tie`` counts.  ``within``: the most ticks that may lie between.  Rows of ``left`` with a null
    key or time stay, without a partner; such rows of ``right`` take no part.

    Both sides go through one exchange by key and, sorted, through one running window.  Keys of more than ``long_key``
    rows are cut into ``slices`` by quantiles of their time; what a slice has at its end is carried on to those after it as one row.
    """
    rank = F.lit(0).cast("long") if tie is None else F.col(tie).cast("long")
    kinds = F.lit(None).cast(left.select(_packed(left).alias("x")).schema["x"].dataType), F.lit(None).cast(right.select(_packed(right).alias("x")).schema["x"].dataType)
    a = left.select(F.col(by).alias("key"), ticks(left, at).alias("at"), F.lit(0 if strict else 2).alias("side"), F.lit(0).cast("long").alias("tie"), _packed(left).alias("left"), kinds[1].alias("right"))
    b = right.where(F.col(by).isNotNull() & F.col(at).isNotNull())
    b = b.select(F.col(by).alias("key"), ticks(right, at).alias("at"), F.lit(1).alias("side"), rank.alias("tie"), kinds[0].alias("left"), _packed(right).alias("right"))
    alone = a.where("key is null or at is null")
    rows = _sliced(a.where("key is not null and at is not null").unionByName(b), long_key, slices)

    # What each slice of the right side ends with, carried to the later slices of its key.
    ends = rows.groupBy("key", "slice").agg(F.max(F.when(F.col("right").isNotNull(), F.struct("at", "tie"))).alias("end"), F.max_by("right", F.when(F.col("right").isNotNull(), F.struct("at", "tie"))).alias("right"))
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("carry", F.last(F.when(F.col("end").isNotNull(), F.struct("end", "right")), ignorenulls=True).over(before)).where("slice > 0 and carry is not null")
    carried = carried.select("key", F.col("carry.end.at").alias("at"), F.lit(1).alias("side"), F.col("carry.end.tie").alias("tie"), kinds[0].alias("left"), F.col("carry.right").alias("right"), "slice")

    so_far = Window.partitionBy("key", "slice").orderBy("at", "side", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.last(F.when(F.col("side") == 1, F.struct("at", "right")), ignorenulls=True).over(so_far)
    met = rows.unionByName(carried).select("at", "side", "left", seen.alias("seen")).where("side <> 1")
    near = F.lit(True) if within is None else F.col("at") - F.col("seen.at") <= within
    return met.select("left", F.when(near, F.col("seen.right")).alias("right")).unionByName(alone.select("left", "right"))


def _level(length: Column, width: int) -> Column:
    """The least power of two of bins of ``width`` that a length fits in."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(length, F.lit(1)) / F.lit(float(width))))).cast("int")


def _size(level: Column, width: int) -> Column:
    return F.pow(F.lit(2.0), level).cast("long") * width


def _bins(level: Column, width: int) -> Column:
    """The one or two bins of a level that an interval touches, being no longer than one."""
    size = _size(level, width)
    return F.array_distinct(F.array(F.floor(F.col("a") / size), F.floor(F.col("b") / size)))


def overlaps(left: DataFrame, right: DataFrame, by: str, left_span: tuple[str, str], right_span: tuple[str, str], width: int) -> DataFrame:
    """Pairs (structs ``left`` and ``right``) of the same ``by`` whose closed spans have a point in common.

    A point is a span from itself to itself.  Spans that end before they begin, and null ones, take no part.  Every span
    has the level whose bins it fits in, and so lies in at most two of them: the longer of two is dealt to the bins of its own
    level, the shorter one to those of all levels that the other side has, of which there are at most 64.  A pair counts in the
    bin where the later of the two begins, so it is found once.  ``width`` is the size of the smallest bins; it changes no result.
    Bins are joined by equality, so Spark splits those that hold too many rows.
    """

    def spans(df: DataFrame, span: tuple[str, str], name: str) -> DataFrame:
        rows = df.select(F.col(by).alias("key"), ticks(df, span[0]).alias("a"), ticks(df, span[1]).alias("b"), _packed(df).alias(name))
        return rows.where("key is not null and a <= b").withColumn("level", _level(F.col("b") - F.col("a"), width))

    a, b = spans(left, left_span, "left"), spans(right, right_span, "right")

    def found(homes: DataFrame, guests: DataFrame, home: str, guest: str, shorter: bool) -> DataFrame:
        levels = sorted(r.level for r in homes.select("level").distinct().collect())
        own = homes.select("key", "level", F.explode(_bins(F.col("level"), width)).alias("bin"), "a", "b", home)
        fits = lambda v: (F.col("level") < v) if shorter else (F.col("level") <= v)
        every = F.array(*[F.when(fits(F.lit(v)), F.lit(v)) for v in levels]) if levels else F.array().cast("array<int>")
        dealt = guests.select("key", F.col("a").alias("c"), F.col("b").alias("d"), "a", "b", guest, F.explode(F.array_compact(every)).alias("level"))
        dealt = dealt.select("key", "level", F.explode(_bins(F.col("level"), width)).alias("bin"), "c", "d", guest)
        size = _size(F.col("level"), width)
        later = F.floor(F.greatest("a", "c") / size) == F.col("bin")
        return own.join(dealt, ["key", "level", "bin"]).where((F.col("a") <= F.col("d")) & (F.col("c") <= F.col("b")) & later).select("left", "right")

    return found(a, b, "left", "right", False).unionByName(found(b, a, "right", "left", True))


def containing(points: DataFrame, spans: DataFrame, by: str, at: str, span: tuple[str, str], width: int) -> DataFrame:
    """Pairs (``left``: a point, ``right``: a closed span of the same ``by`` that contains it)."""
    return overlaps(points, spans, by, (at, at), span, width)
