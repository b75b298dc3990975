"""JSON values that are of the wanted type or null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_at(c: Column, *paths: str) -> Column:
    """The first path that holds something, as text."""
    return F.coalesce(*[F.get_json_object(c, p) for p in paths])


def long_at(c: Column, *paths: str) -> Column:
    return F.coalesce(*[F.get_json_object(c, p).try_cast("bigint") for p in paths])


def double_at(c: Column, *paths: str) -> Column:
    return F.coalesce(*[F.get_json_object(c, p).try_cast("double") for p in paths])


def millis(c: Column) -> Column:
    """Milliseconds since 1970 as a time without zone; none for zero and less."""
    return F.when(c > 0, F.timestamp_millis(c).cast("timestamp_ntz"))


def instant(c: Column) -> Column:
    """An ISO or SQL date and time, in the session's zone where it names none."""
    return F.try_to_timestamp(c).cast("timestamp_ntz")
