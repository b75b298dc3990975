"""What a source of sessions offers, and columns that stores of other versions lack."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import SessionFilter
from ..functions.paths import SCHEME
from ..operators.filters import filtered, ordered
from ..schema import SESSION

CAPABILITIES = ("resume", "fork", "tool_calls", "patches", "incremental", "native_search", "usage", "file_tracking")


@dataclass(frozen=True)
class Probe:
    """Whether a store is there; a probe never raises."""

    source_id: str
    available: bool
    sessions: int = 0
    version: str | None = None
    detail: str = ""
    capabilities: tuple[str, ...] = field(default=())


class SessionSource(ABC):
    """A store of sessions as DataFrames of ``schema``; filters hold for every source alike."""

    source_id = ""
    capabilities: tuple[str, ...] = ()

    def __init__(self, spark: SparkSession, location: str):
        self.spark, self.location = spark, location

    @abstractmethod
    def sessions(self) -> DataFrame: ...

    @abstractmethod
    def turns(self) -> DataFrame: ...

    def turns_of(self, native_id: str) -> DataFrame:
        """The turns of one session.  Stores that can read one alone do."""
        return self.turns().where(F.col("uri") == f"{SCHEME}://{self.source_id}/{native_id}")

    def files(self) -> DataFrame | None:
        return None

    def references(self) -> DataFrame | None:
        return None

    def tool_turns(self) -> DataFrame | None:
        """Turns that the store keeps apart from what was said; they follow on the session's own."""
        return None

    def tool_turns_of(self, native_id: str) -> DataFrame | None:
        rows = self.tool_turns()
        return None if rows is None else rows.where(F.col("uri") == f"{SCHEME}://{self.source_id}/{native_id}")

    def unreadable(self) -> DataFrame | None:
        """``uri`` of sessions that are there but can't be read."""
        return None

    def version(self) -> str | None:
        return None

    def sessions_for(self, f: SessionFilter) -> DataFrame:
        """Sessions among which are all that a filter admits; stores of many files leave files out that it rules out."""
        return self.sessions()

    def list(self, f: SessionFilter = SessionFilter()) -> DataFrame:
        return ordered(filtered(self.sessions_for(f), f), f.sort, f.limit)

    def available(self) -> bool:
        """Whether the store can be read, by its first session; ``probe`` counts them."""
        try:
            self.sessions().isEmpty()
            return True
        except Exception:  # as a probe, it reports whatever is wrong with the store
            return False

    def change_cursor(self):
        """The newest change there is, to be taken before a listing."""
        return self.sessions().agg(F.max("updated_at").alias("c")).first().c

    def changed_since(self, cursor) -> DataFrame:
        s = self.sessions()
        return s if cursor is None else s.where(F.col("updated_at") > F.lit(cursor))

    def ids(self) -> DataFrame:
        return self.sessions().select("uri", "native_id")

    def probe(self) -> Probe:
        try:
            return Probe(self.source_id, True, self.sessions().count(), self.version(), self.location, self.capabilities)
        except Exception as e:  # a probe reports, whatever is wrong with the store
            return Probe(self.source_id, False, detail=str(e).splitlines()[0][:200], capabilities=self.capabilities)


def backfilled(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """``wanted`` columns by name and type; those the store lacks are null."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(f"`{have[c.lower()]}`").cast(t) if c.lower() in have else F.lit(None).cast(t)).alias(c) for c, t in wanted.items()])


def as_sessions(df: DataFrame) -> DataFrame:
    """``df`` with all columns of a session, in their order and types; the rest is null."""
    return backfilled(df, {f.name: f.dataType.simpleString() for f in SESSION.fields})


def block(**fields):
    """A content block as a struct; fields left out are null."""
    from ..schema import BLOCK

    def of(f: T.StructField):
        v = fields.get(f.name)
        return (F.lit(v) if v is None or isinstance(v, str) else v).cast(f.dataType).alias(f.name)

    return F.struct(*[of(f) for f in BLOCK.fields])
